"""A stored vector index: inverted cells that hold rotated residuals as product codes.

The first pass fits a model on a bounded sample: centroids of cells, and for the differences of vectors from
their centroids a rotation and a code book for each part of the rotated elements. The rotation is learned: books are
fitted to rotated residuals, then the rotation that brings residuals nearest to their decoded form is found
(orthogonal Procrustes), and so on in turn. The second pass codes every row and writes it to the folder of its cell,
shard by shard; a build that was stopped goes on with the shards that aren't there. New rows are appended as a shard of
their own, coded by the same model.

A search probes the nearest cells of each query and reads their folders only: first the codes, for the best
``k * refine`` rows, then those rows' vectors, for their scores. With all cells probed and ``refine`` at the size of
the table it is exact. Clips of several rows have the score of the best.

Rows whose vector is null aren't indexed; an empty table of vectors can't be fitted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .block_join import best, matrix, pooled_rows
from .compressed import SAMPLE, centroids_of, lloyd, nearest, sample_matrix

#: Rows of a cell that are searched in one group, on average; larger cells are split.
SLICE_ROWS = 65_536
#: Rounds of fitting books and rotation in turn.
ROTATIONS = 12


@dataclass(frozen=True)
class Model:
    """Centroids of the cells (a row each), the rotation, and a book of codes for each part."""

    centroids: np.ndarray
    rotation: np.ndarray
    books: tuple[np.ndarray, ...]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([b.shape[1] for b in self.books])[:-1], axis=1)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row of x, and its codes, a byte a part."""
        cell = nearest(x, self.centroids)
        y = (x - self.centroids[cell]) @ self.rotation
        return cell, np.stack([nearest(p, b) for p, b in zip(self.parts(y), self.books, strict=True)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        y = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return self.centroids[cell] + y @ self.rotation.T


def _decoded(y: np.ndarray, books: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    return np.concatenate([b[nearest(p, b)] for p, b in zip(np.split(y, cuts, axis=1), books, strict=True)], axis=1)


def fit_books(residuals: np.ndarray, parts: int, codes: int, rotations: int, rounds: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation and a book for each part; without ``rotations`` the elements stay as they are."""
    width = residuals.shape[1]
    rotation = np.eye(width)
    cuts = np.cumsum([len(p) for p in np.array_split(np.arange(width), min(parts, width))])[:-1]
    books = [centroids_of(p, codes, rounds, seed + j) for j, p in enumerate(np.split(residuals, cuts, axis=1))]
    for _ in range(rotations):
        u, _, v = np.linalg.svd(residuals.T @ _decoded(residuals @ rotation, books, cuts))
        rotation = u @ v
        books = [lloyd(p, b, 2) for p, b in zip(np.split(residuals @ rotation, cuts, axis=1), books, strict=True)]
    return rotation, books


def fit(vectors: DataFrame, cells: int, parts: int, codes: int = 256, rotations: int = ROTATIONS, sample: int = SAMPLE, rounds: int = 12, seed: int = 0) -> Model:
    """The model of (row_id, vec), from a sample of so many rows at most."""
    if not 1 <= codes <= 256:
        raise ValueError("a code is a byte")
    x = sample_matrix(vectors, sample, seed)
    centroids = centroids_of(x, cells, rounds, seed)
    rotation, books = fit_books(x - centroids[nearest(x, centroids)], parts, codes, rotations, rounds, seed + 1)
    return Model(centroids, rotation, tuple(books))


def _save(spark: SparkSession, model: Model, path: str) -> None:
    arrays = {"centroids": model.centroids, "rotation": model.rotation} | {f"book{j:05d}": b for j, b in enumerate(model.books)}
    rows = [(n, list(a.shape), bytearray(np.ascontiguousarray(a, "<f8").tobytes())) for n, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").write.parquet(f"{path}/model")


def _load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("name").collect()  # the model's arrays
    arrays = {r.name: np.frombuffer(r.data, "<f8").reshape(r.shape) for r in rows}
    return Model(arrays["centroids"], arrays["rotation"], tuple(a for n, a in sorted(arrays.items()) if n.startswith("book")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_ROWS = "row_id long, clip_id string, vec array<float>, cell int, codes binary"


def coded(vectors: DataFrame, model: Model) -> DataFrame:
    """(row_id, clip_id, vec) -> the rows of the index."""
    schema = pa.schema([("row_id", pa.int64()), ("clip_id", pa.string()), ("vec", pa.list_(pa.float32())), ("cell", pa.int32()), ("codes", pa.binary())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                cell, codes = model.code(matrix(t.column("vec")))
                own = [t.column(c).combine_chunks() for c in ("row_id", "clip_id", "vec")]
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, pa.array(cell.astype(np.int32)), packed], schema=schema)

    return vectors.filter("vec is not null").select(F.col("row_id").cast("long"), F.col("clip_id").cast("string"), F.col("vec").cast("array<float>")).mapInArrow(run, _ROWS)


def _write_shard(vectors: DataFrame, model: Model, path: str, shard: int) -> None:
    rows = coded(vectors, model)
    # by ranges of cell and row, so that a large cell is written by several tasks and small ones by one
    rows.repartitionByRange("cell", F.xxhash64("row_id")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows/shard={shard}")


def build(vectors: DataFrame, path: str, cells: int = 64, parts: int = 8, shards: int = 1, **fitting) -> Index:
    """Fit, code and write the index of (row_id, clip_id, vec). An index that is there in part is completed, with its own model."""
    spark = vectors.sparkSession
    if not _exists(spark, f"{path}/model/_SUCCESS"):
        _save(spark, fit(vectors, cells, parts, **fitting), path)
    model = _load(spark, path)
    for s in range(shards):
        if not _exists(spark, f"{path}/rows/shard={s}/_SUCCESS"):
            _write_shard(vectors if shards == 1 else vectors.filter(F.pmod(F.xxhash64("row_id"), F.lit(shards)) == s), model, path, s)
    return Index(spark, path)


@dataclass
class Index:
    """A stored index, opened."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.model = _load(self.spark, self.path)
        self.rows = self.spark.read.schema(f"{_ROWS}, shard int").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")

    @cached_property
    def sizes(self) -> dict[int, int]:
        """Rows of each cell, as many numbers as the model has cells."""
        return {r.cell: r.n for r in self.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def append(self, vectors: DataFrame) -> Index:
        """Add the rows whose row_id isn't in the index, as a new shard."""
        new = vectors.join(self.rows.select("row_id"), "row_id", "left_anti")
        last = self.rows.agg(F.max("shard")).first()[0]
        _write_shard(new, self.model, self.path, 0 if last is None else last + 1)
        return Index(self.spark, self.path)

    def probes(self, queries: DataFrame, n_probe: int) -> DataFrame:
        """(query_id, vec) -> query_id, vec, cell: the cells of the nearest centroids, by squared distance."""
        centroids = self.model.centroids
        schema = pa.schema([("query_id", pa.string()), ("vec", pa.list_(pa.float64())), ("cell", pa.int32())])

        def run(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                q = matrix(t.column("vec"))
                if len(q):
                    d = (centroids**2).sum(1) / 2 - q @ centroids.T
                    near = np.argsort(d, axis=1, kind="stable")[:, :n_probe]
                    at = np.repeat(np.arange(len(q)), near.shape[1])
                    yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(pa.array(at)) for c in ("query_id", "vec")] + [pa.array(near.ravel().astype(np.int32))], schema=schema)

        asked = queries.filter("vec is not null").select(F.col("query_id").cast("string"), F.col("vec").cast("array<double>"))
        return asked.mapInArrow(run, "query_id string, vec array<double>, cell int")

    def search(self, queries: DataFrame, k: int, n_probe: int = 8, refine: int = 8, pool: DataFrame | None = None) -> DataFrame:
        """(query_id, vec) -> query_id, clip_id, score, rank: the best clips among the rows of the probed cells.

        Only clips of ``pool`` are searched, if it is given. Codes choose ``k * refine`` rows of each slice of a cell, which are
        judged by their vectors where they are: a row's vector is sent once, and of a slice only each query's best k clips go on.
        """
        probes = self.probes(queries, n_probe)
        cells = [r.cell for r in probes.select("cell").distinct().collect()]  # at most all cells
        rows = self.rows.filter(F.col("cell").isin(cells) & F.col("clip_id").isNotNull())
        if pool is not None:
            rows = rows.join(pool.select("clip_id"), "clip_id", "left_semi")
        slices = {c: -(-n // SLICE_ROWS) for c, n in self.sizes.items() if n > SLICE_ROWS and c in set(cells)}
        n_slices = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in slices.items() for x in p]), F.col("cell")), F.lit(1)) if slices else F.lit(1)
        left = rows.select("row_id", "clip_id", "vec", "cell", "codes").withColumn("slice", F.pmod(F.xxhash64("row_id"), n_slices.cast("long")))
        right = probes.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), (n_slices - 1).cast("long"))))
        model, most = self.model, k * refine
        schema = pa.schema([("query_id", pa.string()), ("clip_id", pa.string()), ("score", pa.float64())])

        def judge(of: pa.Table, asked: pa.Table) -> pa.Table:
            if not of.num_rows or not asked.num_rows:
                return schema.empty_table()
            clips, clip = np.unique(np.array(of.column("clip_id").to_pylist(), object).astype(str), return_inverse=True)
            by_clip = np.argsort(clip, kind="stable")  # a clip's rows together
            of, clip = of.take(pa.array(by_clip)), clip[by_clip]
            ids, x, cell = of.column("row_id").to_numpy(), matrix(of.column("vec")), of.column("cell")[0].as_py()
            codes = np.frombuffer(b"".join(of.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            q = matrix(asked.column("vec"))
            base, turned = q @ model.centroids[cell], model.parts(q @ model.rotation)
            products = [p @ b.T for p, b in zip(turned, model.books, strict=True)]
            out: list = [[], [], []]
            for i, name in enumerate(asked.column("query_id").to_pylist()):
                at = np.arange(len(ids))
                if most < len(ids):  # else codes leave nothing out
                    at = np.sort(best(base[i] + sum(p[i][codes[:, j]] for j, p in enumerate(products)), ids, most))
                mine = clip[at]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                rows_of = x if len(at) == len(x) else x[at]
                places, scores = pooled_rows(rows_of @ q[i], first, rows_of, q[i], k)
                kept = clips[mine[first[places]]]
                order = best(scores, kept, k)
                out[0] += [name] * len(order)
                out[1] += kept[order].tolist()
                out[2].append(scores[order])
            return pa.Table.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(np.concatenate(out[2]))], schema=schema)

        near = left.groupBy("cell", "slice").cogroup(right.groupBy("cell", "slice")).applyInArrow(judge, "query_id string, clip_id string, score double")
        near = near.groupBy("query_id", "clip_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "clip_id")
        return near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def recalls(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, clip_id) of two searches -> query_id, recall: the share of the exact clips that was found."""
    hit = found.select("query_id", "clip_id", F.lit(1).alias("hit"))
    return exact.select("query_id", "clip_id").join(hit, ["query_id", "clip_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
