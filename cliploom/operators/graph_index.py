"""A stored index of navigable graphs, one for each shard of the rows.

A row enters the graph of its shard on a random number of layers, each a few times sparser than the one below. On its way
down it is linked to near rows that aren't nearer to one another, ``LINKS`` of them a layer (twice as many on the lowest),
and full rows give up links by the same rule. A search walks greedily down to the lowest layer and
spreads there with ``width`` candidates. Shards are dealt by a hash of the row, so that each is a sample of all rows;
every query asks every shard, and their lists are merged. Graphs are built and searched by executors; none comes to the driver.

Vectors count by their direction (stored ones have unit length); scores are inner products. Rows without a vector aren't
indexed; a clip of several rows has the score of its best found row.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .block_join import matrix

SHARD_ROWS = 4096
LINKS = 12
#: Candidates while a row is linked, and while a query is searched.
BUILD_WIDTH = 80
WIDTH = 96


def spread(x: np.ndarray, links: list[list[int]], q: np.ndarray, entries: list[int], width: int) -> list[tuple[float, int]]:
    """The nearest rows (similarity, row) that a walk with ``width`` candidates finds, best first."""
    near = [(float(x[e] @ q), e) for e in entries]
    todo, seen = [(-s, e) for s, e in near], set(entries)
    heapq.heapify(near)
    heapq.heapify(todo)
    while todo:
        s, at = heapq.heappop(todo)
        if len(near) >= width and -s < near[0][0]:
            break
        new = [n for n in links[at] if n not in seen]
        if not new:
            continue
        seen.update(new)
        for s, n in zip((x[new] @ q).tolist(), new, strict=True):
            if len(near) < width or s > near[0][0]:
                heapq.heappush(todo, (-s, n))
                (heapq.heappush if len(near) < width else heapq.heapreplace)(near, (s, n))
    return sorted(near, key=lambda p: (-p[0], p[1]))


def apart(x: np.ndarray, found: list[tuple[float, int]], most: int) -> list[int]:
    """Of the found rows, best first, those that are nearer to the asked one than to any chosen before, filled up with the best of the rest."""
    chosen: list[int] = []
    rest: list[int] = []
    for s, n in found:
        if len(chosen) == most:
            break
        (rest if chosen and float((x[chosen] @ x[n]).max()) > s else chosen).append(n)
    return (chosen + rest)[:most]


def graph(x: np.ndarray, seed: int = 0) -> list[list[list[int]]]:
    """links[layer][row] of unit vectors, lowest layer first; the top layer's first linked row is where walks begin."""
    n = len(x)
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
    if n:
        height[0] = height.max()  # the first row is on all layers, and every walk begins with it
    layers: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(int(height.max(initial=0)) + 1)]
    for i in range(1, n):
        entries = [0]
        for layer in range(len(layers) - 1, -1, -1):
            links = layers[layer]
            if layer > height[i]:
                entries = [spread(x, links, x[i], entries, 1)[0][1]]
                continue
            found = spread(x, links, x[i], entries, BUILD_WIDTH)
            most = LINKS if layer else 2 * LINKS
            links[i] = apart(x, found, LINKS)
            for j in links[i]:
                links[j].append(i)
                if len(links[j]) > most:
                    s = x[links[j]] @ x[j]
                    links[j] = apart(x, [(float(s[k]), links[j][k]) for k in np.argsort(-s, kind="stable")], most)
            entries = [j for _, j in found]
    return layers


def walk(x: np.ndarray, layers: list[list[list[int]]], q: np.ndarray, width: int) -> list[int]:
    """The rows that a search finds, best first."""
    entries = [0] if len(x) else []
    for links in layers[:0:-1]:
        entries = [spread(x, links, q, entries, 1)[0][1]] if entries else []
    return [n for _, n in spread(x, layers[0], q, entries, width)] if entries else []


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


_ROWS = "shard long, node int, row_id long, clip_id string, vec array<double>, links array<array<int>>"


def build(vectors: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> Index:
    """Build and store the graphs of (row_id, clip_id, vec)."""
    v = vectors.filter("vec is not null").select(F.col("row_id").cast("long"), F.col("clip_id").cast("string"), F.col("vec").cast("array<double>"))
    shards = max(1, -(-v.count() // shard_rows))
    schema = pa.schema([("shard", pa.int64()), ("node", pa.int32()), ("row_id", pa.int64()), ("clip_id", pa.string()), ("vec", pa.list_(pa.float64())), ("links", pa.list_(pa.list_(pa.int32())))])

    def linked(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_id")
        layers = graph(_unit(matrix(rows.column("vec"))))
        links = [[layer[i] for layer in layers] for i in range(rows.num_rows)]
        own = [rows.column(c).combine_chunks() for c in ("row_id", "clip_id", "vec")]
        return pa.Table.from_arrays([rows.column("shard").combine_chunks(), pa.array(np.arange(rows.num_rows, dtype=np.int32)), *own, pa.array(links, schema.field("links").type)], schema=schema)

    dealt = v.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards).cast("long")))
    dealt.groupBy("shard").applyInArrow(linked, _ROWS).write.parquet(path)
    return Index(vectors.sparkSession, path)


@dataclass
class Index:
    """Stored graphs, opened."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.rows = self.spark.read.schema(_ROWS).parquet(self.path)

    def search(self, queries: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
        """(query_id, vec) -> query_id, clip_id, score, rank: the best clips that walks through all graphs find."""
        schema = pa.schema([("query_id", pa.string()), ("clip_id", pa.string()), ("score", pa.float64())])

        def walked(rows: pa.Table, asked: pa.Table) -> pa.Table:
            if not rows.num_rows or not asked.num_rows:
                return schema.empty_table()
            rows = rows.sort_by("node")
            x = matrix(rows.column("vec"))
            unit, q = _unit(x), matrix(asked.column("vec"))
            layers = [list(layer) for layer in zip(*rows.column("links").to_pylist(), strict=True)]
            clips, out = rows.column("clip_id").to_pylist(), []
            for name, query, turned in zip(asked.column("query_id").to_pylist(), q, _unit(q), strict=True):
                best: dict[str, float] = {}
                for n in walk(unit, layers, turned, max(width, k)):
                    s = float((x[n] * query).sum())
                    best[clips[n]] = max(s, best.get(clips[n], s))
                out += [(name, c, s) for c, s in sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        asked = queries.filter("vec is not null").select(F.col("query_id").cast("string"), F.col("vec").cast("array<double>"))
        last = self.rows.agg(F.max("shard")).first()[0] or 0
        copies = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
        found = self.rows.groupBy("shard").cogroup(copies.groupBy("shard")).applyInArrow(walked, "query_id string, clip_id string, score double")
        best = found.groupBy("query_id", "clip_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "clip_id")
        return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
