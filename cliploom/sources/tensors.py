"""Array files as tables: keyed tensors (safetensors layout), metric matrices with index maps, and prediction archives.

Each function takes files as (path, content) rows, as Spark's binaryFile source reads them from any file system, one
file at a time; rows leave in batches of bounded size. Pickled objects are never loaded.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types of the layout (fixed values).
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
ROWS = 1000


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, content of the files below a folder whose names match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def pack_tensors(tensors: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one file: the header's length, the header, the arrays one after another."""
    name = {v: k for k, v in TYPES.items()}
    header, at, parts = {}, 0, []
    for key, a in tensors.items():
        code = a.dtype.str.replace("|", "").replace("b1", "?")
        data = np.ascontiguousarray(a).tobytes()
        header[key] = {"dtype": name[code], "shape": list(a.shape), "data_offsets": [at, at + len(data)]}
        at += len(data)
        parts.append(data)
    head = json.dumps(header).encode()
    return struct.pack("<Q", len(head)) + head + b"".join(parts)


def tensor_header(content: bytes) -> tuple[dict, int]:
    """The header without metadata, and where the arrays begin."""
    (n,) = struct.unpack_from("<Q", content)
    return {k: v for k, v in json.loads(content[8 : 8 + n]).items() if k != "__metadata__"}, 8 + n


def keyed_tensors(content: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """(path, content) -> path, position (order in the file), key, shape, values (float64); only the wanted keys are decoded."""
    wanted = None if keys is None else set(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                header, begin = tensor_header(data)
                order = sorted(header, key=lambda k, h=header: h[k]["data_offsets"])
                for position, key in enumerate(order):
                    if wanted is None or key in wanted:
                        kind, (a, z) = np.dtype(TYPES[header[key]["dtype"]]), header[key]["data_offsets"]
                        values = np.frombuffer(data, kind, (z - a) // kind.itemsize, begin + a).astype(float)
                        out.append((path, position, key, header[key]["shape"], values))
                        if len(out) >= ROWS:
                            yield batch(out)
                            out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        p, n, k, s, v = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.string()), pa.array(n, pa.int32()), pa.array(k, pa.string()), pa.array(s, pa.list_(pa.int64())), pa.array(v, pa.list_(pa.float64()))],
            ["path", "position", "key", "shape", "values"],
        )

    return content.select("path", "content").mapInArrow(run, "path string, position int, key string, shape array<bigint>, values array<double>")


def metric_matrices(content: DataFrame) -> DataFrame:
    """Files ``<model>_metrics.npz`` (arrays values, clip_ids, names; clips x metrics) -> model, clip_id, metric, value; NaN cells left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.load(io.BytesIO(data), allow_pickle=False)
                model = path.rpartition("/")[2].removesuffix(".npz").removesuffix("_metrics")
                clips, names, values = z["clip_ids"].astype(str), z["names"].astype(str), z["values"].astype(float)
                for at in range(0, len(clips), ROWS):
                    part = values[at : at + ROWS]
                    i, j = np.nonzero(~np.isnan(part))
                    yield pa.RecordBatch.from_arrays([pa.array([model] * len(i)), pa.array(clips[at + i].tolist(), pa.string()), pa.array(names[j].tolist(), pa.string()), pa.array(part[i, j])], ["model", "clip_id", "metric", "value"])

    return content.select("path", "content").mapInArrow(run, "model string, clip_id string, metric string, value double")


def predictions(content: DataFrame) -> DataFrame:
    """Files ``<model>/<clip_id>.npz`` (pred: windows x samples x points x 2 or more, gt: windows x points x 2 or more) -> clip_id, model,
    kind (pred or gt), window, sample (0 for gt), xy: x and y of the points, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.load(io.BytesIO(data), allow_pickle=False)
                model, name = path.split("/")[-2:]
                rows = []
                for kind in ("pred", "gt"):
                    if kind in z:
                        a = z[kind] if kind == "pred" else z[kind][:, None]
                        rows += [(name.removesuffix(".npz"), model, kind, w, s, a[w, s, :, :2].astype(float).ravel()) for w in range(a.shape[0]) for s in range(a.shape[1])]
                if rows:
                    c, m, k, w, s, xy = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(m), pa.array(k), pa.array(w, pa.int32()), pa.array(s, pa.int32()), pa.array(xy, pa.list_(pa.float64()))], ["clip_id", "model", "kind", "window", "sample", "xy"])

    return content.select("path", "content").mapInArrow(run, "clip_id string, model string, kind string, window int, sample int, xy array<double>")


def view_rows(content: DataFrame) -> DataFrame:
    """Files with arrays embeddings and clip_ids, several views a clip -> path, position, clip_id, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.load(io.BytesIO(data), allow_pickle=False)
                ids, vec = z["clip_ids"].astype(str), z["embeddings"].astype(np.float32)
                for at in range(0, len(ids), ROWS):
                    n = len(ids[at : at + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(at, at + n), pa.int32()), pa.array(ids[at : at + n].tolist(), pa.string()), pa.array(list(vec[at : at + n]), pa.list_(pa.float32()))], ["path", "position", "clip_id", "vec"])

    return content.select("path", "content").mapInArrow(run, "path string, position int, clip_id string, vec array<float>")


def pose_tables(members: DataFrame) -> DataFrame:
    """Archive members (clip_id, member, content) ``*.poses`` (n 4 x 4 float64 matrices) and ``*.stamps`` (n int64) of a clip ->
    clip_id, timestamp_us, pose: 16 numbers by row."""
    part = lambda end, name: F.max(F.when(F.endswith(F.col("member"), F.lit(end)), F.col("content"))).alias(name)
    both = members.groupBy("clip_id").agg(part(".poses", "poses"), part(".stamps", "stamps")).filter("poses is not null and stamps is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one clip at a time, and its arrays are read where the batch has them
                clip = b.column(0)[i].as_py()
                p, t = np.frombuffer(b.column(1)[i].as_buffer(), "<f8").reshape(-1, 16), np.frombuffer(b.column(2)[i].as_buffer(), "<i8")
                if len(p) != len(t):
                    raise ValueError(f"{clip}: {len(p)} poses and {len(t)} timestamps")
                for at in range(0, len(t), ROWS):
                    n = len(t[at : at + ROWS])
                    pose = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.array(p[at : at + ROWS].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([clip] * n, pa.string()), pa.array(t[at : at + ROWS]), pose], ["clip_id", "timestamp_us", "pose"])

    return both.select("clip_id", "poses", "stamps").mapInArrow(run, "clip_id string, timestamp_us bigint, pose array<double>")
