"""Graph indexes, maps in two dimensions and range readers against plain numpy and whole files."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import block_join, graph_index, projection, vector_index
from cliploom.sources import ranges, tensors

ROWS = "row_id long, clip_id string, vec array<double>"


def test_graph_finds_near_rows():
    """One graph: nine tenths of the ten nearest, while a small part of all rows is compared; equal rows and few rows work."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:130] = x[5]
    layers = graph_index.graph(x)
    assert len(layers) > 2 and max(map(len, layers[0])) <= 2 * graph_index.LINKS and max(map(len, layers[1])) <= graph_index.LINKS
    hits = []
    for q in x[::40]:
        want = np.sort(x @ q)[-10:]
        hits.append(np.mean([float(x[n] @ q) >= want[0] - 1e-12 for n in graph_index.walk(x, layers, q, 64)[:10]]))
    assert np.mean(hits) >= 0.95
    for n in (0, 1, 2):
        assert graph_index.walk(x[:n], graph_index.graph(x[:n]), x[0], 5) == list(range(n))[:n] or n == 2


def test_stored_graphs(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, f"c{i % 700}", v.tolist()) for i, v in enumerate(x)] + [(9999, "c1", None)]
    v = spark.createDataFrame(rows, ROWS)
    graph_index.build(v, str(tmp_path / "graphs"), 300)
    index = graph_index.Index(spark, str(tmp_path / "graphs"))
    assert index.rows.select("shard").distinct().count() == 3 and index.rows.count() == 900
    q = v.filter("row_id % 50 = 0").select(F.col("row_id").cast("string").alias("query_id"), "vec")
    found = index.search(q, 10).cache()
    exact = block_join.similarities(v, q, 10)
    assert vector_index.recalls(exact, found).agg(F.avg("recall")).first()[0] >= 0.95
    score = {(r.query_id, r.clip_id): r.score for r in exact.collect()}
    assert all(abs(score.get((r.query_id, r.clip_id), r.score) - r.score) < 1e-9 for r in found.collect())


def islands(n, dims=20, groups=12, seed=2):
    """Groups on axes of their own, so that two straight axes can't tell them apart."""
    rng = np.random.default_rng(seed)
    return np.eye(dims)[rng.integers(0, groups, n)] * 5 + rng.normal(0, 0.4, (n, dims))


def test_curve_and_memberships():
    a, b = projection.curve()
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01
    far = np.sort(np.random.default_rng(0).random((50, 15)) * 7, axis=1)
    w = projection.memberships(far)
    assert np.allclose(w.sum(1), np.log2(15), atol=1e-6) and np.allclose(w[:, 0], 1) and (np.diff(w, axis=1) <= 0).all()
    x = islands(60)
    i, j, w = projection.fuzzy_graph(x, 5)
    m = np.zeros((60, 60))
    m[i, j] = w
    assert np.allclose(m, m.T) and ((m >= 0) & (m <= 1)).all() and not m.diagonal().any()


def test_map_is_more_trustworthy_than_two_components(spark):
    x = islands(500)
    y = projection.layout(x, epochs=100)
    assert projection.trustworthiness(x, y) > projection.trustworthiness(x, projection.components_2d(x)) + 0.1
    assert projection.trustworthiness(x, x[:, :2] * 0 + np.arange(500)[:, None]) < 0.6 and abs(projection.trustworthiness(x, x) - 1) < 1e-12
    more = islands(1500, seed=3)
    v = spark.createDataFrame([(i, f"c{i}", r.tolist()) for i, r in enumerate(np.concatenate([x, more]))] + [(9999, "c", None)], ROWS)
    of = lambda d: {r.row_id: (round(r.x, 6), round(r.y, 6)) for r in projection.project(d, 400, epochs=100).collect()}
    got = of(v)
    assert len(got) == 2000 and got == of(v.repartition(3))
    some = np.random.default_rng(0).permutation(2000)[:500]
    assert projection.trustworthiness(np.concatenate([x, more])[some], np.array([got[i] for i in some])) > 0.9
    for few in (1, 2, 3):
        assert projection.layout(x[:few]).shape == (few, 2)


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.read_bytes += len(data)
        return data


def archive(n):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for k in range(n):
            info = tarfile.TarInfo(f"d/m{k}.bin")
            info.size = len(data := bytes([k % 251]) * (1000 + k))
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_by_ranges(spark, tmp_path):
    """One tar is read by several tasks, members that nobody wants aren't read, zip members come stored or inflated."""
    (tmp_path / "a b.tar").write_bytes(archive(60))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("stored.txt", b"s" * 99)
        z.writestr("small.txt", b"t" * 9999, zipfile.ZIP_DEFLATED)
    index = ranges.members(ranges.listed(spark, str(tmp_path), "*.{tar,zip}")).cache()
    assert index.count() == 62 and index.filter("offset is null").count() == 1
    got = ranges.contents(index, task_bytes=8000).withColumn("task", F.spark_partition_id()).collect()
    want = {f"d/m{k}.bin": bytes([k % 251]) * (1000 + k) for k in range(60)} | {"stored.txt": b"s" * 99, "small.txt": b"t" * 9999}
    assert {r.member: bytes(r.content) for r in got} == want and len({r.task for r in got if r.archive.endswith("tar")}) > 3
    one = Counted(archive(60))
    row = index.filter("member = 'd/m7.bin'").first()
    assert list(ranges.ranges([(row.archive, row.offset, row.length, row.member)], lambda p: one)) == [want["d/m7.bin"]] and one.read_bytes == 1007
    with pytest.raises(EOFError):
        list(ranges.ranges([("x", 10, 100, "m")], lambda p: io.BytesIO(b"short")))


def test_tensors_by_ranges(spark, tmp_path):
    arrays = {f"k{i}": np.arange(i + 1, dtype="f4") for i in range(20)} | {"flags": np.array([[True, False]])}
    spark.createDataFrame([("one.safetensors", bytearray(tensors.pack_tensors(arrays)))], "path string, content binary")
    ranges.store(spark.createDataFrame([("sub/one.safetensors", bytearray(tensors.pack_tensors(arrays)))], "path string, content binary"), f"file:{tmp_path}")
    entries = ranges.tensor_entries(ranges.listed(spark, str(tmp_path), "*.safetensors"))
    got = {r.key: (r.position, list(r.shape), list(r.values)) for r in ranges.tensor_values(entries, task_bytes=50).collect()}
    whole = {r.key: (r.position, list(r.shape), list(r.values)) for r in tensors.keyed_tensors(tensors.files(spark, str(tmp_path), "*.safetensors")).collect()}
    assert got == whole and len(got) == 21
    some = ranges.tensor_values(entries.filter("key in ('k3', 'flags')")).collect()
    assert {r.key: list(r.values) for r in some} == {"k3": [0, 1, 2, 3], "flags": [1, 0]}
    file = Counted(tensors.pack_tensors(arrays))
    e = entries.filter("key = 'k3'").first()
    assert np.frombuffer(next(ranges.ranges([(e.path, e.offset, e.length, e.key)], lambda p: file)), "f4").tolist() == [0, 1, 2, 3] and file.read_bytes == 16
