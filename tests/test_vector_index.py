"""Block joins and the stored vector index against plain numpy; the lasting text index; run installs."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import block_join, compressed, text, vector_index, vector_search
from cliploom.plans.client import Client
from cliploom.plans.engine import Catalog, Engine
from cliploom.sources import writers

ROWS = "row_id long, clip_id string, vec array<double>"


def correlated(n, dims=16, groups=12, seed=0):
    """Vectors near a few centres, their elements correlated with one another."""
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(4, dims))
    x = rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] * 2 + rng.normal(size=(n, 4)) @ mix + rng.normal(size=(n, dims)) * 0.1
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, clips=None):
    return spark.createDataFrame([(i, f"c{i if clips is None else i % clips}", v.tolist()) for i, v in enumerate(x)], ROWS)


def best_clips(x, names, q, k):
    top = {}
    for n, s in zip(names, (x * q).sum(1), strict=True):
        top[n] = max(s, top.get(n, -np.inf))
    return sorted(top.items(), key=lambda p: (-p[1], p[0]))[:k]


@pytest.mark.parametrize("k", [None, 5])
def test_block_join(spark, monkeypatch, k):
    """Many blocks, clips over several blocks, equal rows that tie, a query's own rows left out, rows without a vector."""
    monkeypatch.setattr(block_join, "ROWS", 40)
    monkeypatch.setattr(block_join, "QUERIES", 6)
    x = correlated(200)
    x[50:60] = x[7]
    v = table(spark, x, 90).unionByName(spark.createDataFrame([(900, "c1", None), (901, None, x[0].tolist())], ROWS))
    q = v.filter("row_id < 20").select(F.concat(F.lit("c"), "row_id").alias("query_id"), "vec")
    got = block_join.similarities(v, q, k, "clip_id")
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query_id, {})[r.clip_id] = r.score
    names = [f"c{i % 90}" for i in range(200)]
    for i in range(20):
        others = [j for j in range(200) if names[j] != f"c{i}"]
        want = best_clips(x[others], [names[j] for j in others], x[i], k)
        assert rows[f"c{i}"].keys() == {n for n, _ in want} and all(abs(rows[f"c{i}"][n] - s) < 1e-9 for n, s in want)
    near = vector_search.neighbours(v, spark.createDataFrame([("c3",), ("c3",), ("none",)], "clip_id string"), 4).orderBy("rank").collect()
    others = [j for j in range(200) if names[j] != "c3"]
    assert [r.clip_id for r in near] == [n for n, _ in best_clips(x[others], [names[j] for j in others], x[3], 4)]


def test_learned_rotation():
    """Rotated residuals lose less in coding than plain ones where elements are correlated; the rotation keeps lengths."""
    x = correlated(3000, 24, seed=3)
    error = {}
    for rotations in (0, 12):
        rotation, books = vector_index.fit_books(x, 6, 32, rotations, 8, 0)
        assert np.allclose(rotation @ rotation.T, np.eye(24))
        m = vector_index.Model(np.zeros((1, 24)), rotation, tuple(books))
        error[rotations] = ((x - m.decode(*m.code(x))) ** 2).sum(1).mean()
    assert error[12] < 0.8 * error[0]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "vectors")
    x = correlated(2000)
    v = table(spark, x, 1500).unionByName(spark.createDataFrame([(9000, "c1", None)], ROWS))
    return x, v, vector_index.build(v, path, cells=24, parts=8, codes=64, shards=3, rotations=4), path


def test_index_recall(spark, built):
    """Opened again, a third of the cells gives nine tenths of the exact result, reading their folders only; all cells give all of it."""
    x, v, _, path = built
    index = vector_index.Index(spark, path)
    q = v.filter("row_id % 100 = 0").select(F.col("row_id").cast("string").alias("query_id"), "vec")
    exact = block_join.similarities(v, q, 10)
    assert vector_index.recalls(exact, index.search(q, 10, 8)).agg(F.avg("recall")).first()[0] >= 0.9
    got, want = (sorted((r.query_id, r.clip_id, round(r.score, 5)) for r in d.collect()) for d in (index.search(q, 10, 24, 200), exact))
    assert got == want
    plan = index.rows.filter(F.col("cell").isin([1, 2])).select("codes")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and " vec" not in plan
    pool = v.filter("row_id % 10 = 3").select("clip_id")
    some = index.search(q, 10, 24, 200, pool)
    assert {r.clip_id for r in some.select("clip_id").distinct().collect()} <= {r.clip_id for r in pool.collect()} and some.count() == 200


def test_index_goes_on_and_grows(spark, built, tmp_path):
    x, v, _, path = built
    path = shutil.copytree(path, str(tmp_path / "copy"))
    index = vector_index.Index(spark, path)
    before = {r.row_id: (r.cell, bytes(r.codes)) for r in index.rows.collect()}
    assert set(before) == set(range(2000)) and len(index.sizes) > 12
    kept = os.stat(f"{path}/rows/shard=0/_SUCCESS").st_mtime_ns
    shutil.rmtree(f"{path}/rows/shard=1")
    again = vector_index.build(v, path, cells=24, parts=8, codes=64, shards=3, rotations=4)
    assert {r.row_id: (r.cell, bytes(r.codes)) for r in again.rows.collect()} == before
    assert os.stat(f"{path}/rows/shard=0/_SUCCESS").st_mtime_ns == kept
    more = table(spark, correlated(2010, seed=9))
    grown = again.append(more)
    assert grown.rows.count() == 2010 and grown.append(more).rows.count() == 2010
    old = {r.row_id: bytes(r.codes) for r in grown.rows.filter("row_id < 2000").collect()}
    assert old == {i: c for i, (_, c) in before.items()}
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build(v.limit(0), f"{path}-none")


def test_large_cells_are_split(spark, built, monkeypatch):
    _, v, index, path = built
    q = v.filter("row_id in (5, 6)").select(F.col("row_id").cast("string").alias("query_id"), "vec")
    want = sorted(map(tuple, index.search(q, 7, 5).collect()))
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 20)
    assert sorted(map(tuple, vector_index.Index(spark, path).search(q, 7, 5).collect())) == want


def test_engine_asks_the_index(spark, built):
    x, v, index, _ = built
    clips = v.select("clip_id").distinct().filter("clip_id is not null")
    upload = {"up": x[17].tolist()}
    of = lambda **more: [(r.clip_id, round(r.visual_image_score, 5)) for r in Client(Engine(Catalog(clips, clips, visual_vectors=v, uploads=upload, **more), k=12, n_probe=24, refine=200)).search_visual_image("up").rows.collect()]
    assert of(indexes={"visual": index}) == of()


def test_lasting_text_index(spark, tmp_path, monkeypatch):
    """A second engine reads the stored index without tokenizing; changed clips alone are built again; readers keep their version."""
    path, ddl = str(tmp_path / "text"), "uid long, clip_id string, caption string, data_source string"
    rows = [(k, f"c{k % 7}", f"word{k % 3} common tail{k}", "s") for k in range(20)] + [(30, "c8", "", "s")]
    c = spark.createDataFrame(rows, ddl)
    clips = c.select("clip_id").distinct()
    found = lambda q, captions: sorted((r.clip_id, round(r.bm25, 9)) for r in Client(Engine(Catalog(clips, clips, captions=captions, text_index=path))).search_caption(q).rows.collect())
    first = found("word1", c)
    assert first and text.open_index(spark, path)[1:] == (8, 60 / 8)
    build = text.build_index
    monkeypatch.setattr(text, "build_index", lambda *a: pytest.fail("tokenized again"))
    assert found("word1", c) == first
    monkeypatch.setattr(text, "build_index", lambda d: build(d.filter(F.raise_error("another clip").isNull() | F.lit(True)) if d.select("clip_id").distinct().count() > 1 else d))
    new = spark.createDataFrame([*rows, (40, "c8", "word1 here", "s")], ddl)
    engine = Engine(Catalog(clips, clips, captions=new, text_index=path))
    engine.captions_changed(spark.createDataFrame([("c8",)], "clip_id string"))
    monkeypatch.setattr(text, "build_index", build)
    assert text.versions(spark, path) == [1, 2]
    assert "c8" in {r.clip_id for r in Client(engine).search_caption("word1").rows.collect()} and text.open_index(spark, path)[1:] == (8, 62 / 8)
    text.drop_versions(spark, path, 1)
    assert text.versions(spark, path) == [2]


def test_installed_runs(spark, tmp_path):
    """Names that leave the folder are refused; a run is replaced by renames, and nothing of the old one stays."""
    victim = tmp_path / "victim"
    victim.mkdir()
    (victim / "file").write_text("x")
    runs = str(tmp_path / "runs")

    def upload(name, clip):
        path = str(tmp_path / name)
        spark.createDataFrame([(clip, 1, 0.5)], "clip_id string, cluster_id int, distance double").write.parquet(path)
        return path

    for bad in ("x/../../victim", "..", "", "a/b", "_hidden", "a=b"):
        with pytest.raises(ValueError, match="name"):
            writers.install_run(spark, upload(f"u{abs(hash(bad))}", "a"), runs, bad, "cluster_assignments", True)
    assert (victim / "file").exists()
    writers.install_run(spark, upload("one", "a"), runs, "r1", "cluster_assignments")
    with pytest.raises(FileExistsError):
        writers.install_run(spark, upload("two", "b"), runs, "r1", "cluster_assignments")
    writers.install_run(spark, str(tmp_path / "two"), runs, "r1", "cluster_assignments", True)
    assert [r.clip_id for r in spark.read.parquet(runs).collect()] == ["b"] and sorted(os.listdir(runs)) == ["run_id=r1"]


def test_sample_is_a_matrix(spark):
    x = correlated(50)
    m = compressed.sample_matrix(table(spark, x), 20)
    assert m.shape == (20, 16) and {tuple(r) for r in m.tolist()} <= {tuple(r) for r in x.tolist()}
