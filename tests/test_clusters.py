"""Runs of clusters: subsets, restarts, blocks, and what a search by cluster keeps."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.model import schema
from cliploom.operators import clusters, windows
from cliploom.operators.windows import random_subset


def _table(spark, x):
    return spark.createDataFrame([(i, f"c{i}", [float(z) for z in p]) for i, p in enumerate(x)], schema("vectors"))


@pytest.mark.parametrize("size", [windows.BIN, 3])
def test_subset_is_exact(spark, monkeypatch, size):
    monkeypatch.setattr(windows, "BIN", size)
    keys = [f"k{i}" for i in range(500 if size > 3 else 6000)]
    m = len(keys)
    rows = spark.createDataFrame([(k, j) for k in keys for j in range(2)] + [(None, 0)], "key string, j int")
    order = sorted(keys, key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())
    for n in (0, 1, 3, 250, m - 1, m, 9000) if size > 3 else (2500,):
        got = random_subset(rows, "key", n, 7)
        assert got.columns == ["key", "j"]
        assert sorted((r.key, r.j) for r in got.collect()) == sorted((k, j) for k in order[:n] for j in range(2))
    assert not random_subset(rows.limit(0), "key", 5).count()


def test_blocks_ties_and_missing_vectors(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CELLS", 21)  # three rows at a time
    x = np.random.default_rng(2).normal(size=(50, 5))
    c = np.concatenate([x[:3], x[:3], x[7:8] + 1])
    rows = _table(spark, x).unionByName(spark.createDataFrame([(99, "none", None)], schema("vectors")))
    got = {r.clip_id: r for r in clusters.assign(rows, c).collect()}
    assert len(got) == 50
    for i, p in enumerate(x):
        d = ((c - p) ** 2).sum(1)
        assert got[f"c{i}"].cluster_id == d.argmin() and got[f"c{i}"].distance == pytest.approx(d.min(), abs=1e-6)
    assert [got[f"c{i}"].cluster_id for i in range(3)] == [0, 1, 2] and got["c0"].distance < 1e-9  # vectors are stored as floats
    with pytest.raises(ValueError, match="centroids"):
        clusters.assign(rows, np.zeros((0, 5)))


def test_runs_of_a_subset_and_restarts(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(3).normal(m, 0.1, (40, 2)) for m in ((0, 0), (5, 0), (0, 5), (5, 5))])
    v = _table(spark, x)
    a, c = clusters.fit(v, 4, most=90)
    assert a.count() == 90 and c.count() == 4
    assert {r.clip_id for r in a.collect()} == {r.clip_id for r in clusters.fit(v, 2, most=90)[0].collect()}
    once, more = (clusters.sum_of_squares(clusters.fit(v, 4, iterations=2, redo=n)[0]) for n in (1, 5))
    assert more <= once + 1e-9
    monkeypatch.setattr(clusters, "MOST_CLUSTERS", 3)
    assert clusters.fit(v, 50)[1].count() == 3
    with pytest.raises(ValueError, match="no vectors"):
        clusters.fit(v.limit(0), 2)


def test_spherical(spark):
    x = np.array([[1, 0.1], [40, 3], [0.1, 1], [2, 30]], float)
    a, c = clusters.fit(_table(spark, x), 2, spherical=True)
    of = {r.clip_id: r.cluster_id for r in a.collect()}
    assert of["c0"] == of["c1"] != of["c2"] == of["c3"]
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in c.collect())


def test_search_by_cluster_is_lazy(spark):
    result = spark.createDataFrame([("a",), ("b",), ("z",)], "clip_id string")
    a = spark.createDataFrame([("r", "a", 1, 0.5), ("r", "a", 2, 0.2), ("r", "b", 2, None), ("s", "z", 1, 0.1)], "run_id string, clip_id string, cluster_id int, distance double")
    got = lambda *x: sorted((r.clip_id, r.cluster_distance) for r in clusters.by_cluster(result, a, *x).collect())
    assert got("r", [1]) == [("a", 0.5)]
    assert got("r", [1, 2]) == [("a", 0.2), ("b", None)]
    assert got("none", [1]) == got("r", [9]) == [("a", None), ("b", None), ("z", None)]
    failing = a.withColumn("distance", F.raise_error(F.lit("read")).cast("double"))
    clusters.by_cluster(result, failing, "r", [1])  # nothing is read yet
