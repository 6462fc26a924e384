"""Product codes against plain numpy and exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.operators import compressed, vector_search
from cliploom.queries.base import standin

DATA = "/root/testdata/sf0.01"


def test_codes_are_nearest_centroids(spark):
    x = np.random.default_rng(1).normal(size=(60, 10))
    rows = [(i, f"c{i}", v.tolist()) for i, v in enumerate(x)] + [(60, "c60", None)]
    v = spark.createDataFrame(rows, "row_id long, clip_id string, vec array<double>")
    parts = compressed.fit_parts(v, 3, 8)
    assert [p.shape for p in parts] == [(8, 4), (8, 3), (8, 3)]
    got = {r.row_id: r.codes for r in compressed.encode(v, parts).collect()}
    assert got.pop(60) is None
    for i, codes in got.items():
        for part, c, piece in zip(parts, codes, np.array_split(x[i], 3), strict=True):
            d = ((part - piece) ** 2).sum(1)
            assert d[c] <= d.min() + 1e-9


def test_few_rows_and_none(spark):
    v = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "b", [0.0, 1.0])], "row_id long, clip_id string, vec array<double>")
    parts = compressed.fit_parts(v, 8)
    coded = compressed.encode(v, parts)
    assert [(r.clip_id, r.score) for r in compressed.search_codes(coded, v, parts, [0.1, 1.0], 5).collect()] == [("b", 1.0), ("a", 0.1)]
    assert compressed.search_codes(coded, v, parts, [0.1, 1.0], 5, pool=v.filter("row_id = 0")).first().clip_id == "a"
    with pytest.raises(ValueError, match="no vectors"):
        compressed.fit_parts(v.filter("row_id < 0"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall(spark):
    v = standin(spark, DATA, "vectors").withColumn("clip_id", F.col("row_id").cast("string"))
    parts = compressed.fit_parts(v, 16)
    coded = compressed.encode(v, parts).cache()
    found = []
    for q in [r.vec for r in v.filter("row_id % 100 = 0").orderBy("row_id").limit(5).collect()]:
        want = {r.clip_id for r in vector_search.knn(v, q, 10).collect()}
        found.append(len(want & {r.clip_id for r in compressed.search_codes(coded, v, parts, q, 10).collect()}) / 10)
    coded.unpersist()
    print(v.count(), len(parts), found)
    assert np.mean(found) >= 0.9
