"""Registered queries that reach every row of their tables."""

import os

import numpy as np
import pandas as pd
import pytest

from cliploom.queries import QUERIES
from cliploom.queries.base import standin

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_index_update_reaches_all_clips(spark):
    got = {r.clip_id for r in QUERIES["t07_update_index"](spark, DATA).select("clip_id").distinct().collect()}
    c = standin(spark, DATA, "captions").filter("caption rlike '[\\\\p{L}\\\\p{N}]'")
    assert got == {r.clip_id for r in c.select("clip_id").distinct().collect()} and len(got) > 1


def test_evaluation_meets_all_vectors(spark):
    v = standin(spark, DATA, "vectors").toPandas().sort_values("row_id")
    m, queries = np.stack(v.vec).astype(float), v.row_id.to_numpy() % 100 == 0
    want = {}
    for q in np.flatnonzero(queries):
        s = pd.Series(m @ m[q], index=v.clip_id)[v.row_id.to_numpy() != v.row_id.iloc[q]].groupby(level=0).max().round(3)
        t = s[v.clip_id.iloc[q]]
        want[str(v.row_id.iloc[q])] = (s > t).sum() + 1 + ((s == t).sum() - 1) / 2
    assert {r.query_id: r["rank"] for r in QUERIES["w05_truth_ranks"](spark, DATA).collect()} == want
    assert {r.n for r in QUERIES["x02_fusion_grid"](spark, DATA).collect()} == {queries.sum()}
