"""Retrieval by rows against plain numpy; sidecars by ranges; all caption scores in one pass."""

import io
import json
import tarfile

import numpy as np
from pyspark.sql import functions as F

from cliploom.model import schema
from cliploom.operators import evaluation, vector_search
from cliploom.plans.client import Client
from cliploom.plans.engine import Catalog, Engine
from cliploom.sources import archives, ranges


def _table(spark, x, clips=7):
    return spark.createDataFrame([(i, f"c{i % clips}", [float(z) for z in p]) for i, p in enumerate(x)], schema("vectors"))


def _nearest(x, q, n, keep=lambda i: True):
    s = x @ q
    order = sorted((i for i in range(len(x)) if keep(i)), key=lambda i: (-s[i], i))
    return [(i, s[i]) for i in (order if n < 0 else order[:n])]


def test_neighbours_of_vectors_texts_and_clips(spark):
    x = np.random.default_rng(5).integers(-3, 4, (60, 4)).astype(float)  # many equal scores
    x[9] = x[30]
    v = _table(spark, x)
    asked = spark.createDataFrame([("p", x[1].tolist()), ("q", x[2].tolist()), ("none", None)], "query_id string, vec array<double>")
    for n in (1, 13, 500, -1):
        got = vector_search.row_neighbours(v, asked, n).orderBy("query_id", "rank").collect()
        want = [(name, i, f"c{i % 7}", s) for name, j in (("p", 1), ("q", 2)) for i, s in _nearest(x, x[j], n)]
        assert [(r.query_id, r.row_id, r.clip_id, r.score) for r in got] == want
        assert [r["rank"] for r in got if r.query_id == "p"] == list(range(1, len(want) // 2 + 1))
    pool = spark.createDataFrame([("c3",), ("c3",), ("x",)], "clip_id string")
    got = vector_search.row_neighbours(v, asked.filter("query_id = 'p'"), 4, pool).orderBy("rank").collect()
    assert [r.row_id for r in got] == [i for i, _ in _nearest(x, x[1], 4, lambda i: i % 7 == 3)]
    texts = spark.createDataFrame([("t", "2"), ("zero", "0")], "query_id string, text string")
    encoder = lambda t: np.array([[float(s), 0, 0, 0] for s in t])
    got = vector_search.text_neighbours(v, texts, encoder, 5).orderBy("rank").collect()
    assert [(r.query_id, r.row_id) for r in got] == [("t", i) for i, _ in _nearest(x, np.array([1.0, 0, 0, 0]), 5)]
    clips = spark.createDataFrame([("c4",), ("nobody",)], "clip_id string")
    got = vector_search.clip_neighbours(v, clips, -1).orderBy("rank").collect()
    assert {r.query_id for r in got} == {"c4"} and len(got) == 60
    assert np.allclose([r.score for r in got], sorted(x @ x[4] / np.linalg.norm(x[4]), reverse=True))
    assert sorted((r.clip_id, r.row_id) for r in vector_search.rows_of(v, pool).collect()) == [("c3", i) for i in range(3, 60, 7)]
    assert not vector_search.row_neighbours(v.limit(0), asked, 3).count() and not vector_search.row_neighbours(v, asked.limit(0), 3).count()


def test_rows_before_clips(spark):
    x = np.random.default_rng(6).normal(size=(40, 3))
    x[:20] += [9, 0, 0]
    v = spark.createDataFrame([(i, "many" if i < 20 else f"c{i}", p.tolist()) for i, p in enumerate(x)], schema("vectors"))
    q = [1.0, 0.0, 0.0]
    assert [r.clip_id for r in vector_search.search_rows(v, [q], 20).collect()] == ["many"]
    best = vector_search.search_rows(v, [q, [-1.0, 0.0, 0.0]], 25)
    assert best.count() == best.select("clip_id").distinct().count() > 2
    clips = v.select("clip_id").distinct()
    of = lambda n: {r.clip_id for r in Client(Engine(Catalog(clips, clips, visual_vectors=v, uploads={"u": q}), visual_rows=n)).search_visual_image("u").rows.collect()}
    assert of(20) == {"many"} and len(of(22)) == 3 and len(of(None)) == 21


def test_sidecars_by_ranges(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for n, b in (("x/c1.json", json.dumps({"n": 1, "more": [2]})), ("x/c1.mp4", "m"), ("c2.meta.json", "{broken"), ("c3.json", "{}")):
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b.encode()))
    got = sorted((r.clip_id, r.n, r.split) for r in archives.sidecars(spark, str(tmp_path), "n int", "test", "*.tar").collect())
    assert got == [("c1", 1, "test"), ("c2", None, "test"), ("c3", None, "test")]
    assert got == sorted((r.clip_id, r.n, r.split) for r in archives.sidecars(spark, str(tmp_path), "n int", "test").collect())


def test_scores_in_one_pass(spark):
    rows = [("a", "the red car", "The red  bus"), ("b", None, "x"), ("c", "", ""), ("d", "a b a b", "b a b a")]
    p = spark.createDataFrame(rows, "clip_id string, reference string, prediction string")
    names = [n for n in evaluation.available_scorers() if n != "cider"]
    s = evaluation.score_captions(p, names)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("run(") <= 2
    for r in s.collect():
        x = next(x for x in rows if x[0] == r.clip_id)
        assert all(r[n] == evaluation.SCORERS[n](x[1] or "", x[2] or "") for n in names)
    assert evaluation.score_captions(p, []).columns == p.columns
    assert s.select(F.sum("rouge_1")).head()[0] > 0


def test_members_go_on_in_batches(spark, tmp_path):
    data = {f"m{i}.bin": bytes([i]) * n for i, n in enumerate((0, 5 << 20, 1, 5 << 20, 9 << 20, 0, 3))}
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for n, b in data.items():
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    m = ranges.members(ranges.listed(spark, str(tmp_path), "*.tar"))
    assert {r.member: bytes(r.content) for r in ranges.contents(m).collect()} == data
