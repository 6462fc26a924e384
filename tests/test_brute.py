"""Operators without SQL, held against plain Python over whole small tables."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cliploom.model import schema
from cliploom.operators import arena, classifiers, clusters, joins, mutations, vector_search, windows
from cliploom.queries import QUERIES
from cliploom.queries.base import standin
from cliploom.queries.search import _tracks
from cliploom.sources import tensors

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_v12_windows_of_paths(spark):
    tracks = {r.clip_id: np.array([(f.x, f.y) for f in r.frames], float) for r in _tracks(standin(spark, DATA, "ticks")).collect()}

    def vectors(frames):
        for at in (0, 150, 300, 450):
            if len(part := frames[at : at + 150]):
                part = part - part.mean(0)
                yield np.concatenate([part.ravel(), np.zeros(300 - part.size)])

    query = next(vectors(tracks["3"]))
    want = {c: min(((v - query) ** 2).sum() for v in vectors(f)) for c, f in tracks.items()} | {"3": 0.0}
    best = sorted((d, c) for c, d in want.items())[:15]
    got = QUERIES["v12_subtrajectory_windows"](spark, DATA).collect()
    assert [r.clip_id for r in got] == [c for _, c in best]
    assert np.allclose([r.distance for r in got], [d for d, _ in best], rtol=1e-6, atol=1e-6)


def glicko(me, other, score, tau=arena.TAU):
    """The paper's update with the volatility found by bisection of its defining equation."""
    mu, phi, s = (me[0] - 1500) / 173.7178, me[1] / 173.7178, me[2]
    m2, p2 = (other[0] - 1500) / 173.7178, other[1] / 173.7178
    g = 1 / math.sqrt(1 + 3 * p2**2 / math.pi**2)
    e = 1 / (1 + math.exp(-g * (mu - m2)))
    v = 1 / (g * g * e * (1 - e))
    d = v * g * (score - e)
    f = lambda x: math.exp(x) * (d * d - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - math.log(s * s)) / tau**2
    lo, hi = -30.0, 5.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    s = math.exp(lo / 2)
    p = 1 / math.sqrt(1 / (phi**2 + s * s) + 1 / v)
    return 1500 + 173.7178 * (mu + p * p * g * (score - e)), 173.7178 * p, s


def replayed(votes):
    """(arena, criterion, model) -> rating, and the steps of each."""
    states, steps, start = {}, {}, (arena.INITIAL, arena.INITIAL_RD, arena.INITIAL_VOL)
    for v in sorted(votes, key=lambda v: v.id):
        if v.winner == "skip" or v.model_a == v.model_b:
            continue
        a, b = ((v.arena, v.criterion, m) for m in (v.model_a, v.model_b))
        x, y = states.get(a, start), states.get(b, start)
        sa = arena.SCORES.get(v.winner, 0.5)
        states[a], states[b] = glicko(x, y, sa), glicko(y, x, 1 - sa)
        for k in (a, b):
            steps.setdefault(k, []).append(states[k][0])
    return {k: s[0] for k, s in states.items()}, steps


@pytest.fixture(scope="module")
def votes(spark):
    return standin(spark, DATA, "votes").filter("id < 400")


def test_w12_ratings(votes):
    want, _ = replayed(votes.collect())
    got = {(r.arena, r.criterion, r.model): r.rating for r in arena.ratings(votes, ("arena", "criterion")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.01 for k in want)


def test_w18_influence(votes):
    """Leaving one annotator out, by replays of all other votes."""
    rows, out = votes.collect(), {}
    flat = lambda vs: {k[2]: r for k, r in replayed([v for v in (pd.Series(x.asDict() | {"arena": "", "criterion": ""}) for x in vs)])[0].items()}
    full = flat(rows)
    order = lambda r: sorted(full, key=lambda m: (-r[m], m))
    for u in sorted({r.username for r in rows})[:3]:
        part = flat([r for r in rows if r.username != u])
        out[u] = sum(abs(part[m] - full[m]) for m in full), sum(a != b for a, b in zip(order(part), order(full), strict=True))
    got = {r.left_out: (r["shift"], r.rank_changes) for r in arena.influence(votes, "username").collect()}
    for u, (shift, changes) in out.items():
        places = got[u][1]
        assert abs(got[u][0] - shift) < 0.1 and (places > 0) == (changes > 0)


def test_w14_choice(spark):
    got = QUERIES["w14_diverse_windows"](spark, DATA).toPandas()
    for _, g in got.groupby("video_id"):
        g = g.sort_values("pick")
        assert list(g["pick"]) == list(range(len(g))) and len(g) <= 5
        spans = sorted(zip(g.a, g.b, strict=True))
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    rng = np.random.default_rng(0)
    c = [("v", float(10 * i), float(10 * i + 5), " ".join(rng.choice(list("abcd"), 3)), str(rng.choice(["l", "r", "s"]))) for i in range(12)]
    chosen = [r.a for r in windows.diverse(spark.createDataFrame(c, "video_id string, a double, b double, cap string, cmd string"), 4).orderBy("pick").collect()]
    n = {m: sum(x[4] == m for x in c) for m in "lrs"}
    rarity = {x[1]: math.log(len(c) / (n[x[4]] + 1)) for x in c}
    by, taken = {x[1]: x for x in c}, []
    like = lambda x, y: 0.5 * len(set(x[3].split()) & set(y[3].split())) / len(set(x[3].split()) | set(y[3].split())) + 0.5 * (x[4] == y[4])
    for _ in range(4):
        mark = lambda a: 0.5 * rarity[a] / max(rarity.values()) - 0.5 * max([0.0, *(like(by[a], by[t]) for t in taken)])
        taken.append(max((a for a in sorted(by) if a not in taken), key=mark))
    assert chosen == taken


def test_samples_are_even(spark):
    """V20 and W16: whole groups where they are small, the same for the same seed, every row as likely as another."""
    v = spark.range(2000).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("clip_id"), (F.col("id") % 4).cast("int").alias("g"))
    draw = lambda s: {r.row_id for r in vector_search.sample_rows(v, 200, s).collect()}
    assert len(draw(1)) == 200 and draw(1) == draw(1) != draw(2)
    assert 400 < np.mean([np.mean(list(draw(s))) for s in range(5)]) - 500 < 600
    per = lambda s: windows.sample_per_group(v, "g", "clip_id", 50, s).groupBy("g").count().collect()
    assert {r["count"] for r in per(1)} == {50}
    assert windows.sample_per_group(v, "g", "clip_id", 10_000).count() == 2000


def test_f38_candidates(spark):
    a, b = (standin(spark, DATA, n).toPandas() for n in ("intervals", "others"))
    want = set()
    for k, g in a.groupby("k"):
        start, end, t = g.start_time.min(), g.end_time.max(), math.ceil(g.start_time.min() / 50) * 50
        mine = b[b.k == k]
        while t + 10 <= end:
            over = np.minimum(mine.end_time, t + 10) - np.maximum(mine.start_time, t)
            if (over > 0).any() and t >= start:
                want.add((str(k), float(t)))
            t += 50
    assert {(r.video_id, float(r.a)) for r in QUERIES["f38_labelled_candidates"](spark, DATA).collect()} == want


def test_j09_ties_and_long_spans(spark):
    w = spark.createDataFrame([(1, 0.0, 100.0), (1, 5.0, 6.0), (1, 500.0, 501.0), (2, 0.0, 1.0)], "k int, a double, b double")
    s = spark.createDataFrame([(1, 0.0, 40.0, "x"), (1, 60.0, 100.0, "y"), (1, -50.0, 5.5, "z"), (1, 5.2, 5.2, "w")], "k int, start_sec double, end_sec double, v string")
    assert sorted(tuple(r) for r in joins.best_overlap(w, s, "k", "v").collect()) == [(1, 0.0, 100.0, "x"), (1, 5.0, 6.0, "x"), (1, 500.0, 501.0, ""), (2, 0.0, 1.0, "")]


def test_m01_every_row_in_its_nearest_cluster(spark):
    v = standin(spark, DATA, "vectors").withColumn("clip_id", F.col("row_id").cast("string"))
    a, c = clusters.fit(v, 6)
    centres = np.array([r.vec for r in c.orderBy("cluster_id").collect()])
    x = {r.clip_id: np.array(r.vec, float) for r in v.collect()}
    got = a.collect()
    assert len(got) == len(x)
    for r in got:
        d = ((centres - x[r.clip_id]) ** 2).sum(1)
        assert d.argmin() == r.cluster_id and abs(d.min() - r.distance) < 1e-6
    small, _ = clusters.fit(v, 2, per_cluster=10)  # fitted on a sample, all rows assigned
    assert small.count() == len(x)


def test_m05_weights_are_the_optimum(spark):
    v = standin(spark, DATA, "vectors").withColumn("clip_id", F.col("row_id").cast("string"))
    labels = v.select("clip_id", (F.col("label") == 3).cast("double").alias("label"))
    w, b = classifiers.train(v, labels, c=1.0, tolerance=1e-9, iterations=500)
    rows = v.collect()
    x, y, c = np.array([r.vec for r in rows], float), np.array([r.label == 3 for r in rows], float), 1.0
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(c * x.T @ (p - y) + w).max() < 1e-3 and abs((p - y).sum()) < 1e-3
    got = {r.clip_id: r.p for r in classifiers.score(v, w, b).collect()}
    assert np.allclose([got[r.clip_id] for r in rows], p)


def test_m08_training_set(spark):
    a, c = standin(spark, DATA, "annotations"), standin(spark, DATA, "clips")
    has = lambda k: {r.clip_id for r in a.filter((F.col("key") == k) & F.col("label_type").isin("manual", "autolabel")).collect()} & {r.clip_id for r in c.collect()}
    pos, neg = has("quality"), has("toxic") - has("quality")
    t = classifiers.training_set(a, c, ["quality"], ["toxic"]).collect()
    good, bad = {r.clip_id for r in t if r.label == 1.0}, {r.clip_id for r in t if r.label == 0.0}
    assert good == pos and not bad & pos and len(t) == len(good) + len(bad)
    assert (bad <= neg if len(neg) >= len(pos) else neg <= bad)
    assert len({r.clip_id for r in classifiers.training_set(a, c, ["quality"], ["toxic"], cap=5).collect()}) == 10


def test_tensor_files(spark):
    x = {"b": np.arange(6, dtype="f4").reshape(2, 3), "a": np.array([1, 2], "i8"), "e": np.zeros(0, "f8")}
    f = spark.createDataFrame([("p", bytearray(tensors.pack_tensors(x)))], "path string, content binary")
    got = {r.key: (r.position, r.shape, r["values"]) for r in tensors.keyed_tensors(f).collect()}
    assert got["b"][:2] == (0, [2, 3]) and got["b"][2] == list(range(6)) and got["a"][2] == [1.0, 2.0] and got["e"][1] == [0]
    assert [r.key for r in tensors.keyed_tensors(f, ["a"]).collect()] == ["a"]


def test_clips_new_twice(spark):
    old = spark.createDataFrame([("a", "s1", "DE")], schema("clips"))
    new = spark.createDataFrame([("a", "s2", None), ("a", "s1", None), ("b", "s3", "FR"), ("b", "s4", "FR")], schema("clips"))
    assert sorted(tuple(r) for r in mutations.upsert_clips(old, new).collect()) == [("a", "s1,s2", "DE"), ("b", "s3,s4", "FR")]
