import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions import expressions as X
from cliploom.functions import scalars as S
from cliploom.model import schema

EXPRESSIONS = [
    *X.PATTERNS.values(), "mean(abs(jerk)) > 2.2", "max(gradient(speed)) - min(diff(speed)) > 9",
    "percentile(speed, 90) > 4 and not std(speed) < 1", "count_nonzero((speed > 1) & ~(jerk < 0)) % 2 == 0",
    "speed[-1] > speed[0]", "sum(where(speed > 0, speed, 0 - speed)) / len(speed) > 2",
    "ptp(clip(speed, -1, 2)) >= 3 or argmax(speed) > argmin(speed)", "median(maximum(speed, jerk)) ** 2 > 3",
    "any(logical_or(speed > 9, curvature > 9))", "0 < mean(sign(speed)) < 0.5", "round(mean(speed)) == 1",
]


def test_motion_agrees_with_numpy(spark):
    names = "mean min max sum all any abs std var median diff where clip sqrt argmin argmax percentile count_nonzero logical_and logical_or gradient maximum minimum ptp sign round".split()
    scope = {n: getattr(np, n) for n in names} | {"len": len}
    rng, rows, data = np.random.default_rng(0), [], []
    for i, n in enumerate((300, 5, 1, 200, 0, 50)):
        a = rng.normal(1, 3, (n, 4)).astype("f4")
        data.append(a.astype("f8"))
        rows.append((str(i), [(0.0, 0.0, 0.0, *map(float, r)) for r in a]))
    df = spark.createDataFrame(rows, schema("trajectories"))
    got = {r.clip_id: r for r in df.select("clip_id", *[X.motion(e).alias(f"e{k}") for k, e in enumerate(EXPRESSIONS)]).collect()}
    for i, a in enumerate(data):
        own = scope | dict(zip(("speed", "acceleration", "jerk", "curvature"), a.T, strict=True)) | {"speed_kph": a[:, 0] * 3.6}
        for k, e in enumerate(EXPRESSIONS):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    want = bool(eval(e, {}, own))
                except (ValueError, IndexError):
                    want = False
            assert got[str(i)][f"e{k}"] == want, (i, e)


@pytest.mark.parametrize("e", ["__import__('os')", "speed.max() > 1", "foo > 1", "sum(speed, axis=0) > 1", "speed", "'a' > 1", "max([1]) > 0", "lambda: 1"])
def test_motion_refuses(e):
    with pytest.raises(ValueError):
        X.motion(e)


@pytest.mark.parametrize(("e", "n"), [("p > 0.5", 5), ("0.3 < p < 0.7", 3), ("p < 0.25 or p > 0.85", 4), ("(p > 0.2) & (p < 0.9)", 6), ("~(p > 0.5)", 5), ("not p >= 0.1", 0), ("(p > 0.5) ^ (p > 0.8)", 3), ("-p < -0.95", 1)])
def test_probability(spark, e, n):
    df = spark.createDataFrame([(i / 10,) for i in range(1, 11)], "p double")
    assert df.filter(X.probability(e)).count() == n


@pytest.mark.parametrize("e", ["p * 2 > 1", "q > 1", "p", "open('x')", "p > 'a'", "True", "p in (1, 2)"])
def test_probability_refuses(e):
    with pytest.raises(ValueError):
        X.probability(e)


def test_scalars(spark):
    d = spark.createDataFrame([("/a/b?x=1&q=a%20b", "running Buses", '<think>{}</think>```json\n{"a": {"b":1}}\n``` bye', "01:02:03")], "u string, t string, j string, h string")
    u, t, j, h = map(F.col, "utjh")
    r = d.select(
        S.first_segment(u), S.query_value(u, "q"), S.canonical_ngram(F.lower(t)), S.llm_json(j), S.hms_seconds(h), S.hms_seconds(t),
        S.token_jaccard(t, F.lit("buses x")), S.harmonic_mean(F.lit(1.0), F.lit(0.5)), S.harmonic_mean(F.lit(0.0), F.lit(0.5)),
        S.sampled_frames(F.lit(100), 5), S.clip_id_of(F.lit("v"), F.lit(1.0), F.lit(5)), S.keywords(F.lit("A, b;c\n a")), S.slug(F.lit(" A b!")), S.word_count(F.lit(" a  b ")),
    ).head()
    assert list(r) == ["/a", "a b", "bus runn", '{"a": {"b":1}}', 3723, 0, 1 / 3, 2 / 3, 0.0, [0, 24, 49, 74, 99], "v__v_1-5", ["a", "b", "c"], "a_b", 2]
    assert S.list_hash(["b", "a", "a"]) == S.list_hash(["a", "b"]) and len(S.list_hash(["a"])) == 16
