"""Token matching against plain Python."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions.encoders import GramTokens, same_tokens
from cliploom.operators import evaluation
from cliploom.queries.base import standin

DATA = "/root/testdata/sf0.001"
DDL = "clip_id string, reference string, prediction string, extra int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def brute(pairs, encoder, weighted=True, baseline=0.0):
    """(precision, recall, f1) of each pair, by loops over tokens."""
    n, df = len(pairs), {}
    for r, _ in pairs:
        for w in set(words(r)):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) if weighted else 1.0
    cos = lambda x, y: float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y)) or 1.0)
    out = []
    for r, p in pairs:
        r, p = words(r), words(p)
        if not r or not p:
            out.append((0.0, 0.0, 0.0))
            continue
        a, b = encoder([r, p])

        def side(mine, m, others):
            u = [idf(w) for w in mine]
            u = u if sum(u) > 0 else [1.0] * len(u)
            v = sum(k * max(cos(x, y) for y in others) for k, x in zip(u, m, strict=True)) / sum(u)
            return (v - baseline) / (1 - baseline)

        x, y = side(p, b, a), side(r, a, b)
        out.append((x, y, 2 * x * y / (x + y) if x + y else 0.0))
    return out


def check(spark, rows, encoder, **options):
    d = spark.createDataFrame([(f"c{i}", r, p, i) for i, (r, p) in enumerate(rows)], DDL)
    got = {r.extra: (r.match_precision, r.match_recall, r.match_f1) for r in evaluation.token_match(d, encoder, **options).collect()}
    want = brute(rows, encoder, options.get("weighted", True), options.get("baseline", 0.0))
    assert len(got) == len(rows)
    assert np.allclose([got[i] for i in range(len(rows))], want, atol=1e-9)


ROWS = [
    ("a red car turns left", "the red cars turned left"),
    ("a red car turns left", "the red cars turned left"),  # repeated
    ("A  Red\tcar", "a red car a red car"),  # ties, case, white space
    ("a", "zzz"),
    ("", "a car"),
    (None, None),
    ("a bus stops", None),
    ("a b c " * 150, "a d " * 150),  # long
    ("größe ü 😀", "grösse u 😀"),
]


@pytest.mark.parametrize("encoder", [GramTokens(64), same_tokens], ids=["grams", "same"])
def test_against_loops(spark, encoder):
    check(spark, [r for r in ROWS if len(r[0] or "") < 100], encoder)
    check(spark, ROWS[:6], encoder, weighted=False, baseline=0.25, batch=2)


def test_long_texts_in_blocks(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2500, 8)), rng.normal(size=(70, 8))
    s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    down, across = evaluation._best(a, b)
    assert np.allclose(down, s.max(1)) and np.allclose(across, s.max(0))
    check(spark, [ROWS[7]], same_tokens)


def test_weights_that_are_all_zero_and_no_rows(spark):
    check(spark, [("a b", "a c"), ("b a", "a")], same_tokens)  # every reference has a and b
    d = spark.createDataFrame([], DDL)
    assert evaluation.token_match(d, same_tokens).collect() == []


def test_repeated_keys_are_told_apart_by_their_texts(spark):
    d = spark.createDataFrame([("k", "a b", "a b", 0), ("k", "x y", "a b", 1), (None, "a b", "a", 2)], DDL)
    got = {r.extra: r.match_f1 for r in evaluation.token_match(d, same_tokens).collect()}
    assert got[0] == 1.0 and got[1] == 0.0 and 0 < got[2] < 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_captions(spark):
    c = standin(spark, DATA, "captions")
    p = c.groupBy("clip_id").agg(F.min_by("caption", "uid").alias("reference"), F.max_by("caption", "uid").alias("prediction")).orderBy("clip_id").limit(60)
    check(spark, [(r.reference, r.prediction) for r in p.collect()], GramTokens())
