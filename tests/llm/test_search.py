"""Ranked search, decontamination and hard negatives against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import lexical, negatives, winnowing
from cliploom.llm.common import terms_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    uses = defaultdict(Counter)
    for i, t in items:
        uses[i] += Counter(terms(t))
    out = []
    for i, q in uses.items():
        found = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "ka le mi no pu ra şi Te ÄÖ 77".split() for b in ["", *"abcdefghij"]]
    say = lambda n: " ".join(rng.choice(vocab[: rng.choice([4, 20, 110])]) + rng.choice(["", "", ",", ".\n", "!_"]) for _ in range(n))
    return say


def test_terms():
    t = "".join(map(chr, [*range(0x800), 0x2028, 0x1F389])) + " Ab-cD_9 İ"
    assert terms_of(t) == [x.encode() for x in terms(t)]


def test_varints():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 21, 40, 62)] + [[0, 127, 128]])
    data, size = lexical.pack(v)
    assert size.sum() == len(data) and (lexical.unpack(data.tobytes()) == v).all()


def test_ranking(spark, texts, monkeypatch):
    """Several shards, ties, repeated and missing ids, repeated terms, unknown terms, documents longer than a shard."""
    docs = [(k * 7 % 301, texts(random.Random(k).choice([1, 5, 30, 200]))) for k in range(300)]
    docs += [(500 + k, "same words here ka") for k in range(14)] + [(None, "ka le only"), (None, "same words here ka"), (7, "ka ka"), (900, None), (901, ""), (902, "!! --"), (903, texts(30_000))]
    items = [(k, texts(25)) for k in range(30)] + [(40, "same words, HERE"), (41, "zzz"), (42, ""), (43, None), (44, "ka ka ka le"), (44, "le MI"), (None, "ka only")]
    d = spark.createDataFrame(docs, DOC).repartition(3).withColumns({"term": F.lit("x"), "shard": F.lit(1), "a.b": F.lit(2)})
    i = spark.createDataFrame(items, ITEM).withColumns({"block": F.lit(3), "weight": F.lit(0)})
    want = ranked(docs, items)
    for size in (lexical.SHARD_CHARS, 3000):
        monkeypatch.setattr(lexical, "SHARD_CHARS", size)
        monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7 if size == 3000 else 256)
        assert sorted([tuple(r) for r in lexical.rank_documents(d, i).collect()], key=str) == want
    assert lexical.rank_documents(d.limit(0), i).count() == 0 and lexical.rank_documents(d, i.limit(0)).count() == 0


def test_index_is_kept(spark, texts, tmp_path):
    docs, items = [(k, texts(40)) for k in range(50)], [(k, texts(5)) for k in range(5)]
    lexical.write_index(spark.createDataFrame(docs, DOC), str(tmp_path / "index"))
    again = lexical.Index(spark, str(tmp_path / "index"))
    assert again.documents == 50 and sorted([tuple(r) for r in again.search(spark.createDataFrame(items, ITEM), 3).collect()], key=str) == ranked(docs, items, 3)


def test_heap_merge():
    """Lists that can't lift a document are only looked up; the best are those of adding everything up."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 60)
        lists = []
        for _ in range(rng.randint(1, 12)):
            docs = sorted(rng.sample(range(n), rng.randint(1, n)))
            adds = [rng.choice([1, 2, 5]) * rng.choice([1, 10, 100]) for _ in docs]
            lists.append((docs, adds, max(adds)))
        total = Counter()
        for docs, adds, _ in lists:
            total.update(dict(zip(docs, adds, strict=True)))
        top = rng.randint(1, 12)
        assert sorted(lexical.best_of(lists, top), key=lambda x: (-x[0], x[1])) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:top]


def contaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = terms(t)
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, names = terms(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    names |= x
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaks(texts):
    """Items, and documents that hold passages of them: whole, cut to 8 to 12 words, with a changed word, side by side, in other case."""
    rng = random.Random(4)
    items = [(k, texts(rng.choice([9, 10, 11, 14, 40]))) for k in range(40)] + [(50, "one two three"), (51, "Seven"), (52, ""), (53, None), (None, texts(20)), (54, "le " * 30), (5, texts(12)), (55, "ja " * 12 + texts(6))]
    docs = []
    for k in range(250):
        parts = []
        for _ in range(rng.randint(0, 3)):
            w = terms(rng.choice(items)[1])
            n = rng.choice([8, 9, 10, 11, 12, 99])
            at = rng.randint(0, max(0, len(w) - n))
            w = w[at : at + n]
            if w and rng.random() < 0.3:
                w[rng.randrange(len(w))] = "other"
            parts += [texts(rng.randint(0, 20)), " ".join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)]
        docs.append((k, " - ".join(parts)))
    docs += [(300, None), (301, ""), (302, "...\n"), (None, docs[3][1]), (3, docs[9][1]), (3, docs[9][1]), (303, "le " * 500), (304, "one, two! three"), (305, "seven" * 2), (306, texts(50_000) + items[0][1])]
    return docs, items


def test_contamination(spark, leaks):
    docs, items = leaks
    d = spark.createDataFrame(docs, DOC).repartition(4).withColumns({"_r": F.lit(1), "found": F.lit(2), "names": F.lit(3), "a.b": F.lit("z")})
    i = spark.createDataFrame(items, ITEM).withColumn("h", F.lit(0))
    want = contaminated(docs, items)
    assert sorted([tuple(r) for r in winnowing.judge(d, i).collect()], key=str) == want and 60 < sum(r[-1] for r in want) < 240
    kept = winnowing.keep(d, i)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if not r[-1])
    assert winnowing.judge(d.limit(0), i).count() == 0
    none = winnowing.judge(d, i.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_items for r in none)


def test_contamination_with_a_full_filter(spark, leaks, monkeypatch):
    """A bit table that says yes to nearly everything changes nothing."""
    docs, items = leaks
    monkeypatch.setattr(winnowing, "FILTER_BITS", 64)
    got = winnowing.judge(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert sorted([tuple(r) for r in got.collect()], key=str) == contaminated(docs, items)


def test_winnowing_guarantee():
    """Two texts that share WINDOW words share a fingerprint at the same place of these words; about a third of the places are kept."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b, shared = (rng.integers(0, 4 if rng.random() < 0.3 else 1 << 62, n).astype(np.uint64) for n in (rng.integers(0, 30), rng.integers(0, 30), winnowing.WINDOW))
        x, y = np.concatenate([a, shared, b]), np.concatenate([b[::-1], shared, a])
        own = lambda w, at: {(int(h), int(p) - at) for h, p in zip(*winnowing.fingerprints(w), strict=True) if 0 <= p - at <= winnowing.W - 1}
        assert own(x, len(a)) & own(y, len(b))
    h = winnowing.run_hashes(rng.integers(0, 1 << 62, 10_000).astype(np.uint64), winnowing.K)
    assert 0.25 < len(winnowing.winnowed(h)) / len(h) < 0.33


def mined(rows, anchor, n_pos=5, n_neg=5):
    rows = [r for r in rows if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[2])]
    v = {}
    for i, y, x in rows:
        v.setdefault(i, []).append((y, [max(min(math.floor(256 * float(a)), (1 << 63) - 1), -(1 << 63)) for a in x]))
    width = max([len(x) for r in v.values() for _, x in r], default=0)
    v = {i: min((y, x + [0] * (width - len(x))) for y, x in r) for i, r in v.items()}
    out = []
    for a in filter(anchor, v):
        y, q = v[a]
        s = {i: max(min(sum(m * n for m, n in zip(q, x, strict=True)), (1 << 63) - 1), 1 - (1 << 63)) for i, (_, x) in v.items() if i != a}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if v[i][0] == y][:n_pos]:
            near = [i for i in order if v[i][0] != y and 80 * s[p] <= 100 * s[i] <= 100 * s[p]][:n_neg]
            out += [(a, p, r + 1, i, s[p], s[i]) for r, i in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "same", "large", "huge", "odd"])
def test_negatives(spark, monkeypatch, kind):
    """Groups of near vectors, a vector that many rows have, scores beyond 53 and 63 bits, and rows that take no part."""
    rng = random.Random(6)
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 7)
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    centres = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(6)]
    scale = {"large": 1e6, "huge": 1e9}.get(kind, 1.0)
    rows = [(k, rng.randrange(4), [scale * (c + rng.gauss(0, 0.3)) for c in rng.choice(centres)]) for k in range(400)]
    if kind == "same":
        rows = [(k, y, x if k % 3 else rows[0][2]) for k, y, x in rows]
    if kind == "odd":
        rows += [(900, None, [1.0] * 9), (901, 1, None), (902, 1, [1.0, None]), (903, 1, [math.nan] * 9), (904, 2, [math.inf] + [0.0] * 8), (None, 1, [1.0] * 9), (905, 1, []), (910, 2, [0.5, 0.5]), (910, 1, [0.25]), (10, 3, [9.0]), (920, -5, [0.0] * 9), *rows[:20]]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"d": F.lit(1), "shard": F.lit("x"), "v": F.lit(2), "a.b": F.lit(0)}).select("label", "vec_id", "d", "shard", "v", "embedding", "`a.b`")
    got = negatives.mine(negatives.integers(d), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
    assert negatives.mine(negatives.integers(d.limit(0)), F.col("vec_id") % 10 == 0).count() == 0


def test_brackets():
    """No score lies outside its bracket, and near the pivots brackets leave most rows out."""
    rng = np.random.default_rng(4)
    v = (256 * (rng.integers(0, 5, (2000, 1)) * 3 + rng.normal(0, 0.02, (2000, 3)))).astype(np.int64)
    norm2 = float(np.square(v.astype(float)).sum(1).max())
    pivots = negatives.pick_pivots(negatives._augmented(v[:200].astype(float), norm2))
    shard = negatives._Shard.__new__(negatives._Shard)
    shard.d, shard.pivots, shard.norm2, shard.slack = negatives.distances(negatives._augmented(v.astype(float), norm2), pivots), pivots, norm2, negatives.SLACK * norm2**0.5
    left = []
    for q in v[::100]:
        low, high = shard.bracket(q, slice(None))
        s = negatives.scores(v, q)
        assert (low <= s).all() and (s <= high).all()
        left.append((high >= np.sort(s)[-5]).mean())
    assert np.mean(left) < 0.5
