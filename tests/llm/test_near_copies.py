"""The near-dedup stage of the pipeline: thresholds and rows of one doc_id."""

import random

import brute
import pytest

import corpus_pipeline
from cliploom.llm import minhash

PAIR = "doc_id long, text string"


def test_least_matches():
    assert [minhash.least_matches(p) for p in (80, 85, 100)] == [35, 40, 64]


def near_copies():
    """Texts with one to six changed words: similarities from 0.66 to 0.97, around both thresholds."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
        for k in range(7):
            w = list(base)
            for at in rng.sample(range(5, 145), k):
                w[at] += "x"
            rows.append((len(rows), " ".join(w)))
    return rows


def kept_by_brute(rows, percent):
    return {d for d, (_, _, kept) in brute.components(rows, percent).items() if kept}


@pytest.mark.parametrize("percent", [80, 85])
def test_threshold(spark, percent):
    rows = near_copies()
    want = kept_by_brute(rows, percent)
    assert {r.doc_id for r in minhash.dedup(spark.createDataFrame(rows, PAIR), percent).collect()} == want


def test_pipeline_stage_takes_80(spark):
    rows = near_copies()
    want = kept_by_brute(rows, 80)
    assert want != kept_by_brute(rows, 85)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, PAIR), "").collect()} == want


def test_rows_of_one_doc_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    d = spark.createDataFrame([(1, a), (5, a), (5, b), (5, None), (7, b), (7, a), (None, a), (9, a)], PAIR)
    kept = sorted(map(str, [tuple(r) for r in minhash.dedup(d).collect()]))
    assert kept == sorted(map(str, [(1, a), (5, b), (5, None), (None, a)]))


def copies(kind, n, rng):
    """n copies of one text, with edits of their own or edits that many of them share, up to a third of the words."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in sorted(rng.sample(range(5, 115), rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 8])), reverse=True):
            if kind == "shared":
                at = at // 20 * 20 + 7
            if kind == "drop" or rng.random() < 0.3:
                del w[at]
            else:
                w[at] = "same" if kind == "shared" else f"v{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_long_lists(spark, percent):
    """Groups of more copies than a short list has, some of them linked only through one another."""
    rng = random.Random(percent)
    texts = [t for kind in ("own", "shared", "drop") for t in copies(kind, 90, rng)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute.components(rows, percent)
    assert len({c for _, c, _ in want.values()}) > 10
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, PAIR), percent).collect()}
    assert got == want


def test_few_pairs_are_left(spark):
    """Copies with edits of their own: no pair of members far from the hub is left, however many there are."""
    n, size = 200, 100
    far = [(0, c, c, size, False, [c * 1000 + k for k in range(12)] + [-k for k in range(c % 50, c % 50 + 12)]) for c in range(1, n)]
    d = spark.createDataFrame([*far, (0, n, 0, size, True, [n * 1000])], "hub long, c long, label long, n int, near boolean, d array<long>")
    assert minhash.differences_in_common(minhash.shared_differences(d, 85), 85).count() == 0
    twins = [(0, n + 1 + k, n + 1 + k, size, False, [n * 9999 + j for j in range(22)] + [k]) for k in range(2)]
    more = d.unionByName(spark.createDataFrame(twins, d.schema))
    assert [tuple(r) for r in minhash.differences_in_common(minhash.shared_differences(more, 85), 85).collect()] == [(n + 1, n + 2)]


def test_recall_of_all_documents(spark):
    """Every link of the synthetic corpus that comparing all pairs finds, found within one component."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == brute.components(rows)


def shared_edits(n, rng):
    """n copies of one text, each with seven of the same fourteen words exchanged."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(260)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(14), 7):
            w[10 + 17 * k] = f"other{k}"
        out.append(" ".join(w))
    return out


def test_pairs_of_shared_edits(spark, monkeypatch):
    """Pairs to compare grow with the number of copies, and all copies end in one component."""
    counts, confirm = [], minhash.confirm

    def counted(pairs, *more):
        counts.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(minhash, "confirm", counted)
    totals = []
    for n in (150, 600):
        counts.clear()
        rows = list(enumerate(shared_edits(n, random.Random(5))))
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, PAIR)).collect()}
        assert got == {d: c for d, (_, c, _) in brute.components(rows).items()} and len(set(got.values())) == 1
        totals.append(sum(counts))
    assert totals[1] < 6 * totals[0] and totals[1] < 30 * 600


def test_exact_links(spark):
    """The prefix join on shingles finds what comparing all pairs finds, whatever the signatures say."""
    rng = random.Random(9)
    texts = [t for kind in ("own", "shared", "drop") for t in copies(kind, 30, rng)] + [t for _, t in near_copies()] + ["a b c", "A b C", "", "x"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, PAIR), exact=True).collect()}
    assert got == brute.components(rows)
