"""Hard-negative mining over a pivot table.

Vectors of integers are augmented so that inner products become distances: with M the largest norm, a row x gets
the element ``sqrt(M^2 - |x|^2)`` and an anchor q gets 0, and then ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``. The table
holds each row's distances to ``PIVOTS`` rows, which are picked far from one another among ``SAMPLE`` rows. By the
triangle inequality ``max |d(q,p) - d(x,p)| <= d(q,x) <= min (d(q,p) + d(x,p))``, so a score is bracketed without
touching x's elements; only rows whose bracket reaches what is asked for have their score computed, in integers.

Anchors (in groups) meet the rows in shards of bounded size. A first look at one shard gives each anchor a score that
its results must reach; after it, other shards send only rows that may be among them. All rows are searched, exactly:
a bracket is widened by more than its rounding errors.

Defined results: rows whose label or vector is null, or with a null or non-finite element, take no part, nor do
those without a vec_id; of rows that share a vec_id, the one of the smallest label and vector takes part; a shorter
vector counts as filled up with zeros; elements and scores end at 63 bits; an anchor without a positive, or a positive
whose score is below 0, has no negatives; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize

PIVOTS = 12
#: Rows among which pivots are picked.
SAMPLE = 1024
#: Rows of a shard and anchors of a group, on average.
SHARD_ROWS = 8192
GROUP_ANCHORS = 8192
POSITIVES = 5
NEGATIVES = 5
#: A negative has at least so many percent of the positive's score.
LEAST_PERCENT = 80
#: Brackets are widened by this share of the largest norm.
SLACK = 1e-6


@dataclass
class PivotTable:
    """rows: vec_id, label, v, d (distances to the pivots), shard. pivots: augmented, one a row."""

    rows: DataFrame
    pivots: np.ndarray
    norm2: float
    shards: int


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, label, v: elements ``floor(scale * x)`` of the rows that take part, filled up with zeros."""
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).filter(good & ~F.exists("embedding", odd))
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(scale * x)).alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))


def _matrix(rows: list, width: int) -> np.ndarray:
    return np.array(rows, np.float64).reshape(len(rows), width)


def _augmented(v: np.ndarray, norm2: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(norm2 - np.square(v).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b."""
    return np.sqrt(np.maximum(np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None] - 2 * a @ b.T, 0))


def pick_pivots(sample: np.ndarray) -> np.ndarray:
    """Rows far from one another: the next one is the farthest from those picked."""
    picked = [0] if len(sample) else []
    near = distances(sample, sample[picked])[:, 0] if picked else None
    while picked and len(picked) < min(PIVOTS, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def pivot_table(rows: DataFrame) -> PivotTable:
    """(vec_id, label, v of equal lengths) -> the written table, a row for each vec_id."""
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    size2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, norm2, width = rows.agg(F.count("*"), F.max(size2), F.max(F.size("v"))).first()
    norm2, width, shards = norm2 or 0.0, width or 0, max(1, -(-n // SHARD_ROWS))
    sample = [r.v for r in rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").collect()]
    pivots = pick_pivots(_augmented(_matrix(sample, width), norm2))

    def each(batches):
        for ids, labels, vs in batches:
            d = distances(_augmented(_matrix(vs, width), norm2), pivots)
            yield list(zip(ids, labels, vs, d.tolist(), strict=True))

    table = map_rows(rows, ["vec_id", "label", "v"], "vec_id long, label long, v array<long>, d array<double>", each)
    table = materialize(table.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))), "pivots")
    return PivotTable(table, pivots, norm2, shards)


def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of v with q, without rounding."""
    most = float(np.abs(v.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).sum())
    if most < 2**53:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return v @ q
    exact = v.astype(object) @ q.astype(object)
    return np.array([min(max(x, 1 - (1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    """Plain columns as arrays, lists of equal lengths as matrices."""
    out = []
    for c in (t.column(n).combine_chunks() for n in names):
        flat = (c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False)
        out.append(flat.reshape(len(c), -1) if pa.types.is_list(c.type) else flat)
    return out


class _Shard:
    """Rows of a shard in memory, by label, with brackets of their scores."""

    def __init__(self, rows: pa.Table, table: tuple[np.ndarray, float]):
        ids, labels, v, d = _columns(rows, "vec_id", "label", "v", "d")
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.v, self.d = ids[order], labels[order], v[order], d[order]
        self.pivots, self.norm2 = table
        self.slack = SLACK * math.sqrt(self.norm2) + 1e-9

    def bracket(self, q: np.ndarray, at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest scores that the rows ``at`` may have with q."""
        q = q.astype(np.float64)
        own, d = float(q @ q), self.d[at]
        mine = distances(np.append(q, 0.0)[None], self.pivots)[0]
        near = np.maximum(np.abs(d - mine).max(1) - self.slack, 0)
        far = (d + mine).min(1) + self.slack
        return tuple(np.clip((own + self.norm2 - np.square(x)) / 2, -(2.0**63), 2.0**63) for x in (far, near))

    def label(self, x: int) -> slice:
        return slice(*np.searchsorted(self.labels, [x, x + 1]))


def _first(scores_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by descending score, then ascending id."""
    return np.lexsort((ids, -scores_))


def _table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_POSITIVE = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")])
_NEGATIVE = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])


def nearest_of(shard: _Shard, anchor: int, label: int, q: np.ndarray, reach: int | None, k: int) -> list[tuple[int, int]]:
    """(id, score) of the shard's best rows of the anchor's label that score ``reach`` or more."""
    at = shard.label(label)
    low, high = shard.bracket(q, at)
    other = shard.ids[at] != anchor
    low = low[other]
    cut = max([x for x in (reach, np.partition(low, -k)[-k] if len(low) >= k else None) if x is not None], default=-math.inf)
    at = np.flatnonzero(other & (high >= cut)) + at.start
    s, ids = scores(shard.v[at], q), shard.ids[at]
    best = _first(s, ids)[:k]
    return [(i, x) for i, x in zip(ids[best].tolist(), s[best].tolist(), strict=True) if reach is None or x >= reach]


def between(shard: _Shard, label: int, q: np.ndarray, wanted: list[tuple[int, int, int]], k: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(positive, its score, reach) -> (positive, its score, id, score) of the shard's first rows of other labels whose score
    is at most the positive's, at least ``percent`` of it, and ``reach`` or more."""
    lowest = lambda p, reach: max(-(-percent * p // 100), reach)
    low, high = shard.bracket(q, slice(None))
    least, most = min(lowest(p, r) for _, p, r in wanted), max(p for _, p, _ in wanted)
    at = np.flatnonzero((high >= least) & (low <= most) & (shard.labels != label))
    s, ids = scores(shard.v[at], q), shard.ids[at]
    order = _first(s, ids)
    s, ids, out = s[order], ids[order], []
    for i, p, reach in wanted:
        a = int(np.searchsorted(-s, -p, side="left"))
        b = int(np.searchsorted(-s, -lowest(p, reach), side="right"))
        out += [(i, p, x, y) for x, y in zip(ids[a : min(b, a + k)].tolist(), s[a : min(b, a + k)].tolist(), strict=True)]
    return out


def _meet(table: PivotTable, anchors: DataFrame, rows: DataFrame, each, schema: pa.Schema, groups: int) -> DataFrame:
    """``each`` over every group of anchors with every shard of rows."""
    shared = table.pivots, table.norm2

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table_of(each(_Shard(left, shared), right) if left.num_rows and right.num_rows else [], schema)

    copies = lambda d, name, n: d.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    left = copies(rows, "team", groups).groupBy("team", "shard")
    right = copies(anchors, "shard", table.shards).join(rows.select("shard").distinct(), "shard", "left_semi").groupBy("team", "shard")
    return left.cogroup(right).applyInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def positives(table: PivotTable, anchors: DataFrame, k: int, groups: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: each anchor's first ``k`` other rows of its label."""

    def each(shard, right):
        ids, labels, reach, q = _columns(right, "vec_id", "label", "reach", "v")
        out = []
        for a, y, r, v in zip(ids.tolist(), labels.tolist(), reach.tolist(), q, strict=True):
            out += [(a, *x) for x in nearest_of(shard, a, y, v, None if r == _ANY else r, k)]
        return out

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    seeds = _meet(table, anchors.withColumn("reach", F.lit(_ANY)), table.rows.filter("shard = 0"), each, _POSITIVE, groups)
    if table.shards == 1:
        return ranked(seeds).drop("rank")
    reach = seeds.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("positive_score").alias("s")).filter(F.col("n") >= k)
    known = anchors.join(reach.select("vec_id", F.col("s").alias("reach")), "vec_id", "left").fillna(_ANY, "reach")
    return ranked(_meet(table, materialize(known, "reach"), table.rows, each, _POSITIVE, groups)).drop("rank")


_ANY = -(1 << 63)


def negatives(table: PivotTable, anchors: DataFrame, pairs: DataFrame, k: int, percent: int, groups: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""

    def each(shard, right):
        ids, labels, q = _columns(right, "vec_id", "label", "v")
        out = []
        for a, y, wanted, v in zip(ids.tolist(), labels.tolist(), right.column("wanted").to_pylist(), q, strict=True):
            out += [(a, *x) for x in between(shard, y, v, [(w["positive_id"], w["positive_score"], w["reach"]) for w in wanted], k, percent)]
        return out

    def asked(wanted: DataFrame) -> DataFrame:
        lists = wanted.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score", "reach")).alias("wanted"))
        return materialize(anchors.join(lists, "vec_id"), "wanted")

    pair = ["anchor_id", "positive_id"]
    order = Window.partitionBy(*pair).orderBy(F.desc("negative_score"), "negative_id")
    pairs = pairs.filter("positive_score >= 0").withColumn("reach", F.lit(_ANY))
    found = _meet(table, asked(pairs), table.rows.filter("shard = 0"), each, _NEGATIVE, groups)
    if table.shards > 1:
        reach = found.groupBy(*pair).agg(F.count("*").alias("n"), F.min("negative_score").alias("s")).filter(F.col("n") >= k)
        pairs = pairs.drop("reach").join(reach.select(*pair, F.col("s").alias("reach")), pair, "left").fillna(_ANY, "reach")
        found = _meet(table, asked(pairs), table.rows, each, _NEGATIVE, groups)
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(*pair, "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(vec_id, label, v: integers of equal lengths) -> hard negatives of the anchors, for each of their positives."""
    table = pivot_table(rows)
    anchors = materialize(table.rows.filter(is_anchor).drop("shard", "d"), "anchors")
    groups = max(1, -(-anchors.count() // GROUP_ANCHORS))
    anchors = anchors.withColumn("team", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    pairs = materialize(positives(table, anchors, n_positives, groups), "positives")
    return negatives(table, anchors, pairs, n_negatives, least_percent, groups)


def oracle() -> str:
    """The same mining as SQL."""
    return """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM v AS a JOIN v AS r ON a.vec_id <> r.vec_id AND a.vec_id % 100 = 0
),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
n AS (
    SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
