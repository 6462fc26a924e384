"""Similarity joins in blocks: every query against every row, with a top k that merges.

Queries and rows are dealt to blocks of bounded size by a hash of their ids; each pair of blocks meets in one
group, as a matrix product. With a limit, a pair of blocks sends the best ``k`` clips of each query only, and these are
merged: a clip that is among the best of all is among the best of the block that holds its best row. No query
goes through the driver or into the plan.

Rows without a vector or a clip, and queries without a vector, meet nothing. Vectors must have one length, queries ids of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block, on average: a block's product has QUERIES * ROWS numbers at most.
ROWS = 16_384
QUERIES = 1024
#: Rows of a block where all pairs are returned, so that a block's result is bounded.
PAIR_ROWS = 1024
#: Numbers of a product that are made at once.
CELLS = 1 << 22

_SCORES = pa.schema([("query_id", pa.string()), ("clip_id", pa.string()), ("score", pa.float64())])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal lengths as the rows of a matrix of doubles."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal ones by ascending name, in order."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.lexsort((names[at], -scores[at]))[:k]]
    return np.lexsort((names, -scores))


def pooled_rows(s: np.ndarray, first: np.ndarray, x: np.ndarray, q: np.ndarray, k: int | None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Clips that may be among the best k, and the scores of their best rows.

    ``s`` comes from a matrix product, in which equal rows may differ in the last bits; what is near the limit is
    added up again, row by row in one order, so that equal rows tie. With ``digits``, scores equal to so many places are near.
    """
    most = np.maximum.reduceat(s, first)
    slack = 1e-12 * float(np.abs(most[most > -np.inf]).max(initial=0)) + (1e-15 if digits is None else 10.0**-digits)
    least = np.partition(most, -k)[-k] - slack if k is not None and len(most) > k else -np.inf
    places = np.flatnonzero((most >= least) & (most > -np.inf))
    clip = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
    rows = np.flatnonzero(np.isin(clip, places) & (s >= most[clip] - slack))
    again = (x[rows] * q).sum(1)
    return places, np.maximum.reduceat(again, np.searchsorted(clip[rows], places)) if len(places) else again


def _blocks(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def _dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
    """Each row in its own block (of n), copied to all blocks of the other side (m)."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n).cast("long"))).withColumn(other, copies)


def similarities(vectors: DataFrame, queries: DataFrame, k: int | None = None, own: str | None = None, digits: int | None = None) -> DataFrame:
    """(clip_id, row_id, vec) and (query_id, vec) -> query_id, clip_id, score: a clip's best row, of the k best clips of each query or of all.

    A row whose column ``own`` is the query's id is left out. With ``digits``, clips go by scores rounded to so many places.

    Where all pairs are returned, blocks are small and a clip's rows share one, so that nothing is left to merge; only where a
    clip has more than ROWS rows, rows are dealt singly and their scores merge afterwards.
    """
    rows = vectors.filter("vec is not null and clip_id is not null").select("clip_id", "row_id", F.col("vec").cast("array<double>"), (F.col(own).cast("string") if own else F.lit("")).alias("_own"))
    asked = queries.filter("vec is not null").select(F.col("query_id").cast("string"), F.col("vec").cast("array<double>"))
    whole = k is None and (rows.groupBy("clip_id").count().agg(F.max("count")).first()[0] or 0) <= ROWS
    n, m = _blocks(rows, PAIR_ROWS if k is None else ROWS), _blocks(asked, QUERIES)
    apart = own is not None

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SCORES.empty_table()
        clips, at = np.unique(np.array(left.column("clip_id").to_pylist(), object).astype(str), return_inverse=True)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(clips)))
        x, q = matrix(left.column("vec"))[order], matrix(right.column("vec"))
        ids = right.column("query_id").to_pylist()
        asked_for = dict(zip(ids, q, strict=True))
        mine = np.array(left.column("_own").to_pylist(), object)[order] if apart else None
        names, order_of_name = pa.array(clips, pa.string()), dict(zip(ids, range(len(ids)), strict=True))
        out: tuple[list, list, list] = ([], [], [])
        step = max(1, CELLS // len(x))
        for start in range(0, len(q), step):
            for name, s in zip(ids[start : start + step], q[start : start + step] @ x.T, strict=True):
                if apart:
                    s = np.where(mine == name, -np.inf, s)
                places, pooled = pooled_rows(s, first, x, asked_for[name], k, digits)
                order_of = np.arange(len(places)) if k is None else best(pooled if digits is None else pooled.round(digits), clips[places], k)
                out[0].append(np.full(len(order_of), order_of_name[name], np.int32))
                out[1].append(places[order_of].astype(np.int32))
                out[2].append(pooled[order_of])
        q_at, c_at, s = (pa.array(np.concatenate(c)) for c in out)
        return pa.Table.from_arrays([pa.array(ids, pa.string()).take(q_at), names.take(c_at), s], schema=_SCORES)

    left = _dealt(rows, "clip_id" if whole else "row_id", "row_block", n, "query_block", m).groupBy("query_block", "row_block")
    right = _dealt(asked, "query_id", "query_block", m, "row_block", n).groupBy("query_block", "row_block")
    found = left.cogroup(right).applyInArrow(meet, "query_id string, clip_id string, score double")
    if n > 1 and not whole:
        found = found.groupBy("query_id", "clip_id").agg(F.max("score").alias("score"))
    if k is None:
        return found
    by = Window.partitionBy("query_id").orderBy(F.desc("score" if digits is None else F.round("score", digits)), "clip_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
