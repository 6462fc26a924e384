"""Set operators on clip ids, ordered list operators, and score merging.

A result is a DataFrame with ``clip_id`` and any score columns; where order counts, ``ord`` carries it.
A family of sets is one DataFrame (set_id, clip_id), so ANY and ALL are one semi join each, however
many sets there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(result: DataFrame, keys: DataFrame) -> DataFrame:
    """Keep listed clips. With ``ord`` in keys, that order is imposed."""
    if "ord" in keys.columns:
        first = keys.groupBy("clip_id").agg(F.min("ord").alias("ord"))
        return result.drop("ord").join(first, "clip_id")
    return result.join(keys.select("clip_id"), "clip_id", "left_semi")


def in_all(sets: DataFrame, n_sets: int) -> DataFrame:
    """Clips that each of n_sets sets has."""
    return sets.groupBy("clip_id").agg(F.countDistinct("set_id").alias("n")).filter(F.col("n") == n_sets).select("clip_id")


def project_any(result: DataFrame, sets: DataFrame) -> DataFrame:
    """Keep clips of any set; no sets, no clips."""
    return result.join(sets.select("clip_id"), "clip_id", "left_semi")


def project_all(result: DataFrame, sets: DataFrame, n_sets: int) -> DataFrame:
    """Keep clips of all sets; no sets, no change."""
    return result if not n_sets else result.join(in_all(sets, n_sets), "clip_id", "left_semi")


def exclude_any(result: DataFrame, sets: DataFrame) -> DataFrame:
    return result.join(sets.select("clip_id"), "clip_id", "left_anti")


def exclude_all(result: DataFrame, sets: DataFrame, n_sets: int) -> DataFrame:
    """Drop clips that all sets have; no sets, no change."""
    return result if not n_sets else result.join(in_all(sets, n_sets), "clip_id", "left_anti")


def project_scores(result: DataFrame, *scored: DataFrame, value: str = "score") -> DataFrame:
    """Inner join of scored lists (clip_id, score, ord): adds score_0, score_1, ...; the last list gives the order.

    A clip that a list names twice takes its last row there.
    """
    for k, s in enumerate(scored):
        last = s.groupBy("clip_id").agg(F.max_by(value, "ord").alias(f"score_{k}"), F.max("ord").alias("_ord"))
        result = result.join(last, "clip_id")
        result = result.drop("ord").withColumnRenamed("_ord", "ord")
    return result


def union_lists(lists: DataFrame) -> DataFrame:
    """(list_no, pos, clip_id) -> distinct clips by first occurrence, ``ord`` from 1."""
    first = lists.groupBy("clip_id").agg(F.min(F.struct("list_no", "pos")).alias("at"))
    return _numbered(first, F.col("at"))


def intersect_lists(lists: DataFrame, n_lists: int) -> DataFrame:
    """Clips of all lists in the order of list 0."""
    every = in_all(lists.withColumnRenamed("list_no", "set_id"), n_lists)
    first = lists.filter("list_no = 0").groupBy("clip_id").agg(F.min("pos").alias("at"))
    return _numbered(first.join(every, "clip_id", "left_semi"), F.col("at"))


def subtract_lists(lists: DataFrame) -> DataFrame:
    """Clips of list 0, in its order, that no other list has."""
    rest = lists.filter("list_no > 0").select("clip_id")
    first = lists.filter("list_no = 0").groupBy("clip_id").agg(F.min("pos").alias("at"))
    return _numbered(first.join(rest, "clip_id", "left_anti"), F.col("at"))


def _numbered(df: DataFrame, by: Column) -> DataFrame:
    # a report in list order: one number for each row of the lists that a caller passes
    return df.select("clip_id", F.row_number().over(Window.orderBy(by, "clip_id")).alias("ord"))


def combine_searches(lists: DataFrame, mode: str, n_lists: int, cap: int | None = None) -> DataFrame:
    """Combine ranked lists (list_no, pos from 0, clip_id), each cut to ``cap``: union, intersection or subtract."""
    if cap is not None:
        lists = lists.filter(F.col("pos") < cap)
    if mode == "union":
        return union_lists(lists)
    if mode == "intersection":
        return intersect_lists(lists, n_lists)
    if mode == "subtract":
        return subtract_lists(lists)
    raise ValueError(f"unknown mode {mode!r}")


def score_vectors(scores: DataFrame) -> DataFrame:
    """(clip_id, dimension, score) -> clip_id, scores (map), aggregate: the mean of finite scores."""
    finite = F.when(~F.isnan("score") & (F.abs("score") != float("inf")), F.col("score"))
    one = scores.groupBy("clip_id", "dimension").agg(F.max(finite).alias("score"))
    return one.groupBy("clip_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("dimension", "score"))))).alias("scores"),
        F.avg("score").alias("aggregate"),
    )


def presence_vectors(found: DataFrame, enriched: DataFrame, top: int = 20) -> DataFrame:
    """(clip_id, dimension, pos) -> score 1.0 for being found; the first ``top`` of a dimension take their own score."""
    e = enriched.select("clip_id", "dimension", F.col("score").alias("_s"))
    s = found.join(e, ["clip_id", "dimension"], "left")
    return s.select("clip_id", "dimension", F.when(F.col("pos") < top, F.coalesce("_s", F.lit(1.0))).otherwise(1.0).alias("score"))


def merge_scored(*lists: DataFrame) -> DataFrame:
    """Best score per (clip, dimension) over scored lists; negative values count as 0."""
    every = reduce(DataFrame.unionByName, lists)
    return every.groupBy("clip_id", "dimension").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def combine_classifiers(scores: DataFrame, thresholds: dict[str, float], op: str = "and") -> DataFrame:
    """(run_id, clip_id, p): clips above each run's threshold in all runs (and) or any (or), with their hits."""
    hit = reduce(lambda a, b: a | b, [(F.col("run_id") == r) & (F.col("p") > t) for r, t in thresholds.items()])
    n = scores.filter(hit).groupBy("clip_id").agg(F.countDistinct("run_id").alias("n_hits"))
    return n.filter(F.col("n_hits") >= (len(thresholds) if op == "and" else 1))
