"""Exports and run writers. Spark's committer makes each write atomic; runs are partitions by run_id."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import check_columns
from ..operators.labels import label_state, labels_only

#: Names that may be a folder beside other runs.
RUN_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def annotation_export(annotations: DataFrame) -> DataFrame:
    return labels_only(annotations).select("clip_id", "key", "start_time", "end_time", "label_type").orderBy("clip_id", "key", "start_time")


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("header", True).option("compression", compression).mode("overwrite").csv(path)


def annotation_summary(annotations: DataFrame) -> DataFrame:
    s = label_state(labels_only(annotations), "key")
    return s.withColumn("total", F.col("n_manual") + F.col("n_autolabel")).orderBy("key")


#: Sizes up to which a search export for a browser has annotations, sources, ids.
TIERS = (10_000, 500_000, 10_000_000)


def search_export(result: DataFrame, clips: DataFrame, annotations: DataFrame, tiers: tuple[int, int, int] | None = None) -> DataFrame:
    """A row per annotation (one without, for a clip that has none), whatever the size.

    With ``tiers``, such as TIERS, a larger result has clip and source, then ids only; ValueError beyond the last size.
    """
    r = result.select("clip_id").join(clips, "clip_id", "left")
    if tiers is not None:
        n = result.count()
        if n > tiers[2]:
            raise ValueError(f"{n} clips are too many for an export; the limit is {tiers[2]}")
        if n > tiers[1]:
            return result.select("clip_id")
        if n > tiers[0]:
            return r.select("clip_id", "data_source")
    a = labels_only(annotations).select("clip_id", "key", "start_time", "end_time", "label_type")
    return r.select("clip_id", "data_source").join(a, "clip_id", "left")


def nested_export(annotations: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """clip_id, annotations (structs): manual and automatic labels of the keys, of all without any."""
    a = labels_only(annotations).filter(F.col("label_type").isin("manual", "autolabel"))
    if keys is not None:
        a = a.filter(F.col("key").isin(list(keys)))
    return a.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("key", "label_type", "start_time", "end_time"))).alias("annotations"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def vote_export(votes: DataFrame, arena: str) -> DataFrame:
    return votes.filter(F.col("arena") == arena).orderBy("id")


def write_run(df: DataFrame, path: str, entity: str, sort: Sequence[str] = (), overwrite: bool = False) -> None:
    """Write a run's rows under its run_id partition after checking columns and keys; without overwrite, an existing run is an error."""
    check_columns(df, entity)
    bad = df.filter("run_id is null" + (" or clip_id is null" if "clip_id" in df.columns else "")).limit(1).count()
    if bad:
        raise ValueError(f"{entity}: rows without keys")
    spark = df.sparkSession
    if not overwrite:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            ids = [r.run_id for r in df.select("run_id").distinct().collect()]  # the runs of one call
            old = spark.read.parquet(path).filter(F.col("run_id").isin(ids)).limit(1).count()
            if old:
                raise FileExistsError(f"run {ids} is there already")
    # ranges rather than hashes of the run, so that a large run has several tasks
    out = df.repartitionByRange("run_id", *sort).sortWithinPartitions("run_id", *sort) if sort else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def weights_json(weights: DataFrame) -> DataFrame:
    """run_id, value: a classifier's weights as one JSON text a run, with the names that its reader expects."""
    return weights.select("run_id", F.to_json(F.struct("coef", "intercept")).alias("value"))


def write_weights(weights: DataFrame, path: str) -> None:
    """Classifier weights as JSON text, a folder per run."""
    check_columns(weights, "classifier_weights")
    weights_json(weights).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").text(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """run_id, coef, intercept as written by write_weights."""
    w = F.from_json("value", "coef array<double>, intercept double")
    return spark.read.text(path).select(F.col("run_id").cast("string").alias("run_id"), w.alias("w")).select("run_id", "w.*")


def stats_json(stats: DataFrame, key: str) -> DataFrame:
    """key, value: a row of statistics as one JSON text."""
    return stats.select(key, F.to_json(F.struct(*[c for c in stats.columns if c != key])).alias("value"))


def write_stats(stats: DataFrame, path: str, key: str) -> None:
    """Statistics as JSON text, a folder per key."""
    stats_json(stats, key).write.mode("overwrite").partitionBy(key).text(path)


def install_run(spark: SparkSession, uploaded: str, path: str, run_id: str, entity: str, overwrite: bool = False) -> None:
    """Check an uploaded run's name and rows and move its folder to its place in one rename.

    Without overwrite, a run that is there already is an error. With it, the old folder is renamed aside, where readers
    don't look, and deleted when the new one is in its place; if that fails, it comes back.
    """
    if not RUN_NAME.fullmatch(run_id):
        raise ValueError(f"not a name of a run: {run_id!r}")
    check_columns(spark.read.parquet(uploaded).withColumn("run_id", F.lit(run_id)), entity)
    place = spark._jvm.org.apache.hadoop.fs.Path
    src, dst = place(uploaded), place(f"{path}/run_id={run_id}")
    fs = dst.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = place(f"{path}/_old-{run_id}-{uuid.uuid4().hex}")
    there = fs.exists(dst)
    if there and not overwrite:
        raise FileExistsError(f"run {run_id} is there already")
    fs.mkdirs(dst.getParent())
    if there and not fs.rename(dst, aside):
        raise OSError(f"{dst} can't be moved")
    try:
        done = fs.rename(src, dst)
    except BaseException:
        if there:
            fs.rename(aside, dst)
        raise
    if not done:
        if there:
            fs.rename(aside, dst)
        raise OSError(f"{uploaded} can't be moved to {dst}")
    if there:
        fs.delete(aside, True)


def write_assignments(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Cluster assignments, by distance within each cluster."""
    write_run(df, path, "cluster_assignments", ("cluster_id", "distance", "clip_id"), overwrite)


def scored_export(scores: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """clip_id, a column per dimension (six decimals, missing 0), aggregate (mean of the dimensions there)."""
    one = [F.round(F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("score"))), F.lit(0.0)), 6).alias(d) for d in dimensions]
    return scores.groupBy("clip_id").agg(*one, F.round(F.avg("score"), 6).alias("aggregate"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "\t").mode("overwrite").csv(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append rows of keys that the table doesn't have; of several rows of a key, the first."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in df.columns]))).filter("_r = 1").drop("_r")
    df.write.mode("append").parquet(path)


def sampling_manifest(windows: DataFrame) -> DataFrame:
    return windows.orderBy("video_id", "a")


def structured_row(df: DataFrame, nested: Sequence[str]) -> DataFrame:
    """Nested columns as JSON strings."""
    return df.withColumns({c: F.to_json(c) for c in nested})


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small report table as Markdown."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
