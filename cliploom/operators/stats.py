"""Data set, motion and metric statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import word_count
from .joins import explode_membership, overlapped


#: Rows of a task that groups rows by a key.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys to so many tasks that none groups more than TASK_ROWS on average; left as it is if the session has as many.

    For keys of few rows each, as rows travel before they are merged. rows: how many df has at most; counted if not given.
    """
    n, s = -(-(df.count() if rows is None else rows) // TASK_ROWS), df.sparkSession
    # small partitions of a session are merged until there are about as many as cores
    return df.repartition(n, *keys) if n > min(int(s.conf.get("spark.sql.shuffle.partitions")), s.sparkContext.defaultParallelism) else df


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def basic(c: Column, prefix: str = "", quantiles: Sequence[float] = ()) -> list[Column]:
    """n, mean, population deviation, min, max, median and percentiles of the finite values, as aggregates."""
    v = finite(c.cast("double"))
    out = [F.count(v).alias(f"{prefix}n"), F.avg(v).alias(f"{prefix}mean"), F.stddev_pop(v).alias(f"{prefix}std"), F.min(v).alias(f"{prefix}min"), F.max(v).alias(f"{prefix}max"), F.percentile(v, F.lit(0.5)).alias(f"{prefix}median")]
    return out + [F.percentile(v, F.lit(min(100.0, max(0.0, q)) / 100)).alias(f"{prefix}p{q:g}") for q in quantiles]


def dataset(clips: DataFrame, annotations: DataFrame, captions: DataFrame, width: float = 10.0) -> DataFrame:
    """One row per data source: counts per clip (zeros included), label durations, captions, and how many timed
    annotations a caption overlaps (each annotation once)."""
    a = annotations.filter("value is null").groupBy("clip_id").agg(
        F.count("*").alias("ann"), F.count_if(F.col("label_type") == "manual").alias("manual"), F.count_if(F.col("label_type") == "autolabel").alias("auto")
    )
    c = captions.groupBy("clip_id").agg(F.count("*").alias("caps"))
    per = explode_membership(clips).select("data_source", "clip_id").join(a, "clip_id", "left").join(c, "clip_id", "left").fillna(0, ["ann", "manual", "auto", "caps"])
    counts = per.groupBy("data_source").agg(F.count("*").alias("n_clips"), *[x for k in ("ann", "manual", "auto", "caps") for x in basic(F.col(k), f"{k}_", (90,))])
    ds = explode_membership(clips).select("data_source", "clip_id")
    timed = annotations.filter("start_time <> -1 and end_time >= start_time")
    hit = overlapped(timed, captions.select("clip_id", "start_time", "end_time"), "clip_id", width=width).select("uid", F.lit(1).alias("hit"))
    t = timed.join(hit, "uid", "left").join(ds, "clip_id").groupBy("data_source").agg(
        F.avg(F.col("end_time") - F.col("start_time")).alias("duration_mean"), F.avg(F.coalesce("hit", F.lit(0))).alias("overlap_ratio")
    )
    w = captions.select("clip_id", word_count(F.col("caption")).alias("words"), (F.col("end_time") - F.col("start_time")).alias("secs")).join(ds, "clip_id")
    w = w.groupBy("data_source").agg(F.avg("words").alias("words_mean"), F.avg("secs").alias("caption_secs_mean"))
    return counts.join(t, "data_source", "left").join(w, "data_source", "left")


def label_frequency(clips: DataFrame, annotations: DataFrame) -> DataFrame:
    """data_source, key, n: how often a label occurs on a source's clips."""
    ds = explode_membership(clips).select("data_source", "clip_id")
    return annotations.filter("value is null").join(ds, "clip_id").groupBy("data_source", "key").agg(F.count("*").alias("n"))


def motion(frames: DataFrame, channels: Sequence[str], quantiles: Sequence[float] = (1, 50, 99)) -> DataFrame:
    """(clip_id, channels...) rows per frame -> channel, level (frame, clip_mean, clip_max) and its statistics."""
    long = lambda df: df.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), finite(F.col(c).cast("double")).alias("v")) for c in channels])).alias("x")).select("clip_id", "x.*")
    f = long(frames)
    per = f.groupBy("clip_id", "channel").agg(F.avg("v").alias("m"), F.max("v").alias("x"))
    levels = f.select("channel", F.lit("frame").alias("level"), "v").unionByName(
        per.select("channel", F.explode(F.array(F.struct(F.lit("clip_mean").alias("level"), F.col("m").alias("v")), F.struct(F.lit("clip_max").alias("level"), F.col("x").alias("v")))).alias("y")).select("channel", "y.*")
    )
    return levels.groupBy("channel", "level").agg(*basic(F.col("v"), quantiles=quantiles))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 100, low: float = 1, high: float = 99) -> DataFrame:
    """bx, by, n, log10(n + 1): counts over a grid between the low and high percentiles, values beyond clipped."""
    q = df.agg(*[F.percentile(c, F.lit(p / 100)).alias(f"{k}{p:g}") for k, c in (("x", x), ("y", y)) for p in (low, high)]).head()

    def bin_of(c: str, k: str) -> Column:
        a, b = q[f"{k}{low:g}"], q[f"{k}{high:g}"]
        if a is None or a == b:
            return F.lit(0)
        return F.least(F.greatest(F.floor((F.col(c) - a) / (b - a) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")

    g = df.groupBy(bin_of(x, "x").alias("bx"), bin_of(y, "y").alias("by")).agg(F.count("*").alias("n"))
    return g.withColumn("log_n", F.log10(F.col("n") + 1))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr for each pair of columns, from one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


#: Reductions of a metric by name.
REDUCTIONS = {
    "mean": lambda v: F.avg(v), "median": lambda v: F.percentile(v, F.lit(0.5)), "p90": lambda v: F.percentile(v, F.lit(0.9)),
    "p95": lambda v: F.percentile(v, F.lit(0.95)), "max": lambda v: F.max(v),
}


def reduce_metrics(metrics: DataFrame, reduction: str, clips: DataFrame | None = None, same_clips: bool = False) -> DataFrame:
    """model, metric, value, num_clips over a clip set, NaN ignored; same_clips: only clips that every model has."""
    if reduction not in REDUCTIONS:
        raise ValueError(f"unknown reduction {reduction!r}")
    m = metrics if clips is None else metrics.join(clips.select("clip_id"), "clip_id", "left_semi")
    if same_clips:
        from .joins import common_to_all

        m = m.join(common_to_all(metrics.select("clip_id", "model").distinct(), "clip_id", "model"), "clip_id", "left_semi")
    v = F.when(~F.isnan("value"), F.col("value"))
    return m.groupBy("model", "metric").agg(REDUCTIONS[reduction](v).alias("value"), F.countDistinct("clip_id").alias("num_clips"))


def metric_matrix(metrics: DataFrame, names: Sequence[str], rows: int | None = None) -> DataFrame:
    """model, clip_id and a column per metric; NaN becomes null. rows: how many metrics has at most; counted if not given."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return spread(metrics, "model", "clip_id", rows=rows).groupBy("model", "clip_id").agg(*[F.max(F.when(F.col("metric") == n, v)).alias(n) for n in names])


def metric_series(series: DataFrame, origin: str = "origin_time") -> DataFrame:
    """Mean over the trajectories of a time; microseconds become seconds after the origin; metrics without any value go."""
    v = F.when(~F.isnan("value"), F.col("value"))
    t = ((F.col("start_time") - F.col(origin)) / 1e6).alias("t")
    return series.groupBy("model", "clip_id", "metric", t).agg(F.avg(v).alias("value")).filter("value is not null")


def leaderboards(metrics: DataFrame) -> DataFrame:
    """model, leaderboard: models with the same set of metric names share a board."""
    return metrics.groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("metric")), "|").alias("leaderboard"))


def by_group(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means by each key's values and over all: grouping, name, n, means. Missing keys count as unknown."""
    r = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("unknown")) for k in keys})
    groups = F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("name")), *[F.struct(F.lit(k).alias("grouping"), F.col(k).alias("name")) for k in keys])
    e = r.select(*values, F.explode(groups).alias("g")).select("g.*", *values)
    return e.groupBy("grouping", "name").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
