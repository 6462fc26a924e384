"""Joins with conditions: overlap, containment, nearest in time, interpolation, and joins with defaults.

Interval joins bin time, so both sides meet by equality on (key, bin) and only then by the
condition; a bin should be about as long as a typical interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import to_frame


def _bins(start: str, end: str, width: float) -> Column:
    first = F.floor(F.col(start) / width)
    return F.explode(F.sequence(first, F.greatest(first, F.floor(F.col(end) / width))))


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str = "start_time", end: str = "end_time", width: float = 10.0) -> DataFrame:
    """Pairs of left and right rows of one key whose closed intervals meet, each pair once.

    Right columns get the suffix _r. Interval ends before their starts meet nothing.
    """
    good = F.col(start) <= F.col(end)
    a = left.filter(good).withColumn("_bin", _bins(start, end, width))
    b = right.filter(good).withColumn("_bin", _bins(start, end, width))
    b = b.select(key, "_bin", *[F.col(c).alias(f"{c}_r") for c in right.columns if c != key])
    p = a.join(b, [key, "_bin"]).filter((F.col(f"{start}_r") <= F.col(end)) & (F.col(f"{end}_r") >= F.col(start)))
    # a pair meets in several bins; it counts in the first one of both
    return p.filter(F.col("_bin") == F.floor(F.greatest(start, f"{start}_r") / width)).drop("_bin")


def overlapped(left: DataFrame, right: DataFrame, key: str, start: str = "start_time", end: str = "end_time", width: float = 10.0) -> DataFrame:
    """Left rows that meet at least one right row, each once (needs a column uid)."""
    return left.join(overlapping(left, right, key, start, end, width).select("uid").distinct(), "uid", "left_semi")


def best_overlap(windows: DataFrame, segments: DataFrame, key: str, value: str, a: str = "a", b: str = "b", start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """windows plus the value of the segment with the largest positive overlap; ties: the earliest; none: ''."""
    w = windows.withColumn("_w", F.struct(key, a, b))
    s = segments.select(key, F.col(start).cast("double").alias("start_time"), F.col(end).cast("double").alias("end_time"), F.col(value).alias("v"))
    spans = w.select("_w", key, F.col(a).cast("double").alias("start_time"), F.col(b).cast("double").alias("end_time")).distinct()
    over = F.least("end_time", "end_time_r") - F.greatest("start_time", "start_time_r")
    j = overlapping(spans, s, key).withColumn("_o", over).filter("_o > 0")
    best = j.groupBy("_w").agg(F.max_by("v_r", F.struct(F.col("_o"), -F.col("start_time_r"), F.col("v_r"))).alias(value))
    return w.join(best, "_w", "left").withColumn(value, F.coalesce(value, F.lit(""))).drop("_w")


def live_users(sessions: DataFrame, users: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Sessions (session_id, username, created_at) younger than ``hours`` with their users; a session of no known user has none."""
    live = sessions.filter(F.col("created_at") > now - F.expr(f"interval {hours} hours"))
    return live.join(users, "username")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, tolerance: float, values: list[str], first: str | None = None) -> DataFrame:
    """left plus the values and time (_t) of the nearest right row of the keys within the tolerance; ties: the earlier.

    Of right rows at one time, the one with the smallest ``first`` counts; without it, the one with the smallest values.
    One sort of both sides together by time, and two running fills: no range join.
    """
    side = F.struct(F.col(time).alias("t"), *([F.col(first).alias("_first")] if first else []), *[F.col(v).alias(v) for v in values])
    none = F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType)
    u = left.select(*left.columns, none.alias("_s"), F.lit(1).alias("_side")).unionByName(
        right.select(*keys, time, side.alias("_s"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    back = Window.partitionBy(*keys).orderBy(time, "_side", F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(time), "_side", F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({"_p": F.last("_s", True).over(back), "_n": F.last("_s", True).over(ahead)}).filter("_side = 1")
    dp, dn = F.col(time) - F.col("_p.t"), F.col("_n.t") - F.col(time)
    pick = F.when(dp.isNotNull() & (dn.isNull() | (dp <= dn)) & (dp <= tolerance), F.col("_p")).when(dn <= tolerance, F.col("_n"))
    u = u.withColumn("_x", pick)
    return u.select(*left.columns, *[F.col(f"_x.{v}").alias(v) for v in values], F.col("_x.t").alias("_t"))


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """left plus each value linearly interpolated at its time; beyond the first and last sample, their values.

    Of samples at one time, the one with the largest values ends the time before it, the one with the smallest begins the time after.
    """
    side = F.struct(F.col(time).cast("double").alias("t"), *[F.col(v).cast("double").alias(v) for v in values])
    none = F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType)
    u = left.select(*left.columns, none.alias("_s"), F.lit(1).alias("_side")).unionByName(
        right.select(*keys, time, side.alias("_s"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    back = Window.partitionBy(*keys).orderBy(time, "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(time), "_side", F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({"_p": F.last("_s", True).over(back), "_n": F.last("_s", True).over(ahead)}).filter("_side = 1")

    def at(v: str) -> Column:
        p, n = F.col("_p"), F.col("_n")
        step = F.try_divide((n[v] - p[v]) * (F.col(time).cast("double") - p["t"]), n["t"] - p["t"])
        return F.when(p.isNull(), n[v]).when(n.isNull() | (n["t"] == p["t"]), p[v]).otherwise(p[v] + step).alias(v)

    return u.select(*left.columns, *[at(v) for v in values])


def explode_membership(clips: DataFrame, col: str = "data_source") -> DataFrame:
    """A row per token of the comma list."""
    from .labels import source_tokens

    return clips.withColumn(col, F.explode(source_tokens(col)))


def common_to_all(pairs: DataFrame, item: str, group: str) -> DataFrame:
    """Items that every group has."""
    n = pairs.select(F.countDistinct(group).alias("n_groups"))
    have = pairs.groupBy(item).agg(F.countDistinct(group).alias("n"))
    return have.join(F.broadcast(n), F.col("n") == F.col("n_groups")).select(item)  # one row


def with_annotations(clips: DataFrame, annotations: DataFrame, projects: list[str]) -> DataFrame:
    """Each clip once with its annotations of the projects, in uid order; without projects, with none."""
    hit = F.col("project").isin(projects) if projects else F.lit(False)
    a = annotations.filter(hit).groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("uid", "key", "start_time", "end_time", "label_type"))).alias("annotations")
    )
    empty = F.array().cast(a.schema["annotations"].dataType)
    return clips.join(a, "clip_id", "left").withColumn("annotations", F.coalesce("annotations", empty))


def caption_pairs(captions: DataFrame, reference: str, prediction: str) -> DataFrame:
    """One row per clip: the first caption, by uid, of each of two models."""
    one = lambda m, c: captions.filter(F.col("model_name") == m).groupBy("clip_id").agg(F.min_by("caption", "uid").alias(c))
    return one(reference, "reference").join(one(prediction, "prediction"), "clip_id")


def caption_of_model(captions: DataFrame, model: str) -> DataFrame:
    """The model's captions of a clip joined by a space, in uid order; empty ones skipped."""
    c = captions.filter((F.col("model_name") == model) & (F.trim("caption") != ""))
    return c.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", "caption"))), lambda x: x["caption"]), " ").alias("caption"))


def attach_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows with a non-empty path."""
    return rows.join(paths.filter(F.coalesce("path", F.lit("")) != "").select("clip_id", "path"), "clip_id")


def with_defaults(rows: DataFrame, dims: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join where missing rows and values take the defaults."""
    return rows.join(dims, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def obstacles_in_ego_frame(obstacles: DataFrame, ego: DataFrame, tolerance_us: int = 50_000, first: str | None = None) -> DataFrame:
    """Each track at each ego frame: the nearest observation within the tolerance, in the frame of the ego.

    Of a track's observations at one time, the one with the smallest ``first`` counts; without it, the one with the smallest values.
    """
    frames = ego.select("clip_id", "timestamp_us", F.col("x").alias("ego_x"), F.col("y").alias("ego_y"), F.col("yaw").alias("ego_yaw"))
    tracks = obstacles.select("clip_id", "track_id").distinct()
    grid = frames.join(tracks, "clip_id")
    values = ["center_x", "center_y", "size_x", "size_y", "yaw"]
    near = nearest(grid, obstacles, ["clip_id", "track_id"], "timestamp_us", tolerance_us, values, first).filter("_t is not null")
    x, y = to_frame(F.col("center_x"), F.col("center_y"), F.col("ego_x"), F.col("ego_y"), F.col("ego_yaw"))
    return near.select("clip_id", "track_id", "timestamp_us", x.alias("x"), y.alias("y"), "size_x", "size_y", (F.col("yaw") - F.col("ego_yaw")).alias("yaw"))
