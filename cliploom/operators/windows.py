"""Windows over time, sequences of equal values, and selections that depend on order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import token_jaccard  # noqa: F401  (the similarity that diverse() computes per pair)
from .joins import best_overlap


def subclips(duration: Column, length: float, overlap: float, least: float) -> Column:
    """Array of (k, start, end): sliding windows; a last one shorter than ``least`` goes."""
    step = length - overlap
    n = (F.ceil(F.greatest(duration - least, F.lit(0.0)) / step) + 1).cast("int")
    w = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), (k * step).alias("start"), F.least(k * step + length, duration).alias("end")))
    return F.filter(w, lambda x: x["end"] - x["start"] >= least)


def uniform_windows(start: Column, end: Column, interval: float, length: float) -> Column:
    """Array of (a, b): windows that start at multiples of the interval and end in time."""
    first = F.ceil(start / interval).cast("long")
    last = F.floor((end - length) / interval).cast("long")
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: F.struct((k * interval).alias("a"), (k * interval + length).alias("b")))).otherwise(
        F.array().cast("array<struct<a: double, b: double>>")
    )


def segments_from_frames(entries: DataFrame, bin_sec: float, fps: float = 10.0) -> DataFrame:
    """(video_id, first_frame, last_frame, value) -> video_id, start_sec, end_sec, value.

    Frames go by their centre into bins, a bin takes its most frequent value (ties: the smallest),
    and neighbouring bins of one value become one segment.
    """
    centre = (F.col("first_frame") + F.col("last_frame")) / 2.0 / fps
    b = entries.select("video_id", F.floor(centre / bin_sec).cast("long").alias("bin"), "value")
    n = b.groupBy("video_id", "bin", "value").agg(F.count("*").alias("n"))
    mode = n.groupBy("video_id", "bin").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return islands(mode, ["video_id"], "bin", "value").select(
        "video_id", (F.col("first") * bin_sec).alias("start_sec"), ((F.col("last") + 1) * bin_sec).alias("end_sec"), "value"
    )


def islands(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Runs of equal values at consecutive whole positions: keys, first, last, value, n."""
    by = Window.partitionBy(*keys).orderBy(at)
    new = ~(F.col(value).eqNullSafe(F.lag(value).over(by)) & (F.col(at) == F.lag(at).over(by) + 1))
    d = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(by))
    return d.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first(value).alias(value), F.count("*").alias("n")).drop("_run")


def labelled_candidates(videos: DataFrame, segments: DataFrame, length: float, stride: float) -> DataFrame:
    """Sliding windows of each video (video_id, start, end) that a command segment overlaps, with caption and command."""
    w = videos.select("video_id", F.explode(uniform_windows(F.col("start"), F.col("end"), stride, length)).alias("w")).select("video_id", "w.a", "w.b")
    pick = lambda kind, name: segments.filter(F.col("kind") == kind).select("video_id", "start_sec", "end_sec", F.col("value").alias(name))
    w = best_overlap(w, pick("command", "cmd"), "video_id", "cmd")
    return best_overlap(w.filter("cmd <> ''"), pick("caption", "cap"), "video_id", "cap")


def diverse(candidates: DataFrame, k: int, lam: float = 0.5) -> DataFrame:
    """Greedy choice per video of at most k windows that don't overlap in time: rare commands first, unlike those chosen.

    Candidates: video_id, a, b, cap, cmd; adds pick, from 0. Each step depends on those before, so it
    runs as one pandas group per video; a video's windows are bounded by its length. Ties: the earliest.
    """

    def similarity(x: tuple, y: tuple) -> float:
        union = x[0] | y[0]
        return 0.5 * (len(x[0] & y[0]) / len(union) if union else 0.0) + 0.5 * float(x[1] == y[1] and bool(x[1]))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["a", "b", "cap", "cmd"], kind="stable").reset_index(drop=True)
        counts = g["cmd"].value_counts()
        rarity = [math.log(len(g) / (counts[c] + 1)) for c in g["cmd"]]
        top = max(rarity) or 1.0
        marks = [(frozenset(str(c).lower().split()), m) for c, m in zip(g["cap"], g["cmd"], strict=True)]
        nearest, free, chosen = [0.0] * len(g), set(range(len(g))), []
        while free and len(chosen) < k:
            best = max(sorted(free), key=lambda i: lam * rarity[i] / top - (1 - lam) * nearest[i])
            chosen.append(best)
            a, b = g["a"][best], g["b"][best]
            free = {i for i in free if i != best and not (g["a"][i] < b and a < g["b"][i])}
            for i in free:
                nearest[i] = max(nearest[i], similarity(marks[i], marks[best]))
        out = g.loc[chosen].copy()
        out["pick"] = range(len(out))
        return out

    c = candidates.select("video_id", "a", "b", "cap", "cmd")
    return c.groupBy("video_id").applyInPandas(choose, "video_id string, a double, b double, cap string, cmd string, pick int")


def round_robin(ranked: DataFrame, group: str, rank: str, total: int) -> DataFrame:
    """The first ``total`` rows, taking every group's first, then every group's second, and so on."""
    return ranked.orderBy(rank, group).limit(total)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, by hash; the same for the same seed."""
    by = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= n).drop("_r")


#: Keys that one task may sort.
BIN = 100_000


def random_subset(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The rows of n keys drawn at random, of all if there are no more; the same keys for the same seed.

    Keys go by a digest. Counts by three of its hexadecimal digits, 4,096 at most, tell which bin the n-th key falls in, and
    a bin of more than BIN keys is counted by its next digits. Keys of the bins before it stay, and of that one bin the
    smallest digests. Rows without a key take no part.
    """
    rows = rows.filter(F.col(key).isNotNull())
    ids = rows.select(F.col(key).alias("key")).distinct().withColumn("digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"))))
    prefix, within, size = "", ids, BIN + 1
    while size > BIN and len(prefix) < 30:
        bins = within.groupBy(F.substring("digest", len(prefix) + 1, 3).alias("bin")).agg(F.count("*").alias("m"))
        edge = None
        for r in sorted(bins.collect()):  # 4,096 rows at most
            if r.m >= n:
                edge = r
                break
            n -= r.m
        if edge is None:
            return rows
        prefix, size = prefix + edge.bin, edge.m
        within = ids.filter(F.col("digest").startswith(prefix))
    kept = ids.filter(F.col("digest") < prefix).unionByName(within.orderBy("digest", "key").limit(n))
    return rows.join(kept.select(F.col("key").alias(key)), key, "left_semi")


def percentile_band(df: DataFrame, group: str, by: str, low: float, high: float, key: str = "clip_id") -> DataFrame:
    """Rows of each group from rank round(n * low / 100) up to round(n * high / 100), by ascending value; halves round to even."""
    w = Window.partitionBy(group)
    d = df.withColumns({"_r": F.row_number().over(w.orderBy(by, key)) - 1, "_n": F.count("*").over(w)})
    edge = lambda q: F.bround(F.col("_n") * F.lit(float(q)) / 100)
    return d.filter((F.col("_r") >= edge(low)) & (F.col("_r") < edge(high))).drop("_r", "_n")


def _ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers have it: by zero, an infinity or NaN."""
    by_zero = F.when(F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def gradients(df: DataFrame, keys: list[str], time: str, value: str, out: str, then: list[str] | None = None) -> DataFrame:
    """df plus the derivative of value by time, second order for uneven steps, one-sided at the ends.

    Rows of equal times go by the columns ``then`` (by value, without any); a step of no length gives an infinity or NaN.
    """
    by = Window.partitionBy(*keys).orderBy(time, *(then or [value]))
    v, t = F.col(value), F.col(time)
    vp, vn, tp, tn = F.lag(value).over(by), F.lead(value).over(by), F.lag(time).over(by), F.lead(time).over(by)
    hp, hn = t - tp, tn - t
    mid = _ratio(hp * hp * vn + (hn * hn - hp * hp) * v - hn * hn * vp, hp * hn * (hp + hn))
    return df.withColumn(out, F.when(hp.isNull(), _ratio(vn - v, hn)).when(hn.isNull(), _ratio(v - vp, hp)).otherwise(mid))


def savitzky_golay(df: DataFrame, keys: list[str], time: str, value: str, out: str, window: int = 11, order: int = 3) -> DataFrame:
    """df plus the smoothed value: a least-squares polynomial per window; at the ends, the first and last window's polynomial.

    Runs as one pandas group per key, as the ends need a fit of their own. Shorter groups stay as they are.
    """
    import numpy as np

    half = window // 2
    x = np.arange(-half, half + 1)
    basis = np.vander(x, order + 1, increasing=True)
    fit = np.linalg.pinv(basis)

    def smooth(batches: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        g = batches.sort_values(time, kind="stable").reset_index(drop=True)
        y = g[value].to_numpy(float)
        if len(y) < window:
            g[out] = y
            return g
        s = np.empty(len(y))
        s[half : len(y) - half] = np.lib.stride_tricks.sliding_window_view(y, window) @ fit[0]
        s[:half] = basis[:half] @ (fit @ y[:window])
        s[len(y) - half :] = basis[half + 1 :] @ (fit @ y[-window:])
        g[out] = s
        return g

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", {out} double"
    return df.groupBy(*keys).applyInPandas(smooth, schema)


def path_curvature(df: DataFrame, keys: list[str], time: str, least_kph: float = 2.0) -> DataFrame:
    """(x, y by time) plus speed and curvature; below the least speed the curvature is 0."""
    for a, b in (("x", "vx"), ("y", "vy"), ("vx", "ax"), ("vy", "ay")):
        df = gradients(df, keys, time, a, b, ["x", "y"])
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    k = F.abs(F.col("vx") * F.col("ay") - F.col("vy") * F.col("ax")) / F.pow(speed, 3)
    return df.withColumns({"speed": speed, "curvature": F.when(speed * 3.6 < least_kph, 0.0).otherwise(k)}).drop("vx", "vy", "ax", "ay")
