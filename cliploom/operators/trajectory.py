"""Motion search: predicates over frame arrays, and nearest trajectories by shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions, vectors

#: Points of a full vector; samples a second; windows in seconds by tag (fixed values).
FULL_POINTS, RATE = 605, 30
WINDOWS = {"5s": ((0, 5), (5, 10), (10, 15), (15, 20)), "10s": ((0, 10), (5, 15), (10, 20))}


def by_motion(result: DataFrame, trajectories: DataFrame, expression: str | None = None, pattern: str | None = None) -> DataFrame:
    """Clips whose frames satisfy the expression, the named pattern, or both."""
    c = expressions.pattern(pattern, expression) if pattern else expressions.motion(expression)
    return result.join(trajectories.filter(c).select("clip_id"), "clip_id", "left_semi")


def channel(name: str, step: int = 1) -> Column:
    """A channel of the frames, every step-th sample."""
    return F.transform(F.filter("frames", lambda _, i: i % step == 0), lambda f: f[name])


def shape_vector(frames: Column, points: int) -> Column:
    """x and y of the frames about their centroid, cut or filled with zeros to ``points``, as one array."""
    f = F.slice(frames, 1, points)
    n = F.size(f)
    mean = lambda k: F.aggregate(f, F.lit(0.0), lambda s, p: s + p[k].cast("double")) / n
    # bound as a variable of the outer transform, so that the means are taken once a clip
    once = F.array(F.struct(mean("x").alias("mx"), mean("y").alias("my"), f.alias("f")))
    about = lambda m: F.flatten(F.transform(m["f"], lambda p: F.array(p["x"].cast("double") - m["mx"], p["y"].cast("double") - m["my"])))
    xy = F.transform(once, about)[0]
    return F.concat(xy, F.array_repeat(F.lit(0.0), F.lit(2 * points) - 2 * n))


def _finite(frames: str = "frames") -> Column:
    return ~F.exists(frames, lambda p: F.isnan(p["x"]) | F.isnan(p["y"]))


def shape_index(trajectories: DataFrame, tag: str = "full") -> DataFrame:
    """clip_id, window, vec: one vector per clip, or one per window, each about its own centroid; clips with NaN left out."""
    t = trajectories.filter(_finite() & (F.size("frames") > 0))
    if tag == "full":
        return t.select("clip_id", F.lit(0).alias("window"), shape_vector(F.col("frames"), FULL_POINTS).alias("vec"))
    points = (WINDOWS[tag][0][1] - WINDOWS[tag][0][0]) * RATE
    starts = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(a * RATE + 1).alias("at")) for k, (a, _) in enumerate(WINDOWS[tag])])
    w = t.select("clip_id", "frames", F.explode(starts).alias("w")).filter(F.size("frames") >= F.col("w.at"))
    return w.select("clip_id", "w.window", shape_vector(F.slice("frames", F.col("w.at"), points), points).alias("vec"))


def window_tag(start: float | None, end: float | None) -> str:
    """Which index serves a span: up to 6 s the 5 s windows, up to 15 s the 10 s windows, else the whole."""
    d = (20.0 if end is None else end) - (0.0 if start is None else start)
    return "5s" if d <= 6 else "10s" if d <= 15 else "full"


def window_tags(start: Column, end: Column) -> Column:
    """window_tag of columns."""
    d = F.coalesce(end, F.lit(20.0)) - F.coalesce(start, F.lit(0.0))
    return F.when(d <= 6, "5s").when(d <= 15, "10s").otherwise("full")


def window_of(tag: str, start: float | None) -> int:
    """The window that begins nearest to the span's start."""
    return 0 if tag == "full" else min(range(len(WINDOWS[tag])), key=lambda k: (abs(WINDOWS[tag][k][0] - (start or 0.0)), k))


def by_shape(trajectories: DataFrame, clip_id: str, k: int, start: float | None = None, end: float | None = None, pool: DataFrame | None = None) -> DataFrame:
    """clip_id, distance (squared L2): clips whose path is like the query clip's in the span.

    Of several windows of a clip the best counts; the query clip itself is there at 0.
    """
    tag = window_tag(start, end)
    own = shape_index(trajectories.filter(F.col("clip_id") == clip_id), tag)
    q = own.orderBy(F.abs(F.col("window") - window_of(tag, start)), "window").head()
    if q is None:
        return trajectories.select("clip_id", F.lit(0.0).alias("distance")).filter(F.lit(False))
    index = shape_index(trajectories if pool is None else trajectories.join(pool.select("clip_id"), "clip_id", "left_semi"), tag)
    d = index.select("clip_id", vectors.squared_l2("vec", vectors.vector(q.vec)).alias("distance"))
    me = trajectories.filter(F.col("clip_id") == clip_id).select("clip_id", F.lit(0.0).alias("distance")).limit(1)
    return d.unionByName(me).groupBy("clip_id").agg(F.min("distance").alias("distance")).orderBy("distance", "clip_id").limit(k)


def nearest_by_vector(index: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    d = index.select("clip_id", vectors.squared_l2("vec", vectors.vector(query)).alias("distance"))
    return d.groupBy("clip_id").agg(F.min("distance").alias("distance")).orderBy("distance", "clip_id").limit(k)
