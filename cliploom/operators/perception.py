"""Filters on perception counts and ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of each sector in a frame's distances (fixed values).
SECTORS = {"FRONT_RIGHT": 0, "BACK_RIGHT": 1, "BACK": 2, "BACK_LEFT": 3, "FRONT_LEFT": 4, "FRONT": 5}
FPS = 10.0


def by_count(result: DataFrame, perception: DataFrame, cls: str, least: int, most: int | None = None) -> DataFrame:
    p = perception.filter((F.col("class") == cls) & (F.col("n") >= least))
    if most is not None:
        p = p.filter(F.col("n") <= most)
    return result.join(p.select("clip_id"), "clip_id", "left_semi")


def by_range(result: DataFrame, perception: DataFrame, cls: str, sectors: Sequence[str], max_dist: float, min_time: float) -> DataFrame:
    """Clips where some chosen sector is nearer than max_dist for more than min_time seconds; an unknown sector: none."""
    if not sectors or any(s not in SECTORS for s in sectors):
        return result.filter(F.lit(False))
    near = lambda f: reduce(lambda a, b: a | b, [F.coalesce(F.get(f, F.lit(SECTORS[s])) < max_dist, F.lit(False)) for s in sectors])
    seconds = F.size(F.filter("loc", near)) / FPS
    p = perception.filter((F.col("class") == cls) & F.col("loc").isNotNull() & (seconds > min_time))
    return result.join(p.select("clip_id"), "clip_id", "left_semi")


def to_long(wide: DataFrame) -> DataFrame:
    """clip_id, num_<class>, loc_<class> columns -> clip_id, class, n, loc."""
    classes = sorted(c[4:] for c in wide.columns if c.startswith("num_"))
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"num_{c}").cast("int").alias("n"), F.col(f"loc_{c}").alias("loc")) for c in classes])
    return wide.select("clip_id", F.explode(rows).alias("r")).select("clip_id", "r.*").filter("n is not null")
