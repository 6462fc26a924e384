"""Changes to annotations and metadata as copies: each returns the table after the change.

A caller writes the result over the partitions that changed (partitioned by project, say).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import squeeze
from ..model import schema


def add(annotations: DataFrame, uid: str, project: str, clip_id: str, key: str, label_type: str = "manual", start: float = -1.0, end: float = -1.0) -> DataFrame:
    new = annotations.sparkSession.createDataFrame([(uid, project, clip_id, key, None, start, end, label_type)], schema("annotations"))
    return annotations.unionByName(new.withColumn("key", squeeze(F.col("key"))))


def _update(annotations: DataFrame, hit: Column, **values: Column) -> DataFrame:
    return annotations.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def update_times(annotations: DataFrame, uid: str, start: float, end: float) -> DataFrame:
    """New times; whoever sets times has looked, so the label counts as manual."""
    return _update(annotations, F.col("uid") == uid, start_time=F.lit(start), end_time=F.lit(end), label_type=F.lit("manual"))


def remove(annotations: DataFrame, uid: str) -> DataFrame:
    return annotations.filter(F.col("uid") != uid)


def verify(annotations: DataFrame, uid: str, project: str | None = None) -> DataFrame:
    """An automatic label becomes manual and may move to another project."""
    hit = (F.col("uid") == uid) & (F.col("label_type") == "autolabel")
    return _update(annotations, hit, label_type=F.lit("manual"), project=F.col("project") if project is None else F.lit(project))


def remove_label(annotations: DataFrame, key: str, project: str, autolabel_only: bool = False) -> DataFrame:
    hit = (F.col("key") == key) & (F.col("project") == project)
    return annotations.filter(~(hit & (F.col("label_type") == "autolabel") if autolabel_only else hit))


def rename(annotations: DataFrame, old: Sequence[str], new: str, project: str) -> DataFrame:
    """Rename a label, or merge several into one."""
    return _update(annotations, F.col("key").isin(list(old)) & (F.col("project") == project), key=F.lit(new))


def add_many(annotations: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of (project, clip, key) that aren't there yet, each once, the first uid of several; with a value they are numeric."""
    k = ["project", "clip_id", "key"]
    n = new.withColumn("label_type", F.when(F.col("value").isNotNull(), "numeric").otherwise(F.col("label_type")))
    n = n.withColumn("_r", F.row_number().over(Window.partitionBy(*k).orderBy("uid"))).filter("_r = 1").drop("_r")
    return annotations.unionByName(n.join(annotations, k, "left_anti"))


def autolabel(annotations: DataFrame, found: DataFrame, key: str, project: str, mode: str = "union", limit: int | None = None) -> DataFrame:
    """Label a ranked query result (clip_id, ord): union adds, replace clears the label's automatic rows first, clear only clears."""
    if mode not in ("union", "replace", "clear"):
        raise ValueError(f"unknown mode {mode!r}")
    base = annotations if mode == "union" else remove_label(annotations, key, project, True)
    if mode == "clear":
        return base
    clips = found if limit is None else found.orderBy("ord").limit(limit)
    new = clips.select(
        F.concat_ws(":", F.lit("auto"), F.lit(project), F.lit(key), "clip_id").alias("uid"), F.lit(project).alias("project"), "clip_id", F.lit(key).alias("key"),
        F.lit(None).cast("double").alias("value"), F.lit(-1.0).alias("start_time"), F.lit(-1.0).alias("end_time"), F.lit("autolabel").alias("label_type"),
    )
    return add_many(base, new)


def upsert_clips(clips: DataFrame, new: DataFrame) -> DataFrame:
    """New clips, and known ones with the new data sources appended once to their list; a clip that is new twice is one row."""
    from .labels import source_tokens

    n = new.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_set("data_source")), ",").alias("_d"), F.min("country").alias("_c"))
    j = clips.join(n, "clip_id", "full")
    tokens = F.array_distinct(F.concat(source_tokens(), source_tokens("_d")))
    return j.select("clip_id", F.array_join(tokens, ",").alias("data_source"), F.coalesce("country", "_c").alias("country"))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def grant(grants: DataFrame, users: DataFrame, data_source: str) -> DataFrame:
    """A data source granted to all the users, once each."""
    return grants.unionByName(users.select("username", F.lit(data_source).alias("data_source"))).distinct()


def set_grants(grants: DataFrame, username: str, sources: Sequence[str]) -> DataFrame:
    new = grants.sparkSession.createDataFrame([(username, s) for s in dict.fromkeys(sources)], schema("grants"))
    return grants.filter(F.col("username") != username).unionByName(new)


def granted(grants: DataFrame, username: str) -> list[str]:
    """A user's data sources, for allowed_sources()."""
    return sorted(r.data_source for r in grants.filter(F.col("username") == username).select("data_source").distinct().collect())
