"""Mutations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, mutations
from ..sources import writers
from .base import query

_ALL = "uid, project, clip_id, key, value, start_time, end_time, label_type"


@query("d01_add", "annotations", f"SELECT {_ALL} FROM annotations UNION ALL SELECT 'new', 'p0', '5', 'lane change', NULL, -1, -1, 'manual'")
def d01(spark, sf_dir, a):
    return mutations.add(a, "new", "p0", "5", "  lane   change ")


@query("d02_update_times", "annotations", "SELECT uid, CASE WHEN uid = 'q8' THEN 1.5 ELSE start_time END::DOUBLE AS start_time, CASE WHEN uid = 'q8' THEN 2.5 ELSE end_time END::DOUBLE AS end_time, CASE WHEN uid = 'q8' THEN 'manual' ELSE label_type END AS label_type FROM annotations")
def d02(spark, sf_dir, a):
    return mutations.update_times(a, "q8", 1.5, 2.5).select("uid", "start_time", "end_time", "label_type")


@query("d03_remove", "annotations", "SELECT uid FROM annotations WHERE uid <> 'q8'")
def d03(spark, sf_dir, a):
    return mutations.remove(a, "q8").select("uid")


@query("d04_verify", "annotations", "SELECT uid, CASE WHEN uid = 'q8' AND label_type = 'autolabel' THEN 'p9' ELSE project END AS project, CASE WHEN uid = 'q8' THEN 'manual' ELSE label_type END AS label_type FROM annotations")
def d04(spark, sf_dir, a):
    return mutations.verify(a, "q8", "p9").select("uid", "project", "label_type")


@query("d05_remove_label", "annotations", "SELECT uid FROM annotations WHERE NOT (key = 'quality' AND project = 'p0' AND label_type = 'autolabel')")
def d05(spark, sf_dir, a):
    return mutations.remove_label(a, "quality", "p0", True).select("uid")


@query("d06_rename", "annotations", "SELECT uid, CASE WHEN key IN ('toxic', 'unsafe') AND project = 'p1' THEN 'harm' ELSE key END AS key FROM annotations")
def d06(spark, sf_dir, a):
    return mutations.rename(a, ["toxic", "unsafe"], "harm", "p1").select("uid", "key")


@query("d07_add_many", "annotations clips", """SELECT uid, clip_id, label_type FROM annotations UNION ALL SELECT concat('b', clip_id), clip_id, 'numeric' FROM clips c WHERE clip_id::BIGINT % 2 = 0 AND NOT EXISTS (SELECT 1 FROM annotations a WHERE a.clip_id = c.clip_id AND key = 'n_chars' AND project = 'p1')""")
def d07(spark, sf_dir, a, c):
    n = c.filter("cast(clip_id as bigint) % 2 = 0").select(F.concat(F.lit("b"), "clip_id").alias("uid"), F.lit("p1").alias("project"), "clip_id", F.lit("n_chars").alias("key"), F.lit(1.0).alias("value"), F.lit(-1.0).alias("start_time"), F.lit(-1.0).alias("end_time"), F.lit("manual").alias("label_type"))
    return mutations.add_many(a, n.unionByName(n.withColumn("uid", F.concat(F.lit("z"), "uid")))).select("uid", "clip_id", "label_type")


@query("d08_autolabel_replace", "annotations clips", """SELECT clip_id, key, label_type FROM annotations WHERE NOT (key = 'quality' AND project = 'p0' AND label_type = 'autolabel')
  UNION ALL SELECT clip_id, 'quality', 'autolabel' FROM (SELECT clip_id FROM clips WHERE country = 'DE' ORDER BY clip_id::BIGINT LIMIT 25) c WHERE clip_id NOT IN (SELECT clip_id FROM annotations WHERE key = 'quality' AND project = 'p0' AND label_type <> 'autolabel')""")
def d08(spark, sf_dir, a, c):
    found = c.filter("country = 'DE'").select("clip_id", F.col("clip_id").cast("long").alias("ord"))
    return mutations.autolabel(a, found, "quality", "p0", "replace", 25).select("clip_id", "key", "label_type")


@query("d09_upsert_clips", "clips", """SELECT clip_id, CASE WHEN clip_id::BIGINT % 4 <> 0 THEN replace(data_source, ', ', ',') WHEN list_contains(list_transform(string_split(data_source, ','), lambda x: trim(x)), 'extra') THEN replace(data_source, ', ', ',') ELSE concat(replace(data_source, ', ', ','), ',extra') END AS data_source, country FROM clips
  UNION ALL SELECT concat('n', clip_id), 'extra', 'XX' FROM clips WHERE clip_id::BIGINT % 100 = 0""")
def d09(spark, sf_dir, c):
    n = F.col("clip_id").cast("long")
    new = c.filter(n % 4 == 0).select("clip_id", F.lit("extra").alias("data_source"), F.lit("XX").alias("country"))
    new = new.unionByName(c.filter(n % 100 == 0).select(F.concat(F.lit("n"), "clip_id").alias("clip_id"), F.lit("extra").alias("data_source"), F.lit("XX").alias("country")))
    return mutations.upsert_clips(c, new)


@query("d11_grants", "clips", "SELECT concat('u', i) AS username, s AS data_source FROM range(3) t(i), (SELECT 'src1' AS s UNION ALL SELECT 'src2') WHERE i > 0 OR s = 'src2'")
def d11(spark, sf_dir, c):
    users = spark.range(3).select(F.concat(F.lit("u"), "id").alias("username"))
    g = users.filter("username <> 'u0'").select("username", F.lit("src1").alias("data_source"))
    return mutations.grant(mutations.grant(g, users, "src2"), users, "src2")


@query("k01_annotation_export", "annotations", "SELECT clip_id, key, start_time, end_time, label_type FROM annotations WHERE value IS NULL")
def k01(spark, sf_dir, a):
    return writers.annotation_export(a)


@query("k02_annotation_summary", "annotations", "SELECT key, count(*) FILTER (label_type = 'manual') AS n_manual, count(*) FILTER (label_type = 'autolabel') AS n_autolabel, count(*) FILTER (start_time <> -1) AS n_timed, count(*) FILTER (label_type IN ('manual', 'autolabel')) AS total FROM annotations WHERE value IS NULL GROUP BY key")
def k02(spark, sf_dir, a):
    return writers.annotation_summary(a)


@query("k03_search_export", "clips annotations", "SELECT c.clip_id, data_source, key, label_type FROM clips c LEFT JOIN (SELECT * FROM annotations WHERE value IS NULL) a USING (clip_id) WHERE country = 'ES'")
def k03(spark, sf_dir, c, a):
    return writers.search_export(labels.by_country(c, c, "ES"), c, a).select("clip_id", "data_source", "key", "label_type")


@query("k04_nested_export", "annotations", "SELECT clip_id, count(*) AS n, string_agg(key, ',' ORDER BY key, label_type, start_time, end_time) AS keys FROM annotations WHERE value IS NULL AND label_type IN ('manual', 'autolabel') GROUP BY clip_id")
def k04(spark, sf_dir, a):
    return writers.nested_export(a).select("clip_id", F.size("annotations").cast("long").alias("n"), F.array_join(F.transform("annotations", lambda x: x["key"]), ",").alias("keys"))


@query("k09_scored_export", "scores", "SELECT clip_id, round(coalesce(max(p) FILTER (run_id = 'run0'), 0), 6) AS run0, round(coalesce(max(p) FILTER (run_id = 'run1'), 0), 6) AS run1, round(avg(p), 6) AS aggregate FROM scores GROUP BY clip_id")
def k09(spark, sf_dir, s):
    return writers.scored_export(s.withColumnsRenamed({"run_id": "dimension", "p": "score"}), ["run0", "run1"])
