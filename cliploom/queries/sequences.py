"""Joins in time, windows, runs and order-dependent choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, windows
from .base import query


@query("j02_inner_annotations", "clips annotations", "SELECT c.clip_id, c.country, a.key, a.label_type FROM clips c JOIN annotations a USING (clip_id) WHERE a.value IS NULL")
def j02(spark, sf_dir, c, a):
    return c.join(a.filter("value is null"), "clip_id").select("clip_id", "country", "key", "label_type")


@query("j06_caption_pairs", "captions", "SELECT clip_id, min_by(caption, uid) FILTER (model_name = 'model_b') AS reference, min_by(caption, uid) FILTER (model_name = 'model_a') AS prediction FROM captions GROUP BY clip_id HAVING count(DISTINCT model_name) = 2")
def j06(spark, sf_dir, c):
    return joins.caption_pairs(c, "model_b", "model_a")


@query("j07_overlap_pairs", "intervals others", "SELECT a.uid, b.oid FROM intervals a JOIN others b ON a.k = b.k AND b.start_time <= a.end_time AND b.end_time >= a.start_time WHERE a.start_time <= a.end_time AND b.start_time <= b.end_time")
def j07(spark, sf_dir, a, b):
    return joins.overlapping(a, b, "k").select("uid", F.col("oid_r").alias("oid"))


@query("j08_overlap_once", "intervals others", "SELECT uid FROM intervals a WHERE EXISTS (SELECT 1 FROM others b WHERE a.k = b.k AND b.start_time <= a.end_time AND b.end_time >= a.start_time AND b.start_time <= b.end_time) AND a.start_time <= a.end_time")
def j08(spark, sf_dir, a, b):
    return joins.overlapped(a, b, "k").select("uid")


@query("j09_best_overlap", "intervals others", """SELECT uid, coalesce((SELECT b.oid::VARCHAR FROM others b WHERE b.k = a.k AND least(b.end_time, a.end_time) > greatest(b.start_time, a.start_time)
  ORDER BY least(b.end_time, a.end_time) - greatest(b.start_time, a.start_time) DESC, b.start_time, b.oid::VARCHAR DESC LIMIT 1), '') AS best FROM intervals a""")
def j09(spark, sf_dir, a, b):
    o = b.withColumn("best", F.col("oid").cast("string"))
    return joins.best_overlap(a, o, "k", "best", "start_time", "end_time", "start_time", "end_time").select("uid", "best")


@query("j10_nearest_in_time", "ticks", """SELECT event_id, near_v FROM (SELECT a.event_id, b.v AS near_v, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.t) AS r FROM ticks a LEFT JOIN ticks b ON a.user_id = b.user_id AND b.event_type = 'click' AND abs(a.t - b.t) <= 400 WHERE a.event_type = 'error') WHERE r = 1""")
def j10(spark, sf_dir, t):
    right = t.filter("event_type = 'click'").select("user_id", "t", F.col("v").alias("near_v"), "event_id")
    return joins.nearest(t.filter("event_type = 'error'").select("event_id", "user_id", "t"), right, ["user_id"], "t", 400, ["near_v"], "event_id").select("event_id", "near_v")


@query("j11_interpolate", "ticks", """SELECT event_id, round(CASE WHEN p.t IS NULL THEN n.v WHEN n.t IS NULL OR n.t = p.t THEN p.v ELSE p.v + (n.v - p.v) * (a.t - p.t)::DOUBLE / (n.t - p.t) END, 6) AS v FROM (
  SELECT event_id, user_id, t, (SELECT max({'t': b.t, 'v': b.v}) FROM ticks b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.t <= a.t) AS p,
  (SELECT min({'t': b.t, 'v': b.v}) FROM ticks b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.t >= a.t) AS n FROM ticks a WHERE event_type = 'error') a""")
def j11(spark, sf_dir, t):
    right = t.filter("event_type = 'click'").select("user_id", "t", "v")
    r = joins.interpolate(t.filter("event_type = 'error'").select("event_id", "user_id", "t"), right, ["user_id"], "t", ["v"])
    return r.select("event_id", F.round("v", 6).alias("v"))


@query("j12_explode_sources", "clips", "SELECT clip_id, trim(unnest(string_split(data_source, ','))) AS data_source FROM clips")
def j12(spark, sf_dir, c):
    return joins.explode_membership(c).select("clip_id", "data_source")


@query("j13_common_clips", "metrics", "SELECT clip_id FROM metrics GROUP BY clip_id HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM metrics)")
def j13(spark, sf_dir, m):
    return joins.common_to_all(m, "clip_id", "model")


@query("j16_obstacles_ego_frame", "ticks", """SELECT frame, track, round((x - ex) * cos(ey) + (y - eyy) * sin(ey), 6) AS x, round(-(x - ex) * sin(ey) + (y - eyy) * cos(ey), 6) AS y FROM (
  SELECT e.t AS frame, e.v AS ex, e.v / 2 AS eyy, e.v / 30 AS ey, o.event_type AS track, o.v AS x, o.v * 3 AS y, row_number() OVER (PARTITION BY e.event_id, o.event_type ORDER BY abs(e.t - o.t), o.t) AS r
  FROM ticks e JOIN ticks o ON e.user_id = o.user_id AND abs(e.t - o.t) <= 900 AND o.event_type IN ('click', 'view') WHERE e.event_type = 'purchase') WHERE r = 1""")
def j16(spark, sf_dir, t):
    ego = t.filter("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("clip_id"), F.col("t").alias("timestamp_us"), F.col("v").alias("x"), (F.col("v") / 2).alias("y"), (F.col("v") / 30).alias("yaw"))
    obs = t.filter("event_type in ('click', 'view')").select(
        F.col("user_id").cast("string").alias("clip_id"), F.when(F.col("event_type") == "click", 1).otherwise(2).cast("long").alias("track_id"), F.col("t").alias("timestamp_us"),
        F.col("v").alias("center_x"), (F.col("v") * 3).alias("center_y"), F.lit(1.0).alias("size_x"), F.lit(1.0).alias("size_y"), F.lit(0.0).alias("yaw"), "event_id",
    )
    r = joins.obstacles_in_ego_frame(obs, ego, 900, "event_id")
    return r.select(F.col("timestamp_us").alias("frame"), F.when(F.col("track_id") == 1, "click").otherwise("view").alias("track"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("j18_dataset_defaults", "clips datasets", "SELECT n.name, coalesce(category, 'Other/unknown') AS category, coalesce(license, 'Other/unknown') AS license FROM (SELECT DISTINCT trim(unnest(string_split(data_source, ','))) AS name FROM clips) n LEFT JOIN datasets USING (name)")
def j18(spark, sf_dir, c, d):
    from ..operators.labels import dataset_metadata

    return dataset_metadata(joins.explode_membership(c).select(F.col("data_source").alias("name")).distinct(), d)


@query("j19_attach_paths", "clips video_paths", "SELECT clip_id, path FROM clips JOIN video_paths USING (clip_id)")
def j19(spark, sf_dir, c, v):
    return joins.attach_paths(c, v).select("clip_id", "path")


@query("a32_caption_of_model", "captions", "SELECT clip_id, string_agg(caption, ' ' ORDER BY uid) AS caption FROM captions WHERE model_name = 'model_a' AND trim(caption) <> '' GROUP BY clip_id")
def a32(spark, sf_dir, c):
    return joins.caption_of_model(c, "model_a")


@query("w06_subclips", "captions", """SELECT uid, k, round(k * 3.5::DOUBLE, 6) AS start, round(least(k * 3.5::DOUBLE + 5, d), 6) AS "end" FROM (SELECT uid, d, unnest(range(ceil(greatest(d - 1, 0) / 3.5)::BIGINT + 1)) AS k FROM (SELECT uid, length(caption) / 50.0::DOUBLE AS d FROM captions)) WHERE least(k * 3.5::DOUBLE + 5, d) - k * 3.5::DOUBLE >= 1""")
def w06(spark, sf_dir, c):
    d = c.select("uid", F.explode(windows.subclips(F.length("caption") / 50.0, 5.0, 1.5, 1.0)).alias("w"))
    return d.select("uid", F.col("w.k").cast("long").alias("k"), F.round("w.start", 6).alias("start"), F.round("w.end", 6).alias("end"))


@query("w07_uniform_windows", "intervals", "SELECT uid, k * 2.5::DOUBLE AS a, k * 2.5::DOUBLE + 4 AS b FROM (SELECT uid, unnest(range(ceil(start_time / 2.5)::BIGINT, floor((end_time - 4) / 2.5)::BIGINT + 1)) AS k FROM intervals)")
def w07(spark, sf_dir, i):
    return i.select("uid", F.explode(windows.uniform_windows(F.col("start_time"), F.col("end_time"), 2.5, 4.0)).alias("w")).select("uid", "w.a", "w.b")


@query("w08_segments", "ticks", """SELECT video_id, min(bin)::DOUBLE * 5 AS start_sec, (max(bin) + 1)::DOUBLE * 5 AS end_sec, value FROM (SELECT *, bin - row_number() OVER (PARTITION BY video_id, value ORDER BY bin) AS g FROM (
  SELECT video_id, bin, arg_min(value, (-n, value)) AS value FROM (SELECT user_id AS video_id, floor((event_id % 900 + 0.5) / 50)::BIGINT AS bin, event_type AS value, count(*) AS n FROM ticks GROUP BY ALL) GROUP BY video_id, bin)) GROUP BY video_id, value, g""")
def w08(spark, sf_dir, t):
    e = t.select(F.col("user_id").alias("video_id"), (F.col("event_id") % 900).alias("first_frame"), (F.col("event_id") % 900 + 1).alias("last_frame"), F.col("event_type").alias("value"))
    return windows.segments_from_frames(e, 5.0)


@query("a26_bin_mode", "ticks", "SELECT user_id AS video_id, floor(event_id / 100)::BIGINT AS bin, arg_min(event_type, (-n, event_type)) AS value FROM (SELECT user_id, event_id - event_id % 100 AS event_id, event_type, count(*) AS n FROM ticks GROUP BY ALL) GROUP BY ALL")
def a26(spark, sf_dir, t):
    n = t.groupBy(F.col("user_id").alias("video_id"), F.floor(F.col("event_id") / 100).cast("long").alias("bin"), "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("video_id", "bin").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("value"))


@query("w10_gradient", "ticks", """SELECT event_id, round(CASE WHEN hp IS NULL THEN (vn - v) / hn WHEN hn IS NULL THEN (v - vp) / hp ELSE (hp * hp * vn + (hn * hn - hp * hp) * v - hn * hn * vp) / (hp * hn * (hp + hn)) END, 6) AS dv FROM (
  SELECT event_id, v, lag(v) OVER w AS vp, lead(v) OVER w AS vn, (t - lag(t) OVER w)::DOUBLE AS hp, (lead(t) OVER w - t)::DOUBLE AS hn FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY t))""")
def w10(spark, sf_dir, t):
    return windows.gradients(t.withColumn("t", F.col("t").cast("double")), ["user_id"], "t", "v", "dv", ["event_id"]).select("event_id", (F.round(F.col("dv") * 1e6) / 1e6).alias("dv"))  # as SQL rounds: the product, not the digits


@query("w10_savitzky_golay", "ticks")
def w10b(spark, sf_dir, t):
    return windows.savitzky_golay(t.select("user_id", "t", "v"), ["user_id"], "t", "v", "smooth")


@query("w14_diverse_windows", "ticks")
def w14(spark, sf_dir, t):
    c = t.select(F.col("user_id").cast("string").alias("video_id"), (F.col("event_id") % 600).cast("double").alias("a"), (F.col("event_id") % 600 + 20).cast("double").alias("b"), F.concat_ws(" ", "event_type", F.floor("v").cast("string")).alias("cap"), F.col("event_type").alias("cmd"))
    return windows.diverse(c, 5)


@query("w15_round_robin", "ticks", "SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM ticks) ORDER BY r, user_id LIMIT 200")
def w15(spark, sf_dir, t):
    r = t.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("r"))
    return windows.round_robin(r, "user_id", "r", 200)


@query("w16_sample_per_group", "assignments")
def w16(spark, sf_dir, a):
    return windows.sample_per_group(a, "cluster_id", "clip_id", 20)


@query("f38_labelled_candidates", "intervals others")
def f38(spark, sf_dir, a, b):
    seg = b.select(F.col("k").cast("string").alias("video_id"), F.col("start_time").alias("start_sec"), F.col("end_time").alias("end_sec"), F.lit("command").alias("kind"), F.col("oid").cast("string").alias("value"))
    seg = seg.unionByName(seg.withColumn("kind", F.lit("caption")))
    v = a.groupBy(F.col("k").cast("string").alias("video_id")).agg(F.min("start_time").alias("start"), F.max("end_time").alias("end"))
    return windows.labelled_candidates(v, seg, 10.0, 50.0)


@query("s12_static_shard", "clips", "SELECT clip_id FROM (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS r FROM clips) WHERE r % 4 = 1")
def s12(spark, sf_dir, c):
    from ..sources.readers import shard

    return shard(c, "clip_id", 1, 4).select("clip_id")


@query("s06_downsampled_channel", "ticks", "SELECT user_id::STRING AS clip_id, i::BIGINT AS i, x FROM (SELECT user_id, (r - 1) / 10 AS i, v::FLOAT::DOUBLE AS x, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM ticks)) WHERE (r - 1) % 10 = 0")
def s06(spark, sf_dir, t):
    from ..operators.trajectory import channel
    from .search import _tracks

    return _tracks(t).select("clip_id", F.posexplode(channel("x", 10)).alias("i", "x")).select("clip_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query("v11_trajectory_shape", "ticks", """SELECT clip_id, round(d, 4) AS distance FROM (WITH p AS (SELECT user_id, r, v::FLOAT::DOUBLE - avg(v::FLOAT::DOUBLE) OVER w AS x, (v * 2)::FLOAT::DOUBLE - avg((v * 2)::FLOAT::DOUBLE) OVER w AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM ticks) WHERE r <= 605 WINDOW w AS (PARTITION BY user_id)),
  q AS (SELECT r, x, y FROM p WHERE user_id = 3), u AS (SELECT DISTINCT user_id FROM p), n AS (SELECT max(r) AS n FROM p)
  SELECT u.user_id::STRING AS clip_id, sum(pow(coalesce(p.x, 0) - coalesce(q.x, 0), 2) + pow(coalesce(p.y, 0) - coalesce(q.y, 0), 2)) AS d FROM u, range(1, 606) t(i) LEFT JOIN p ON p.user_id = u.user_id AND p.r = i LEFT JOIN q ON q.r = i GROUP BY u.user_id) ORDER BY d, clip_id LIMIT 15""")
def v11(spark, sf_dir, t):
    from ..operators.trajectory import by_shape
    from .search import _tracks

    return by_shape(_tracks(t), "3", 15).select("clip_id", F.round("distance", 4).alias("distance"))


@query("v12_subtrajectory_windows", "ticks")
def v12(spark, sf_dir, t):
    from ..operators.trajectory import by_shape
    from .search import _tracks

    return by_shape(_tracks(t), "3", 15, 0.0, 5.0)
