"""Label summaries, data set, motion, metric and log statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters, evaluation, labels, logs, stats
from .base import query

_C = "count(*) FILTER (label_type = 'manual') AS n_manual, count(*) FILTER (label_type = 'autolabel') AS n_autolabel, count(*) FILTER (start_time <> -1) AS n_timed"


@query("a01_label_state", "annotations", f"SELECT project, key, {_C} FROM annotations GROUP BY project, key")
def a01(spark, sf_dir, a):
    return labels.label_state(a)


@query("a02_label_state_by_key", "annotations", f"SELECT key, {_C} FROM annotations GROUP BY key")
def a02(spark, sf_dir, a):
    return labels.label_state(a, "key")


@query("a03_label_totals", "annotations", "SELECT count(*) FILTER (label_type = 'manual') AS n_manual, count(*) FILTER (label_type = 'autolabel') AS n_autolabel, count(*) FILTER (label_type IN ('manual', 'autolabel')) AS n_both FROM annotations WHERE project IN ('p0', 'p1')")
def a03(spark, sf_dir, a):
    return labels.label_totals(a, ["p0", "p1"])


@query("a04_option_set", "annotations", "SELECT key, count(*) AS n FROM annotations WHERE project = 'p0' AND label_type IN ('manual', 'autolabel') GROUP BY key")
def a04(spark, sf_dir, a):
    return labels.option_set(a, ["p0"])


@query("a05_options", "annotations clips", "SELECT DISTINCT 'project' AS kind, project AS name FROM annotations UNION SELECT 'label', key FROM annotations WHERE value IS NULL UNION SELECT 'metric', key FROM annotations WHERE value IS NOT NULL UNION SELECT 'data_source', trim(d) FROM (SELECT unnest(string_split(data_source, ',')) AS d FROM clips)")
def a05(spark, sf_dir, a, c):
    return labels.options(a, c)


@query("a06_multiplicity", "annotations", "SELECT project, key, clip_id, count(*) AS n FROM annotations WHERE value IS NULL GROUP BY ALL")
def a06(spark, sf_dir, a):
    return labels.multiplicity(a)


@query("a07_table_counts", "annotations clips", "SELECT 'annotations' AS name, count(*) AS n FROM annotations UNION ALL SELECT 'clips', count(*) FROM clips")
def a07(spark, sf_dir, a, c):
    one = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one(a, "annotations").unionByName(one(c, "clips"))


@query("a08_basic_stats", "ticks", "SELECT event_type, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(median(v), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.95), 6) AS p95 FROM ticks GROUP BY event_type")
def a08(spark, sf_dir, t):
    d = t.groupBy("event_type").agg(*stats.basic(F.col("v"), quantiles=(10, 95)))
    return d.select("event_type", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "p10", "p95")])


@query("a10_dataset_stats", "clips annotations captions", """SELECT data_source, count(*) AS n_clips, round(avg(ann), 6) AS ann_mean, round(avg(manual), 6) AS manual_mean, max(ann)::DOUBLE AS ann_max, round(quantile_cont(caps, 0.9), 6) AS caps_p90, round(any_value(ratio), 6) AS overlap_ratio FROM (
  SELECT trim(unnest(string_split(data_source, ','))) AS data_source, clip_id FROM clips) d
  LEFT JOIN (SELECT clip_id, count(*) AS a1, count(*) FILTER (label_type = 'manual') AS m1 FROM annotations WHERE value IS NULL GROUP BY clip_id) a USING (clip_id) LEFT JOIN (SELECT clip_id, count(*) AS c1 FROM captions GROUP BY clip_id) c USING (clip_id)
  LEFT JOIN (SELECT data_source, avg(hit) AS ratio FROM (SELECT trim(unnest(string_split(c.data_source, ','))) AS data_source, EXISTS (SELECT 1 FROM captions x WHERE x.clip_id = t.clip_id AND x.start_time <= t.end_time AND x.end_time >= t.start_time)::INT AS hit FROM annotations t JOIN clips c USING (clip_id) WHERE start_time <> -1 AND end_time >= start_time) GROUP BY data_source) r USING (data_source),
  LATERAL (SELECT coalesce(a1, 0) AS ann, coalesce(m1, 0) AS manual, coalesce(c1, 0) AS caps) GROUP BY data_source""")
def a10(spark, sf_dir, c, a, cap):
    d = stats.dataset(c, a, cap)
    return d.select("data_source", "n_clips", "ann_max", *[F.round(x, 6).alias(x) for x in ("ann_mean", "manual_mean", "caps_p90", "overlap_ratio")])


@query("a11_label_frequency", "clips annotations", "SELECT data_source, key, count(*) AS n FROM (SELECT trim(unnest(string_split(data_source, ','))) AS data_source, clip_id FROM clips) JOIN annotations USING (clip_id) WHERE value IS NULL GROUP BY ALL")
def a11(spark, sf_dir, c, a):
    return stats.label_frequency(c, a)


@query("a12_motion_stats", "ticks", """SELECT channel, level, count(*) AS n, round(avg(x)::DECIMAL(20, 6), 3)::DOUBLE AS mean, round(quantile_cont(x, 0.99)::DECIMAL(20, 6), 3)::DOUBLE AS p99 FROM (
  SELECT 'v' AS channel, 'frame' AS level, v AS x FROM ticks UNION ALL SELECT 'w', 'frame', v * v FROM ticks UNION ALL SELECT 'v', 'clip_mean', avg(v) FROM ticks GROUP BY user_id UNION ALL SELECT 'w', 'clip_mean', avg(v * v) FROM ticks GROUP BY user_id
  UNION ALL SELECT 'v', 'clip_max', max(v) FROM ticks GROUP BY user_id UNION ALL SELECT 'w', 'clip_max', max(v * v) FROM ticks GROUP BY user_id) GROUP BY channel, level""")
def a12(spark, sf_dir, t):
    f = t.select(F.col("user_id").alias("clip_id"), "v", (F.col("v") * F.col("v")).alias("w"))
    exact = lambda c: F.round(F.col(c).cast("decimal(20, 6)"), 3).cast("double").alias(c)  # noqa: E731  ties at the fourth digit go up in both engines
    return stats.motion(f, ["v", "w"]).select("channel", "level", "n", exact("mean"), exact("p99"))


@query("a13_histogram_2d", "ticks", """SELECT least(greatest(floor((v - a) / (b - a) * 20), 0), 19)::INT AS bx, least(greatest(floor((t - c) / (d - c) * 20), 0), 19)::INT AS "by", count(*) AS n, round(log10(count(*) + 1), 6) AS log_n
  FROM ticks, (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b, quantile_cont(t, 0.01) AS c, quantile_cont(t, 0.99) AS d FROM ticks) GROUP BY bx, "by\"""")
def a13(spark, sf_dir, t):
    return stats.histogram_2d(t, "v", "t", 20).withColumn("log_n", F.round("log_n", 6))


@query("a13_correlations", "ticks", "SELECT 'v' AS a, 't' AS b, round(corr(v, t), 6) AS corr FROM ticks UNION ALL SELECT 'v', 'user_id', round(corr(v, user_id), 6) FROM ticks UNION ALL SELECT 't', 'user_id', round(corr(t, user_id), 6) FROM ticks")
def a13b(spark, sf_dir, t):
    return stats.correlations(t, ["v", "t", "user_id"]).withColumn("corr", F.round("corr", 6))


@query("a14_reduced_metrics", "metrics", "SELECT model, metric, round(quantile_cont(value, 0.9), 6) AS value, count(DISTINCT clip_id) AS num_clips FROM metrics WHERE clip_id IN (SELECT clip_id FROM metrics GROUP BY clip_id HAVING count(DISTINCT model) = 3) GROUP BY model, metric")
def a14(spark, sf_dir, m):
    return stats.reduce_metrics(m, "p90", same_clips=True).withColumn("value", F.round("value", 6))


@query("a15_metric_matrix", "metrics", "SELECT model, clip_id, max(value) FILTER (metric = 'qty') AS qty, max(value) FILTER (metric = 'disc') AS disc FROM metrics GROUP BY model, clip_id")
def a15(spark, sf_dir, m):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return stats.metric_matrix(m, ["qty", "disc"], 2 * lines)  # a line makes at most one row of each metric


@query("a16_metric_series", "ticks", "SELECT event_type AS metric, round((event_id % 50 * 100000 - 7) / 1e6::DOUBLE, 6) AS t, round(avg(v), 6) AS value FROM ticks GROUP BY event_type, event_id % 50")
def a16(spark, sf_dir, t):
    s = t.select(F.lit("m").alias("model"), F.lit("c").alias("clip_id"), F.col("event_type").alias("metric"), (F.col("event_id") % 50 * 100000).alias("start_time"), F.lit(7).alias("origin_time"), F.col("v").alias("value"))
    return stats.metric_series(s).select("metric", F.round("t", 6).alias("t"), F.round("value", 6).alias("value"))


@query("a17_leaderboards", "metrics", "SELECT model, string_agg(metric, '|' ORDER BY metric) AS leaderboard FROM (SELECT DISTINCT model, metric FROM metrics) GROUP BY model")
def a17(spark, sf_dir, m):
    return stats.leaderboards(m)


@query("a18_grouped_means", "ticks", """SELECT 'all' AS grouping, 'all' AS name, count(*) AS n, round(avg(v), 6) AS v FROM ticks UNION ALL SELECT 'event_type', event_type, count(*), round(avg(v), 6) FROM ticks GROUP BY event_type
  UNION ALL SELECT 'third', CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE (event_id % 3)::VARCHAR END, count(*), round(avg(v), 6) FROM ticks GROUP BY event_id % 3""")
def a18(spark, sf_dir, t):
    d = t.withColumn("third", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3))
    return stats.by_group(d, ["event_type", "third"], ["v"]).withColumn("v", F.round("v", 6))


@query("a20_caption_coverage", "captions", "SELECT model_name, count(DISTINCT clip_id) AS n FROM captions GROUP BY model_name ORDER BY n DESC, model_name LIMIT 1")
def a20(spark, sf_dir, c):
    return clusters.highest_coverage(c)


@query("a30_source_counts", "clips", "SELECT trim(d) AS data_source, count(*) AS n FROM (SELECT unnest(string_split(data_source, ',')) AS d FROM clips) GROUP BY trim(d) ORDER BY n DESC, data_source LIMIT 10")
def a30(spark, sf_dir, c):
    return labels.source_counts(c, 10)


def _log(t):
    """Log lines from the event table."""
    n, e = F.col("event_id"), F.col("event_type")
    head = F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" "), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":00:00,123 "), F.when(n % 5 > 0, F.concat(F.lit("[user=u"), (F.col("user_id") % 9).cast("string"), F.lit("] "))).otherwise(""))
    sec = F.concat((n % 7).cast("string"), F.lit(".5"))
    msg = (
        F.when(e == "view", F.concat(F.lit('"GET /videos?search=w'), (n % 6).cast("string"), F.lit('&filter=x%20y HTTP/1.1" '), F.when(n % 10 == 0, "404").otherwise("200")))
        .when(e == "click", F.concat(F.lit("search=w"), (n % 6).cast("string"), F.lit(" from "), F.when(n % 2 == 0, "cache").otherwise("search"), F.lit(" "), (n % 4).cast("string"), F.lit(" took "), sec))
        .when(e == "error", F.concat(F.lit("S3 error fetching a/b"), (n % 3).cast("string"), F.lit(": NoSuchKey")))
        .when(e == "purchase", F.concat(F.lit("Adding label l"), (n % 4).cast("string"), F.lit(" for project p1 took "), sec))
        .otherwise(F.lit("hello"))
    )
    return t.select(F.concat(head, msg).alias("value"))


@query("a21_log_requests", "ticks", "SELECT CASE WHEN event_id % 10 = 0 THEN '404' ELSE '200' END AS name, count(*) AS n FROM ticks WHERE event_type = 'view' GROUP BY ALL")
def a21(spark, sf_dir, t):
    return logs.summary(logs.parse(_log(t)))["status"]


@query("a21_log_cache", "ticks", "SELECT round(avg((event_id % 2 = 0)::INT), 6) AS hit_rate, round(avg((event_id % 7 + 0.5::DOUBLE) * 1000) FILTER (event_id % 2 = 0), 6) AS hit_ms, round(avg((event_id % 7 + 0.5::DOUBLE) * 1000) FILTER (event_id % 2 = 1), 6) AS miss_ms, count(*) AS n FROM ticks WHERE event_type = 'click'")
def a21b(spark, sf_dir, t):
    d = logs.summary(logs.parse(_log(t)))["cache"]
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "hit_ms", "miss_ms")])


@query("a21_log_kinds", "ticks", "SELECT CASE event_type WHEN 'view' THEN 'http' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'cache_hit' ELSE 'cache_miss' END WHEN 'error' THEN 's3_error' WHEN 'purchase' THEN 'add' ELSE 'other' END AS name, count(*) AS n FROM ticks WHERE event_id % 28 + 1 BETWEEN 5 AND 20 GROUP BY ALL")
def a21c(spark, sf_dir, t):
    return logs.summary(logs.between(logs.parse(_log(t)), "2024-01-05", "2024-01-20"))["kinds"]


@query("a21_log_users_per_day", "ticks", "SELECT concat('2024-01-', lpad((event_id % 28 + 1)::VARCHAR, 2, '0')) AS name, count(DISTINCT user_id % 9) AS n FROM ticks WHERE event_id % 5 > 0 GROUP BY ALL")
def a21d(spark, sf_dir, t):
    return logs.summary(logs.parse(_log(t)))["users_per_day"]


@query("a22_log_top_searches", "ticks", "SELECT concat('w', event_id % 6) AS name, count(*) AS n FROM ticks WHERE event_type = 'view' GROUP BY ALL ORDER BY n DESC, name LIMIT 4")
def a22(spark, sf_dir, t):
    return logs.summary(logs.parse(_log(t)), 4)["search_texts"]


@query("a21_log_zero_results", "ticks", "SELECT concat('search=w', event_id % 6) AS name, count(*) AS n FROM ticks WHERE event_type = 'click' AND event_id % 4 = 0 GROUP BY ALL")
def a21e(spark, sf_dir, t):
    return logs.summary(logs.parse(_log(t)))["zero_result_keys"]


@query("x06_balanced_pairs", "captions", "SELECT uid, data_source FROM (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY uid) AS r FROM captions) WHERE r <= 7")
def x06(spark, sf_dir, c):
    return evaluation.balanced_pairs(c, "data_source", "uid", 7).select("uid", "data_source")


@query("fn_strings", "captions", r"""SELECT uid, trim(regexp_replace(caption, '\s+', ' ', 'g')) AS squeezed, lower(regexp_replace(caption, '[^A-Za-z0-9]+', '', 'g')) AS alnum, length(list_filter(string_split(trim(regexp_replace(caption, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS words FROM captions""")
def fn_strings(spark, sf_dir, c):
    x = F.col("caption")
    return c.select("uid", S.squeeze(x).alias("squeezed"), S.alphanumeric(x).alias("alnum"), S.word_count(x).cast("long").alias("words"))


@query("fn_math", "ticks", """SELECT event_id, round(1 / (1 + exp(-(v / 50 - 1))), 6) AS sig, round(CASE WHEN v > 0 THEN 2 / (1 / v + 1 / (v + 1)) ELSE 0 END, 6) AS hm, round(1 / (1 + v), 6) AS sim, round(v * cos(0.5::DOUBLE) + 2 * sin(0.5::DOUBLE), 6) AS fx FROM ticks""")
def fn_math(spark, sf_dir, t):
    from ..functions.vectors import to_similarity

    v = F.col("v")
    x, _ = S.to_frame(v, F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.5))
    return t.select("event_id", F.round(S.sigmoid(v / 50 - 1), 6).alias("sig"), F.round(S.harmonic_mean(v, v + 1), 6).alias("hm"), F.round(to_similarity(v), 6).alias("sim"), F.round(x, 6).alias("fx"))
