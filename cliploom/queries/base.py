"""Stand-in tables and the registry.

A stand-in is one SQL text that both engines run; Spark gets it as a DataFrame, an oracle as a WITH
item of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.stats import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STANDINS = {
    "clips": "SELECT CAST(doc_id AS STRING) AS clip_id, CASE WHEN doc_id % 5 = 0 THEN concat(source, ', extra') ELSE source END AS data_source, upper(lang) AS country FROM documents",
    "video_paths": "SELECT CAST(doc_id AS STRING) AS clip_id, concat('/v/', doc_id, '.mp4') AS path FROM documents WHERE doc_id % 7 <> 3",
    "annotations": """SELECT concat('q', doc_id) AS uid, concat('p', doc_id % 2) AS project, CAST(doc_id AS STRING) AS clip_id, 'quality' AS key, CAST(NULL AS DOUBLE) AS value,
  CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 10 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS start_time,
  CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 10 + 5 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS end_time,
  CASE WHEN doc_id % 3 = 0 THEN 'manual' ELSE 'autolabel' END AS label_type FROM labels WHERE quality = 1
UNION ALL SELECT concat('t', doc_id), concat('p', doc_id % 3), CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN 'toxic' ELSE 'unsafe' END, CAST(NULL AS DOUBLE), CAST(-1 AS DOUBLE), CAST(-1 AS DOUBLE), 'manual' FROM labels WHERE toxic = 1 OR doc_id % 6 = 1
UNION ALL SELECT concat('n', doc_id), concat('p', doc_id % 2), CAST(doc_id AS STRING), 'n_chars', CAST(n_chars AS DOUBLE), CAST(-1 AS DOUBLE), CAST(-1 AS DOUBLE), 'numeric' FROM documents WHERE doc_id % 2 = 0""",
    "datasets": "SELECT source AS name, 'web' AS category, 'open' AS license FROM documents WHERE source < 'src5' GROUP BY source",
    "captions": """SELECT conv_id * 100 + turn AS uid, CAST(conv_id AS STRING) AS clip_id, CASE WHEN role = 'assistant' THEN 'model_a' ELSE 'model_b' END AS model_name, text AS caption,
  concat('src', conv_id % 20) AS data_source, CAST(turn * 4 AS DOUBLE) AS start_time, CAST(turn * 4 + 5 AS DOUBLE) AS end_time FROM conversations""",
    "vectors": "SELECT vec_id AS row_id, concat('c', vec_id % 100) AS clip_id, label, embedding AS vec FROM embeddings",
    "assignments": "SELECT 'run1' AS run_id, CAST(vec_id AS STRING) AS clip_id, label AS cluster_id, CAST(vec_id % 37 AS DOUBLE) / 10 AS distance FROM embeddings",
    "scores": "SELECT concat('run', o_orderkey % 3) AS run_id, CAST(o_custkey AS STRING) AS clip_id, MAX(CAST(o_orderkey % 101 AS DOUBLE) / 100) AS p FROM orders GROUP BY o_orderkey % 3, o_custkey",
    "metrics": """SELECT l_returnflag AS model, CAST(l_orderkey AS STRING) AS clip_id, 'qty' AS metric, MAX(l_quantity) AS value FROM lineitem GROUP BY l_returnflag, l_orderkey
UNION ALL SELECT l_returnflag, CAST(l_orderkey AS STRING), 'disc', MAX(l_discount) FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag, l_orderkey""",
    "intervals": "SELECT concat('a', event_id) AS uid, user_id AS k, CAST(event_id % 1000 AS DOUBLE) AS start_time, CAST(event_id % 1000 AS DOUBLE) + value / 10 AS end_time FROM events WHERE event_type = 'error' OR event_type = 'purchase'",
    "others": "SELECT event_id AS oid, user_id AS k, CAST(event_id % 1000 AS DOUBLE) AS start_time, CAST(event_id % 1000 AS DOUBLE) + value / 10 AS end_time FROM events WHERE event_type = 'click'",
    "ticks": "SELECT event_id, user_id, event_id * 7 % 100003 AS t, value AS v, event_type FROM events",
    "votes": """SELECT event_id AS id, concat('m', CAST(floor(event_id / 2) AS BIGINT)) AS match_id, concat('a', user_id % 3) AS arena, concat('i', event_id % 20) AS input_id,
  concat('x', event_id % 4) AS model_a, concat('x', (event_id + 1 + user_id % 3) % 4) AS model_b,
  CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' WHEN 3 THEN 'a_slightly' ELSE 'skip' END AS winner,
  concat('u', user_id % 7) AS username, concat('c', event_id % 2) AS criterion, event_id * 10 AS created_at, CAST(floor(value * 10) AS BIGINT) AS duration_ms FROM events""",
    "perception": """SELECT CAST(user_id AS STRING) AS clip_id, event_type AS class, CAST(COUNT(*) AS INT) AS n FROM events GROUP BY user_id, event_type""",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "l_returnflag", "l_orderkey") if name == "lineitem" else df  # nearly as many groups as rows


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = STANDINS[name]
    used = [t for t in ("documents", "labels", "conversations", "embeddings", "orders", "lineitem", "events") if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: _table(spark, sf_dir, t) for t in used})


def query(name: str, tables: str = "", sql: str | None = None):
    """Register f(spark, sf_dir, *stand-ins); sql may name the stand-ins as tables."""
    names = tables.split()

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir, *[standin(spark, sf_dir, t) for t in names])

        QUERIES[name] = run
        if sql is not None:
            used = [t for t in STANDINS if re.search(rf"\b{t}\b", sql)]
            ORACLES[name] = ("WITH " + ",\n".join(f"{t} AS ({STANDINS[t]})" for t in used) + "\n" if used else "") + sql
        return f

    return wrap
