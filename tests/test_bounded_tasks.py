"""Tasks and files stay bounded as a table grows."""

import os

import numpy as np
from pyspark.sql import functions as F

from cliploom.operators import clusters, stats
from cliploom.queries import io as q
from cliploom.queries.base import QUERIES, standin
from cliploom.sources import tensors


def test_term_weights_count_so_many_documents_a_task(spark, monkeypatch):
    d = spark.range(40).selectExpr("cast(id as string) as clip_id", "concat('red car ', if(id % 2 = 0, 'stops', 'turns'), ' at word', char(97 + id % 9)) as caption")
    want = sorted(map(tuple, clusters.term_weights(d).collect()))
    monkeypatch.setattr(clusters, "TERM_DOCS", 5)
    w = clusters.term_weights(d)
    assert sorted(map(tuple, w.collect())) == want and want
    assert "hashpartitioning(clip_id" in (plan := w._jdf.queryExecution().toString()) and ", 8), REPARTITION_BY_NUM" in plan


def test_label_files_hold_many_videos(spark, monkeypatch):
    seen, read = [], q.readers.label_files
    monkeypatch.setattr(q.readers, "label_files", lambda s, path: seen.append(path) or read(s, path))
    got = QUERIES["s16_label_files"](spark, "/root/testdata/sf0.001").collect()
    folder = seen[0].removeprefix("file:")
    assert len(got) > 10 and sum(f.endswith(".txt") for _, _, fs in os.walk(folder) for f in fs) == 2


def test_poses_of_long_clips(spark):
    r = np.random.default_rng(3)
    p = {"a": r.normal(size=(2500, 16)), "b": r.normal(size=(1, 16)), "c": np.zeros((0, 16))}
    rows = [(k, f"x.{e}", bytearray(v)) for k, x in p.items() for e, v in (("poses", x.astype("<f8").tobytes()), ("stamps", np.arange(len(x), dtype="<i8").tobytes()))]
    got = tensors.pose_tables(spark.createDataFrame(rows, "clip_id string, member string, content binary")).collect()
    assert sorted((x.clip_id, x.timestamp_us) for x in got) == [("a", i) for i in range(2500)] + [("b", 0)]
    assert all(np.array_equal(x.pose, p[x.clip_id][x.timestamp_us]) for x in got)


def _most_rows(df):
    """Rows of the task that returns most."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_metric_matrix_groups_so_many_rows_a_task(spark, monkeypatch):
    rows = [(f"m{i % 2}", f"c{i // 2}" if i else None, k, (float("nan") if i % 7 == 0 else None if i % 5 == 0 else float(i * (k == "a") - i * (k == "b")))) for i in range(600) for k in ("a", "b", "other")]
    want = {(m, c): [None, None] for m, c, _, _ in rows}
    for m, c, k, v in rows:
        if k != "other" and v is not None and v == v:
            want[m, c]["ab".index(k)] = v
    monkeypatch.setattr(stats, "TASK_ROWS", 100)
    d = spark.createDataFrame(rows, "model string, clip_id string, metric string, value double")
    for given in (None, 2 * len(rows)):
        got = stats.metric_matrix(d, ["a", "b"], given)
        assert _most_rows(got) <= 100
        got = got.collect()
        assert len(got) == 600 and {(x.model, x.clip_id): [x.a, x.b] for x in got} == want


def test_metrics_of_orders_are_grouped_so_many_rows_a_task(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    run = lambda: sorted(map(tuple, QUERIES["a15_metric_matrix"](spark, sf).collect()), key=str)
    want, before = run(), sorted(map(tuple, standin(spark, sf, "metrics").collect()))
    monkeypatch.setattr(stats, "TASK_ROWS", 500)
    m = standin(spark, sf, "metrics")
    assert _most_rows(m) <= 500 and sorted(map(tuple, m.collect())) == before
    assert _most_rows(QUERIES["a15_metric_matrix"](spark, sf)) <= 500 and run() == want and len(want) > 1000
