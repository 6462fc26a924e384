import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.model import schema
from cliploom.sources import archives, readers, writers
from cliploom.streaming import incremental


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for n, b in (("x/c1.json", b'{"n": 1}'), ("x/c1.mp4", b"m")):
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("c2.json", '{"n": 2}')
    archives.register(spark)
    got = spark.read.format("clip_archive").load(str(tmp_path))
    assert sorted((r.clip_id, bytes(r.content)) for r in got.collect()) == [("c1", b"m"), ("c1", b'{"n": 1}'), ("c2", b'{"n": 2}')]
    assert sorted((r.clip_id, r.n, r.split) for r in archives.sidecars(spark, str(tmp_path), "n int", "train").collect()) == [("c1", 1, "train"), ("c2", 2, "train")]


def test_shards_and_scores(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0])], "clip_id string, embeddings array<float>")
    v.coalesce(1).write.parquet(str(tmp_path / "e"))
    assert {r.clip_id: list(r.vec) for r in readers.embedding_shards(spark, str(tmp_path / "e")).collect()} == {"a": [1.0, 0.0], "b": [1.0, 1.0]}
    (tmp_path / "v").mkdir()
    np.savez(tmp_path / "v" / "s.npz", embeddings=np.eye(2, dtype="f4"), clip_ids=np.array(["x", "x"]))
    assert readers.view_shards(spark, str(tmp_path / "v")).count() == 2
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r2").mkdir()
    (tmp_path / "runs" / "r1" / "predicted_scores.json").write_text(json.dumps({"a": 0.5, "b": 0.25}))
    (tmp_path / "runs" / "r1" / "metadata.json").write_text('{"status": "done"}')
    (tmp_path / "runs" / "r2" / "metadata.json").write_text("{broken")
    assert sorted((r.run_id, r.clip_id, r.p) for r in readers.score_maps(spark, str(tmp_path / "runs")).collect()) == [("r1", "a", 0.5), ("r1", "b", 0.25)]
    assert [(r.run_id, r.status) for r in readers.runs(spark, str(tmp_path / "runs")).collect()] == [("r1", "done")]


def test_messy_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Video ID , Length,Views,Weather\n"a ",01:00:05,"1,200",Sunny \nb,,x,RAIN\n')
    r = readers.messy_csv(spark, str(tmp_path / "m.csv"), {"video id": "id", "length": "secs", "views": "views", "weather": "weather"}, ["views"], ["secs"], ["weather"])
    assert [tuple(x) for x in r.collect()] == [("a", 3605, 1200, "sunny"), ("b", 0, 0, "rain")]


def test_run_writer(spark, tmp_path):
    p = str(tmp_path / "runs")
    d = spark.createDataFrame([("r", "a", 0, 1.0)], schema("cluster_assignments"))
    writers.write_assignments(d, p)
    with pytest.raises(FileExistsError):
        writers.write_assignments(d, p)
    writers.write_assignments(d.withColumn("run_id", F.lit("s")), p)
    assert spark.read.parquet(p).count() == 2
    with pytest.raises(ValueError):
        writers.write_run(d.drop("distance"), p, "cluster_assignments")


def test_export_tiers(spark):
    c = spark.createDataFrame([("a", "s", "DE"), ("b", "s", "DE")], schema("clips"))
    a = spark.createDataFrame([("u", "p", "a", "k", None, -1.0, -1.0, "manual")], schema("annotations"))
    cols = lambda tiers: writers.search_export(c.select("clip_id"), c, a, tiers).columns
    assert (len(cols((5, 6, 7))), cols((1, 6, 7)), cols((0, 1, 7))) == (6, ["clip_id", "data_source"], ["clip_id"])
    with pytest.raises(ValueError, match="too many"):
        writers.search_export(c.select("clip_id"), c, a, (0, 0, 1))
    assert "| a |" in writers.markdown(c.select("clip_id").orderBy("clip_id"), "t")


def test_ingest_skips_known(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    ddl = "clip_id string, vec array<float>"
    spark.createDataFrame([("a", [1.0]), ("b", [1.0])], ddl).write.parquet(src)
    incremental.ingest(spark.readStream.schema(ddl).parquet(src), out, ck).awaitTermination(120)
    spark.createDataFrame([("b", [2.0]), ("c", [2.0])], ddl).write.mode("append").parquet(src)
    incremental.ingest(spark.readStream.schema(ddl).parquet(src), out, ck).awaitTermination(120)
    assert sorted((r.clip_id, r.vec[0]) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 1.0), ("c", 2.0)]


def test_live_ratings_equal_replay(spark, tmp_path):
    from cliploom.operators import arena

    rows = [(i, f"m{i}", "ar", "i", "x" if i % 2 else "y", "z", ["a", "b", "tie", "skip"][i % 4], "u", "c", i, 1) for i in range(12)]
    v = spark.createDataFrame(rows, schema("votes"))
    v.coalesce(1).write.parquet(str(tmp_path / "v"))
    q = incremental.live_ratings(spark.readStream.schema(v.schema).parquet(str(tmp_path / "v"))).writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    live = {r.model: round(r.rating, 6) for r in spark.table("live").collect()}
    assert live == {r.model: round(r.rating, 6) for r in arena.ratings(v).collect()}


def test_log_stream(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.log").write_text("2024-01-02 03:04:05,678 hello\n2024-01-02 04:04:05,678 Query rewrite: query=x\n")
    q = incremental.log_counts(spark, str(tmp_path / "l")).writeStream.format("memory").queryName("logs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(120)
    assert {(str(r.day), r.kind, r.n) for r in spark.table("logs").collect()} == {("2024-01-02", "other", 1), ("2024-01-02", "rewrite", 1)}
