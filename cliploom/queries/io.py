"""Sources, sinks, streams, text queries and small rules: written to the shared folder and read back, or over all rows of a stand-in."""

from __future__ import annotations

import io
import json
import tarfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoders, expressions
from ..functions.scalars import llm_json
from ..operators import joins, labels, logs, stats, text, trajectory, vector_search, windows
from ..operators import sets as sets_
from ..plans.client import Client
from ..plans.engine import Catalog, Engine, page
from ..plans.filters import NumericFilter, SearchFilters
from ..sources import archives, ranges, readers, tensors, writers
from ..sources.commits import CommittedTable
from ..sources.workdir import workdir
from ..streaming import incremental
from .analytics import _log
from .base import query
from .search import _index


def _stored(df: DataFrame, tag: str, **options) -> str:
    path = workdir(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return path


@query("s01_table_scan", "annotations", "SELECT * FROM annotations")
def s01(spark, sf_dir, a):
    return readers.table(spark, _stored(a.withColumn("extra", F.lit(1)), "annotations"), "annotations")


@query("s03_embedding_shards", "vectors", "SELECT clip_id, count(*) AS n, round(sum(list_sum(list_transform(vec::DOUBLE[], lambda x: x))), 4) AS s FROM vectors GROUP BY clip_id")
def s03(spark, sf_dir, v):
    """All rows of all shards; a file that is no Parquet is passed over."""
    path = _stored(v.select("clip_id", F.col("vec").alias("embeddings")), "shards")
    v.limit(1).select(F.lit("not a table").alias("value")).write.text(f"{path}/broken.parquet")
    r = readers.embedding_shards(spark, path, one_per_clip=False)
    return r.groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)), 4).alias("s"))


def _packed(df: DataFrame, key: str, path, pack) -> DataFrame:
    """path, content: one array file per value of the key."""
    make = lambda g: g.iloc[:1].assign(path=path(g[key].iloc[0]), content=pack(g))[["path", "content"]]
    return df.groupBy(key).applyInPandas(make, "path string, content binary")


def _parted(df: DataFrame, name: str, key: str, rows: int = 20_000) -> DataFrame:
    """df with at: ``part/name``, a folder for so many rows in all, so that no file of a name holds more as a table grows."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn("at", F.concat(F.pmod(F.xxhash64(key), F.lit(n)).cast("string"), F.lit("/"), name))


def _npz(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


@query("s04_view_files", "vectors", "SELECT clip_id, count(*) AS n, round(sum(vec[1]), 4) AS s FROM vectors GROUP BY clip_id")
def s04(spark, sf_dir, v):
    f = _packed(v, "label", lambda k: f"/views/{k}.npz", lambda g: _npz(embeddings=np.stack(g.vec), clip_ids=g.clip_id.to_numpy(str)))
    return tensors.view_rows(f).groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("vec")[0].cast("double")), 4).alias("s"))


@query("s05_keyed_tensors", "vectors", "SELECT row_id::STRING AS key, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS position, 64 AS size, round(list_sum(list_transform(vec::DOUBLE[], lambda x: x)), 5) AS s FROM vectors")
def s05(spark, sf_dir, v):
    f = _packed(v, "label", lambda k: f"/t/{k}.safetensors", lambda g: tensors.pack_tensors({str(r.row_id): np.asarray(r.vec, "f4") for r in g.sort_values("row_id").itertuples()}))
    t = tensors.keyed_tensors(f)
    return t.select("key", F.col("position").cast("long").alias("position"), F.col("shape")[0].cast("int").alias("size"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


@query("s05_tensor_ranges", "vectors", "SELECT row_id::STRING AS key, 64 AS size, round(list_sum(list_transform(vec::DOUBLE[], lambda x: x)), 5) AS s FROM vectors WHERE row_id % 3 = 1")
def s05_ranges(spark, sf_dir, v):
    """Some keys of stored files: headers first, then the wanted keys' bytes."""
    f = _packed(v, "label", lambda k: f"{k}.safetensors", lambda g: tensors.pack_tensors({str(r.row_id): np.asarray(r.vec, "f4") for r in g.itertuples()}))
    folder = workdir(spark, "tensors")
    ranges.store(f, folder)
    t = ranges.tensor_values(ranges.tensor_entries(ranges.listed(spark, folder, "*.safetensors")).filter("cast(key as bigint) % 3 = 1"), task_bytes=1 << 16)
    return t.select("key", F.col("shape")[0].cast("int").alias("size"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


def _tar(g, ending: str = "txt") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for r in g.itertuples():
            info = tarfile.TarInfo(f"clips/{r.clip_id}.{ending}")
            info.size = len(data := r.text.encode())
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@query("s11_archive_ranges", "captions", "SELECT 'src' || (clip_id::BIGINT % 20) AS archive, clip_id, string_agg(caption, ' ' ORDER BY uid) AS text FROM captions GROUP BY clip_id")
def s11(spark, sf_dir, c):
    """The members of stored archives, by an index of their headers and ranges that several tasks read."""
    texts = c.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", "caption"))), lambda x: x["caption"]), " ").alias("text"))
    f = _packed(_parted(texts.withColumn("src", F.concat(F.lit("src"), F.col("clip_id").cast("long") % 20)), "src", "clip_id"), "at", lambda k: f"{k}.tar", _tar)
    folder = workdir(spark, "archives")
    ranges.store(f, folder)
    m = ranges.contents(ranges.members(ranges.listed(spark, folder, "*.tar")), task_bytes=1 << 16)
    part = lambda col, pattern: F.regexp_extract(col, pattern, 1)
    return m.select(part("archive", r"([^/]+)\.tar$").alias("archive"), part("member", r"([^/]+)\.txt$").alias("clip_id"), F.decode("content", "UTF-8").alias("text"))


@query("s23_sidecars", "captions", "SELECT uid::STRING AS clip_id, caption, model_name, 'train' AS split FROM captions")
def s23(spark, sf_dir, c):
    """Sidecars of all captions in stored archives, with the fields that are kept."""
    j = c.select(F.col("uid").cast("string").alias("clip_id"), F.to_json(F.struct("caption", "model_name", "start_time")).alias("text"), F.col("data_source").alias("src"))
    folder = workdir(spark, "sidecars")
    ranges.store(_packed(_parted(j, "src", "clip_id"), "at", lambda k: f"{k}.tar", lambda g: _tar(g, "json")), folder)
    return archives.sidecars(spark, folder, "caption string, model_name string", "train", "*.tar")


@query("s07_score_maps", "scores", "SELECT * FROM scores")
def s07(spark, sf_dir, s):
    path = workdir(spark, "scores")
    maps = s.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("clip_id", "p")))).alias("value"))
    maps.write.partitionBy("run_id").text(path)
    return readers.score_maps(spark, path, "*.txt").withColumn("run_id", F.regexp_replace("run_id", "^run_id=", ""))


@query("s08_metric_matrices", "metrics", "SELECT model, clip_id, metric, value FROM metrics")
def s08(spark, sf_dir, m):
    def pack(g):
        w = g.pivot(index="clip_id", columns="metric", values="value")
        return _npz(values=w.to_numpy(float), clip_ids=w.index.to_numpy(str), names=w.columns.to_numpy(str))

    return tensors.metric_matrices(_packed(_parted(m, "model", "clip_id", 100_000), "at", lambda k: f"/m/{k}_metrics.npz", pack))


@query("s09_predictions", "vectors", """SELECT row_id::STRING AS clip_id, 'm' || label AS model, kind, "window"::INT AS "window", sample::INT AS sample, round(vec[i]::DOUBLE, 5) AS x0, round(vec[i + 5]::DOUBLE, 5) AS y1 FROM vectors,
  (SELECT 'pred' AS kind, w AS "window", s AS sample, 1 + 32 * w + 16 * s AS i FROM range(2) a(w), range(2) b(s) UNION ALL SELECT 'gt', w, 0, 1 + 32 * w FROM range(2) c(w))""")
def s09(spark, sf_dir, v):
    """Of every row, 2 windows of 2 samples of 4 points with 4 numbers each, and the first sample as truth."""

    def pack(g):
        x = np.asarray(g.vec.iloc[0], float).reshape(2, 2, 4, 4)
        return _npz(pred=x, gt=x[:, 0])

    f = _packed(v.withColumn("at", F.concat(F.lit("m"), "label", F.lit("/"), "row_id")), "at", lambda k: f"/p/{k}.npz", pack)
    return tensors.predictions(f).select("clip_id", "model", "kind", "window", "sample", F.round(F.col("xy")[0], 5).alias("x0"), F.round(F.col("xy")[3], 5).alias("y1"))


def _folders(datasets) -> str:
    path = workdir(datasets.sparkSession, "media")
    datasets.select("name", F.col("category").alias("value")).write.partitionBy("name").text(path)
    return path


@query("s10_media_files", "datasets", "SELECT concat('name=', name) AS clip_id, 4::BIGINT AS length FROM datasets")
def s10(spark, sf_dir, d):
    return readers.media_files(spark, _folders(d), "*.txt", camera="part-").select("clip_id", "length")


@query("s25_varying_part", "datasets", "SELECT -2 AS part FROM (SELECT count(*) FROM datasets)")
def s25(spark, sf_dir, d):
    paths = d.select(F.explode(F.array(F.lit("cam0.mp4"), F.lit("cam1.mp4"))).alias("f"), "name").select(F.concat(F.lit("/data/v1/"), "name", F.lit("/"), "f").alias("path"))
    return spark.createDataFrame([(readers.varying_part(paths),)], "part int")


@query("s26_available", "datasets", "SELECT name AS clip_id FROM datasets")
def s26(spark, sf_dir, d):
    return readers.available(spark, _folders(d), "*.txt", r"name=([^/]+)/")


@query("s14_log_scan", "ticks", "SELECT CASE event_type WHEN 'view' THEN 'http' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'cache_hit' ELSE 'cache_miss' END WHEN 'error' THEN 's3_error' WHEN 'purchase' THEN 'add' ELSE 'other' END AS kind, count(*) AS n FROM ticks GROUP BY ALL")
def s14(spark, sf_dir, t):
    path = workdir(spark, "logs")
    _log(t).select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(f"{path}/deep")
    return logs.read(spark, path).groupBy("kind").agg(F.count("*").alias("n"))


@query("s15_messy_csv", "", """SELECT lower(c_name) AS name, c_nationkey AS nation, (c_custkey % 5) * 3600 + (c_custkey % 60) * 60 + 7 AS secs, 0 AS missing FROM customer""")
def s15(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, path = F.col("c_custkey"), workdir(spark, "csv")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    rows = c.select(F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("#")), F.lit("  ")).alias("Cust NAME "), F.col("c_nationkey").cast("string").alias(" Nation"), F.concat(two(k % 5), F.lit(":"), two(k % 60), F.lit(":07")).alias("Length"))
    rows.write.option("header", True).csv(path)
    r = readers.messy_csv(spark, path, {"cust name": "name", "nation": "nation", "length": "secs", "views": "missing"}, ["nation", "missing"], ["secs"], ["name"])
    return r.withColumn("secs", F.col("secs").cast("long"))


@query("s16_label_files", "intervals", """SELECT k::STRING AS video_id, count(*) AS n, max(b) AS cmd FROM (SELECT *, (k % 3 > 0)::INT AS b FROM intervals) GROUP BY k""")
def s16(spark, sf_dir, a):
    """Two folders of files; of videos in both, the later folder's entries count."""
    path = workdir(spark, "labels")
    entry = F.struct(F.col("k").cast("string").alias("folder"), F.col("start_time").cast("int").alias("first_frame"), F.col("end_time").cast("int").alias("last_frame"), F.col("cmd"), F.lit("x").alias("blip"))
    a = _parted(a.withColumn("name", F.lit("labels")), "name", "k")  # a file holds many videos, so that files don't grow in number with videos
    one = lambda d, cmd: d.withColumn("cmd", F.lit(cmd)).groupBy("at").agg(F.to_json(F.collect_list(entry)).alias("value"))
    one(a, 0).write.partitionBy("at").text(f"{path}/a")
    one(a.filter("k % 3 > 0"), 1).write.partitionBy("at").text(f"{path}/b")
    return readers.label_files(spark, path).groupBy("video_id").agg(F.count("*").alias("n"), F.max("cmd").alias("cmd"))


@query("s17_captions", "captions", "SELECT * FROM captions")
def s17(spark, sf_dir, c):
    return readers.captions(spark, _stored(c.withColumn("more", F.lit(0)), "captions"))


@query("s18_ego_axes", "ticks", "SELECT event_id::STRING AS clip_id, t AS timestamp_us, CASE event_id % 3 WHEN 0 THEN v * 3 ELSE v END AS a, CASE event_id % 3 WHEN 0 THEN v WHEN 1 THEN -(v * 2) ELSE v * 2 END AS b, CASE event_id % 3 WHEN 0 THEN -(v * 2) ELSE v * 3 END AS c FROM ticks")
def s18(spark, sf_dir, t):
    """Recordings of three axis conventions."""
    n = [F.lit(0.0)] * 16
    n[3], n[7], n[11] = F.col("v"), F.col("v") * 2, F.col("v") * 3
    p = t.select(F.col("event_id").cast("string").alias("clip_id"), F.col("t").alias("timestamp_us"), F.array(*n).alias("pose"), F.element_at(F.array(*map(F.lit, ("camera", "flu", "other"))), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"))
    return readers.ego_from_poses(p).select("clip_id", "timestamp_us", F.col("x").alias("a"), F.col("y").alias("b"), F.col("z").alias("c"))


@query("s24_pose_members", "ticks", "SELECT user_id::STRING AS clip_id, count(*) AS n, sum(t)::BIGINT AS stamps, round(sum(v), 4) AS x FROM ticks GROUP BY user_id")
def s24(spark, sf_dir, t):
    def members(g):
        p = np.zeros((len(g), 16))
        p[:, 3] = g.v
        out = g.iloc[:2][["clip_id"]].iloc[[0, 0]].copy()
        return out.assign(member=["a/x.poses", "a/x.stamps"], content=[p.astype("<f8").tobytes(), g.t.to_numpy("<i8").tobytes()])

    m = t.select(F.col("user_id").cast("string").alias("clip_id"), "t", "v").groupBy("clip_id").applyInPandas(members, "clip_id string, member string, content binary")
    return tensors.pose_tables(m).groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("timestamp_us").alias("stamps"), F.round(F.sum(F.col("pose")[3]), 4).alias("x"))


@query("s19_eval_table", "scores", "SELECT clip_id, p FROM scores WHERE run_id = 'run1'")
def s19(spark, sf_dir, s):
    path = workdir(spark, "eval") + ".jsonl"
    s.filter("run_id = 'run1'").select("clip_id", "p").write.json(path)
    return readers.eval_table(spark, path, "clip_id", s.filter("run_id = 'run1'"))


@query("s20_clip_index", "vectors", 'SELECT clip_id, min(row_id) AS "row" FROM vectors GROUP BY clip_id')
def s20(spark, sf_dir, v):
    return readers.clip_index(spark, workdir(spark, "none"), _stored(v.select("clip_id", F.col("row_id").alias("row")), "index"))


@query("s21_runs", "scores", "SELECT run_id AS folder, 'done' AS status FROM scores GROUP BY run_id")
def s21(spark, sf_dir, s):
    """Folders whose metadata can't be read are left out."""
    path, runs = workdir(spark, "runs"), s.select("run_id").distinct()
    good = runs.select(F.lit('{"status": "done"}').alias("value"), "run_id")
    good.unionByName(runs.select(F.lit("{broken").alias("value"), F.concat(F.lit("bad"), "run_id").alias("run_id"))).write.partitionBy("run_id").text(path)
    return readers.runs(spark, path, name="*.txt").select(F.regexp_replace("folder", "run_id=", "").alias("folder"), "status")


@query("k05_vote_export", "votes", "SELECT * FROM votes WHERE arena = 'a1'")
def k05(spark, sf_dir, v):
    path = workdir(spark, "votes")
    writers.write_json(writers.vote_export(v, "a1"), path)
    return spark.read.schema(v.schema).json(path)


@query("k06_assignment_runs", "assignments", "SELECT clip_id, cluster_id, distance, run_id FROM assignments")
def k06(spark, sf_dir, a):
    path = workdir(spark, "runs")
    writers.write_assignments(a, path)
    writers.write_assignments(a.withColumn("distance", F.col("distance")), path, overwrite=True)
    return spark.read.parquet(path)


@query("k07_classifier_weights", "vectors", "SELECT concat('r', row_id) AS run_id, round(list_sum(list_transform(vec::DOUBLE[], lambda x: x)), 6) AS s, label::DOUBLE AS intercept FROM vectors")
def k07(spark, sf_dir, v):
    """Weights of every run as JSON text and back."""
    w = v.select(F.concat(F.lit("r"), "row_id").alias("run_id"), F.col("vec").cast("array<double>").alias("coef"), F.col("label").cast("double").alias("intercept"))
    path = _stored(writers.weights_json(w), "weights")
    back = spark.read.parquet(path).select("run_id", F.from_json("value", "coef array<double>, intercept double").alias("w")).select("run_id", "w.*")
    return back.select("run_id", F.round(F.aggregate("coef", F.lit(0.0), lambda a, x: a + x), 6).alias("s"), "intercept")


@query("k11_installed_run", "assignments", "SELECT clip_id, cluster_id, distance, 'up1' AS run_id FROM assignments")
def k11(spark, sf_dir, a):
    path = workdir(spark, "installed")
    for overwrite in (False, True):
        writers.install_run(spark, _stored(a.drop("run_id"), "upload"), path, "up1", "cluster_assignments", overwrite)
    return spark.read.parquet(path)


@query("k10_append_new", "vectors", "SELECT clip_id, min(row_id) AS row_id FROM vectors GROUP BY clip_id")
def k10(spark, sf_dir, v):
    path, rows = workdir(spark, "append"), v.select("clip_id", "row_id")
    writers.append_new(rows.filter("row_id < 50"), path, "clip_id")
    writers.append_new(rows, path, "clip_id")
    return spark.read.parquet(path)


@query("k10_commits_at_once", "vectors", "SELECT clip_id, count(*) AS n_rows, sum(row_id)::BIGINT AS s FROM vectors GROUP BY clip_id UNION ALL SELECT 'keys', count(DISTINCT clip_id), NULL FROM vectors")
def k10b(spark, sf_dir, v):
    """Four writers append a quarter of all rows each at once; four more append the keys they see, of which each stays once."""
    rows = v.select("clip_id", "row_id")
    all_, keys = (CommittedTable(spark, workdir(spark, t)) for t in ("commits", "keys"))
    quarter = lambda i: rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(4)) == i)
    with ThreadPoolExecutor(4) as pool:
        for f in [pool.submit(t, i) for i in range(4) for t in (lambda i: all_.append(quarter(i)), lambda i: keys.append_new(quarter(i).select("clip_id"), "clip_id"))]:
            f.result()
    n = keys.read().agg(F.lit("keys").alias("clip_id"), F.count("*").alias("n_rows"), F.lit(None).cast("long").alias("s"))
    return all_.read().groupBy("clip_id").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("s")).unionByName(n)


@query("k11_pinned_runs", "assignments", "SELECT 'pinned' AS seen, clip_id, cluster_id, distance FROM assignments UNION ALL SELECT 'newest', clip_id, cluster_id + 1, distance FROM assignments UNION ALL SELECT 'newest', clip_id, cluster_id, distance FROM assignments")
def k11b(spark, sf_dir, a):
    """A run is replaced while a reader holds the version before; the other run stays."""
    t, rows = CommittedTable(spark, workdir(spark, "runs")), a.select("clip_id", "cluster_id", "distance")
    t.install_run(rows, "up1")
    pinned = t.read()
    t.install_run(rows, "up2")
    t.install_run(rows.withColumn("cluster_id", (F.col("cluster_id") + 1).cast(rows.schema["cluster_id"].dataType)), "up1", overwrite=True)
    return pinned.select(F.lit("pinned").alias("seen"), "*").unionByName(t.read().select(F.lit("newest").alias("seen"), "*"))


@query("i05_live_ratings", "votes")
def i05(spark, sf_dir, v):
    """All votes as a stream; the last state of each model."""
    src, out = _stored(v, "votes"), workdir(spark, "rated")
    write = lambda d, n: d.write.mode("overwrite").parquet(f"{out}/batch={n}")
    incremental.start_ratings(spark.readStream.schema(v.schema).parquet(src), write, workdir(spark, "ratings")).awaitTermination()
    return spark.read.parquet(out).groupBy("arena", "criterion", "model").agg(F.max_by(F.struct("rating", "rd", "vol", "n"), "n").alias("s")).select("arena", "criterion", "model", "s.*")


@query("k12_sampling_manifest", "intervals", "SELECT k::STRING AS video_id, start_time AS a, end_time AS b, uid FROM intervals")
def k12(spark, sf_dir, i):
    path = workdir(spark, "manifest")
    w = i.select(F.col("k").cast("string").alias("video_id"), F.col("start_time").alias("a"), F.col("end_time").alias("b"), "uid")
    writers.write_json(writers.sampling_manifest(w), path)
    return spark.read.schema(w.schema).json(path)


@query("k13_stats_json", "clips annotations", "SELECT data_source, key, count(*) AS n FROM (SELECT trim(unnest(string_split(data_source, ','))) AS data_source, clip_id FROM clips) JOIN annotations USING (clip_id) WHERE value IS NULL GROUP BY ALL")
def k13(spark, sf_dir, c, a):
    path = workdir(spark, "stats")
    s = stats.label_frequency(c, a).groupBy("data_source").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("labels"))
    writers.write_stats(s, path, "data_source")
    return spark.read.text(path).select("data_source", F.explode(F.from_json("value", "labels map<string, bigint>")["labels"]).alias("key", "n"))


@query("k14_markdown", "datasets", "SELECT '| ' || name || ' | ' || category || ' |' AS line FROM datasets")
def k14(spark, sf_dir, d):
    out = writers.markdown(d.select("name", "category").orderBy("name"), "Data sets")
    return spark.createDataFrame([(x,) for x in out.splitlines()[4:]], "line string")


@query("k15_structured_rows", "ticks", """SELECT event_id, '{"t":' || t || ',"kind":"' || event_type || '"}' AS scene FROM ticks""")
def k15(spark, sf_dir, t):
    return writers.structured_row(t.select("event_id", F.struct("t", F.col("event_type").alias("kind")).alias("scene")), ["scene"])


_WORDS = r"regexp_extract_all(lower(string_agg(caption, ' ' ORDER BY uid)), '[\p{L}\p{N}]+')"
_HAS = "contains(d, ' {} ')"
_DOCS = rf"(SELECT clip_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS d FROM captions GROUP BY clip_id)"


@query("f30_caption_filter", "captions clips", f"SELECT clip_id FROM {_DOCS} WHERE {_HAS.format('of the')} AND NOT {_HAS.format('und')} AND clip_id IN (SELECT clip_id FROM clips WHERE country = 'EN')")
def f30(spark, sf_dir, c, clips):
    """Captions within a search that a country narrows first."""
    e = Engine(Catalog(clips, clips.select("clip_id"), captions=c), k=None)
    return Client(e).search_caption('"of the" NOT und', search_country="EN").rows.select("clip_id")


@query("t11_any_of_terms", "captions clips", f"SELECT clip_id FROM {_DOCS} WHERE ({_HAS.format('the')} OR {_HAS.format('und')} OR {_HAS.format('les')}) AND clip_id IN (SELECT clip_id FROM clips)")
def t11(spark, sf_dir, c, clips):
    return Client(Engine(Catalog(clips, clips.select("clip_id"), captions=c))).search_caption_any(["the", "und", "les"]).rows.select("clip_id")


@query("t06_multi_query", "captions", f"SELECT clip_id FROM {_DOCS} WHERE {_HAS.format('of the')} OR {_HAS.format('tion')}")
def t06(spark, sf_dir, c):
    return text.search(*_index(spark, c), text.parse_any(["of-the", "tion", "of the"]), limit=None).select("clip_id")


def _values(spark, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _each(f, returns):
    """A column function of a text function, batch by batch."""
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore"), returns)


_STOPS = ", ".join(f"'{w}'" for w in sorted(text.STOP_WORDS))
_CONNECTORS = ", ".join(f"'{w}'" for w in sorted(text.CONNECTORS))
_BARE = "replace(caption, chr(34), ' ')"
_SPLIT = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


@query("t01_sanitizer", "captions", f"""SELECT uid, array_to_string(list_transform(list_filter(string_split(regexp_replace(' ' || array_to_string({_SPLIT.format(f"replace({_BARE}, '-', ' ')")}, '  ') || ' ', ' (and|or|not) ', '|\\1|', 'gi'), '|'), lambda p: trim(p) <> ''),
  lambda p: CASE WHEN p ILIKE 'and' OR p ILIKE 'or' OR p ILIKE 'not' THEN upper(p) ELSE '"' || replace(trim(p), '  ', ' ') || '"' END), '|') AS parts FROM captions""")
def t01(spark, sf_dir, c):
    """Every caption as a query text of bare words and operators."""
    return c.select("uid", _each(lambda q: "|".join(text.sanitize(q)), "string")(F.translate("caption", '"', " ")).alias("parts"))


@query("t05_limits", "clips", "SELECT count(*) AS n, greatest(100000, least(3 * count(*), 200000)) AS before, 100000::BIGINT AS alone FROM clips")
def t05(spark, sf_dir, c):
    n = c.count()
    return _values(spark, [(n, text.scaled_limit(n, True), text.scaled_limit(n, False))], "n bigint, before bigint, alone bigint")


_THREE = f"list_slice({_SPLIT.format('lower(caption)')}, 1, 3)"
_LESS = f"CASE WHEN len(w) > 1 AND w[len(w)] IN ({_STOPS}) THEN list_slice(w, 1, len(w) - 1) ELSE w END AS w"


@query("t09_rewrites", "captions", f"SELECT uid, array_to_string(w, ' ') AS rewrite FROM (SELECT uid, {_LESS} FROM (SELECT uid, {_LESS} FROM (SELECT uid, {_THREE} AS w FROM captions)))")
def t09(spark, sf_dir, c):
    """Every caption as a rewrite that a model may have given."""
    return c.select("uid", _each(text.normalize_rewrite, "string")("caption").alias("rewrite"))


@query("t10_decomposition", "captions", rf"""SELECT uid, CASE WHEN len(p) >= 2 THEN array_to_string(p, '|') END AS parts FROM (SELECT uid, list_filter(list_transform(string_split(array_to_string(list_transform(
  regexp_extract_all(lower(caption), '[\p{{L}}\p{{N}}]+|[,;.]'), lambda w: CASE WHEN w IN ({_CONNECTORS}, ',', ';', '.') THEN '|' ELSE w END), ' '), '|'),
  lambda s: array_to_string(list_filter(string_split(s, ' '), lambda w: w <> '' AND w NOT IN ({_STOPS})), ' ')), lambda s: s <> '') AS p FROM captions)""")
def t10(spark, sf_dir, c):
    """The parts of every caption."""
    return c.select("uid", _each(lambda x: None if (d := text.decompose(x)) is None else "|".join(d), "string")("caption").alias("parts"))


def _prior(key, value, clip_id) -> bool:
    """Of a text search beside what an annotation says: its value as a numeric filter, or its clip's neighbours, or its label."""
    more = {"numeric_filter": [NumericFilter(key, value, value)]} if value == value and value is not None else {"semantic_clip": clip_id} if key == "toxic" else {"filter": [key]}
    return bool(SearchFilters(semantic_text="x", **more).has_prior_filters("semantic_text"))


@query("f35_prior_filters", "annotations", "SELECT uid, value IS NOT NULL OR key = 'toxic' AS prior FROM annotations")
def f35(spark, sf_dir, a):
    """Whether another ranked filter is active, of a search made from each annotation."""
    prior = F.pandas_udf(lambda key, value, clip: pd.Series([_prior(*x) for x in zip(key, value, clip, strict=True)], dtype=bool), "boolean")
    return a.select("uid", prior("key", "value", "clip_id").alias("prior"))


@query("v13_window_choice", "intervals", "SELECT uid, CASE WHEN end_time - start_time <= 6 THEN '5s' WHEN end_time - start_time <= 15 THEN '10s' ELSE 'full' END AS tag FROM intervals")
def v13(spark, sf_dir, i):
    return i.select("uid", trajectory.window_tags(F.col("start_time"), F.col("end_time")).alias("tag"))


@query("v14_query_clip_kept", "ticks", "SELECT user_id::STRING AS clip_id FROM ticks WHERE user_id = 3 GROUP BY user_id")
def v14(spark, sf_dir, t):
    """The query's own clip comes first, at distance 0."""
    from .search import _tracks

    r = trajectory.by_shape(_tracks(t), "3", 1)
    return r.filter("distance = 0").select("clip_id")


@query("w17_percentile_band", "assignments", """SELECT clip_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, clip_id) - 1 AS r, count(*) OVER (PARTITION BY cluster_id) AS n FROM assignments)
  WHERE r >= round_even(n * 25.0::DOUBLE / 100, 0) AND r < round_even(n * 75.0::DOUBLE / 100, 0)""")
def w17(spark, sf_dir, a):
    return windows.percentile_band(a, "cluster_id", "distance", 25, 75).select("clip_id")


@query("j03_semi", "clips annotations", "SELECT clip_id FROM clips WHERE clip_id IN (SELECT clip_id FROM annotations)")
def j03(spark, sf_dir, c, a):
    return labels.in_list(c, a.select("clip_id"), True).select("clip_id")


@query("j04_anti", "clips annotations", "SELECT clip_id FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM annotations)")
def j04(spark, sf_dir, c, a):
    return labels.in_list(c, a.select("clip_id"), False).select("clip_id")


@query("j05_score_join", "clips scores", "SELECT c.clip_id, p AS score_0 FROM clips c JOIN scores s ON s.clip_id = c.clip_id AND run_id = 'run1'")
def j05(spark, sf_dir, c, s):
    return sets_.project_scores(c.select("clip_id"), s.filter("run_id = 'run1'").select("clip_id", F.col("p").alias("score"), F.lit(0).alias("ord"))).drop("ord")


@query("o10_common_clips", "scores", "SELECT clip_id FROM scores GROUP BY clip_id HAVING count(DISTINCT run_id) = 3")
def o10(spark, sf_dir, s):
    lists = s.select("clip_id", F.substring("run_id", 4, 1).cast("int").alias("list_no"), F.col("clip_id").cast("long").alias("pos"))
    return sets_.intersect_lists(lists, 3).select("clip_id")


@query("j15_live_sessions", "ticks", """SELECT event_id::STRING AS session_id, 'u' || (user_id % 50) AS username, 'r' || (user_id % 50) AS role FROM ticks WHERE event_id * 600 > (SELECT max(event_id) * 600 FROM ticks) - 72 * 3600 AND user_id % 50 < 40""")
def j15(spark, sf_dir, t):
    at = F.timestamp_seconds(F.col("event_id") * 600)
    s = t.select(F.col("event_id").cast("string").alias("session_id"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("username"), at.alias("created_at"))
    users = t.select((F.col("user_id") % 50).alias("k")).distinct().filter("k < 40").select(F.concat(F.lit("u"), "k").alias("username"), F.concat(F.lit("r"), "k").alias("role"))
    now = t.agg(F.max(at)).head()[0]
    return joins.live_users(s, users, F.lit(now)).select("session_id", "username", "role")


@query("a09_percentiles", "ticks", "SELECT event_type, min(v) AS low, max(v) AS high, round(quantile_cont(v, 0.37), 6) AS p37 FROM ticks GROUP BY event_type")
def a09(spark, sf_dir, t):
    r = t.groupBy("event_type").agg(*stats.basic(F.col("v"), quantiles=(-5, 37, 150)))
    return r.select("event_type", F.col("p-5").alias("low"), F.col("p150").alias("high"), F.round("p37", 6).alias("p37"))


@query("u07_reductions", "metrics", "SELECT model, metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max FROM metrics GROUP BY model, metric")
def u07(spark, sf_dir, m):
    out = None
    for r in ("mean", "median", "p95", "max"):
        one = stats.reduce_metrics(m, r).select("model", "metric", F.round("value", 6).alias(r))
        out = one if out is None else out.join(one, ["model", "metric"])
    return out


@query("u01_probability_expressions", "scores", """SELECT run_id, clip_id, (p > 0.2::DOUBLE AND p <= 0.6::DOUBLE) AS band, NOT (p < 0.5::DOUBLE) OR p = 0.1::DOUBLE AS other FROM scores""")
def u01(spark, sf_dir, s):
    return s.select("run_id", "clip_id", expressions.probability("0.2 < p <= 0.6").alias("band"), expressions.probability("not (p < 0.5) or p == 0.1").alias("other"))


@query("u02_motion_expressions", "ticks", "SELECT user_id::STRING AS clip_id, max((floor(v) / 10)::FLOAT) > 9 AND min((floor(v) / 10)::FLOAT) < 1 AS wide FROM ticks GROUP BY user_id")
def u02(spark, sf_dir, t):
    from .search import _tracks

    return _tracks(t).select("clip_id", expressions.motion("max(speed) > 9 and min(speed) < 1").alias("wide"))


@query("w11_first_order", "ticks", """SELECT user_id::STRING AS clip_id, coalesce(max(r) FILTER (floor(v) / 10 > 9) > max(r) FILTER (floor(v)::BIGINT % 9 - 4 < -3), false) AS late_peak, coalesce(min(r) FILTER (floor(v) / 10 > 3) > max(r) FILTER (floor(v) / 10 < 0::DOUBLE), false) AS never
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM ticks) GROUP BY user_id""")
def w11(spark, sf_dir, t):
    """Orders of first and last places where a channel meets a condition; without such a place the clip isn't kept."""
    from .search import _tracks

    late, never = "max(where(speed > 9)[0]) > max(where(acceleration < -3)[0])", "min(where(speed > 3)[0]) > max(where(speed < 0)[0])"
    return _tracks(t).select("clip_id", expressions.motion(late).alias("late_peak"), expressions.motion(never).alias("never"))


def _letters(texts) -> np.ndarray:
    return np.array([[t.count(x) for x in "ae "] for t in texts], np.float32).reshape(-1, 3)


@query("u03_encoded_texts", "captions", "SELECT uid, " + " || ',' || ".join(f"(length(caption) - length(replace(caption, '{x}', '')))" for x in "ae ") + " AS vec FROM captions")
def u03(spark, sf_dir, c):
    """All captions through an encoder of counted letters."""
    vec = F.transform(encoders.encode("caption", _letters), lambda x: x.cast("int").cast("string"))
    return c.select("uid", F.array_join(vec, ",").alias("vec"))


def _lines(data: bytes):
    lines = data.decode().split("\n")
    return [("full", [0, 0, len(lines), 1], [len(data)])] + [(f"line{i}", [i, 0, i + 1, 1], [len(x.encode())]) for i, x in enumerate(lines)]


@query("u04_proposals", "captions", """SELECT uid::STRING AS clip_id, 'line' || i AS "view", i::DOUBLE AS top, strlen(part)::DOUBLE AS size FROM (
  SELECT uid, unnest(string_split(caption, chr(10))) AS part, generate_subscripts(string_split(caption, chr(10)), 1) - 1 AS i FROM captions)""")
def u04(spark, sf_dir, c):
    """A row for each line of a caption, as a view of its medium; the whole is left out."""
    media = c.select(F.col("uid").cast("string").alias("clip_id"), F.encode("caption", "UTF-8").alias("content"))
    return encoders.propose(media, _lines, full=False).select("clip_id", "view", F.col("box")[0].alias("top"), F.col("vec")[0].cast("double").alias("size"))


def _judge(row: dict) -> str:
    if "?" in row["caption"]:
        raise ValueError("no answer")
    return f'<think>{{"score": -1}}</think>Well: ```json\n{{"score": {len(row["caption"])}}}\n``` done'


@query("u05_judged_captions", "captions", "SELECT uid, CASE WHEN contains(caption, '?') THEN NULL ELSE length(caption) END AS score FROM captions")
def u05(spark, sf_dir, c):
    """All captions through a judge that fails at some: these have no score."""
    j = encoders.judge(c.select("uid", "caption"), _judge)
    return j.select("uid", F.get_json_object(llm_json(F.col("answer")), "$.score").cast("long").alias("score"))


@query("w03_rank_gate", "clips", "SELECT clip_id, 0.0::DOUBLE AS rank_score FROM clips WHERE country = 'DE'")
def w03(spark, sf_dir, c):
    """Without a score no rank is made up."""
    return Engine(Catalog(c, c)).search(SearchFilters(search_country="DE")).select("clip_id", F.col("rank_score").cast("double").alias("rank_score"))


def _ranked(c, a):
    return Engine(Catalog(c, c, a)).search(SearchFilters(numeric_filter=[NumericFilter("n_chars", 0, 1e9)], project_source=["p0", "p1"]))


_RANKED = "(SELECT c.clip_id, max(a.value) AS v FROM clips c JOIN annotations a USING (clip_id) WHERE a.key = 'n_chars' GROUP BY c.clip_id)"


@query("l01_rank_order", "clips annotations", f"SELECT clip_id, row_number() OVER (ORDER BY v DESC, clip_id) AS place FROM {_RANKED}")
def l01(spark, sf_dir, c, a):
    """The ranked result as written in its order: sorted ranges follow one another."""
    from ..plans.engine import numbered

    return numbered(_ranked(c, a).select("clip_id", "rank_score"), "rank_score", "place").select("clip_id", "place")


@query("l02_page", "clips annotations", f"SELECT clip_id FROM {_RANKED} ORDER BY v DESC, clip_id LIMIT 20 OFFSET 20")
def l02(spark, sf_dir, c, a):
    return page(_ranked(c, a), 500, 1).select("clip_id")


@query("l03_partial_top", "vectors", "SELECT row_id::STRING AS clip_id, round(vec[1]::DOUBLE, 6) AS score FROM vectors ORDER BY vec[1] DESC, row_id::STRING LIMIT 25")
def l03(spark, sf_dir, v):
    from ..operators.vector_search import top

    return top(v.select(F.col("row_id").cast("string").alias("clip_id"), F.col("vec")[0].cast("double").alias("score")), 25).select("clip_id", F.round("score", 6).alias("score"))


@query("l04_head", "clips annotations", f"SELECT clip_id FROM {_RANKED} ORDER BY v DESC, clip_id LIMIT 7")
def l04(spark, sf_dir, c, a):
    f = SearchFilters(numeric_filter=[NumericFilter("n_chars", 0, 1e9)], project_source=["p0", "p1"])
    return Client(Engine(Catalog(c, c, a)))._run(f).head(7).rows.select("clip_id")


@query("l05_numeric_order", "clips annotations", f"SELECT clip_id, row_number() OVER (ORDER BY v, clip_id DESC) AS place FROM {_RANKED}")
def l05(spark, sf_dir, c, a):
    """Keys in ascending order of a number, with their places."""
    from ..plans.engine import numbered

    n = _ranked(c, a).count()
    r = numbered(_ranked(c, a).select("clip_id", "rank_score"), "rank_score", "place")
    return r.select("clip_id", (F.lit(n + 1) - F.col("place")).alias("place"))


def _stream_table(q, name: str, spark) -> DataFrame:
    q.awaitTermination()
    out = spark.table(name)
    return spark.createDataFrame(out.collect(), out.schema)  # a report-sized sink; its table goes with the next run


def _memory(stream: DataFrame, name: str, mode: str):
    spark = stream.sparkSession
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", workdir(spark, "stream")).start()


@query("i01_append_embeddings", "vectors", "SELECT clip_id, min(row_id) AS row_id FROM vectors GROUP BY clip_id")
def i01(spark, sf_dir, v):
    """Two arrivals; rows of clips that are known are skipped, and a second run goes on where the first stopped."""
    src, out, mark = (workdir(spark, x) for x in ("in", "out", "mark"))
    first = v.groupBy("clip_id").agg(F.min("row_id").alias("row_id"))
    for part in (first.filter("row_id % 2 = 0"), first.unionByName(first.filter("row_id % 2 = 0").withColumn("row_id", F.col("row_id") + 1_000_000))):
        part.write.mode("append").parquet(src)
        incremental.ingest(spark.readStream.schema(first.schema).parquet(src), out, mark).awaitTermination()
    return spark.read.parquet(out).select("clip_id", "row_id")


@query("i02_append_captions", "captions", "SELECT uid, clip_id FROM captions")
def i02(spark, sf_dir, c):
    src, out, mark = (workdir(spark, x) for x in ("in", "out", "mark"))
    rows = c.select("uid", "clip_id")
    for part in (rows.filter("uid % 2 = 0"), rows.filter("uid % 2 = 1")):
        part.write.mode("append").parquet(src)
        incremental.ingest(spark.readStream.schema(rows.schema).parquet(src), out, mark, key="uid").awaitTermination()
    return spark.read.parquet(out).select("uid", "clip_id")


@query("i03_finite_trajectories", "ticks", "SELECT user_id::STRING AS clip_id FROM ticks GROUP BY user_id HAVING min(v) >= 1")
def i03(spark, sf_dir, t):
    from .search import _tracks

    odd = _tracks(t.withColumn("v", F.when(F.col("v") < 1, float("nan")).otherwise(F.col("v"))))
    return incremental.finite_trajectories(odd).select("clip_id")


@query("i04_label_counters", "annotations", "SELECT project, key, sum((label_type = 'manual')::INT)::BIGINT AS n_manual, sum((label_type = 'autolabel')::INT)::BIGINT AS n_autolabel FROM annotations GROUP BY project, key")
def i04(spark, sf_dir, a):
    """Every label is added twice and removed once."""
    path = workdir(spark, "events")
    e = a.select("project", "key", "label_type", F.explode(F.array(F.lit(1), F.lit(1), F.lit(-1))).alias("change"))
    e.write.parquet(path)
    q = _memory(incremental.label_counters(spark.readStream.schema(e.schema).parquet(path)), "i04_counters", "complete")
    return _stream_table(q, "i04_counters", spark)


@query("i06_manifests", "datasets", "SELECT name, category FROM datasets")
def i06(spark, sf_dir, d):
    path = workdir(spark, "manifests")
    d.select("name", "category").write.json(path)
    return _stream_table(_memory(incremental.manifests(spark, path, "name string, category string"), "i06_manifests", "append"), "i06_manifests", spark)


@query("i07_first_logins", "ticks", "SELECT 'u' || user_id AS username FROM ticks GROUP BY user_id")
def i07(spark, sf_dir, t):
    """All logins fall within one time to live: each user comes once."""
    path = workdir(spark, "logins")
    e = t.select(F.concat(F.lit("u"), "user_id").alias("username"), F.timestamp_seconds(F.col("event_id") % 86_400).alias("at"))
    e.write.parquet(path)
    s = incremental.live_sessions(spark.readStream.schema(e.schema).parquet(path)).select("username")
    return _stream_table(_memory(s, "i07_logins", "append"), "i07_logins", spark)


@query("i09_log_stream", "ticks", "SELECT make_date(2024, 1, (event_id % 28 + 1)::INT) AS day, CASE event_type WHEN 'view' THEN 'http' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'cache_hit' ELSE 'cache_miss' END WHEN 'error' THEN 's3_error' WHEN 'purchase' THEN 'add' ELSE 'other' END AS kind, count(*) AS n FROM ticks GROUP BY ALL")
def i09(spark, sf_dir, t):
    path = workdir(spark, "logs")
    _log(t).write.text(path)
    return _stream_table(_memory(incremental.log_counts(spark, path, "60 days"), "i09_logs", "complete"), "i09_logs", spark)


@query("i08_plan_cache", "clips", "SELECT * FROM (VALUES ('same', true), ('after', false)) v(name, kept)")
def i08(spark, sf_dir, c):
    """Equal filters share a plan until a term of theirs is invalidated."""
    e = Engine(Catalog(c, c))
    first = e.search(SearchFilters(search_country="DE"))
    same = e.search(SearchFilters(search_country="DE")) is first
    e.invalidate("DE")
    return _values(spark, [("same", same), ("after", e.search(SearchFilters(search_country="DE")) is first)], "name string, kept boolean")


@query("i10_resume", "clips", "SELECT clip_id FROM clips")
def i10(spark, sf_dir, c):
    """A run that stopped after some clips; the next one reads only what is new."""
    src, out, mark = (workdir(spark, x) for x in ("in", "out", "mark"))
    ids, seen = c.select("clip_id"), []
    clean = lambda d: (seen.append(d.count()), d)[1]
    for part in (ids.filter("cast(clip_id as bigint) % 3 = 0"), ids.filter("cast(clip_id as bigint) % 3 > 0")):
        part.write.mode("append").parquet(src)
        incremental.ingest(spark.readStream.schema(ids.schema).parquet(src), out, mark, clean=clean).awaitTermination()
    if sum(seen) != ids.count():
        raise ValueError("rows were read again")
    return spark.read.parquet(out).select("clip_id")


@query("v10_row_map", "vectors", "SELECT clip_id, array_to_string(list_sort(list(row_id)), ',') AS rows FROM vectors WHERE clip_id <> 'c3' GROUP BY clip_id")
def v10(spark, sf_dir, v):
    """Rows of each wanted clip; unknown clips are dropped."""
    wanted = v.filter("clip_id <> 'c3'").select("clip_id").distinct().unionByName(spark.createDataFrame([("nobody",)], "clip_id string"))
    return vector_search.rows_of(v, wanted).groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_list("row_id")), ",").alias("rows"))


@query("k08_checked_runs", "assignments", "SELECT * FROM (VALUES ('good', true), ('no distance', false), ('null clip', false)) v(name, accepted) WHERE (SELECT count(*) FROM assignments) >= 0")
def k08(spark, sf_dir, a):
    cases = {"good": a, "no distance": a.drop("distance"), "null clip": a.withColumn("clip_id", F.lit(None).cast("string"))}
    out = []
    for name, d in cases.items():
        try:
            writers.write_assignments(d, workdir(spark, "checked"))
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return _values(spark, out, "name string, accepted boolean")



