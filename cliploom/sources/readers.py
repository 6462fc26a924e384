"""Readers: tables, embedding shards, score maps, metric and prediction files, media and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hms_seconds, squeeze
from ..model import schema
from . import tensors


def table(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """A Parquet table, with the entity's columns only where one is named."""
    df = spark.read.parquet(path)
    return df if entity is None else df.select(*schema(entity).fieldNames())


def jdbc_table(spark: SparkSession, url: str, name: str, partition_column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table, read by ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=partition_column, lowerBound=low, upperBound=high, numPartitions=parts)


def embedding_shards(spark: SparkSession, path: str, column: str = "embeddings", one_per_clip: bool = True, keep: DataFrame | None = None, element: str = "float") -> DataFrame:
    """clip_id, vec, row_id from a folder of Parquet shards, whose vectors have this element type; broken files are skipped.

    one_per_clip keeps each clip's first row by file name and place.
    """
    # with the schema stated, no file is opened to guess it, and only the two columns are read
    r = spark.read.schema(f"clip_id string, `{column}` array<{element}>").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).parquet(path)
    v = r.select("clip_id", F.col(column).cast("array<float>").alias("vec"), F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("at"))
    if keep is not None:
        v = v.join(keep.select("clip_id"), "clip_id", "left_semi")
    if one_per_clip:
        v = v.groupBy("clip_id").agg(F.min_by("vec", "at").alias("vec"), F.min("at").alias("at"))
    return v.select("clip_id", "vec", F.xxhash64("at.f", "at.i").alias("row_id"))


def view_shards(spark: SparkSession, path: str) -> DataFrame:
    """clip_id, vec, row_id of array shards (.npz with arrays embeddings and clip_ids), several views a clip."""
    v = tensors.view_rows(tensors.files(spark, path, "*.npz"))
    return v.select("clip_id", "vec", F.xxhash64("path", "position").alias("row_id"))


def score_maps(spark: SparkSession, path: str, name: str = "predicted_scores.json") -> DataFrame:
    """run_id, clip_id, p from <run>/<name>, each a JSON map."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return t.select(run.alias("run_id"), F.explode(F.from_json("value", "map<string, double>")).alias("clip_id", "p"))


def runs(spark: SparkSession, path: str, metadata: str = "run_id string, status string, embed_type string, started_at string", name: str = "metadata.json") -> DataFrame:
    """A row per run folder with a readable file of metadata, others skipped."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    parsed = t.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"), F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", metadata)).alias("m"))
    return parsed.filter("m is not null").select("folder", "m.*").withColumn("run_id", F.coalesce("run_id", "folder"))


def shard(df: DataFrame, key: str, process: int, processes: int) -> DataFrame:
    """Every n-th row of the sorted distinct keys: an exact copy of a static split between processes."""
    w = Window.orderBy(key)  # a list of file names
    return df.dropDuplicates([key]).withColumn("_r", F.row_number().over(w) - 1).filter(F.col("_r") % processes == process).drop("_r")


def media_files(spark: SparkSession, path: str, pattern: str = "*.mp4", clip_part: int = -2, camera: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """clip_id, path, length of media files; the clip id is a part of the path, counted from its end."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    f = f.select(F.element_at(parts, F.lit(clip_part)).alias("clip_id"), "path", "length")
    if camera:
        f = f.filter(F.contains("path", F.lit(camera)))
    return f if exclude is None else f.join(exclude.select("clip_id"), "clip_id", "left_anti")


def varying_part(paths: DataFrame) -> int:
    """The place, counted from the end, of the path part with the most distinct values; ties: the last folder."""
    n = paths.select(F.posexplode(F.reverse(F.split("path", "/"))).alias("i", "part")).groupBy("i").agg(F.countDistinct("part").alias("n"))
    row = n.filter("i > 0").orderBy(F.desc("n"), "i").head()
    return -(row.i + 1)


def available(spark: SparkSession, path: str, pattern: str, id_regex: str) -> DataFrame:
    """clip_id of files whose name matches; only names are listed."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select(F.regexp_extract("path", id_regex, 1).alias("clip_id")).filter("clip_id <> ''").distinct()


def messy_csv(spark: SparkSession, path: str, columns: dict[str, str], integers: Sequence[str] = (), durations: Sequence[str] = (), lower: Sequence[str] = ()) -> DataFrame:
    """CSV with headers mapped to names; white space squeezed; integers fall back to 0; HH:MM:SS becomes seconds."""
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    by_name = {c.strip().lower(): c for c in r.columns}

    def value(src: str, name: str) -> Column:
        c = squeeze(F.col(f"`{by_name[src.lower()]}`")) if src.lower() in by_name else F.lit(None).cast("string")
        if name in integers:
            return F.coalesce(F.regexp_replace(c, ",", "").try_cast("int"), F.lit(0))
        if name in durations:
            return hms_seconds(c)
        return F.lower(c) if name in lower else c

    return r.select(*[value(s, n).alias(n) for s, n in columns.items()])


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """Frame entries of JSON files of one or more videos: video_id, first_frame, last_frame, cmd, blip; of a video in several files the last by name."""
    r = spark.read.schema("folder string, first_frame int, last_frame int, cmd int, blip string").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    r = r.select(F.col("folder").alias("video_id"), "first_frame", "last_frame", "cmd", "blip", F.col("_metadata.file_path").alias("f"))
    last = r.groupBy("video_id").agg(F.max("f").alias("f"))
    return r.join(last, ["video_id", "f"], "left_semi").drop("f")


def captions(spark: SparkSession, path: str, kind: str = "parquet", jdbc_url: str | None = None) -> DataFrame:
    """Captions from Parquet or a database, as the captions entity."""
    df = spark.read.parquet(path) if kind == "parquet" else spark.read.jdbc(jdbc_url, path)
    return df.select(*schema("captions").fieldNames())


def eval_table(spark: SparkSession, path: str, required: str, ids: DataFrame | None = None) -> DataFrame:
    """CSV, JSON lines or Parquet by ending; KeyError if an id that is needed isn't there."""
    read = spark.read
    df = read.option("header", True).csv(path) if path.endswith(".csv") else read.json(path) if path.endswith((".jsonl", ".json")) else read.parquet(path)
    if ids is not None:
        missing = ids.select(required).join(df.select(required), required, "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"no row for {[r[0] for r in missing]}")
    return df


def clip_index(spark: SparkSession, *paths: str) -> DataFrame:
    """clip_id, row of the first path that can be read; the first row of a clip counts."""
    for p in paths:
        try:
            df = spark.read.parquet(p).select("clip_id", "row")
        except Exception as e:  # noqa: BLE001  (any reader error sends us on; the last one is told)
            last = e
            continue
        return df.groupBy("clip_id").agg(F.min("row").alias("row"))
    raise FileNotFoundError(f"none of {paths} can be read") from last


def ego_from_poses(poses: DataFrame) -> DataFrame:
    """(clip_id, timestamp_us, pose: 16 numbers by row, kind) -> clip_id, timestamp_us, x, y, z in forward-left-up axes."""
    from ..functions.scalars import frame_axes

    at = lambda i: F.col("pose")[i]
    return poses.withColumn("p", frame_axes(F.col("kind"), at(3), at(7), at(11))).select("clip_id", "timestamp_us", "p.x", "p.y", "p.z")


def trajectories_of(frames: DataFrame) -> DataFrame:
    """Exploded frames (clip_id, frame, channels) -> one row per clip with the frames in order."""
    cols = ["x", "y", "z", "speed", "acceleration", "jerk", "curvature"]
    s = F.struct(*[F.col(c).cast("float").alias(c) for c in cols])
    return frames.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", s.alias("s")))), lambda x: x["s"]).alias("frames"))
