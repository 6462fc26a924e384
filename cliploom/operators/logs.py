"""Server log analytics: schema on read by regular expressions, then counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_segment, path_without_query, query_value

_NUM = r"([0-9]*\.?[0-9]+)"
#: Line formats by record kind: pattern, and the names of its groups (fixed values of the log format).
FORMATS = {
    "http": (r'"([A-Z]+)\s+(\S+)\s+HTTP/[\d.]+"\s+(\d{3})', ("method", "path", "code")),
    "s3_error": (r"S3 error fetching\s+([^:]+):\s+(\w+)", ("key", "error")),
    "cache_hit": (rf"^(.*?)\s*from\s+cache\s+(\d+)\s+took\s+{_NUM}\s*$", ("key", "count", "sec")),
    "cache_miss": (rf"^(.*?)\s*from\s+search\s+(\d+)\s+took\s+{_NUM}\s*$", ("key", "count", "sec")),
    "search": (rf"^(.*?)\s*→\s*(\d+)\s+results\s+in\s+{_NUM}\s+s\s*$", ("key", "count", "sec")),
    "add": (rf"Adding\s+label\s+(.+?)\s+for\s+project\s+(.+?)\s+took\s+{_NUM}", ("label", "project", "sec")),
    "remove": (rf"Removing\s+label\s+(.+?)\s+for\s+project\s+(.+?)\s+took\s+{_NUM}", ("label", "project", "sec")),
    "verify": (rf"Verifying\s+label\s+(.+?)\s+for\s+project\s+(.+?)\s+took\s+{_NUM}", ("label", "project", "sec")),
    "label_many": (rf"Labelling\s+(\d+)\s+took\s+{_NUM}", ("count", "sec")),
    "upload": (rf"Uploading\s+(\d+)\s+took\s+{_NUM}", ("count", "sec")),
    "autolabel": (rf"Autolabel(?:ling|led)?\s+(\d+)\s+(?:pages|clips)\s+with\s+label\s+(.+?)\s+for\s+project\s+(.+?)\s+took\s+{_NUM}", ("count", "label", "project", "sec")),
    "rewrite": (r"Query rewrite: query=(.+)", ("key",)),
    "train": (r"Classifier training started: label=(.+?) embed_type=(\w+) n_pos=(\S*) n_neg=(\S*)", ("label", "embed_type", "n_pos", "n_neg")),
}
FIELDS = ("method", "path", "code", "key", "error", "count", "sec", "label", "project", "embed_type", "n_pos", "n_neg")


def parse(lines: DataFrame, col: str = "value") -> DataFrame:
    """ts, user, kind and the FIELDS of each line that starts with a time; blank and other lines go."""
    # a line's time and user (fixed patterns of the log format)
    head = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2}),\d{3}\s+(.*)$"
    x = lambda k: F.regexp_extract(col, head, k)
    d = lines.filter(F.col(col).rlike(head)).select(F.to_timestamp(F.concat_ws(" ", x(1), x(2))).alias("ts"), x(3).alias("rest"))
    user = r"^\[user=([^\]]+)\]\s+(.*)$"
    d = d.select("ts", F.nullif(F.regexp_extract("rest", user, 1), F.lit("")).alias("user"), F.when(F.col("rest").rlike(user), F.regexp_extract("rest", user, 2)).otherwise(F.col("rest")).alias("msg"))
    # within transforms the many patterns stay out of the stage's generated code, which would grow too large to be compiled
    kind = F.transform(F.array("msg"), lambda m: F.coalesce(*[F.when(m.rlike(p), F.lit(k)) for k, (p, _) in FORMATS.items()], F.lit("other")))[0]
    d = d.withColumn("kind", kind)

    def field(m: Column, name: str) -> Column:
        got = [F.when(m["kind"] == k, F.regexp_extract(m["msg"], p, names.index(name) + 1)) for k, (p, names) in FORMATS.items() if name in names]
        return F.coalesce(*got).alias(name)

    found = F.transform(F.array(F.struct("msg", "kind")), lambda m: F.struct(*[field(m, f) for f in FIELDS]))[0]
    d = d.select("ts", "user", "kind", found.alias("f")).select("ts", "user", "kind", "f.*")
    return d.withColumns({"code": F.col("code").try_cast("int"), "count": F.col("count").try_cast("long"), "sec": F.col("sec").try_cast("double")})


def between(records: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Records of the days from start to end, both included."""
    day = F.to_date("ts")
    r = records if start is None else records.filter(day >= F.lit(start).cast("date"))
    return r if end is None else r.filter(day <= F.lit(end).cast("date"))


def read(spark, path: str, recursive: bool = True) -> DataFrame:
    return parse(spark.read.option("recursiveFileLookup", recursive).text(path))


def top(df: DataFrame, key: Column | str, n: int, count: Column | None = None) -> DataFrame:
    """name, n: the most frequent values; ties by name."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.cast("string").alias("name")).agg((F.count("*") if count is None else count).alias("n")).filter("name is not null").orderBy(F.desc("n"), "name").limit(n)


def summary(records: DataFrame, n: int = 20) -> dict[str, DataFrame]:
    """All reports by name, each a small table; records are best cached, as every report reads them."""
    day, hour = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH")
    http = records.filter("kind = 'http'")
    path = path_without_query(F.col("path"))
    searches = records.filter("kind in ('cache_hit', 'cache_miss', 'search')").withColumn("hit", F.col("kind") == "cache_hit")
    edits = records.filter("kind in ('add', 'remove', 'verify', 'autolabel', 'label_many', 'upload')")
    video = http.filter(path == "/videos")
    ms = lambda c: F.avg(F.when(c, F.col("sec") * 1000))
    out = {
        "users_per_day": records.filter("user is not null").groupBy(day.alias("name")).agg(F.countDistinct("user").alias("n")),
        "requests_per_day": http.groupBy(day.alias("name")).agg(F.count("*").alias("n")),
        "requests_per_hour": http.groupBy(hour.alias("name")).agg(F.count("*").alias("n")),
        "requests_per_method": http.groupBy(F.col("method").alias("name")).agg(F.count("*").alias("n")),
        "requests_per_path": top(http, path, n),
        "requests_per_segment": top(http, first_segment(path), n),
        "requests_per_user": top(http, "user", n),
        "status": http.groupBy(F.col("code").cast("string").alias("name")).agg(F.count("*").alias("n")),
        "status_by_path": http.groupBy(path.alias("path"), F.col("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path", "code").limit(n),
        "errors_by_path": top(http.filter("code >= 400"), path, n),
        "anonymous_ratio": http.agg(F.avg(F.col("user").isNull().cast("double")).alias("ratio"), F.count("*").alias("n")),
        "storage_errors": top(records.filter("kind = 's3_error'"), "error", n),
        "storage_error_keys": top(records.filter("kind = 's3_error'"), "key", n),
        "cache": searches.agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), ms(F.col("hit")).alias("hit_ms"), ms(~F.col("hit")).alias("miss_ms"), F.count("*").alias("n")),
        "cache_per_day": searches.groupBy(day.alias("name")).agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("n")),
        "search_time_per_type": searches.groupBy(F.regexp_extract(F.coalesce("key", F.lit("")), r"^([a-z_]+)=", 1).alias("name")).agg(F.avg("sec").alias("sec"), F.count("*").alias("n")),
        "zero_results": searches.agg(F.count_if(F.col("count") == 0).alias("n")),
        "zero_result_keys": top(searches.filter("count = 0"), "key", n),
        "search_keys": top(searches, "key", n),
        "searchers": top(searches, "user", n),
        "search_texts": top(video, query_value(F.col("path"), "search"), n),
        "semantic_texts": top(video, query_value(F.col("path"), "semantic_text"), n),
        "filter_labels": top(video, query_value(F.col("path"), "filter"), n),
        "data_sources": top(video, query_value(F.col("path"), "data_source"), n),
        "edits_per_day": edits.groupBy(day.alias("day"), "kind").agg(F.count("*").alias("n")),
        "edits_per_user": top(edits, "user", n),
        "labels": top(edits, "label", n),
        "projects": top(edits, "project", n),
        "edit_seconds": edits.groupBy(F.col("kind").alias("name")).agg(F.avg("sec").alias("sec"), F.max("sec").alias("max_sec"), F.count("*").alias("n")),
        "labelled_clips": edits.groupBy(F.col("kind").alias("name")).agg(F.sum("count").alias("n")),
        "trainings": records.filter("kind = 'train'").groupBy(F.col("label").alias("name"), "embed_type").agg(F.count("*").alias("n")),
        "trainings_per_user": top(records.filter("kind = 'train'"), "user", n),
        "rewrites": top(records.filter("kind = 'rewrite'"), "key", n),
        "kinds": records.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")),
        "span": records.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")),
    }
    return out
