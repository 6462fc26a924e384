"""Quality rules with adaptive thresholds.

Each document gets a few metrics. Per language and source, a log-bucket histogram of each metric is
a mergeable quantile sketch of 1 % relative error: sketches of parts add up by their counts, so the
sketch of a language is the sum of its sources'. Thresholds are fences made of a sketch's quartiles and
their distance alone; no metric has a cutoff of its own. Metrics that are zero for most documents are
sketched over their positive values, whose fences are multiples (quartiles of logarithms), as their
quartiles would be zero otherwise. A group's fence is held within its language's, so that a source
which is mostly junk doesn't set its own standard, and groups of few values take their language's. The
thresholds are joined to the documents, and documents beyond any of them are rejected.

Defined results: null and empty texts have no words and fail the base rule; null languages and
sources are groups of their own; repeated rows are judged alike; texts are read whole; an empty
table gives no rows; other columns are not read by ``judge`` and are kept by ``keep``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, null_key

GAMMA = 1.02
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass(frozen=True)
class Metric:
    """An expression over the counts; ``rare`` ones are zero for most documents."""

    name: str
    value: str
    rare: bool = False
    two_sided: bool = False


METRICS = (
    Metric("punctuation", "n_punctuation / greatest(word_chars, 1)"),
    Metric("dup_lines", "n_dup_lines / greatest(n_lines, 1)", rare=True),
    Metric("repeats", "n_repeat_words / greatest(n_words, 1)", rare=True),
    Metric("capitals", "n_capitals / greatest(word_chars, 1)"),
    Metric("word_length", "word_chars / greatest(n_words, 1)", two_sided=True),
)
#: Multiples of the quartile distance for a group and for its language, and for rare metrics; values that a group needs.
GROUP_REACH, LANGUAGE_REACH, RARE_REACH, LEAST_DOCS = 3.0, 4.0, 1.5, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_punctuation")


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a text."""
    raw = text.encode() if text else b""
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        seen, end = Counter(grams), 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    joined = b"".join(words)
    return (
        n, len(joined.decode()), len(joined) - len(joined.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), len(joined) - len(joined.translate(None, CAPITALS)), len(joined) - len(joined.translate(None, PUNCTUATION)),
    )


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) -> doc_id, group keys, COUNTS."""

    def each(batches):
        for ids, texts, langs, sources in batches:
            yield [(i, lg, s, *counts(t)) for i, t, lg, s in zip(ids, texts, langs, sources, strict=True)]

    keyed = docs.select("doc_id", "text", null_key("lang").alias("lang_key"), null_key("source").alias("source_key"))
    schema = "doc_id long, lang_key string, source_key string, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_rows(keyed, ["doc_id", "text", "lang_key", "source_key"], schema, each)


def sketch(feats: DataFrame) -> DataFrame:
    """Histogram sketches: lang_key, source_key, metric, bucket, n. Equal to the sum of the sketches of any parts."""
    values = F.explode(F.array(*[F.struct(F.lit(m.name).alias("metric"), F.expr(m.value).cast("double").alias("v"), F.lit(m.rare).alias("rare")) for m in METRICS]))
    bucket = F.when(F.col("v") > 0, F.ceil(F.log("v") / math.log(GAMMA))).otherwise(F.lit(-100_000)).cast("int")
    return (
        feats.filter(~base_failed()).select("lang_key", "source_key", values.alias("x")).select("lang_key", "source_key", "x.*")
        .filter("v > 0 or not rare").groupBy("lang_key", "source_key", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    )


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Add sketches up to those of coarser groups."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, docs, q25, q75 from sketches; a bucket's value is its middle."""
    by = Window.partitionBy(*keys, "metric")
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (1 + GAMMA))
    s = sketches.select(*keys, "metric", value.alias("v"), F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("docs"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("v")))
    return s.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang_key, source_key, and a low_ and high_ column for each metric."""
    group = quartiles(sketches, "lang_key", "source_key")
    lang = quartiles(merge(sketches, "lang_key"), "lang_key").select(
        "lang_key", "metric", F.col("docs").alias("ldocs"), F.col("q25").alias("l25"), F.col("q75").alias("l75")
    )
    every = quartiles(merge(sketches)).select("metric", F.col("q25").alias("a25"), F.col("q75").alias("a75"))
    x = group.join(lang, ["lang_key", "metric"]).join(every, ["metric"])
    few, l_few = F.col("docs") < LEAST_DOCS, F.col("ldocs") < LEAST_DOCS
    l25, l75 = F.when(l_few, F.col("a25")).otherwise(F.col("l25")), F.when(l_few, F.col("a75")).otherwise(F.col("l75"))
    g25, g75 = F.when(few, l25).otherwise(F.col("q25")), F.when(few, l75).otherwise(F.col("q75"))
    rare = F.col("metric").isin([m.name for m in METRICS if m.rare])
    up = lambda a, b, reach: F.when(rare, b * F.pow(b / a, F.lit(RARE_REACH))).otherwise(b + reach * (b - a)) * GAMMA
    down = lambda a, b, reach: (a - reach * (b - a)) / GAMMA
    # a bucket's width more, so that no value of the quartile's own bucket is beyond it
    high = F.least(up(g25, g75, GROUP_REACH), up(l25, l75, LANGUAGE_REACH))
    low = F.greatest(down(g25, g75, GROUP_REACH), down(l25, l75, LANGUAGE_REACH))
    x = x.select("lang_key", "source_key", "metric", low.alias("low"), high.alias("high"))
    one = lambda m, c: F.max(F.when(F.col("metric") == m.name, F.col(c))).alias(f"{c}_{m.name}")
    return x.groupBy("lang_key", "source_key").agg(*[one(m, c) for m in METRICS for c in ("low", "high")])


def verdict():
    """True where base and all thresholds hold; a group without thresholds has no documents past the base rule."""
    good = ~base_failed()
    for m in METRICS:
        v = F.expr(m.value)
        good = good & F.coalesce(v <= F.col(f"high_{m.name}"), F.lit(True))
        if m.two_sided:
            good = good & F.coalesce(v >= F.col(f"low_{m.name}"), F.lit(True))
    return good


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and thresholds, both written to the shared folder."""
    feats = materialize(features(docs), "quality")
    return feats, materialize(thresholds(sketch(feats)), "fences")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept."""
    feats, fences = fit(docs)
    return feats.join(fences, ["lang_key", "source_key"], "left").select(
        "doc_id", *COUNTS[:5], base_failed().alias("base_failed"), verdict().alias("kept")
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns as they were.

    The counts are made again beside the text rather than joined to it, so no text is shuffled.
    """
    feats, fences = fit(docs)
    inner = [f"_q_{i}" for i in range(len(docs.columns))]
    text_at = docs.columns.index("text")
    renamed = docs.toDF(*inner).withColumns({"lang_key": null_key(inner[docs.columns.index("lang")]), "source_key": null_key(inner[docs.columns.index("source")])})

    def each(batches):
        for cols in batches:
            yield [(*row, *counts(row[text_at])) for row in zip(*cols, strict=True)]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema) + ", " + ", ".join(f"{c} long" for c in COUNTS)
    counted = map_rows(renamed, renamed.columns, schema, each)
    return counted.join(fences, ["lang_key", "source_key"], "left").filter(verdict()).select(*inner).toDF(*docs.columns)
