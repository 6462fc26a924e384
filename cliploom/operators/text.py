"""Full-text search over captions: query parsing, an inverted index, boolean and phrase matching, BM25.

A clip's document is its captions joined by a space, in uid order, so phrases may straddle captions.
The index is a table (term, clip_id, positions, doc_len); a query reads only its own terms' rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import alphanumeric

#: BM25 as in Robertson & Zaragoza (2009).
K1, B = 1.2, 0.75
#: Words that end no search phrase (fixed values).
STOP_WORDS = frozenset("a an the of to in on at for with by is are".split())
#: Words that connect parts of a scenario (fixed values).
CONNECTORS = ("while", "with", "and", "when", "during", "near", "in", "on", "at", "under", "after", "before")

_TOKEN = re.compile(r'"([^"]*)"|(\S+)')


@dataclass(frozen=True)
class Node:
    """A boolean query: op is phrase, and, or, not (left without right)."""

    op: str
    words: tuple[str, ...] = ()
    kids: tuple[Node, ...] = ()

    def phrases(self) -> list[tuple[str, ...]]:
        own = [self.words] if self.op == "phrase" else []
        return list(dict.fromkeys(own + [p for k in self.kids for p in k.phrases()]))


def tokens_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower()))


def sanitize(query: str) -> list[str]:
    """Quoted phrases, upper-case operators, and runs of bare words as one phrase each."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            out.append(f'"{" ".join(run)}"')
            run.clear()

    for quoted, word in _TOKEN.findall(query.replace("-", " ")):
        if word.upper() in ("AND", "OR", "NOT"):
            close()
            out.append(word.upper())
        elif quoted:
            close()
            out.append(f'"{quoted}"')
        elif clean := word.strip('"'):
            run.append(clean)
    close()
    return out


def parse(query: str) -> Node | None:
    """The boolean tree of a query: NOT binds closest, then AND (also between neighbours), then OR.

    Operators without a phrase on each side they need are passed over; without any phrase, None.
    """
    parts = sanitize(query)
    at = 0

    def leaf() -> Node | None:
        nonlocal at
        while at < len(parts) and parts[at] in ("AND", "NOT"):
            at += 1
        if at >= len(parts) or parts[at] == "OR":
            return None
        words = tokens_of(parts[at])
        at += 1
        return Node("phrase", words) if words else leaf()

    def without() -> Node | None:
        nonlocal at
        left = leaf()
        while left and at < len(parts) and parts[at] == "NOT":
            at += 1
            if right := leaf():
                left = Node("not", kids=(left, right))
        return left

    def conjunction() -> Node | None:
        nonlocal at
        kids = []
        while at < len(parts) and parts[at] != "OR":
            if parts[at] == "AND":
                at += 1
                continue
            if k := without():
                kids.append(k)
        return None if not kids else kids[0] if len(kids) == 1 else Node("and", kids=tuple(kids))

    kids = []
    while at < len(parts):
        if parts[at] == "OR":
            at += 1
            continue
        if k := conjunction():
            kids.append(k)
    return None if not kids else kids[0] if len(kids) == 1 else Node("or", kids=tuple(kids))


def parse_any(queries: Sequence[str]) -> Node | None:
    """Several queries as one OR, repeated ones once."""
    kids = [n for q in dict.fromkeys(queries) if (n := parse(q))]
    return None if not kids else kids[0] if len(kids) == 1 else Node("or", kids=tuple(dict.fromkeys(kids)))


def documents(captions: DataFrame) -> DataFrame:
    """clip_id, doc, sources: one document per clip."""
    c = captions.groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("uid", "caption"))).alias("c"),
        F.array_sort(F.collect_set(alphanumeric(F.col("data_source")))).alias("sources"),
    )
    return c.select("clip_id", F.array_join(F.transform("c", lambda x: x["caption"]), " ").alias("doc"), "sources")


def tokens(doc: Column) -> Column:
    return F.regexp_extract_all(F.lower(doc), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def build_index(captions: DataFrame) -> DataFrame:
    """term, clip_id, positions, doc_len, sources: write it partitioned or sorted by term for pruning."""
    d = documents(captions).withColumn("t", tokens(F.col("doc"))).withColumn("doc_len", F.size("t"))
    e = d.select("clip_id", "sources", "doc_len", F.posexplode("t").alias("pos", "term"))
    return e.groupBy("term", "clip_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.first("doc_len").alias("doc_len"), F.first("sources").alias("sources"))


def write_index(captions: DataFrame, path: str) -> None:
    """The index in ranges of terms, sorted by term, so that a query's files and row groups are found by their statistics;
    and its statistics beside it. Captions are tokenized once."""
    _write(build_index(captions), captions, path)


def _write(index: DataFrame, captions: DataFrame, path: str) -> None:
    spark = captions.sparkSession
    index.repartitionByRange("term", "clip_id").sortWithinPartitions("term", "clip_id").write.parquet(f"{path}/terms")
    # one term of each document is its first word
    first = spark.read.parquet(f"{path}/terms").filter(F.col("positions")[0] == 0)
    words = first.agg(F.sum("doc_len").cast("double")).first()[0] or 0.0
    n_docs = captions.select("clip_id").distinct().count()  # clips without a word count as well
    spark.createDataFrame([(n_docs, words / n_docs if n_docs else None)], "n_docs bigint, avg_len double").write.parquet(f"{path}/stats")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a lasting index, in order; statistics are written last."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place(path))]
    return sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n) and fs.exists(place(f"{path}/{n}/stats/_SUCCESS")))


def _next_version(spark: SparkSession, path: str) -> str:
    """The folder of a new version. Another writer that takes the same one makes the slower of both fail; readers keep theirs."""
    return f"{path}/v={max(versions(spark, path), default=0) + 1}"


def save_index(captions: DataFrame, path: str) -> None:
    """Write the index of all captions as the next version in ``path``."""
    write_index(captions, _next_version(captions.sparkSession, path))


def refresh_index(captions: DataFrame, path: str, changed: DataFrame) -> None:
    """Write the next version: the last one, with the documents of the changed clips built again. Only their captions are tokenized."""
    spark = captions.sparkSession
    _write(update_index(open_index(spark, path)[0], captions, changed), captions, _next_version(spark, path))


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, int, float]:
    """The last finished version."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no index in {path}")
    return read_index(spark, f"{path}/v={found[-1]}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last versions, which readers may still use."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    for v in versions(spark, path)[:-keep]:
        place(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(place(f"{path}/v={v}"), True)


def read_index(spark, path: str) -> tuple[DataFrame, int, float]:
    """The index, its number of documents and their mean length, from the files."""
    row = spark.read.parquet(f"{path}/stats").head()
    return spark.read.parquet(f"{path}/terms"), row.n_docs, row.avg_len


def index_stats(captions: DataFrame) -> DataFrame:
    """One row: n documents and their mean length; kept beside the index."""
    d = documents(captions).select(F.size(tokens(F.col("doc"))).alias("n"))
    return d.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))


def _frequency(words: tuple[str, ...]) -> Column:
    """Occurrences of a phrase, from the map term -> positions."""
    at = [F.coalesce(F.col("m")[w], F.array().cast("array<int>")) for w in words]
    hits = at[0] if len(at) == 1 else F.filter(at[0], lambda p: reduce(lambda a, b: a & b, [F.array_contains(x, p + k) for k, x in enumerate(at) if k]))
    return F.size(hits)


def _matches(n: Node, tf: dict[tuple[str, ...], Column]) -> Column:
    if n.op == "phrase":
        return tf[n.words] > 0
    kids = [_matches(k, tf) for k in n.kids]
    if n.op == "not":
        return kids[0] & ~kids[1]
    return reduce((lambda a, b: a & b) if n.op == "and" else (lambda a, b: a | b), kids)


def search(
    index: DataFrame, n_docs: int, avg_len: float, query: Node | None, sources: Sequence[str] | None = None, pool: DataFrame | None = None, limit: int | None = 100_000
) -> DataFrame:
    """clip_id, bm25: matching clips, best first up to ``limit``; sources and pool narrow before the limit.

    A phrase counts as one term, with its own document frequency over the whole index.
    """
    if query is None:
        return index.select("clip_id", F.lit(0.0).alias("bm25")).filter(F.lit(False))
    phrases = query.phrases()
    words = sorted({w for p in phrases for w in p})
    hits = index.filter(F.col("term").isin(words)).groupBy("clip_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"), F.first("doc_len").alias("doc_len"), F.first("sources").alias("sources")
    )
    hits = hits.select("clip_id", "doc_len", "sources", *[_frequency(p).alias(f"tf{k}") for k, p in enumerate(phrases)])
    df = hits.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"d{k}") for k in range(len(phrases))])
    tf = {p: F.col(f"tf{k}") for k, p in enumerate(phrases)}
    found = hits.filter(_matches(query, tf))
    if sources is not None:
        found = found.filter(F.arrays_overlap("sources", F.array(*[F.lit("".join(re.findall("[a-z0-9]", s.lower()))) for s in sources])))
    if pool is not None:
        found = found.join(pool.select("clip_id"), "clip_id", "left_semi")
    row = df.head()
    length = K1 * (1 - B + B * F.col("doc_len") / avg_len)
    score = F.lit(0.0)
    for k in range(len(phrases)):
        d = row[f"d{k}"]
        idf = F.greatest(F.log(F.lit((n_docs - d + 0.5) / (d + 0.5))), F.lit(1e-6))
        score = score + idf * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + length)
    out = found.select("clip_id", score.alias("bm25"))
    return out if limit is None else out.orderBy(F.desc("bm25"), "clip_id").limit(limit)


def scaled_limit(pool_size: int, ranked_before: bool) -> int:
    """The limit the query language states; unneeded here, where the pool narrows before the limit."""
    return min(max(3 * pool_size, 100_000), 200_000) if ranked_before else 100_000


def update_index(index: DataFrame, captions: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with the documents of changed clips built again."""
    new = build_index(captions.join(changed.select("clip_id"), "clip_id", "left_semi"))
    return index.join(changed.select("clip_id"), "clip_id", "left_anti").unionByName(new)


def captions_by_model(captions: DataFrame) -> DataFrame:
    """clip_id, model_name, captions: structs in start order."""
    s = F.array_sort(F.collect_list(F.struct("start_time", "uid", "end_time", "caption")))
    return captions.groupBy("clip_id", "model_name").agg(s.alias("captions"))


def normalize_rewrite(text: str) -> str:
    """Lower case, at most three words, no stop word at the end."""
    words = text.lower().split()[:3]
    while len(words) > 1 and words[-1] in STOP_WORDS:
        words.pop()
    return " ".join(words)


def distinct_rewrites(rewrites: Sequence[str]) -> list[str]:
    return [r for r in dict.fromkeys(map(normalize_rewrite, rewrites)) if r]


def glossary_hints(query: str, glossary: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Entries of the glossary that the query contains."""
    return {t: list(s) for t, s in glossary.items() if t in query.lower()}


def decompose(description: str) -> list[str] | None:
    """Parts of a scenario between connector words, without stop words; None if there are fewer than two."""
    split = re.split(r"\b(?:" + "|".join(CONNECTORS) + r")\b|[,;.]", description.lower())
    chunks = [" ".join(w for w in tokens_of(c) if w not in STOP_WORDS) for c in split]
    chunks = [c for c in chunks if c]
    return chunks if len(chunks) >= 2 else None
