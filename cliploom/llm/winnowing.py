"""Benchmark decontamination by winnowing.

Of each ``K + W - 1 = WINDOW`` consecutive words, both a document and an item keep the smallest of the W hashes
of K words as a fingerprint. Equal runs of WINDOW words have equal smallest hashes at equal places, so every
shared window is found by an equal fingerprint. Fingerprints travel with the hashes of the W - 1 words on either
side. Those of documents and items are joined, and each meeting is extended to both sides word by word; a run
of WINDOW equal words or more holds whole windows, and all its words are hit. An item of fewer words than WINDOW
is one window of its own: its one hash is looked for at all places of the documents.

Documents ask a bit table of the items' hashes (``FILTER_BITS`` bits, whatever the number of items) before a
fingerprint leaves the task, so only candidates are shuffled. Items that share a passage share a row with the list of
their ids. ``spans`` gives the hit words and items of each document, ``keep`` the documents that aren't contaminated.

Defined results: null and empty texts, and texts without a word, have no window and no hit; rows that share a
doc_id are judged each by its own text; rows that share an item_id are one item; an item_id of null is an item
whose name is the empty string; texts are read whole; an empty table of documents gives no rows, an empty
benchmark no hits; ``keep`` leaves other columns as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, map_rows, materialize, terms_of
from .substring import WordHashes, mix

WINDOW = 10
K = 5
W = WINDOW - K + 1
#: Bits of the table that documents ask first: 2 MiB, sent to every task.
FILTER_BITS = 1 << 24
#: Rows of items are copied so often, so that the documents that share a passage are split.
SALT = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words at each place, by their word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h *= _PRIME
        h += words[k : k + n]
    return mix(h)


def winnowed(h: np.ndarray) -> np.ndarray:
    """Places of the smallest of each W hashes in a row, all of them where they are equal."""
    if len(h) < W:
        return np.zeros(0, np.int64)
    low = h
    for step in (1, 2, W - 4):  # smallest of 2, 4 and W in a row
        low = np.minimum(low[:-step], low[step:])
    worst, most = np.zeros(len(low) + 2 * (W - 1), np.uint64), 0  # a place is kept if the largest of its windows' minima is its own hash
    worst[W - 1 : W - 1 + len(low)] = low
    for step in (1, 2, W - 4):
        worst = np.maximum(worst[:-step], worst[step:])
    return np.flatnonzero(worst == h)


assert 5 <= W <= 8


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fingerprints of a text, and their places."""
    h = run_hashes(words, K)
    at = winnowed(h)
    return h[at], at


def contexts(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place, the word hashes from W - 1 before it to W - 1 behind its K words; 0 beyond the text's ends."""
    padded = np.concatenate([np.zeros(W - 1, np.uint64), words, np.zeros(W - 1, np.uint64)])
    return padded[at[:, None] + np.arange(K + 2 * (W - 1))[None]]


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the table for each hash."""
    return np.stack([h % np.uint64(bits), (h >> np.uint64(32)) % np.uint64(bits)])


def item_prints(items: DataFrame) -> DataFrame:
    """h, size (words of a window: WINDOW, or all of a short item), near (context, or the short item's words), name."""

    def each(batches):
        hashes = WordHashes()
        for names, texts in batches:
            rows = []
            for name, text in zip(names, texts, strict=True):
                words = hashes.of(terms_of(text))
                if len(words) >= WINDOW:
                    h, at = fingerprints(words)
                    rows += [(x, WINDOW, c, name) for x, c in zip(h.view(np.int64).tolist(), contexts(words, at).view(np.int64), strict=True)]
                elif len(words):
                    rows.append((int(run_hashes(words, len(words)).view(np.int64)[0]), len(words), words.view(np.int64), name))
            yield rows

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")
    return map_rows(named, ["name", "text"], "h long, size int, near array<long>, name string", each)


def hash_filter(prints: DataFrame) -> np.ndarray:
    """The bits that the items' hashes set, packed; at most eight tables of a fixed size come to the driver."""
    size = FILTER_BITS

    def each(batches):
        table = np.zeros(size, bool)
        for (h,) in batches:
            table[slots(np.array(h, np.int64).view(np.uint64), size)] = True
        yield [(np.packbits(table).tobytes(),)]

    table = np.zeros(size // 8, np.uint8)
    for row in map_rows(prints.select("h").distinct().coalesce(8), ["h"], "bits binary", each).collect():
        table |= np.frombuffer(row.bits, np.uint8)
    return table


def candidates(docs: DataFrame, table: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, digest (of texts with candidates), found: fingerprints that the table may hold.

    ``sizes`` are the numbers of words of short items.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def each(batches):
        hashes, bits = WordHashes(), np.unpackbits(shared.value).view(bool)

        def may(h):
            a, b = slots(h, len(bits))
            return np.flatnonzero(bits[a] & bits[b])

        for ids, texts in batches:
            rows = []
            for i, text in zip(ids, texts, strict=True):
                words, found = hashes.of(terms_of(text)), []
                h, at = fingerprints(words)
                if len(m := may(h)):
                    near = contexts(words, at[m]).view(np.int64).tolist()
                    found += [{"h": x, "size": WINDOW, "at": p, "near": c} for x, p, c in zip(h[m].view(np.int64).tolist(), at[m].tolist(), near, strict=True)]
                for size in sizes:
                    h, signed = run_hashes(words, size), words.view(np.int64)
                    found += [{"h": int(h[p : p + 1].view(np.int64)[0]), "size": size, "at": p, "near": signed[p : p + size].tolist()} for p in may(h).tolist()]
                rows.append((i, len(words), hashlib.md5(text.encode()).hexdigest() if found else None, found))
            yield rows

    schema = "doc_id long, n_words long, digest string, found array<struct<h:long,size:int,at:int,near:array<long>>>"
    return map_rows(docs, ["doc_id", "text"], schema, each)


def _equal(a: str, b: str) -> str:
    """SQL: how many first elements of two arrays are equal; 0 is a place beyond a text's end."""
    step = "struct(if(s.on and same, s.n + 1, s.n) as n, s.on and same as on)"
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x = y and x <> 0), struct(0 as n, true as on), (s, same) -> {step}, s -> s.n)"


def extended(found: DataFrame, prints: DataFrame) -> DataFrame:
    """(_r, h, size, at, near) and the items' prints -> _r, lo, hi (words of a run that holds whole windows), names."""
    items = prints.groupBy("h", "size", F.col("near").alias("other")).agg(F.collect_set("name").alias("names"))
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = found.withColumn("salt", F.pmod(F.xxhash64("_r"), F.lit(SALT)).cast("int")).join(items, ["h", "size", "salt"])
    side = W - 1
    back = _equal(f"reverse(slice(near, 1, {side}))", f"reverse(slice(other, 1, {side}))")
    ahead = _equal(f"slice(near, {side + 1}, {K + side})", f"slice(other, {side + 1}, {K + side})")
    met = met.withColumn("back", F.expr(f"if(size < {WINDOW}, 0, {back})")).withColumn("ahead", F.expr(f"if(size < {WINDOW}, {_equal('near', 'other')}, {ahead})"))
    met = met.filter((F.col("back") + F.col("ahead") >= F.col("size")) & (F.col("ahead") >= F.least("size", F.lit(K))))
    return met.select("_r", (F.col("at") - F.col("back")).alias("lo"), (F.col("at") + F.col("ahead")).alias("hi"), "names")


def spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, digest (null where nothing is hit), n_hit, spans (ordered runs of hit
    words, lo and hi, which may overlap) and names (of the items, ordered)."""
    prints = materialize(item_prints(items), "prints")
    sizes = sorted(r.size for r in prints.filter(F.col("size") < WINDOW).select("size").distinct().collect())
    rows = materialize(candidates(docs, hash_filter(prints), sizes).withColumn("_r", F.monotonically_increasing_id()), "candidates")
    found = rows.filter(F.size("found") > 0).select("_r", F.explode("found").alias("f")).select("_r", "f.*")
    hits = extended(found, prints).groupBy("_r")
    hits = hits.agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))
    hit = "aggregate(spans, struct(0L as n, 0 as at), (s, x) -> struct(s.n + greatest(x.hi - greatest(x.lo, s.at), 0) as n, greatest(s.at, x.hi) as at), s -> s.n)"
    hits = materialize(hits.withColumn("n_hit", F.expr(hit)), "hits")
    drop_scratch(prints)
    out = rows.select("doc_id", "n_words", "digest", "_r").join(hits, "_r", "left").drop("_r")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "digest": F.when(F.col("n_hit") > 0, F.col("digest"))})


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    names = F.coalesce("names", F.array().cast("array<string>"))
    return spans(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep(docs: DataFrame, items: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of docs in which at most the share ``most`` of the words is hit."""
    gone = spans(docs, items).filter((F.col("n_hit") > 0) & (F.col("n_hit") > most * F.col("n_words"))).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct()
    own = docs.toDF(*[f"_s{i}" for i in range(len(docs.columns))])
    at = lambda c: F.col(f"_s{docs.columns.index(c)}")
    same = at("doc_id").eqNullSafe(F.col("_doc")) & (F.md5(at("text")) == F.col("_digest"))
    return own.join(materialize(gone, "gone"), same, "left_anti").toDF(*docs.columns)


def oracle() -> str:
    """The same verdict as SQL."""
    words = "regexp_extract_all(translate({0}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    windows = "SELECT {0}, size, i, array_to_string(ws[i : i + size - 1], ' ') AS run FROM (SELECT {0}, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM {1})"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words.format("documents")}, []) AS ws FROM documents),
b AS (SELECT item_id, {words.format("benchmark")} AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM b WHERE len(ws) > 0),
item AS (SELECT DISTINCT item_id, size, run FROM ({windows.format("item_id", "s")})),
doc AS ({windows.format("doc_id", "d, (SELECT DISTINCT size FROM s)")}),
hit AS (SELECT DISTINCT doc_id, item_id, i, size FROM doc JOIN item USING (size, run)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
