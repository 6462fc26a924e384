"""Ranked lexical search: a document-at-a-time heap merge over compressed postings, shard by shard.

The index is split by documents. A shard is a run of a task's documents, about ``SHARD_CHARS`` bytes of text
(one document may be more); its documents are numbered in ascending doc_id order, and each of its terms has one
row with the list of documents and occurrences, as differences in variable-length bytes. No posting is
shuffled to build it. ``write_index`` stores it, ``Index`` opens it again.

A search brings to a (block of items, shard) only the postings of the block's terms. There, each item's lists
are merged by a heap of cursors, one document at a time, into a bounded heap keyed by score, then doc_id. Lists
whose largest contributions together can't lift a document over the worst score in that heap are only looked up,
for documents that the others bring and that may still get in (an exact bound). The best of all shards are
merged by a window, which Spark limits before it shuffles.

Defined results: a null or empty text has no term and isn't counted; rows that share a doc_id are documents of
their own, in no defined order where their scores are equal; a null doc_id comes after others of an equal score; rows
that share an item_id are one item, null being an id as well; an item without a term, or whose terms no document
holds, has no rows; texts are read whole; an empty table on either side gives no rows; other columns aren't read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, scratch, terms_of

TOP = 10
#: Bytes of text after which a shard is closed.
SHARD_CHARS = 16 << 20
#: Items that are searched together, on average.
BLOCK_ITEMS = 256
#: A term's uses are copied so often, so that the postings of a term of many shards are split.
SALT = 32

ROWS = "part string, shard long, term binary, n int, total long, ids array<long>, docs binary, counts binary"
_ARROW = pa.schema([
    ("part", pa.string()), ("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int32()), ("total", pa.int64()),
    ("ids", pa.list_(pa.int64())), ("docs", pa.binary()), ("counts", pa.binary()),
])


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes of seven bits each, lowest first, the last without its high bit; and the bytes each takes."""
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        size += v >= np.uint64(1 << bits)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        has = size > k
        byte = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[has] - size[has] + k] = byte | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, size


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    if len(last) == len(b):
        return b.astype(np.int64)
    start = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(b)) - np.repeat(start, last - start + 1)) * 7
    return np.add.reduceat((b & 127).astype(np.int64) << shift, start)


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _lists(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Slices of data between offsets as binary values."""
    cut = data[offsets[0] : offsets[-1]]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(cut)])


def _shard_rows(shard: int, ids: list, docs: list[np.ndarray], vocabulary: dict) -> Iterator[pa.RecordBatch]:
    """The rows of a shard; docs holds the term numbers of each document."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    lengths = np.array([len(docs[i]) for i in order], np.int64)
    terms = sorted(vocabulary)
    rank = np.empty(len(terms), np.int64)
    rank[np.fromiter((vocabulary[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms))
    keys, tf = np.unique(rank[np.concatenate([docs[i] for i in order])] * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    term, doc = np.divmod(keys, len(ids))
    first = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1])
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    ends = np.append(first, len(keys))
    sides = []
    for values in (gap, tf):
        data, size = pack(values)
        sides.append((np.concatenate([[0], np.cumsum(size)])[ends], data))
    nulls = lambda n, f: pa.nulls(n, _ARROW.field(f).type)
    for at in range(0, len(terms), 1 << 15):
        to = min(at + (1 << 15), len(terms))
        n = to - at
        yield pa.RecordBatch.from_arrays([
            pa.array(["terms"] * n), pa.array(np.full(n, shard)), pa.array(terms[at:to], pa.binary()), pa.array(np.diff(ends[at : to + 1]).astype(np.int32)),
            nulls(n, "total"), nulls(n, "ids"), *(_lists(offsets[at : to + 1], data) for offsets, data in sides),
        ], schema=_ARROW)
    yield pa.RecordBatch.from_pylist(
        [{"part": "docs", "shard": shard, "n": len(ids), "total": int(lengths.sum()), "ids": [ids[i] for i in order], "counts": pack(lengths)[0].tobytes()}], schema=_ARROW
    )


def shards(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> rows of ROWS: ``part`` is terms (a list) or docs (a shard's ids and lengths)."""

    most = SHARD_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids, found, vocabulary, size = [], [], _Numbers(), 0
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                terms = terms_of(text := text.as_py())
                if terms:
                    ids.append(i.as_py())
                    found.append(np.fromiter(map(vocabulary.__getitem__, terms), np.int32, len(terms)))
                    size += len(text)
                    if size >= most:
                        yield from _shard_rows(shard, ids, found, vocabulary)
                        shard, ids, found, vocabulary, size = shard + 1, [], [], _Numbers(), 0
        if ids:
            yield from _shard_rows(shard, ids, found, vocabulary)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)


def write_index(docs: DataFrame, path: str) -> Index:
    """Build the index of docs in the folder ``path``, which driver and executors share."""
    shards(docs).write.partitionBy("part").parquet(path)
    return Index(docs.sparkSession, path)


@dataclass
class Index:
    """A stored index. ``documents`` counts those with a term, ``terms`` all their terms with repeats."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        part = lambda name: self.spark.read.schema(ROWS).parquet(self.path).filter(F.col("part") == name)
        self.postings = part("terms").select("shard", "term", "n", "docs", "counts")
        self.shards = part("docs").select("shard", "n", "total", "ids", "counts")
        both = self.shards.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("l")).first()
        self.documents, self.terms = both.n, both.l

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def search(self, items: DataFrame, top: int = TOP) -> DataFrame:
        """(item_id, text) -> item_id, rank, doc_id, score: each item's best documents."""
        return search(self, items, top)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, uses."""

    def each(batches):
        for ids, texts in batches:
            yield [(i, t, n) for i, text in zip(ids, texts, strict=True) for t, n in Counter(terms_of(text)).items()]

    return map_rows(items, ["item_id", "text"], "item_id long, term binary, uses long", each).groupBy("item_id", "term").agg(F.sum("uses").alias("uses"))


def best_of(lists: list[tuple[list[int], list[int], int]], top: int) -> list[tuple[int, int]]:
    """(documents, contributions, largest contribution) of each list -> (score, document) of the best, by a heap merge.

    ``above[i]`` is the most that the lists up to i can add. Those below ``first`` can't reach ``least`` on their own, so
    documents come from the others alone.
    """
    lists = sorted(lists, key=lambda x: x[2])
    above, total = [0], 0
    for x in lists:
        above.append(total := total + x[2])
    least, first, best = 0, 0, []
    while first < len(lists) and above[first + 1] <= least:
        first += 1
    cursors = [0] * len(lists)
    heap = [(lists[i][0][0], i) for i in range(first, len(lists))]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            i = heap[0][1]
            docs, adds, _ = lists[i]
            at = cursors[i]
            score += adds[at]
            cursors[i] = at = at + 1
            if at < len(docs) and i >= first:
                heapq.heapreplace(heap, (docs[at], i))
            else:
                heapq.heappop(heap)
        for i in range(first - 1, -1, -1):
            if score + above[i + 1] <= least:
                break
            docs, adds, _ = lists[i]
            at = cursors[i] = bisect_left(docs, doc, cursors[i])
            if at < len(docs) and docs[at] == doc:
                score += adds[at]
        if score > least:
            (heapq.heappush if len(best) < top else heapq.heapreplace)(best, (score, -doc))
            if len(best) == top:
                least = best[0][0]
                while first < len(lists) and above[first + 1] <= least:
                    first += 1
    return [(s, -d) for s, d in best]


_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _merge(n_documents: int, n_terms: int, top: int):
    def merge(postings: pa.Table, shard: pa.Table) -> pa.Table:
        """The best documents of one shard for the items of one block."""
        out = []
        if postings.num_rows and shard.num_rows:
            n = unpack(shard.column("counts")[0].as_py())
            m = 25 + 75 * n * n_documents // n_terms
            items = defaultdict(list)
            for docs, counts, uses in zip(*(postings.column(c) for c in ("docs", "counts", "uses")), strict=True):
                at, tf = np.cumsum(unpack(docs.as_py())), unpack(counts.as_py())
                part = 1_000_000_000 * tf // (1000 * tf + 8 * m[at])
                at, most, by = at.tolist(), int(part.max()), {}
                for use in uses.as_py():
                    if w := use["weight"]:
                        if w not in by:
                            by[w] = (w * part).tolist()
                        items[use["item_id"]].append((at, by[w], w * most))
            ids = shard.column("ids")[0].as_py()
            out = [(i, ids[d], s) for i, lists in items.items() for s, d in best_of(lists, top)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], []), _FOUND, strict=True)], schema=_FOUND)

    return merge


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of each item, scores above 0 only.

    A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document's score adds up ``weight * ((10^9 * tf) div
    (1000 * tf + 8 * m))`` over the item's terms with repeats, with ``m = 25 + (75 * n * N) div L``.
    """
    terms = materialize(item_terms(items), "items")
    df = index.postings.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * index.documents + 2) / (2 * F.col("df") + 1)))
    blocks = max(1, -(-items.select("item_id").distinct().count() // BLOCK_ITEMS))
    use = terms.join(df, "term").select("term", "item_id", (weight * F.col("uses")).alias("weight"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))
    use = use.groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "weight")).alias("uses"))
    use = use.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("shard"), F.lit(SALT)).cast("int")
    lists = index.postings.withColumn("salt", salt).join(use, ["term", "salt"]).select("block", "shard", "docs", "counts", "uses")
    each = index.shards.select(F.explode(F.sequence(*[F.lit(x).cast("long") for x in (0, blocks - 1)])).alias("block"), "shard", "ids", "counts")
    best = lists.groupBy("block", "shard").cogroup(each.groupBy("block", "shard"))
    best = best.applyInArrow(_merge(index.documents, max(index.terms, 1), top), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index docs in a working folder, search all items, and drop the index."""
    index = write_index(docs, scratch(docs.sparkSession, "lexical"))
    out = materialize(search(index, items, top), "ranked")
    index.drop()
    return out


def oracle() -> str:
    """The same ranking as SQL."""
    terms = "regexp_extract_all(translate({0}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {terms.format("documents")} AS ts FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
t AS (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS uses FROM (SELECT item_id, unnest({terms.format("benchmark")}) AS term FROM benchmark) GROUP BY ALL),
s AS (
    SELECT item_id, doc_id, sum(uses * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""
