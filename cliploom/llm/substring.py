"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words. ``COVER`` is a difference cover modulo ``PERIOD``: any two
residues differ by a difference of two of its members, so two equal windows, at any two starts,
have within their first ``PERIOD`` places one that lies at a cover position in both documents. Only
at cover positions are ``ANCHOR`` words hashed, and ``ANCHOR + PERIOD - 1 <= WINDOW``, so equal
windows always share an aligned anchor. Anchors that occur once are dropped; around the others the
match is extended to whole windows, which are compared by 128-bit hashes of their words.

Within a task, an anchor or window that was seen before is decided on the spot, so the rows of one
hash that meet in a shuffle are bounded by the number of tasks, however often a passage occurs.

A word is removed if a window over it also starts earlier: in a smaller doc_id, or earlier in the
same document. Exact copies of earlier documents are removed whole without hashing windows.

Defined results: null and empty texts, and those of fewer words than a window, lose nothing; null
doc_ids come before all others, in the order of a hash of their texts (ids within ``NULL_KEYS`` of the
least 64-bit number are not told from them); rows that share a doc_id, and equal texts without one, aren't compared
with one another; texts are read whole; an empty table gives no rows; ``dedup`` keeps other
columns as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, map_arrays, map_rows, materialize, release

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = 8
#: Word hashes a worker keeps.
CACHE_WORDS = 400_000
FIRST_KEY = -(1 << 63)
NULL_KEYS = 1 << 40

assert ANCHOR + PERIOD - 1 <= WINDOW
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def run_hash(words: np.ndarray, starts: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of the runs of ``length`` words at ``starts``."""
    h = np.full(len(starts), seed, np.uint64)
    for k in range(length):
        h = mix((h + words[starts + k]) * _M1 + np.uint64(k))
    return h


_COVERED = np.isin(np.arange(PERIOD), COVER)


def cover_positions(n_words: int, length: int = ANCHOR) -> np.ndarray:
    if n_words < WINDOW:
        return np.zeros(0, np.int64)
    n = n_words - length + 1
    return np.flatnonzero(np.tile(_COVERED, -(-n // PERIOD))[:n])


def found_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Mask of the values that an ascending array holds."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def merged(ordered: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Two ascending arrays as one: the stable sort merges runs."""
    return np.sort(np.concatenate([ordered, more]), kind="stable") if len(more) else ordered


def candidate_starts(n_words: int, anchors: np.ndarray) -> np.ndarray:
    """Starts of all windows whose first PERIOD places hold one of the anchors."""
    starts = np.unique(np.asarray(anchors, np.int64)[:, None] - np.arange(PERIOD)[None])
    return starts[(starts >= 0) & (starts <= n_words - WINDOW)]


def covered(n_words: int, starts: np.ndarray) -> np.ndarray:
    """Mask of the words under windows at these starts."""
    d = np.zeros(n_words + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(np.asarray(starts, np.int64) + WINDOW, n_words), -1)
    return np.cumsum(d)[:-1] > 0


def anchors_of(docs: DataFrame) -> DataFrame:
    """(_k, text) -> h, _k, pos. Within a task a hash goes out at most twice with its own value; that shows that it is repeated.

    Further occurrences are known to be repeated and go out under hashes of their own, with ``-1 - pos``.
    So the rows of one hash are bounded by twice the number of tasks, however often it occurs. What a task has seen
    grows with its input, by 16 bytes at most for each of its anchors.
    """

    def each(batches):
        hashes, once, twice = WordHashes(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for keys, texts in batches:
            hs, ks, ps = [], [], []
            for k, text in zip(keys, texts, strict=True):
                words = text.encode().split() if text else []
                if len(words) >= WINDOW:
                    at = cover_positions(len(words))
                    hs.append(run_hash(hashes.of(words), at, ANCHOR))
                    ks.append(np.full(len(at), k, np.int64))
                    ps.append(at)
            if not hs:
                continue
            h, k, p = np.concatenate(hs), np.concatenate(ks), np.concatenate(ps)
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
            size = np.diff(np.concatenate([first, [len(s)]]))
            rank = np.arange(len(s)) - np.repeat(first, size)
            distinct = s[first]
            in_once, in_twice = found_in(distinct, once), found_in(distinct, twice)
            rank += np.repeat(in_once.astype(np.int64) + in_twice, size)
            more = rank >= 2
            h_out = np.where(more, mix(s + rank.astype(np.uint64) * _M2 + k[order].view(np.uint64)), s)
            yield h_out.view(np.int64), k[order], np.where(more, -1 - p[order], p[order]).astype(np.int32)
            most = np.maximum.reduceat(rank, first)
            once, twice = merged(once, distinct[~in_once]), merged(twice, distinct[(most >= 1) & ~in_twice])

    return map_arrays(docs, ["_k", "text"], "h long, _k long, pos int", each)


#: Windows that a task remembers to decide later ones by; beyond them it begins anew, and more rows of a hash may meet.
SEEN_WINDOWS = 1_000_000


def windows_of(docs: DataFrame) -> DataFrame:
    """(_k, text, _m, _hits, _copies) -> h1, h2, _k, at: the windows around repeated anchors.

    ``at`` is the start below the text's checksum in the upper half. A window that the task has seen
    in an earlier document, or earlier in the same one, is known to go and leaves with ``-1 - at``
    under hashes of its own.
    """

    def each(batches):
        hashes, seen = WordHashes(), {}
        for keys, texts, digests, hits, copies in batches:
            ones, twos, ks, ats = [], [], [], []
            for k, text, m, hit, copy in zip(keys, texts, digests, hits, copies, strict=True):
                words = text.encode().split() if text and hit and not (copy and m in copy) else []
                starts = candidate_starts(len(words), np.array(hit)) if len(words) >= WINDOW else np.zeros(0, np.int64)
                if not len(starts):
                    continue
                if len(seen) > SEEN_WINDOWS:
                    seen.clear()
                wh = hashes.of(words)
                one, two = run_hash(wh, starts, WINDOW, 1), run_hash(wh, starts, WINDOW, 2)
                at = (zlib.crc32(text.encode()) << 31) | starts
                late, own = np.zeros(len(starts), bool), set()
                for i, (h, low) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    h = h << 64 | low
                    if h in own or seen.get(h, k) < k:
                        late[i] = True
                    else:
                        own.add(h)
                        seen[h] = k
                n = np.arange(len(starts), dtype=np.uint64)
                ones.append(np.where(late, mix(one + n * _M2 + np.uint64(k & 0xFFFFFFFF)), one))
                twos.append(two)
                ks.append(np.full(len(starts), k, np.int64))
                ats.append(np.where(late, -1 - at, at))
            if ones:
                yield np.concatenate(ones).view(np.int64), np.concatenate(twos).view(np.int64), np.concatenate(ks), np.concatenate(ats)

    return map_arrays(docs, ["_k", "text", "_m", "_hits", "_copies"], "h1 long, h2 long, _k long, at long", each)


def repeated_anchors(base: DataFrame) -> DataFrame:
    """_k, _hits: places of the anchors that occur more than once."""
    repeated = anchors_of(base).withColumn("c", F.count("*").over(Window.partitionBy("h"))).filter("c > 1 or pos < 0")
    hits = repeated.groupBy("_k").agg(F.collect_set(F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos"))).alias("_hits"))
    return materialize(hits, "anchors")


def exact_copies(base: DataFrame) -> DataFrame:
    """_k, _copies: digests of the doc_id's texts that a smaller doc_id has."""
    rows = base.select("_k", "_m").filter("_m is not null")
    groups = rows.groupBy("_m").agg(F.min("_k").alias("first"), F.max("_k").alias("last")).filter("first <> last").select("_m", "first")
    return materialize(rows.join(groups, "_m").filter("_k > first").groupBy("_k").agg(F.collect_set("_m").alias("_copies")), "copies")


def late_windows(base: DataFrame, hits: DataFrame, copies: DataFrame) -> DataFrame:
    """_k, _gone: windows that start earlier elsewhere."""
    near = windows_of(base.select("_k", "text", "_m").join(hits.join(copies, "_k", "left"), "_k"))
    late = near.withColumn("first", F.min("_k").over(Window.partitionBy("h1", "h2"))).filter("at < 0 or _k > first")
    gone = late.groupBy("_k").agg(F.collect_set(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))).alias("_gone"))
    return materialize(gone, "windows")


def marked(docs: DataFrame) -> DataFrame:
    """docs (columns named _s0, _s1 and so on) plus _m (a digest of texts that may hold a window), _copies (digests of the doc_id's texts
    that are copies) and _gone (its windows to remove).

    Each phase is written, and its shuffle files are let go before the next one begins.
    """
    spark, names = docs.sparkSession, docs.columns
    own = docs.toDF(*[f"_s{i}" for i in range(len(names))])
    text, doc_id = (F.col(f"_s{names.index(c)}") for c in ("text", "doc_id"))
    no_id = F.lit(FIRST_KEY) + F.pmod(F.xxhash64(text), F.lit(NULL_KEYS))
    own = own.withColumns({"_k": F.coalesce(doc_id.cast("long"), no_id), "_m": F.when(F.length(text) >= 2 * WINDOW - 1, F.md5(text))})
    base = own.select("_k", "_m", text.alias("text"))
    hits = repeated_anchors(base)
    release(spark)
    copies = exact_copies(base)
    gone = late_windows(base, hits, copies)
    drop_scratch(hits)
    release(spark)
    return own.join(gone.join(copies, "_k", "full"), "_k", "left").drop("_k")


def kept_words(text: str | None, digest: str | None, copies: list[str] | None, gone: list[int] | None) -> tuple[list[bytes], np.ndarray]:
    """The text's words, and the mask of those that go."""
    words = text.encode().split() if text else []
    if copies and digest in copies and len(words) >= WINDOW:
        return words, np.ones(len(words), bool)
    if gone:
        at = np.array(gone, np.int64)
        at = at[at >> 31 == zlib.crc32(text.encode())] & ((1 << 31) - 1)
        if len(at):
            return words, covered(len(words), at)
    return words, np.zeros(len(words), bool)


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def each(batches):
        for ids, texts, digests, copies, gones in batches:
            rows = []
            for i, text, m, copy, g in zip(ids, texts, digests, copies, gones, strict=True):
                words, gone = kept_words(text, m, copy, g)
                n = int(gone.sum())
                if n:
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                rows.append((i, len(gone), n, hashlib.sha256(b" ".join(words)).hexdigest()))
            yield rows

    m = marked(docs.select("doc_id", "text"))
    return map_rows(m, ["_s0", "_s1", "_m", "_copies", "_gone"], "doc_id long, n_words long, n_removed long, kept_sha256 string", each)


def cut(text: str, gone: np.ndarray) -> str:
    """The text without the words of the mask; white space between words that stay together stays too."""
    out, run, end, at, raw = [], None, 0, 0, text.encode()
    for word, g in zip(raw.split(), gone.tolist(), strict=True):
        at = raw.index(word, end)
        if g:
            if run is not None:
                out.append(raw[run:end])
            run = None
        elif run is None:
            run = at
        end = at + len(word)
    if run is not None:
        out.append(raw[run:end])
    return b" ".join(out).decode()


def dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from their texts (and n_chars counted again); documents left without a word go."""
    marks = marked(docs)
    names = docs.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def each(batches):
        for cols in batches:
            rows = []
            for *row, m, copy, g in zip(*cols, strict=True):
                _, gone = kept_words(row[text_at], m, copy, g)
                if gone.any():
                    if gone.all():
                        continue
                    row[text_at] = cut(row[text_at], gone)
                    if chars_at is not None:
                        row[chars_at] = len(row[text_at])
                rows.append(tuple(row))
            yield rows

    inner = [f"_s{i}" for i in range(len(names))]
    schema = ", ".join(f"{i} {marks.schema[i].dataType.simpleString()}" for i in inner)
    return map_rows(marks, [*inner, "_m", "_copies", "_gone"], schema, each).toDF(*names)
