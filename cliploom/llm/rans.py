"""Token-ID files: a static range asymmetric numeral system over independent interleaved blocks.

One frequency table, made from the counts of all ids of the corpus, is shared by every block. A
block holds whole documents; its ids are dealt round robin to ``LANES`` states that run side by
side in numpy. Blocks carry checksums of their payload and of their ids, and snapshots of the
states, so that readers can decode blocks, and parts of a block, independently.

File format: a Parquet data set (so that Spark's committer makes writing safe against lost
executors) with one row per block: ``part`` (range partition, ascending in doc_id), ``block``,
``first`` (ids before the block within its part), ``n_tokens`` and ``data``, the block's bytes; the
shared table is the data set ``table`` beside it. Within a part, rows are in ascending doc_id order.

Defined results: a null doc_id sorts first; rows that share a doc_id each keep their own ids, next
to one another, ordered by their ids; null and empty texts hold the end id only; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import normalizers, pre_tokenizers

from .bpe_trie import DEFAULT_FILE, Splitter, TextEncoder, drops_spaces, library, tokenizer_path
from .common import drop_scratch, kept, map_rows, materialize, scratch

MAGIC = b"RNSB"
SCALE_BITS = 20
LANES = 2048
BLOCK_TOKENS = 1 << 19
#: Words that the library gets in one string.
WORDS_AT_ONCE = 500
#: Steps between snapshots of the lane states.
CHECKPOINT_STEPS = 128
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sBHIIIII")


class Table:
    """Frequencies scaled to 2**SCALE_BITS, at least 1 for each id that occurs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype("<u4")
        self.cum = np.concatenate([[0], np.cumsum(self.freq, dtype=np.uint64)[:-1]]).astype(np.uint64)
        self.f64 = self.freq.astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq)

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        total, size = int(counts.sum()), 1 << SCALE_BITS
        if not total:
            return cls(np.zeros(1, "<u4"))
        if int((counts > 0).sum()) > size:
            raise ValueError("more distinct ids than the table has slots")
        exact = counts * (size / total)
        freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
        order = np.lexsort((np.arange(len(counts)), -counts))
        order = order[counts[order] > 0]
        while (off := size - int(freq.sum())) > 0:
            freq[order[: min(off, len(order))]] += 1
        while (over := int(freq.sum()) - size) > 0:
            can = order[freq[order] > 1]
            freq[can[: min(over, len(can))]] -= 1
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """Ids -> states, snapshots and words; decode_block gives the ids again."""
    n = len(ids)
    lanes = min(LANES, max(1, n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    f_all, c_all = table.f64[ids], table.cum[ids]
    shift, low32, n_words = np.uint64(SCALE_BITS), np.uint64(32), 0
    limit = (LOW >> shift) << low32
    for step in range(steps - 1, -1, -1):
        f, c = f_all[step * lanes : (step + 1) * lanes], c_all[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= limit * f
        if full.any():
            out = x[full].astype(np.uint32)
            words.append(out)
            n_words += len(out)
            x = np.where(full, x >> low32, x)
        q = x // f
        state[: len(f)] = (q << shift) + (x - q * f) + c
        if step % CHECKPOINT_STEPS == 0:
            marks.append((n_words, state.copy()))
    stream = np.concatenate(words[::-1]).astype("<u4") if words else np.zeros(0, "<u4")
    marks.reverse()
    body = b"".join(struct.pack("<I", n_words - at) + s.astype("<u8").tobytes() for at, s in marks) + stream.tobytes()
    return (
        _HEAD.pack(MAGIC, SCALE_BITS, lanes, n, len(marks), len(stream), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body
    )


def decode_block(data: bytes, table: Table, from_mark: int = 0, to_mark: int | None = None) -> np.ndarray:
    """All ids of a block, or those between two snapshots; checksums that don't fit raise ValueError."""
    magic, bits, lanes, n, n_marks, n_words, crc, crc_ids = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size :]
    if magic != MAGIC or bits != SCALE_BITS or zlib.crc32(body) != crc:
        raise ValueError("block is damaged")
    if not n:
        return np.zeros(0, "<u4")
    size = 4 + 8 * lanes
    stream = np.frombuffer(body, "<u4", n_words, n_marks * size)
    (at,) = struct.unpack_from("<I", body, from_mark * size)
    state = np.frombuffer(body, "<u8", lanes, from_mark * size + 4).astype(np.uint64)
    steps, shift, mask, low32 = -(-n // lanes), np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
    first, last = from_mark * CHECKPOINT_STEPS, steps if to_mark is None else min(steps, to_mark * CHECKPOINT_STEPS)
    out = np.empty(min(n, last * lanes) - first * lanes, "<u4")
    for step in range(first, last):
        width = min(lanes, n - step * lanes)
        x = state[:width]
        slot = x & mask
        ids = table.slots[slot]
        x = table.f64[ids] * (x >> shift) + slot - table.cum[ids]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << low32) | stream[at : at + len(need)]
            at += len(need)
        state[:width] = x
        out[(step - first) * lanes : (step - first) * lanes + width] = ids
    if from_mark == 0 and last == steps and zlib.crc32(out.tobytes()) != crc_ids:
        raise ValueError("ids don't fit their checksum")
    return out


@kept
@functools.lru_cache(2)
def library_encoder(path: str, code: str) -> Callable[[list[str | None]], Iterable[bytes]]:
    """Texts -> ids packed by ``code`` ("H" or "I"), as the tokenizers library encodes them.

    Where the file's words end at white space, each word is encoded once by a worker process, and joined
    encodings of words are the encoding of the text; with other files texts are encoded whole. Words go to
    the library many at a time, between spaces; as they are normalized and split already, it needn't do so again, and
    a word's ids end at the token that has the mark of a word's end.
    """
    t = library(path)

    def whole(texts: list[str | None]) -> Iterator[bytes]:
        for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False):
            yield struct.pack(f"<{len(e.ids)}{code}", *e.ids)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not drops_spaces(spec):
        return whole
    mark, added = spec["model"]["end_of_word_suffix"], {x["id"] for x in spec["added_tokens"]}
    ends = np.zeros(t.get_vocab_size(), bool)
    ends[[i for w, i in t.get_vocab().items() if w.endswith(mark) or i in added]] = True
    t.normalizer = normalizers.Sequence([])
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    ])
    width = struct.calcsize(f"<{code}")

    def encode(words: list[str]) -> pa.Array:
        groups, ids = range(0, len(words), WORDS_AT_ONCE), []
        for e in t.encode_batch_fast([" ".join(words[i : i + WORDS_AT_ONCE]) for i in groups], add_special_tokens=False):
            ids.append(np.array(e.ids, f"<u{width}"))
        ids = np.concatenate(ids)
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) != len(words) or stop[-1] != len(ids):
            raise ValueError("a word was split")
        offsets = pa.py_buffer(np.concatenate([[0], stop * width]))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, offsets, pa.py_buffer(ids)])

    return TextEncoder(Splitter(path), encode)


def write_ids(docs: DataFrame, path: str, tokenizer: str = DEFAULT_FILE, end_id: int = 2) -> None:
    """Encode (doc_id, text), append the end id to each document, write the blocks in ascending doc_id order."""
    spark, tokenizer = docs.sparkSession, tokenizer_path(tokenizer)
    size = max(library(tokenizer).get_vocab_size(), end_id + 1)
    code, kind = ("H", "<u2") if size <= 1 << 16 else ("I", "<u4")

    def encode(batches):
        encoded, end, counts = library_encoder(tokenizer, code), struct.pack(f"<{code}", end_id), np.zeros(size, np.int64)
        for ids, texts in batches:
            packed = [p + end for p in encoded(texts)]
            counts += np.bincount(np.frombuffer(b"".join(packed), kind), minlength=size)
            yield [(i, p, None) for i, p in zip(ids, packed, strict=True)]
        if counts.any():
            yield [(None, None, counts.tobytes())]

    # a task's last row holds its counts, so that the ids needn't be read again for them
    coded = materialize(map_rows(docs, ["doc_id", "text"], "doc_id long, ids binary, counts binary", encode), "ids")

    def count(batches):
        total = np.zeros(size, np.int64)
        for (packed,) in batches:
            for p in packed:
                total += np.frombuffer(p, np.int64)
        yield [(int(i), int(total[i])) for i in np.flatnonzero(total)]

    counts = map_rows(coded.filter("counts is not null"), ["counts"], "id int, n long", count).groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # at most one row for each id of the vocabulary
    per_id = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        per_id[r.id] = r.n
    freq = Table.from_counts(per_id).freq
    spark.createDataFrame([(bytearray(freq.tobytes()),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")

    def blocks(batches):
        table, part = Table(freq), None
        held: list[tuple] = []
        tokens, first, block = 0, 0, 0

        def close():
            nonlocal held, tokens, first, block
            ids = np.concatenate([a for _, a in held])
            head = struct.pack("<I", len(held)) + b"".join(struct.pack("<Bqq", i is None, i or 0, len(a)) for i, a in held)
            row = (part, block, first, len(ids), head + encode_block(ids, table))
            first, block, held, tokens = first + len(ids), block + 1, [], 0
            return row

        for parts, docs_, packed in batches:
            rows = []
            for p, i, data in zip(parts, docs_, packed, strict=True):
                part = p
                held.append((i, np.frombuffer(data, kind).astype("<u4")))
                tokens += len(held[-1][1])
                if tokens >= BLOCK_TOKENS:
                    rows.append(close())
            yield rows
        if held:
            yield [close()]

    ordered = coded.filter("counts is null").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids").withColumn("part", F.spark_partition_id())
    map_rows(
        ordered, ["part", "doc_id", "ids"], "part int, block int, first long, n_tokens long, data binary", blocks
    ).write.parquet(f"{path}/blocks")
    drop_scratch(coded)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids (packed uint32), from the files."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").head().freq, "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row per part
    before, total = {}, 0
    for p in sorted(sums):
        before[p] = total
        total += sums[p]

    def decode(batches):
        table = Table(freq)
        for parts, firsts, datas in batches:
            for part, first, data in zip(parts, firsts, datas, strict=True):
                (n,) = struct.unpack_from("<I", data)
                docs = [struct.unpack_from("<Bqq", data, 4 + 17 * k) for k in range(n)]
                ids = decode_block(data[4 + 17 * n :], table)
                at, rows = 0, []
                for null, i, size in docs:
                    packed = ids[at : at + size].tobytes()
                    rows.append((None if null else i, before[part] + first + at, size, zlib.crc32(packed), *([packed] * with_ids)))
                    at += size
                yield rows

    return map_rows(
        blocks, ["part", "first", "data"], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids, decode
    )


def pack_documents(docs: DataFrame, path: str | None = None, tokenizer: str = DEFAULT_FILE, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Write the id files and read them back."""
    path = path or scratch(docs.sparkSession, "rans")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path, with_ids)
