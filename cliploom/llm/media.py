"""Audio features of media columns.

Bytes are stored as 8-bit mono samples in RIFF/WAVE files, a Parquet data set of them; read back,
resampled by a polyphase filter, turned into overlapped log-mel frames and segmented by energy with
hysteresis. Features are stored as fixed-shape Arrow tensors (``FRAMES`` x ``MELS`` float32) with the
time span of each; the last one of a clip is padded with the floor value and its span ends where the
sound ends.

Files of features: a data set whose rows are blocks of whole clips, each block two Arrow streams,
``tensors`` (clip, position, start_s, end_s, log_mel of the type ``arrow.fixed_shape_tensor``) and
``clips`` (a row per clip: its id, digests of the stored media and its segments). Spark's committer
makes writing them safe against lost executors.

Segments open at a clip's own high level of energy and go on above its own middle level, so that a
quiet clip has segments too. Samples go through in pieces of ``PIECE`` samples, so a clip of any
length needs bounded memory beyond its bytes and its features. Defined results: null and empty texts
are one padding block; equal texts give equal values; rows that share a doc_id each keep their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import drop_scratch, map_rows, materialize

BLOCK = 576
RATE = 16_000
UP, DOWN = 3, 4  # 16 kHz -> 12 kHz
TAPS = 32  # per phase, of a windowed sinc
FRAME, HOP, MELS = 512, 256, 24
FRAMES = 32  # of one tensor
FLOOR = -10.0
#: Samples of a piece.
PIECE = 1 << 18
#: Quantiles of a clip's frame energies: segments reach the high one and stay above the low one, if long enough.
HIGH, LOW_LEVEL, LEAST_FRAMES = 0.8, 0.5, 2
#: Samples of a block of clips; a longer clip is a block of its own.
BLOCK_SAMPLES = 1 << 20


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF container; lossless."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def from_wave(wave: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono file; other chunks are passed over."""
    if wave[:4] != b"RIFF" or wave[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(wave):
        kind, size = wave[at : at + 4], struct.unpack_from("<I", wave, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wave, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            return wave[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 filled with bytes 255 to a positive multiple of BLOCK; its length before."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


@functools.lru_cache(4)
def polyphase(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Filter banks (up, taps): a Hann-windowed sinc cut at the lower of both Nyquist rates."""
    n = np.arange(up * taps) - up * taps // 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * cut * (0.5 + 0.5 * np.cos(2 * np.pi * n / (up * taps)))
    h = h * up / h.sum()
    return h.reshape(taps, up).T[:, ::-1].copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, start: int = 0, count: int | None = None) -> np.ndarray:
    """Output samples start..start+count of the resampled signal; beyond its ends the signal is 0.

    Each output sample is one bank's dot product with the inputs around it, by its phase.
    """
    total = -(-len(x) * up // down)
    count = total - start if count is None else min(count, total - start)
    if count <= 0:
        return np.zeros(0, np.float32)
    banks = polyphase(up, down, taps).astype(np.float32)
    at = np.arange(start, start + count, dtype=np.int64) * down
    base = at // up - taps // 2 + 1
    lo, hi = int(base[0]), int(base[-1]) + taps
    part = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(x))
    if a < b:
        part[a - lo : b - lo] = x[a:b]
    windows = np.lib.stride_tricks.sliding_window_view(part, taps)
    out = np.empty(count, np.float32)
    for r in range(min(up, count)):  # every up-th sample has the same phase, and inputs down samples further on
        n = len(out[r::up])
        out[r::up] = windows[int(base[r]) - lo :: down][:n] @ banks[int(at[r]) % up]
    return out


@functools.lru_cache(4)
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    freq = np.arange(frame // 2 + 1) * rate / frame
    up = (freq[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freq[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None).T.astype(np.float32)


def log_mel(samples: bytes, rate: int = RATE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of (log-mel frames, frame log energies) of 8-bit samples, frames overlapping by half."""
    raw = np.frombuffer(samples, np.uint8)
    out_len = -(-len(raw) * UP // DOWN)
    n_frames = max(1, -(-max(0, out_len - FRAME) // HOP) + 1)
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    bank, per = mel_bank(rate * UP // DOWN), PIECE // HOP
    for f in range(0, n_frames, per):
        k = min(per, n_frames - f)
        need = (k - 1) * HOP + FRAME
        lo = max(0, f * HOP * DOWN // UP - TAPS) // DOWN * DOWN
        x = (raw[lo : (f * HOP + need) * DOWN // UP + TAPS + 1].astype(np.float32) - 128) / 128
        shift = lo // DOWN * UP
        y = resample(x, start=f * HOP - shift, count=need)
        y = np.pad(y, (0, need - len(y)))
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        swing = frames.var(axis=1, dtype=np.float64)  # energy without the constant part
        frames = frames * window
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
        mel = np.log(np.maximum(power @ bank, np.exp(FLOOR)))
        yield mel.astype(np.float32), np.log(swing + 1e-10)


def hysteresis(energy: np.ndarray, high: float | None = None, low: float | None = None, least: int = LEAST_FRAMES) -> list[tuple[int, int]]:
    """Runs of frames above ``low`` that reach ``high``, if they have ``least`` frames: [first, end) pairs.

    The levels are quantiles of the clip's own energies unless given.
    """
    if not len(energy):
        return []
    own = np.quantile(energy, [HIGH, LOW_LEVEL])
    high, low = own[0] if high is None else high, own[1] if low is None else low
    on = np.concatenate([[False], energy > low, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    peaks = np.concatenate([[0], np.cumsum(energy >= high)])
    return [(int(a), int(b)) for a, b in edges if b - a >= least and peaks[b] > peaks[a]]


def tensors(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Fixed-shape tensors, their time spans, and the segments' time spans, in seconds."""
    mels, energies = zip(*log_mel(samples, rate), strict=True)
    mel = np.concatenate(mels)
    mel = np.concatenate([mel, np.full((-len(mel) % FRAMES, MELS), FLOOR, np.float32)])
    out = mel.reshape(-1, FRAMES, MELS)
    step, end = HOP * DOWN / UP / rate, len(samples) / rate
    spans = [(k * FRAMES * step, min(end, ((k + 1) * FRAMES - 1) * step + FRAME * DOWN / UP / rate)) for k in range(len(out))]
    segments = [(a * step, min(end, (b - 1) * step + FRAME * DOWN / UP / rate)) for a, b in hysteresis(np.concatenate(energies))]
    return out, spans, segments


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media: WAVE files, written to the shared folder and read back."""

    def each(batches):
        for ids, texts in batches:
            yield [(i, n, to_wave(p)) for i, t in zip(ids, texts, strict=True) for p, n in [payload(t)]]

    return materialize(map_rows(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary", each), "media", "zstd")


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
TENSORS = pa.schema([("clip", pa.int32()), ("position", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", TENSOR)])
SPANS = pa.list_(pa.list_(pa.float64(), 2))
CLIPS = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("segments", SPANS)]
)


def to_stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_stream(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def store_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> n_clips, clips, tensors: blocks of features, written to the shared folder and read back."""

    def block(clips: list[tuple], arrays: list[np.ndarray], spans: list[list]) -> tuple:
        values = np.concatenate(arrays)
        tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS))
        counts = [len(a) for a in arrays]
        flat = np.array([s for x in spans for s in x])
        place = [np.repeat(np.arange(len(counts), dtype="i4"), counts), np.concatenate([np.arange(n, dtype="i4") for n in counts])]
        rows = pa.RecordBatch.from_arrays([pa.array(place[0]), pa.array(place[1]), pa.array(flat[:, 0]), pa.array(flat[:, 1]), tensor], schema=TENSORS)
        table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*clips, strict=True), CLIPS, strict=True)], schema=CLIPS)
        return len(clips), to_stream(table), to_stream(rows)

    def each(batches):
        clips, arrays, spans, size = [], [], [], 0
        for ids, sizes, waves in batches:
            done = []
            for i, n, w in zip(ids, sizes, waves, strict=True):
                samples, rate = from_wave(w)
                ts, at, segments = tensors(samples, rate)
                clips.append((i, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(w), hashlib.sha256(w).hexdigest(), segments))
                arrays.append(ts)
                spans.append(at)
                size += len(samples)
                if size >= BLOCK_SAMPLES:
                    done.append(block(clips, arrays, spans))
                    clips, arrays, spans, size = [], [], [], 0
            yield done
        if clips:
            yield [block(clips, arrays, spans)]

    return materialize(map_rows(media, ["doc_id", "n_bytes", "media"], "n_clips int, clips binary, tensors binary", each), "tensors", "zstd")


def audio_tensors(blocks: DataFrame) -> DataFrame:
    """Stored blocks -> a row per tensor: doc_id, position, start_s, end_s, log_mel (FRAMES * MELS floats)."""

    def each(batches):
        for clips, rows in batches:
            for c, r in zip(clips, rows, strict=True):
                ids, t = from_stream(c)["doc_id"].to_pylist(), from_stream(r)
                values = t["log_mel"].to_numpy_ndarray().reshape(t.num_rows, -1)
                yield [(ids[k], *rest, v) for k, *rest, v in zip(*(t[n].to_pylist() for n in ("clip", "position", "start_s", "end_s")), values, strict=True)]

    return map_rows(blocks, ["clips", "tensors"], "doc_id long, position int, start_s double, end_s double, log_mel array<float>", each)


def audio_segments(blocks: DataFrame) -> DataFrame:
    """Stored blocks -> a row per energy segment: doc_id, start_s, end_s."""

    def each(batches):
        for (clips,) in batches:
            for c in map(from_stream, clips):
                yield [(i, a, b) for i, found in zip(c["doc_id"].to_pylist(), c["segments"].to_pylist(), strict=True) for a, b in found]

    return map_rows(blocks, ["clips"], "doc_id long, start_s double, end_s double", each)


def media_digests(blocks: DataFrame) -> DataFrame:
    """Stored blocks -> the digest columns; ``feature`` is made of the tensors and spans read back."""

    def each(batches):
        for clips, rows in batches:
            for c, r in zip(map(from_stream, clips), map(from_stream, rows), strict=True):
                values = np.round(r["log_mel"].to_numpy_ndarray(), 2).astype("<f4")  # two digits, as the last ones depend on the machine's arithmetic
                spans = np.round(np.stack([r["start_s"].to_numpy(), r["end_s"].to_numpy()], 1), 4).tolist()
                ends = np.cumsum(np.bincount(r["clip"].to_numpy(), minlength=c.num_rows))
                out, at = [], 0
                for k, (*digests, segments) in enumerate(zip(*(x.to_pylist() for x in c.columns), strict=True)):
                    n = int(ends[k]) - at
                    h = hashlib.sha256(values[at : at + n].tobytes())
                    h.update(repr([*spans[at : at + n], *[[round(a, 4), round(b, 4)] for a, b in segments]]).encode())
                    out.append((*digests, f"{n}x{FRAMES}x{MELS};segments={len(segments)};{h.hexdigest()}"))
                    at += n
                yield out

    return map_rows(
        blocks, ["clips", "tensors"],
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", each,
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the digest columns, by way of stored media and stored features; the media go when these are written."""
    media = store_media(docs)
    blocks = store_features(media)
    drop_scratch(media)
    return media_digests(blocks)
