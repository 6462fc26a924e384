"""Encoders, region proposals and judges as callables that a caller supplies, applied by Arrow batches.

No models are shipped. ``HashingEncoder`` maps words to signed hashed dimensions: deterministic, and
texts that share words get similar vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], np.ndarray]


class HashingEncoder:
    """Unit vectors of ``dims`` elements from hashed words and word pairs; texts without words get zeros."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            words = (t or "").lower().split()
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1.0 if h >> 31 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    def one(self, text: str) -> list[float]:
        """A query vector, as the engine's catalog takes encoders."""
        return self([text])[0].tolist()


TokenEncoder = Callable[[Sequence[Sequence[str]]], Sequence[np.ndarray]]


class GramTokens:
    """A token encoder: words as hashed letter groups of three with their edges marked, so related forms are alike."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def __call__(self, texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
        out = []
        for words in texts:
            m = np.zeros((len(words), self.dims))
            for i, w in enumerate(words):
                w = f"<{w}>"
                for j in range(max(len(w) - 2, 1)):
                    h = zlib.crc32(w[j : j + 3].encode())
                    m[i, h % self.dims] += 1.0 if h >> 31 else -1.0
            out.append(m)
        return out


def same_tokens(texts: Sequence[Sequence[str]]) -> list[np.ndarray]:
    """A token encoder under which a word is like itself only: an axis for each word of the call."""
    axis = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
    out = [np.zeros((len(words), max(len(axis), 1))) for words in texts]
    for m, words in zip(out, texts, strict=True):
        m[np.arange(len(words)), [axis[w] for w in words]] = 1.0
    return out


def encode(col: Column | str, encoder: Encoder) -> Column:
    """A column of vectors; the encoder gets a batch of values at once."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(encoder(values.tolist())))

    return run(col)


def encode_cached(texts: DataFrame, cache: DataFrame, encoder: Encoder, col: str = "text") -> DataFrame:
    """(text) -> text, hash, vec: texts whose hash the cache (hash, vec) has aren't encoded again."""
    t = texts.select(col).distinct().withColumn("hash", F.sha2(F.coalesce(col, F.lit("")), 256))
    known = t.join(cache, "hash")
    new = t.join(cache, "hash", "left_anti").withColumn("vec", encode(col, encoder))
    return known.select(col, "hash", "vec").unionByName(new.select(col, "hash", "vec"))


def propose(media: DataFrame, propose_views: Callable[[bytes], Iterable[tuple[str, list[float], np.ndarray]]], full: bool = True) -> DataFrame:
    """(clip_id, content) -> a row per view: clip_id, view, box, vec. With full=False, the view named full goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, name, list(map(float, box)), np.asarray(v, np.float32)) for c, data in zip(b["clip_id"], b["content"], strict=True) for name, box, v in propose_views(data) if full or name != "full"]
            yield pd.DataFrame(rows, columns=["clip_id", "view", "box", "vec"])

    return media.select("clip_id", "content").mapInPandas(run, "clip_id string, view string, box array<double>, vec array<float>")


def judge(pairs: DataFrame, model: Callable[[dict], str], out: str = "answer") -> DataFrame:
    """Rows plus a model's raw answer to each, None where the call fails; parse it with scalars.llm_json."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + f", {out} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for row in b.to_dict("records"):
                try:
                    answers.append(model(row))
                except Exception:  # noqa: BLE001  (one failed call must not fail the job; it shows as null)
                    answers.append(None)
            b[out] = answers
            yield b

    return pairs.mapInPandas(run, schema)
