"""Vectors compressed to product codes, and searches over the codes.

A vector is cut into parts, and each part is stored as the number of its nearest centroid. Centroids are
fitted on a bounded sample, every row is coded. A search adds up one looked-up product per part for all
rows, and judges the best ``k * refine`` clips again by their vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .vector_search import knn, pooled, sample_rows, top

#: Rows that centroids are fitted on; these come to the driver.
SAMPLE = 65_536


def centroids_of(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """n centroids of the rows of x (all distinct rows if there are fewer); one without members stays where it is."""
    distinct = np.unique(x, axis=0)
    return lloyd(x, distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]], rounds)


def lloyd(x: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds that start with c."""
    for _ in range(rounds):
        at = nearest(x, c)
        size = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row of x, in slices so that no large matrix is made."""
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(half - x[at : at + 1024] @ centroids.T).argmin(1) for at in range(0, len(x), 1024)]])


def sample_matrix(vectors: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """At most n vectors as the rows of a matrix; they come to the driver as columns, not as Python objects."""
    t = sample_rows(vectors.filter("vec is not null"), n, seed).select(F.col("vec").cast("array<double>")).toArrow()
    if not t.num_rows:
        raise ValueError("no vectors to fit on")
    return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def fit_parts(vectors: DataFrame, parts: int = 8, codes: int = 256, sample: int = SAMPLE, rounds: int = 12, seed: int = 0) -> list[np.ndarray]:
    """Centroids of each part of the vectors, from a sample of so many rows."""
    x = sample_matrix(vectors, sample, seed)
    return [centroids_of(p, codes, rounds, seed + j) for j, p in enumerate(np.array_split(x, min(parts, x.shape[1]), axis=1))]


def encode(vectors: DataFrame, centroids: Sequence[np.ndarray]) -> DataFrame:
    """vectors with ``codes``, one number a part, in place of vec; null for a null vector."""
    ends = np.cumsum([c.shape[1] for c in centroids])[:-1]

    @F.pandas_udf("array<smallint>")
    def code(vec: pd.Series) -> pd.Series:
        there = vec.notna().to_numpy()
        out: list = [None] * len(vec)
        if there.any():
            x = np.stack(vec[there].to_numpy()).astype(np.float64)
            found = np.stack([nearest(p, c) for p, c in zip(np.split(x, ends, axis=1), centroids, strict=True)], 1)
            for at, codes in zip(np.flatnonzero(there), found.astype(np.int16), strict=True):
                out[at] = codes
        return pd.Series(out, dtype=object)

    return vectors.withColumn("codes", code("vec")).drop("vec")


def search_codes(
    coded: DataFrame, vectors: DataFrame, centroids: Sequence[np.ndarray], query: Sequence[float], k: int, refine: int = 8, pool: DataFrame | None = None
) -> DataFrame:
    """Approximate neighbours of a query: clip_id, score. The scores are exact; clips beyond the best k * refine by codes are missed."""
    ends, size = np.cumsum([c.shape[1] for c in centroids])[:-1], max(len(c) for c in centroids)
    products = [c @ q for c, q in zip(centroids, np.split(np.asarray(query, np.float64), ends), strict=True)]
    looked_up = V.vector(np.concatenate([np.pad(p, (0, size - len(p))) for p in products]))
    score = F.aggregate(F.transform("codes", lambda c, j: F.get(looked_up, c + j * size)), F.lit(0.0), lambda s, x: s + x)
    c = coded if pool is None else coded.join(pool.select("clip_id"), "clip_id", "left_semi")
    near = top(pooled(c.filter("codes is not null").select("clip_id", score.alias("score"))), k * refine)
    return knn(vectors, query, k, near)
