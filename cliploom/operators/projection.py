"""A map of vectors in two dimensions by a fuzzy neighbour graph (UMAP), laid out on a sample, placed for all.

Each sampled row has ``neighbours`` nearest others; how much it belongs with each falls with the distance beyond the
nearest, at a rate that makes the memberships add up to log2 of their number. A graph of both directions is laid out by a
sampled gradient: members attract each other, random rows repel. The layout begins with two principal
components. Rows outside the sample take the mean place of their nearest sampled rows, weighted by the same memberships.

``LAYOUT_ROWS`` bounds the sample, which comes to the driver as one matrix; all rows are placed by executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_join import matrix
from .compressed import sample_matrix

LAYOUT_ROWS = 5000
NEIGHBOURS = 15
EPOCHS = 200
#: Random rows that repel, for each attraction.
REPEL = 5
#: Longest step of an element.
STEP = 4.0


def nearest_rows(x: np.ndarray, to: np.ndarray, k: int, skip_self: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows of ``to``, for each row of x, nearest first."""
    at, far = [], []
    square = (to**2).sum(1)
    for start in range(0, len(x), 1024):
        part = x[start : start + 1024]
        d = np.maximum((part**2).sum(1)[:, None] + square - 2 * part @ to.T, 0)
        if skip_self:
            d[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(d, near, 1)
        order = np.argsort(own, axis=1, kind="stable")
        at.append(np.take_along_axis(near, order, 1))
        far.append(np.sqrt(np.take_along_axis(own, order, 1)))
    return np.concatenate(at), np.concatenate(far)


def memberships(far: np.ndarray) -> np.ndarray:
    """How much each row belongs with its neighbours, by their distances (nearest first)."""
    beyond = np.maximum(far - far[:, :1], 0)
    target = np.log2(far.shape[1])
    low, high = np.zeros(len(far)), np.full(len(far), np.inf)
    rate = np.ones(len(far))
    for _ in range(64):  # halving, once a rate that is too large was seen
        over = np.exp(-beyond / rate[:, None]).sum(1) > target
        high, low = np.where(over, rate, high), np.where(over, low, rate)
        rate = np.where(np.isinf(high), 2 * rate, (low + np.where(np.isinf(high), 0, high)) / 2)
        rate = np.maximum(rate, 1e-12)
    return np.exp(-beyond / rate[:, None])


def fuzzy_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and weights of the edges: ``a + b - a * b`` of the memberships in both directions."""
    at, far = nearest_rows(x, x, k, skip_self=True)
    w = memberships(far).ravel()
    a, b = np.repeat(np.arange(len(x)), k), at.ravel()
    key, where = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]), return_inverse=True)
    one, two = np.zeros(len(key)), np.zeros(len(key))
    one[where[: len(w)]] = w
    two[where[len(w) :]] = w
    return key // len(x), key % len(x), one + two - one * two


def curve(least: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b for which ``1 / (1 + a * d^(2b))`` is nearest to 1 up to ``least`` and ``exp(-(d - least) / spread)`` beyond."""
    d = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(d < least, 1.0, np.exp(-(d - least) / spread))
    p = np.zeros(2)  # logarithms of a and b
    for _ in range(100):
        a, b = np.exp(p)
        power = a * d ** (2 * b)
        f = 1 / (1 + power)
        slope = -f * f * power
        jac = np.stack([slope, slope * 2 * b * np.log(d)], 1)
        p = p + np.linalg.lstsq(jac.T @ jac + 1e-6 * np.eye(2), jac.T @ (want - f), rcond=None)[0]
    return float(np.exp(p[0])), float(np.exp(p[1]))


def components_2d(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    y = centred @ v[:2].T
    return y if y.shape[1] == 2 else np.pad(y, ((0, 0), (0, 2 - y.shape[1])))


def layout(x: np.ndarray, neighbours: int = NEIGHBOURS, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Places of the rows of x."""
    rng = np.random.default_rng(seed)
    y = components_2d(x)
    y = y / max(np.abs(y).max(initial=0), 1e-12) * 10 + rng.normal(0, 1e-4, y.shape)
    k = min(neighbours, len(x) - 1)
    if k < 2:
        return y
    a, b = curve()
    head, tail, w = fuzzy_graph(x, k)
    chance = w / w.max()
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        picked = rng.permutation(np.flatnonzero(rng.random(len(w)) < chance))
        for part in np.array_split(picked, 8):  # steps of a part are taken together
            i, j = head[part], tail[part]
            away = y[i] - y[j]
            d2 = (away**2).sum(1)
            pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)[:, None] * away
            move = np.zeros_like(y)
            np.add.at(move, i, np.clip(pull, -STEP, STEP))
            np.add.at(move, j, -np.clip(pull, -STEP, STEP))
            i, j = np.repeat(i, REPEL), rng.integers(0, len(x), len(part) * REPEL)
            away = y[i] - y[j]
            d2 = (away**2).sum(1)
            push = (2 * b / ((0.001 + d2) * (1 + a * d2**b)) * (i != j))[:, None] * away
            np.add.at(move, i, np.clip(push, -STEP, STEP))
            y = y + rate * move
    return y


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    """1 if the k nearest places of each row are nearest in x as well, less for every rank that they are beyond k there."""
    n = len(x)
    square = lambda m: (m**2).sum(1)[:, None] + (m**2).sum(1) - 2 * m @ m.T + np.diag(np.full(n, np.inf))
    rank = np.argsort(np.argsort(square(x), 1, kind="stable"), 1) + 1
    near = np.argsort(square(y), 1, kind="stable")[:, :k]
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum())


def project(vectors: DataFrame, rows: int = LAYOUT_ROWS, neighbours: int = NEIGHBOURS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """(clip_id, row_id, vec) -> clip_id, row_id, x, y: places on the map of every row with a vector."""
    sample = sample_matrix(vectors, min(rows, LAYOUT_ROWS), seed)
    places, k = layout(sample, neighbours, epochs, seed), min(neighbours, len(sample))
    schema = pa.schema([("clip_id", pa.string()), ("row_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])

    def placed(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            v = matrix(t.column("vec"))
            if len(v):
                at, far = nearest_rows(v, sample, k)
                w = np.where(far == 0, 1e12, memberships(far))  # a sampled row has its own place
                y = (places[at] * w[..., None]).sum(1) / w.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in ("clip_id", "row_id")], pa.array(y[:, 0]), pa.array(y[:, 1])], schema=schema)

    v = vectors.filter("vec is not null").select(F.col("clip_id").cast("string"), F.col("row_id").cast("long"), F.col("vec").cast("array<double>"))
    return v.mapInArrow(placed, "clip_id string, row_id long, x double, y double")
