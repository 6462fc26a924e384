"""Vector retrieval: exact and cell-probing nearest neighbours, pooling, fusion, expansion.

Stored vectors have unit length, so the inner product is the cosine. A query vector that a caller gives is a
parameter and becomes a literal; queries that are rows of a table meet the others in blocks (``block_join``).
Filters on the pool come before any top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.encoders import Encoder, encode
from .block_join import similarities

#: Video embeddings at or below this score are no hits.
CUTOFF = 0.001


def scored(vectors: DataFrame, query: Sequence[float], pool: DataFrame | None = None) -> DataFrame:
    """clip_id, score for every row (several rows a clip stay)."""
    v = vectors if pool is None else vectors.join(pool.select("clip_id"), "clip_id", "left_semi")
    return v.select("clip_id", V.dot("vec", V.vector(query)).alias("score"))


def top(scores: DataFrame, k: int | None) -> DataFrame:
    """Best k rows, ties by clip; None or negative: all."""
    return scores if k is None or k < 0 else scores.orderBy(F.desc("score"), "clip_id").limit(k)


def pooled(scores: DataFrame) -> DataFrame:
    """The best row of each clip."""
    return scores.groupBy("clip_id").agg(F.max("score").alias("score"))


def knn(vectors: DataFrame, query: Sequence[float], k: int | None, pool: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
    """Exact nearest clips: pooled over a clip's rows, cut off, then the best k."""
    s = pooled(scored(vectors, query, pool))
    return top(s if cutoff is None else s.filter(F.col("score") > cutoff), k)


def vector_of(vectors: DataFrame, clip_id: str) -> list[float] | None:
    """A clip's stored vector; of several rows, their mean."""
    rows = vectors.filter(F.col("clip_id") == clip_id).select("vec").collect()  # one clip
    if not rows:
        return None
    return [sum(float(r.vec[i]) for r in rows) / len(rows) for i in range(len(rows[0].vec))]


def search_clip(vectors: DataFrame, clip_id: str, k: int | None, pool: DataFrame | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """Neighbours of a stored clip, itself included; an unknown clip has none."""
    q = vector_of(vectors, clip_id)
    return knn(vectors, q, k, pool, cutoff) if q else vectors.select("clip_id", F.lit(0.0).alias("score")).filter(F.lit(False))


def search_many(vectors: DataFrame, queries: Sequence[Sequence[float]], k: int | None, pool: DataFrame | None = None) -> DataFrame:
    """Best score over several query vectors, then the best k."""
    v = vectors if pool is None else vectors.join(pool.select("clip_id"), "clip_id", "left_semi")
    best = F.greatest(*[V.dot("vec", V.vector(q)) for q in queries]) if len(queries) > 1 else V.dot("vec", V.vector(queries[0]))
    return top(v.groupBy("clip_id").agg(F.max(best).alias("score")), k)


def search_without(vectors: DataFrame, query: Sequence[float], negative: Sequence[float], k: int, n_negative: int) -> DataFrame:
    """Neighbours of the query that aren't among the nearest n_negative of the negative one."""
    drop = knn(vectors, negative, n_negative).select("clip_id")
    return top(pooled(scored(vectors, query)).join(drop, "clip_id", "left_anti"), k)


def search_two_stage(vectors: DataFrame, first: Sequence[float], second: Sequence[float], n_first: int, k: int) -> DataFrame:
    """The n_first nearest of one query, ranked by another."""
    return knn(vectors, second, k, knn(vectors, first, n_first))


def similarity_rows(vectors: DataFrame, queries: DataFrame, own: str | None = None) -> DataFrame:
    """(query_id, vec) x vectors -> query_id, clip_id, score pooled per clip, for all pairs. A row whose column ``own`` is the query's id is left out."""
    return similarities(vectors, queries, None, own)


def rows_of(vectors: DataFrame, clips: DataFrame) -> DataFrame:
    """clip_id, row_id of the rows of clips; unknown clips have none, a clip that is asked for twice counts once."""
    return vectors.select("clip_id", "row_id").join(clips.select("clip_id"), "clip_id", "left_semi")


def row_neighbours(vectors: DataFrame, queries: DataFrame, n: int = 2048, pool: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, vec) x vectors -> query_id, rank, row_id, clip_id, score: the n nearest rows of each query, several of a clip included.

    -1 takes all rows. Equal scores go by ascending row. Rows of a pool's clips only, where one is given. Row ids are unique
    and not negative. Queries are taken as they are: scores are cosines where they have unit length. With ``digits``, scores
    that are equal to so many places are equal.
    """
    v = vectors if pool is None else vectors.join(pool.select("clip_id"), "clip_id", "left_semi")
    named = v.withColumn("clip_id", F.concat(F.lpad(F.col("row_id").cast("string"), 20, "0"), "clip_id"))  # a row as a clip of its own, in the order of rows
    s = similarities(named, queries, None if n < 0 else n, digits=digits)
    if n < 0:
        s = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score" if digits is None else F.round("score", digits)), "clip_id")))
    return s.select("query_id", "rank", F.substring("clip_id", 1, 20).cast("long").alias("row_id"), F.expr("substring(clip_id, 21)").alias("clip_id"), "score")


def text_neighbours(vectors: DataFrame, texts: DataFrame, encoder: Encoder, n: int = 2048, pool: DataFrame | None = None) -> DataFrame:
    """(query_id, text) -> row_neighbours of the encoded texts, at unit length; a text without a direction has none."""
    q = texts.select("query_id", encode("text", encoder).alias("vec")).withColumn("vec", V.normalize("vec"))
    return row_neighbours(vectors, q, n, pool)


def clip_neighbours(vectors: DataFrame, clips: DataFrame, n: int = 2048, pool: DataFrame | None = None) -> DataFrame:
    """(clip_id) -> row_neighbours of each clip's first row, at unit length, itself included; unknown clips have none.

    Scores count to nine places, as making the query's length one moves the last bits.
    """
    known = vectors.join(clips.select("clip_id"), "clip_id", "left_semi")
    return row_neighbours(vectors, one_per_clip(known).withColumnRenamed("clip_id", "query_id"), n, pool, 9)


def search_rows(vectors: DataFrame, queries: Sequence[Sequence[float]], rows: int, pool: DataFrame | None = None) -> DataFrame:
    """clip_id, score: the best of each clip among the nearest ``rows`` rows of each query; so clips with many rows leave fewer clips."""
    v = vectors if pool is None else vectors.join(pool.select("clip_id"), "clip_id", "left_semi")
    out = None
    for q in queries:
        s = v.select("clip_id", "row_id", V.dot("vec", V.vector(q)).alias("score")).filter("score is not null").orderBy(F.desc("score"), "row_id").limit(rows)
        out = s if out is None else out.unionByName(s)
    return pooled(out)


def neighbours(vectors: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """(clip_id) -> seed, clip_id, score, rank: the n nearest of each seed clip (by its first row), the seed itself left out."""
    q = vectors.join(seeds.select("clip_id").distinct(), "clip_id", "left_semi").groupBy("clip_id").agg(F.min_by("vec", "row_id").alias("vec"))
    return similarities(vectors, q.withColumnRenamed("clip_id", "query_id"), n, "clip_id").withColumnRenamed("query_id", "seed")


def expand(vectors: DataFrame, seeds: DataFrame, n: int, most: int) -> DataFrame:
    """(clip_id) -> seeds at 1.0 and their neighbours with the best score and its seed, up to ``most`` clips."""
    seeds = seeds.select("clip_id").distinct()
    near = neighbours(vectors, seeds, n).join(seeds, "clip_id", "left_anti")
    near = near.groupBy("clip_id").agg(F.max("score").alias("score"), F.max_by("seed", F.struct("score", "seed")).alias("seed"))
    own = vectors.join(seeds, "clip_id", "left_semi").select("clip_id").distinct().select("clip_id", F.lit(1.0).alias("score"), F.col("clip_id").alias("seed"))
    return own.unionByName(near).orderBy(F.desc("score"), "clip_id").limit(most)


def nearest_cells(query: Sequence[float], centroids: DataFrame, n: int) -> list[int]:
    """The n cells whose centroids are nearest to the query, by squared distance."""
    c = centroids.select("cluster_id", V.squared_l2("vec", V.vector(query)).alias("d")).orderBy("d", "cluster_id").limit(n)
    return [r.cluster_id for r in c.collect()]  # n rows


def assign_cells(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors plus cell: write it partitioned by cell, and a probe reads only its partitions."""
    rows = centroids.select("cluster_id", "vec").collect()  # k centroids
    best = F.array_min(F.array(*[F.struct(V.squared_l2("vec", V.vector(r.vec)).alias("d"), F.lit(r.cluster_id).alias("c")) for r in rows]))
    return vectors.withColumn("cell", best["c"])


def search_cells(celled: DataFrame, centroids: DataFrame, query: Sequence[float], k: int, n_probe: int, pool: DataFrame | None = None) -> DataFrame:
    """Approximate neighbours: exact within the n_probe nearest cells. All cells: exact."""
    return knn(celled.filter(F.col("cell").isin(nearest_cells(query, centroids, n_probe))), query, k, pool)


def recall(exact: DataFrame, found: DataFrame) -> Column | float:
    """Share of the exact result that was found; NaN if either is empty."""
    n, m = exact.count(), found.count()
    return float("nan") if not n or not m else exact.select("clip_id").join(found.select("clip_id"), "clip_id", "left_semi").count() / n


def sample_rows(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of n rows, the same for the same seed: the n smallest hashes."""
    return vectors.orderBy(F.xxhash64(F.lit(seed), "row_id", "clip_id"), "row_id").limit(n)


def one_per_clip(vectors: DataFrame) -> DataFrame:
    """The first row of each clip, at unit length."""
    first = vectors.groupBy("clip_id").agg(F.min_by("vec", "row_id").alias("vec"), F.min("row_id").alias("row_id"))
    return first.withColumn("vec", V.normalize(F.col("vec")))


def rrf(scores: DataFrame, k: int = 60) -> DataFrame:
    """(clip_id, modality, score) -> clip_id, rrf: the sum of 1 / (k + rank), rank 1 the highest score.

    Ranks are counted by score, then clip, within each modality.
    """
    by = Window.partitionBy("modality").orderBy(F.desc("score"), "clip_id")
    r = scores.filter("score is not null").withColumn("r", F.row_number().over(by))
    return r.groupBy("clip_id").agg(F.sum(1 / (k + F.col("r"))).alias("rrf"))


def zscores(sims: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(query_id, clip_id, score) with z: the score in population deviations of its query."""
    by = Window.partitionBy("query_id")
    return sims.withColumn("z", (F.col("score") - F.avg("score").over(by)) / (F.stddev_pop("score").over(by) + eps))
