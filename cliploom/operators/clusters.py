"""Clustering of clips, search by cluster, cluster topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scalars import canonical_ngram, clean_caption
from .windows import percentile_band, random_subset, sample_per_group


#: Most clusters of a run; so centroids, which each task holds, have a bound.
MOST_CLUSTERS = 20_000
#: Numbers of a matrix of distances that are made at once.
CELLS = 1 << 22
#: Centroids whose squared distance is this near to the least, as a part of the numbers summed, tie; the first one wins.
SLACK = 1e-12


def fit(vectors: DataFrame, k: int, iterations: int = 25, seed: int = 1234, spherical: bool = False, per_cluster: int = 256, most: int | None = None, redo: int = 1):
    """K-means on about k * per_cluster rows, then every row assigned: (assignments, centroids).

    The sample is the rows whose hash is below a threshold. Distances are squared L2 to the nearest centroid. Of
    ``redo`` fits from different starts the one of the least cost stays. k is MOST_CLUSTERS at most. With ``most``, a
    run takes that many clips only, drawn at random; without, all. Rows without a vector or a clip take no part; no
    rows at all are a ValueError.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    k = min(k, MOST_CLUSTERS)
    v = vectors.filter("vec is not null and clip_id is not null")
    if most is not None:
        v = random_subset(v, "clip_id", most, seed)
    if spherical:
        v = v.withColumn("vec", V.normalize(F.col("vec"))).filter("vec is not null")  # a zero vector has no direction
    cap = k * per_cluster
    n = v.count()
    if not n:
        raise ValueError("no vectors to cluster")
    share = F.pmod(F.xxhash64(F.lit(seed), "clip_id", "row_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, cap / n))
    sample = (v.filter(share) if n > cap else v).select(array_to_vector("vec").alias("f"))
    if redo > 1:
        sample = sample.persist()
    fits = (KMeans(k=k, maxIter=iterations, seed=seed + i, featuresCol="f", distanceMeasure="cosine" if spherical else "euclidean").fit(sample) for i in range(redo))
    centres = _centres(min(fits, key=lambda m: m.summary.trainingCost))
    if redo > 1:
        sample.unpersist()
    return assign(v, centres), centroid_table(vectors.sparkSession, centres)


def _centres(model):
    import numpy as np

    return np.array(model.clusterCenters(), float)


def centroid_table(spark: SparkSession, centres) -> DataFrame:
    """cluster_id, vec of the rows of a matrix."""
    import numpy as np
    import pyarrow as pa

    k, dims = centres.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * dims, pa.int32()), pa.array(centres.ravel()))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(np.arange(k), pa.int32()), lists], ["cluster_id", "vec"]))


def assign(vectors: DataFrame, centres) -> DataFrame:
    """clip_id, cluster_id, distance for every row with a vector: products of CELLS numbers at most, row blocks against all centroids.

    Centroids go to each executor once; they are MOST_CLUSTERS at most. Of centroids that are as near as rounding can
    tell, the first one wins.
    """
    import numpy as np
    import pyarrow as pa

    c = np.asarray(centres, float)
    if not 0 < len(c) <= MOST_CLUSTERS:
        raise ValueError(f"{len(c)} centroids")
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        c = shared.value
        squares = (c**2).sum(1)
        step = max(1, CELLS // len(c))
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
            for start in range(0, b.num_rows, step):
                x = flat.reshape(b.num_rows, -1)[start : start + step]
                own = (x**2).sum(1)
                d = squares[None] - 2 * x @ c.T
                near = d <= (d.min(1) + SLACK * (own + squares.max()))[:, None]
                at = near.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, step), pa.array(at, pa.int32()), pa.array(((x - c[at]) ** 2).sum(1))], ["clip_id", "cluster_id", "distance"])

    return vectors.filter("vec is not null").select("clip_id", "vec").mapInArrow(run, "clip_id string, cluster_id int, distance double")


def by_cluster(result: DataFrame, assignments: DataFrame, run_id: str, ids: Sequence[int], low: float | None = None, high: float | None = None) -> DataFrame:
    """Clips of the clusters, with their distance; a missing run, or a selection without clips, changes nothing.

    For a single cluster, low and high cut a percentile band of ascending distance. Whether there are clips is asked
    within the plan: no job runs before the result is read.
    """
    a = assignments.filter((F.col("run_id") == run_id) & F.col("cluster_id").isin(list(ids)))
    if len(set(ids)) == 1 and (low is not None or high is not None):
        a = percentile_band(a, "cluster_id", "distance", low or 0.0, 100.0 if high is None else high)
    some = a.agg((F.count("*") > 0).alias("some")).scalar()
    found = a.groupBy("clip_id").agg(F.min("distance").alias("cluster_distance"), F.lit(True).alias("_in_cluster"))
    return result.join(found, "clip_id", "left").filter(F.col("_in_cluster").isNotNull() | ~some).drop("_in_cluster")


def closest(centroids: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """cluster_id, distance (L2) of the k nearest centroids; another dimension is an error."""
    c = centroids.select("cluster_id", F.when(F.size("vec") != len(query), F.raise_error(F.lit("dimensions differ"))).otherwise(F.sqrt(V.squared_l2("vec", V.vector(query)))).cast("double").alias("distance"))
    return c.orderBy("distance", "cluster_id").limit(k)


def members(assignments: DataFrame, run_id: str, cluster_id: int) -> DataFrame:
    return assignments.filter((F.col("run_id") == run_id) & (F.col("cluster_id") == cluster_id)).orderBy("distance", "clip_id")


def clusters_of(clips: DataFrame, assignments: DataFrame, run_id: str) -> DataFrame:
    return clips.join(assignments.filter(F.col("run_id") == run_id).select("clip_id", "cluster_id", "distance"), "clip_id")


def sizes(assignments: DataFrame, k: int) -> DataFrame:
    """cluster_id, size, representative (nearest clip) for all k clusters, empty ones included."""
    every = assignments.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    n = assignments.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min_by("clip_id", F.struct("distance", "clip_id")).alias("representative"))
    return every.join(n, "cluster_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def find_by_keyword(topics: DataFrame, sizes_: DataFrame, keyword: str, k: int) -> DataFrame:
    """Clusters whose keywords, else whose description, hold the keyword; the largest first."""
    word = keyword.lower()
    in_words = F.exists("keywords", lambda w: F.contains(F.lower(w), F.lit(word)))
    hit = in_words | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(word))
    return topics.filter(hit).join(sizes_, "cluster_id").withColumn("matched", F.when(in_words, "keywords").otherwise("description")).orderBy(F.desc("size"), "cluster_id").limit(k)


def summarize(topics: DataFrame, sizes_: DataFrame, least: int, k: int) -> DataFrame:
    """cluster_id, size, share, theme of the largest clusters: the description, else the first three keywords."""
    s = sizes_.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(1))))  # one row per cluster
    theme = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.array_join(F.slice("keywords", 1, 3), ", "))
    return s.filter(F.col("size") >= least).join(topics, "cluster_id", "left").select("cluster_id", "size", "share", theme.alias("theme")).orderBy(F.desc("size"), "cluster_id").limit(k)


def highest_coverage(captions: DataFrame) -> DataFrame:
    """model_name, n: the caption model with the most clips; ties by name."""
    return captions.groupBy("model_name").agg(F.countDistinct("clip_id").alias("n")).orderBy(F.desc("n"), "model_name").limit(1)


#: Documents of a task that counts terms.
TERM_DOCS = 1000


def term_weights(docs: DataFrame, text: str = "caption", least_df: int = 3, most_df: float = 0.6, features: int = 20_000) -> DataFrame:
    """(clip_id, text) -> clip_id, term, w: TF-IDF of one- and two-word terms.

    Sublinear counts 1 + ln tf, smoothed idf ln((1 + n) / (1 + df)) + 1, rows of unit length. With
    fewer than ten documents, any df will do. Of too many terms the most frequent ones stay.
    """
    n = docs.select("clip_id").distinct().count()
    # so many documents a task, else one that got many holds the terms of all of them at once
    docs = docs.repartition(max(1, -(-n // TERM_DOCS)), "clip_id")
    t = docs.select("clip_id", F.filter(F.split(clean_caption(F.col(text)), " "), lambda w: F.length(w) > 1).alias("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(1))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    tf = t.select("clip_id", F.explode(F.concat("t", F.coalesce(pairs, F.array().cast("array<string>")))).alias("term")).groupBy("clip_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if n >= 10:
        df = df.filter((F.col("df") >= least_df) & (F.col("df") <= most_df * n))
    df = df.orderBy(F.desc("total"), "term").limit(features).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(df, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = w.groupBy("clip_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(length, "clip_id").select("clip_id", "term", (F.col("w") / F.col("len")).alias("w"))


def topics(assignments: DataFrame, captions: DataFrame, k: int = 15, jargon: Sequence[str] = (), per_cluster: int = 50) -> DataFrame:
    """cluster_id, keywords: the best k terms by mean weight over a sample of each cluster's clips.

    Terms with a jargon word go; of terms that differ in order or ending only, the best one stays.
    """
    a = sample_per_group(assignments.select("cluster_id", "clip_id"), "cluster_id", "clip_id", per_cluster)
    w = term_weights(captions.join(a, "clip_id", "left_semi"))
    n = a.groupBy("cluster_id").agg(F.count("*").alias("n"))
    m = w.join(a, "clip_id").groupBy("cluster_id", "term").agg(F.sum("w").alias("s")).join(n, "cluster_id").withColumn("m", F.col("s") / F.col("n"))
    if jargon:
        m = m.filter(~F.arrays_overlap(F.split("term", " "), F.array(*map(F.lit, jargon))))
    m = m.withColumn("canon", canonical_ngram(F.col("term")))
    best = m.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "canon").orderBy(F.desc("m"), "term"))).filter("_r = 1")
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("m"), "term"))).filter(F.col("_r") <= k)
    return ranked.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("keywords"))


def project_2d(vectors: DataFrame) -> DataFrame:
    """clip_id, x, y: the first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("clip_id", array_to_vector("vec").alias("f"))
    p = PCA(k=2, inputCol="f", outputCol="o").fit(v).transform(v)
    return p.select("clip_id", vector_to_array("o").alias("o")).select("clip_id", F.col("o")[0].alias("x"), F.col("o")[1].alias("y"))


def sum_of_squares(assignments: DataFrame) -> Column | float:
    return assignments.agg(F.sum("distance")).head()[0]
