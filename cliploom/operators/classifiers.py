"""Classifier training, scoring, and search by probability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions
from ..functions import vectors as V
from ..functions.scalars import sigmoid
from .labels import labels_only


def by_probability(result: DataFrame, scores: DataFrame, run_id: str | None, expression: str | None) -> DataFrame:
    """Clips whose p satisfies the expression, with it; without both parameters no change, a missing run keeps nothing."""
    if not run_id or not expression:
        return result.withColumn("classifier_score", F.lit(None).cast("double"))
    s = scores.filter((F.col("run_id") == run_id) & expressions.probability(expression))
    return result.join(s.groupBy("clip_id").agg(F.max("p").alias("classifier_score")), "clip_id")


def training_set(
    annotations: DataFrame, corpus: DataFrame, positive: Sequence[str], negative: Sequence[str], cap: int = 50_000, seed: int = 0, types: Sequence[str] = ("manual", "autolabel")
) -> DataFrame:
    """clip_id, label: clips of the positive labels (at most cap) and as many negatives.

    Negatives come from the negative labels first and are filled up with clips that have neither;
    choices are by hash, the same for the same seed. Only clips of the corpus count.
    """
    a = labels_only(annotations).filter(F.col("label_type").isin(list(types)))
    inside = lambda keys: a.filter(F.col("key").isin(list(keys))).select("clip_id").distinct().join(corpus.select("clip_id"), "clip_id", "left_semi")
    order = F.xxhash64(F.lit(seed), "clip_id")
    pos = inside(positive).orderBy(order, "clip_id").limit(cap)
    n = pos.count()
    named = inside(negative).join(inside(positive), "clip_id", "left_anti") if negative else corpus.select("clip_id").filter(F.lit(False))
    rest = corpus.select("clip_id").distinct().join(inside([*positive, *negative]), "clip_id", "left_anti")
    neg = named.withColumn("first", F.lit(0)).unionByName(rest.withColumn("first", F.lit(1))).orderBy("first", order, "clip_id").limit(n)
    return pos.withColumn("label", F.lit(1.0)).unionByName(neg.select("clip_id", F.lit(0.0).alias("label")))


def train(vectors: DataFrame, labelled: DataFrame, c: float = 100.0, iterations: int = 100, tolerance: float = 1e-3) -> tuple[list[float], float]:
    """Weights and intercept of an L2 logistic regression of inverse strength c."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = vectors.select("clip_id", "vec").join(labelled, "clip_id").select(array_to_vector("vec").alias("features"), "label")
    n = d.count()
    m = LogisticRegression(regParam=1 / (c * max(1, n)), maxIter=iterations, tol=tolerance, standardization=False).fit(d)
    return m.coefficients.toArray().tolist(), float(m.intercept)


def score(vectors: DataFrame, coef: Sequence[float], intercept: float) -> DataFrame:
    """clip_id, p for every row."""
    return vectors.select("clip_id", sigmoid(V.dot("vec", V.vector(coef)) + intercept).alias("p"))


def keep_top(scores: DataFrame, threshold: float = 0.3, most: int = 1_000_000) -> DataFrame:
    """Scores above the threshold, the best ``most``."""
    return scores.filter(F.col("p") > threshold).orderBy(F.desc("p"), "clip_id").limit(most)


def coverage(scores: DataFrame, clips: DataFrame, run_id: str, threshold: float) -> DataFrame:
    """data_source, n_clips, n_hits."""
    from .joins import explode_membership

    s = scores.filter(F.col("run_id") == run_id).select("clip_id", "p")
    return explode_membership(clips).join(s, "clip_id", "left").groupBy("data_source").agg(
        F.count("*").alias("n_clips"), F.count_if(F.coalesce(F.col("p") > threshold, F.lit(False))).alias("n_hits")
    )


def resolve(names: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(name) -> name, match: how well a classifier's name fits the query, best first.

    1.0 equal, 0.9 starts with it, 0.8 contains it, 0.7 is contained in it, then the share of the
    query's words it has if at least half, else half the edit similarity if that is above 0.6.
    """
    q = " ".join(query.lower().replace("_", " ").split())
    n = F.lower(F.regexp_replace("name", "[_\\s]+", " "))
    words = F.array(*[F.lit(w) for w in dict.fromkeys(q.split())]).cast("array<string>")
    share = F.size(F.array_intersect(F.split(n, " "), words)) / max(1, len(set(q.split())))
    edit = 1 - F.levenshtein(n, F.lit(q)) / F.greatest(F.length(n), F.lit(len(q)), F.lit(1))
    m = (
        F.when(n == q, 1.0).when(n.startswith(q), 0.9).when(F.contains(n, F.lit(q)), 0.8).when(F.contains(F.lit(q), n), 0.7)
        .when(share >= 0.5, 0.6 * share).when(edit > 0.6, 0.5 * edit)
    )
    return names.select("name", m.alias("match")).filter("match is not null").orderBy(F.desc("match"), "name").limit(k)
