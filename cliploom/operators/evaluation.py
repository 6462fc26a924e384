"""Retrieval and caption evaluation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoders import TokenEncoder


def truth_ranks(sims: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, clip_id, score), (query_id, clip_id) -> query_id, rank of the true clip; ties share their mean rank."""
    t = sims.join(truth, ["query_id", "clip_id"]).select("query_id", F.col("score").alias("s"))
    j = sims.join(t, "query_id")
    return j.groupBy("query_id").agg((F.count_if(F.col("score") > F.col("s")) + 1 + (F.count_if(F.col("score") == F.col("s")) - 1) / 2.0).alias("rank"))


def recall_report(ranks: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    return ranks.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in ks], F.median("rank").alias("median_rank"), F.count("*").alias("n"))


def both_directions(sims: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """The report for text to video, and with both sides swapped for video to text."""
    swap = lambda d: d.select(F.col("clip_id").alias("query_id"), F.col("query_id").alias("clip_id"), *[c for c in d.columns if c not in ("query_id", "clip_id")])
    one = recall_report(truth_ranks(sims, truth), ks).withColumn("direction", F.lit("t2v"))
    return one.unionByName(recall_report(truth_ranks(swap(sims), swap(truth)), ks).withColumn("direction", F.lit("v2t")))


def failures(sims: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """query_id, rank, wrong: queries whose true clip is below the threshold and not first, with the clip that is."""
    r = truth_ranks(sims, truth)
    first = sims.groupBy("query_id").agg(F.min_by("clip_id", F.struct(-F.col("score"), F.col("clip_id"))).alias("wrong"))
    j = r.filter(F.col("rank") > threshold).join(first, "query_id").join(truth.withColumnRenamed("clip_id", "right"), "query_id")
    return j.filter("wrong <> `right`").select("query_id", "rank", "wrong").orderBy(F.desc("rank"), "query_id")


def fuse(sims: dict[str, DataFrame], method: str = "rrf", k: int = 60) -> DataFrame:
    """query_id, clip_id, score: reciprocal ranks or standard scores summed over models."""
    by = Window.partitionBy("query_id")
    parts = []
    for s in sims.values():
        if method == "rrf":
            parts.append(s.withColumn("t", 1 / (k + F.row_number().over(by.orderBy(F.desc("score"), "clip_id")))))
        elif method == "zscore":
            parts.append(s.withColumn("t", (F.col("score") - F.avg("score").over(by)) / (F.stddev_pop("score").over(by) + 1e-8)))
        else:
            raise ValueError(f"unknown method {method!r}")
    u = reduce(DataFrame.unionByName, [p.select("query_id", "clip_id", "t") for p in parts])
    return u.groupBy("query_id", "clip_id").agg(F.sum("t").alias("score"))


def fusion_grid(sims: dict[str, DataFrame], families: dict[str, str], truth: DataFrame, size: int = 2, method: str = "rrf") -> DataFrame:
    """The recall report of each combination of ``size`` models from different families."""
    from itertools import combinations

    out = None
    for names in combinations(sorted(sims), size):
        if len({families[n] for n in names}) == size:
            r = recall_report(truth_ranks(fuse({n: sims[n] for n in names}, method), truth)).withColumn("models", F.lit("+".join(names)))
            out = r if out is None else out.unionByName(r)
    if out is None:
        raise ValueError("no combination of models from different families")
    return out


def ranked_hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, clip_id, rank) with hit, hits so far, n_true, precision and recall at each rank."""
    t = truth.select("label", "clip_id", F.lit(1).alias("hit"))
    n = truth.groupBy("label").agg(F.countDistinct("clip_id").alias("n_true"))
    w = Window.partitionBy("label").orderBy("rank")
    r = ranked.join(n, "label").join(t, ["label", "clip_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    r = r.withColumn("hits", F.sum("hit").over(w))
    return r.withColumns({"precision": F.col("hits") / F.col("rank"), "recall": F.col("hits") / F.col("n_true")})


def label_scores(ranked: DataFrame, truth: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """label, ap, r_precision, p_k and r_k: hits over k or over all true clips, whether found or not."""
    h = ranked_hits(ranked, truth)
    at = lambda c: F.sum(F.when(c, F.col("hit")).otherwise(0))
    return h.groupBy("label").agg(
        (F.sum(F.when(F.col("hit") == 1, F.col("precision")).otherwise(0.0)) / F.first("n_true")).alias("ap"),
        (at(F.col("rank") <= F.col("n_true")) / F.first("n_true")).alias("r_precision"),
        *[(at(F.col("rank") <= k) / F.lit(float(k))).alias(f"p_{k}") for k in ks], *[(at(F.col("rank") <= k) / F.first("n_true")).alias(f"r_{k}") for k in ks],
    )


def mean_scores(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(c).alias("map" if c == "ap" else c) for c in scores.columns if c != "label"], F.count("*").alias("n_labels"))


def select_scenarios(annotations: DataFrame, predicted: DataFrame, n: int, least: int, pool: int) -> DataFrame:
    """key, n_clips, n_pred: labels with enough clips, the most frequent ``pool`` of them, those with the best
    coverage by predictions, then n by an even stride over the clip counts."""
    a = annotations.filter("value is null").select("key", "clip_id").distinct()
    p = a.join(predicted.select("clip_id").distinct().withColumn("pred", F.lit(1)), "clip_id", "left")
    k = p.groupBy("key").agg(F.count("*").alias("n_clips"), F.sum(F.coalesce("pred", F.lit(0))).alias("n_pred")).filter(F.col("n_clips") >= least)
    k = k.orderBy(F.desc("n_clips"), "key").limit(pool)  # at most ``pool`` rows from here on
    w = Window.orderBy(F.desc("n_clips"), "key")
    k = k.filter("n_pred > 0").withColumns({"r": F.row_number().over(w) - 1, "m": F.count("*").over(Window.partitionBy(F.lit(1)))})
    stride = F.greatest(F.lit(1), F.floor(F.col("m") / n))
    return k.filter((F.col("r") % stride == 0) & (F.col("r") / stride < n)).select("key", "n_clips", "n_pred")


def balanced_pairs(pairs: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """At most n rows per group, by key."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col("_r") <= n).drop("_r")


# Caption metrics: n-gram scorers by name, and judges that a caller supplies.


def _grams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu(reference: str, prediction: str, n: int = 4) -> float:
    """Geometric mean of clipped n-gram precisions (one added to each from bigrams on), with brevity penalty."""
    r, p = reference.lower().split(), prediction.lower().split()
    if not r or not p:
        return 0.0
    logs = 0.0
    for k in range(1, n + 1):
        have = _grams(p, k)
        match, total = sum((have & _grams(r, k)).values()), sum(have.values())
        if k > 1:
            match, total = match + 1, total + 1
        if not match:
            return 0.0
        logs += math.log(match / total) / n
    return math.exp(logs + min(0.0, 1 - len(r) / len(p)))


def rouge_n(reference: str, prediction: str, n: int) -> float:
    a, b = _grams(reference.lower().split(), n), _grams(prediction.lower().split(), n)
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if both else 0.0


def rouge_l(reference: str, prediction: str) -> float:
    """F1 of the longest common subsequence."""
    a, b = reference.lower().split(), prediction.lower().split()
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0


def meteor(reference: str, prediction: str) -> float:
    """Exact matches only: recall-weighted F mean with the fragmentation penalty (Banerjee & Lavie 2005)."""
    r, p = reference.lower().split(), prediction.lower().split()
    free: dict[str, list[int]] = {}
    for i, w in enumerate(r):
        free.setdefault(w, []).append(i)
    at = [free[w].pop(0) if free.get(w) else None for w in p]
    hits = [x for x in at if x is not None]
    if not hits:
        return 0.0
    chunks = sum(1 for i, x in enumerate(at) if x is not None and (i == 0 or at[i - 1] is None or at[i - 1] + 1 != x))
    precision, recall = len(hits) / len(p), len(hits) / len(r)
    return 10 * precision * recall / (recall + 9 * precision) * (1 - 0.5 * (chunks / len(hits)) ** 3)


SCORERS: dict[str, Callable[[str, str], float]] = {
    "bleu": bleu, "rouge_1": lambda r, p: rouge_n(r, p, 1), "rouge_2": lambda r, p: rouge_n(r, p, 2), "rouge_l": rouge_l, "meteor": meteor,
}


def register_scorer(name: str, scorer: Callable[[str, str], float]) -> None:
    """Add a scorer: a judge model, say, as a callable of reference and prediction."""
    SCORERS[name] = scorer


def available_scorers() -> list[str]:
    return sorted([*SCORERS, "cider"])


def score_captions(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    """pairs (reference, prediction) plus a column per scorer, all by one pass over Arrow batches; a null is an empty text."""
    unknown = [n for n in names if n not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scorers {unknown}")
    chosen = {n: SCORERS[n] for n in names}
    if not chosen:
        return pairs

    @F.pandas_udf(", ".join(f"`{n}` double" for n in chosen))
    def run(r: pd.Series, p: pd.Series) -> pd.DataFrame:
        rows = [[f(x or "", y or "") for f in chosen.values()] for x, y in zip(r, p, strict=True)]
        return pd.DataFrame(rows, columns=list(chosen), dtype=float)

    scored = pairs.withColumn("_scores", run("reference", "prediction"))
    return scored.withColumns({n: F.col("_scores").getField(n) for n in chosen}).drop("_scores")


def cider(pairs: DataFrame, n: int = 4) -> DataFrame:
    """(clip_id, reference, prediction) plus cider: 10 times the mean cosine of TF-IDF n-grams, idf over the references."""

    def grams(c: str):
        w = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")
        per = [
            F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i, k=k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(w, i, k), " ").alias("g")))).otherwise(
                F.array().cast("array<struct<k: int, g: string>>")
            )
            for k in range(1, n + 1)
        ]
        return F.explode(F.concat(*per))

    tf = lambda c: pairs.select("clip_id", grams(c).alias("x")).groupBy("clip_id", "x.k", "x.g").agg(F.count("*").alias("tf"))
    total = pairs.count()
    ref = tf("reference")
    df = ref.groupBy("k", "g").agg(F.count("*").alias("df"))
    weigh = lambda t: t.join(df, ["k", "g"], "left").withColumn("w", F.col("tf") * F.log(F.lit(float(max(total, 1))) / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1))))
    a, b = weigh(ref).select("clip_id", "k", "g", F.col("w").alias("wa")), weigh(tf("prediction")).select("clip_id", "k", "g", F.col("w").alias("wb"))
    j = a.join(b, ["clip_id", "k", "g"], "full").fillna(0.0, ["wa", "wb"]).groupBy("clip_id", "k").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("ab"), F.sqrt(F.sum(F.col("wa") ** 2)).alias("na"), F.sqrt(F.sum(F.col("wb") ** 2)).alias("nb")
    )
    s = j.groupBy("clip_id").agg((10 * F.sum(F.coalesce(F.try_divide(F.col("ab"), F.col("na") * F.col("nb")), F.lit(0.0))) / n).alias("cider"))
    return pairs.join(s, "clip_id", "left").fillna(0.0, ["cider"])


# Token matching: each token with its most similar one on the other side, by the vectors of a supplied encoder.


def _tokens(col: str):
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def token_weights(references: DataFrame, salts: int = 1) -> DataFrame:
    """(reference) -> token, idf, salt: log((n + 1) / (df + 1)) over all n rows, a row per salt."""
    n = references.agg(F.count("*").alias("n"))
    df = references.select(F.explode(F.array_distinct(_tokens("reference"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1))
    return df.crossJoin(F.broadcast(n)).select("token", idf.alias("idf"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))


def _best(a: np.ndarray, b: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The highest cosine of each row of a in b, and of each row of b in a; ``rows`` of a at a time."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    a, b = unit(np.asarray(a, float)), unit(np.asarray(b, float))
    down, across = np.empty(len(a)), np.full(len(b), -1.0)
    for at in range(0, len(a), rows):
        s = a[at : at + rows] @ b.T
        down[at : at + rows] = s.max(1)
        np.maximum(across, s.max(0), out=across)
    return down, across


def token_match(pairs: DataFrame, encoder: TokenEncoder, key: str = "clip_id", weighted: bool = True, baseline: float = 0.0, batch: int = 16, salts: int = 16) -> DataFrame:
    """pairs (key, reference, prediction, ...) plus match_precision, match_recall and match_f1.

    Precision is the mean over the prediction's tokens of the highest cosine with any token of the reference, recall the
    same the other way, both weighted by inverse document frequencies over all references (Zhang et al. 2020). A token that no
    reference has weighs most; where all weights of a text are zero, its tokens weigh the same. ``baseline`` rescales
    to (x - baseline) / (1 - baseline). A side without tokens scores 0. Nulls are empty texts; equal keys may repeat.
    The encoder gets the token lists of ``batch`` pairs, references first, and returns a matrix for each.
    """
    weight = "map<string, double>"
    own = pairs.withColumns({"_key": F.xxhash64(F.coalesce("reference", F.lit("")), F.coalesce("prediction", F.lit("")), F.col(f"`{key}`")), "_r": _tokens("reference"), "_p": _tokens("prediction")})
    n = pairs.agg(F.log(F.count("*") + 1.0).alias("_unseen"))
    if weighted:
        # words that a third of all texts have meet salted copies of their weight; a text's weights come back as one map
        t = own.select("_key", F.explode(F.array_distinct(F.concat("_r", "_p"))).alias("token")).distinct().withColumn("salt", F.pmod("_key", F.lit(salts)).cast("int"))
        w = t.join(token_weights(pairs, salts), ["token", "salt"]).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("_w"))
        own = own.join(w, "_key", "left")
    else:
        own = own.withColumn("_w", F.lit(None).cast(weight))
    own = own.crossJoin(F.broadcast(n)).drop("_key")
    out = ("match_precision", "match_recall", "match_f1")
    keep = [c for c in pairs.columns]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), *(f"{c} double" for c in out)])

    def mean(best: np.ndarray, words: Sequence[str], weights: dict[str, float], unseen: float) -> float:
        u = np.array([weights.get(x, unseen) for x in words]) if weighted else np.ones(len(words))
        u = u if u.sum() > 0 else np.ones(len(words))
        return (float(best @ u / u.sum()) - baseline) / (1 - baseline)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = []
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                refs, preds = ([list(x) for x in part[c]] for c in ("_r", "_p"))
                vectors = encoder(refs + preds)
                for r, p, a, b, w, unseen in zip(refs, preds, vectors[: len(refs)], vectors[len(refs) :], part["_w"], part["_unseen"], strict=True):
                    if not r or not p:
                        scores.append((0.0, 0.0, 0.0))
                        continue
                    weights = dict(w) if w is not None else {}
                    down, across = _best(a, b)
                    precision, recall = mean(across, p, weights, unseen), mean(down, r, weights, unseen)
                    scores.append((precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0))
            yield f[keep].assign(**dict(zip(out, np.array(scores).reshape(-1, 3).T, strict=True)))

    return own.mapInPandas(run, schema)
