"""Vector search, clusters, classifiers and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encoders
from ..functions import vectors as V
from ..operators import classifiers, clusters, compressed, evaluation, graph_index, projection, vector_index, vector_search, windows
from ..operators.block_join import similarities
from ..sources.workdir import workdir
from .base import query

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
_DOT = "list_sum(list_transform(list_zip(vec::DOUBLE[], {}), lambda x: x[1] * x[2]))"
_L2 = "list_sum(list_transform(list_zip(vec::DOUBLE[], {}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _queries(v):
    """The stated query set of searches: every id divisible by 100."""
    return v.filter("row_id % 100 = 0").select(F.col("row_id").cast("string").alias("query_id"), "vec")


def _vec(v, i):
    return [float(x) for x in v.filter(F.col("row_id") == i).head().vec]


@query("v01_exact_knn", "vectors", f"SELECT clip_id, round(max({_DOT.format(_Q.format(3))}), 6) AS score FROM vectors GROUP BY clip_id ORDER BY max({_DOT.format(_Q.format(3))}) DESC, clip_id LIMIT 20")
def v01(spark, sf_dir, v):
    return vector_search.knn(v, _vec(v, 3), 20).select("clip_id", F.round("score", 6).alias("score"))


@query("v02_cell_knn_all_cells", "vectors", f"SELECT clip_id, round(max({_DOT.format(_Q.format(3))}), 6) AS score FROM vectors GROUP BY clip_id ORDER BY max({_DOT.format(_Q.format(3))}) DESC, clip_id LIMIT 20")
def v02(spark, sf_dir, v):
    """Probing every cell is exact, so SQL can tell; tests hold the recall of fewer cells."""
    c = v.filter("row_id < 8").select(F.col("row_id").cast("int").alias("cluster_id"), "vec")
    r = vector_search.search_cells(vector_search.assign_cells(v, c), c, _vec(v, 3), 20, 8)
    return r.select("clip_id", F.round("score", 6).alias("score"))


@query("v02_compressed_knn", "vectors", None)
def v02_compressed(spark, sf_dir, v):
    """Product codes of all rows, searched for one of them; tests hold the recall against exact search."""
    v = v.withColumn("clip_id", F.col("row_id").cast("string"))
    parts = compressed.fit_parts(v, 16)
    return compressed.search_codes(compressed.encode(v, parts), v, parts, _vec(v, 3), 20).select("clip_id", F.round("score", 6).alias("score"))


@query("v03_cutoff", "vectors", f"SELECT clip_id, round(max({_DOT.format(_Q.format(9))}), 6) AS score FROM vectors GROUP BY clip_id HAVING max({_DOT.format(_Q.format(9))}) > 0.001::DOUBLE")
def v03(spark, sf_dir, v):
    return vector_search.knn(v, _vec(v, 9), None, cutoff=vector_search.CUTOFF).select("clip_id", F.round("score", 6).alias("score"))


@query("v04_similar_to_clip", "vectors", f"SELECT row_id::STRING AS clip_id, round({_DOT.format(_Q.format(5))}, 6) AS score FROM vectors WHERE {_DOT.format(_Q.format(5))} > 0.001::DOUBLE")
def v04(spark, sf_dir, v):
    v = v.withColumn("clip_id", F.col("row_id").cast("string"))
    return vector_search.search_clip(v, "5", None).select("clip_id", F.round("score", 6).alias("score"))


@query("v06_multi_query", "vectors", f"SELECT clip_id, round(max(greatest({_DOT.format(_Q.format(1))}, {_DOT.format(_Q.format(2))})), 6) AS score FROM vectors GROUP BY clip_id")
def v06(spark, sf_dir, v):
    return vector_search.search_many(v, [_vec(v, 1), _vec(v, 2)], None).select("clip_id", F.round("score", 6).alias("score"))


@query("v07_pool_before_topk", "vectors", f"SELECT clip_id, round(max({_DOT.format(_Q.format(3))}), 6) AS score FROM vectors WHERE clip_id IN (SELECT clip_id FROM vectors WHERE label = 4) GROUP BY clip_id ORDER BY max({_DOT.format(_Q.format(3))}) DESC, clip_id LIMIT 10")
def v07(spark, sf_dir, v):
    return vector_search.knn(v, _vec(v, 3), 10, v.filter("label = 4").select("clip_id").distinct()).select("clip_id", F.round("score", 6).alias("score"))


@query("v15_mean_vector", "vectors", "SELECT clip_id, i AS dim, round(avg(vec[i + 1]::DOUBLE), 6) AS value FROM vectors, range(8) t(i) GROUP BY clip_id, i")
def v15(spark, sf_dir, v):
    m = v.groupBy("clip_id").agg(V.mean_vector("vec", 8).alias("m"))
    return m.select("clip_id", F.posexplode("m").alias("dim", "value")).select("clip_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("v16_negative_prompt", "vectors", f"""SELECT clip_id, round(max({_DOT.format(_Q.format(3))}), 6) AS score FROM vectors WHERE clip_id NOT IN
  (SELECT clip_id FROM vectors GROUP BY clip_id ORDER BY max({_DOT.format(_Q.format(4))}) DESC, clip_id LIMIT 30) GROUP BY clip_id ORDER BY max({_DOT.format(_Q.format(3))}) DESC, clip_id LIMIT 15""")
def v16(spark, sf_dir, v):
    return vector_search.search_without(v, _vec(v, 3), _vec(v, 4), 15, 30).select("clip_id", F.round("score", 6).alias("score"))


@query("v17_two_stage", "vectors", f"""SELECT clip_id, round(max({_DOT.format(_Q.format(4))}), 6) AS score FROM vectors WHERE clip_id IN
  (SELECT clip_id FROM vectors GROUP BY clip_id ORDER BY max({_DOT.format(_Q.format(3))}) DESC, clip_id LIMIT 30) GROUP BY clip_id ORDER BY max({_DOT.format(_Q.format(4))}) DESC, clip_id LIMIT 10""")
def v17(spark, sf_dir, v):
    return vector_search.search_two_stage(v, _vec(v, 3), _vec(v, 4), 30, 10).select("clip_id", F.round("score", 6).alias("score"))


@query("v18_closest_clusters", "vectors", f"SELECT cluster_id, round(sqrt({_L2.format(_Q.format(3))}), 6) AS distance FROM (SELECT row_id::INT AS cluster_id, vec FROM vectors WHERE row_id < 12) ORDER BY {_L2.format(_Q.format(3))}, cluster_id LIMIT 4")
def v18(spark, sf_dir, v):
    c = v.filter("row_id < 12").select(F.col("row_id").cast("int").alias("cluster_id"), "vec")
    return clusters.closest(c, _vec(v, 3), 4).select("cluster_id", F.round("distance", 6).alias("distance"))


@query("v19_normalize", "vectors", "SELECT row_id, round(list_sum(list_transform(vec::DOUBLE[], lambda x: x)) / sqrt(list_sum(list_transform(vec::DOUBLE[], lambda x: x * x))), 6) AS s FROM vectors")
def v19(spark, sf_dir, v):
    n = v.select("row_id", V.normalize(F.col("vec")).alias("n"))
    return n.select("row_id", F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("v21_similarity_matrix", "vectors", """SELECT q.row_id::STRING AS query_id, v.clip_id, round(max(list_sum(list_transform(list_zip(v.vec::DOUBLE[], q.vec::DOUBLE[]), lambda x: x[1] * x[2]))), 6) AS score
  FROM vectors v, vectors q WHERE q.row_id % 100 = 0 GROUP BY ALL""")
def v21(spark, sf_dir, v):
    return vector_search.similarity_rows(v, _queries(v)).select("query_id", "clip_id", F.round("score", 6).alias("score"))


@query("v22_expand_seeds", "vectors", """SELECT clip_id, round(score, 6) AS score, seed FROM (SELECT row_id::STRING AS clip_id, 1.0::DOUBLE AS score, row_id::STRING AS seed FROM vectors WHERE row_id % 100 = 0
  UNION ALL (SELECT clip_id, max(score), max_by(seed, (score, seed)) FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, clip_id) AS r FROM (
  SELECT q.row_id::STRING AS seed, v.row_id::STRING AS clip_id, list_sum(list_transform(list_zip(v.vec::DOUBLE[], q.vec::DOUBLE[]), lambda x: x[1] * x[2])) AS score FROM vectors v, vectors q WHERE q.row_id % 100 = 0 AND v.row_id <> q.row_id))
  WHERE r <= 10 AND clip_id::BIGINT % 100 <> 0 GROUP BY clip_id)) ORDER BY score DESC, clip_id LIMIT 200""")
def v22(spark, sf_dir, v):
    v = v.withColumn("clip_id", F.col("row_id").cast("string"))
    return vector_search.expand(v, v.filter("row_id % 100 = 0"), 10, 200).select("clip_id", F.round("score", 6).alias("score"), "seed")


@query("v23_similar_to_each", "vectors", """SELECT seed, clip_id, rank FROM (SELECT q.row_id::STRING AS seed, v.row_id::STRING AS clip_id, row_number() OVER (PARTITION BY q.row_id ORDER BY list_sum(list_transform(list_zip(v.vec::DOUBLE[], q.vec::DOUBLE[]), lambda x: x[1] * x[2])) DESC, v.row_id::STRING) AS rank
  FROM vectors v, vectors q WHERE q.row_id % 100 = 0 AND v.row_id <> q.row_id) WHERE rank <= 7""")
def v23(spark, sf_dir, v):
    v = v.withColumn("clip_id", F.col("row_id").cast("string"))
    return vector_search.neighbours(v, v.filter("row_id % 100 = 0"), 7).select("seed", "clip_id", F.col("rank").cast("long").alias("rank"))


@query("s02_one_per_clip", "vectors", "SELECT clip_id, min(row_id) AS row_id FROM vectors GROUP BY clip_id")
def s02(spark, sf_dir, v):
    return vector_search.one_per_clip(v).select("clip_id", "row_id")


@query("l06_cluster_members", "assignments", "SELECT clip_id, distance, row_number() OVER (ORDER BY distance, clip_id) AS pos FROM assignments WHERE cluster_id = 2")
def l06(spark, sf_dir, a):
    return clusters.members(a, "run1", 2).select("clip_id", "distance", F.row_number().over(Window.orderBy("distance", "clip_id")).cast("long").alias("pos"))


@query("j17_clusters_of_clips", "assignments", "SELECT clip_id, cluster_id, distance FROM assignments WHERE clip_id IN ('1', '5', '9')")
def j17(spark, sf_dir, a):
    return clusters.clusters_of(a.filter("clip_id in ('1', '5', '9')").select("clip_id"), a, "run1")


@query("a19_cluster_sizes", "assignments", "SELECT i::INT AS cluster_id, coalesce(n, 0) AS size, rep AS representative FROM range(12) t(i) LEFT JOIN (SELECT cluster_id, count(*) AS n, min_by(clip_id, (distance, clip_id)) AS rep FROM assignments GROUP BY cluster_id) ON cluster_id = i")
def a19(spark, sf_dir, a):
    return clusters.sizes(a, 12)


@query("a33_cluster_summary", "assignments", "SELECT cluster_id, count(*) AS size, round(count(*) / (SELECT count(*) FROM assignments), 6) AS share, CASE WHEN cluster_id % 2 = 0 THEN concat('topic ', cluster_id) ELSE 'a, b, c' END AS theme FROM assignments GROUP BY cluster_id HAVING count(*) >= 30 ORDER BY size DESC, cluster_id LIMIT 8")
def a33(spark, sf_dir, a):
    t = a.select("cluster_id").distinct().select("cluster_id", F.when(F.col("cluster_id") % 2 == 0, F.concat(F.lit("topic "), "cluster_id")).alias("description"), F.array(*map(F.lit, "abcd")).alias("keywords"))
    return clusters.summarize(t, clusters.sizes(a, 12), 30, 8).withColumn("share", F.round("share", 6))


@query("f37_clusters_by_keyword", "assignments", "SELECT cluster_id, count(*) AS size, CASE WHEN cluster_id % 3 = 0 THEN 'keywords' ELSE 'description' END AS matched FROM assignments WHERE cluster_id % 3 = 0 OR cluster_id % 2 = 0 GROUP BY cluster_id ORDER BY size DESC, cluster_id LIMIT 5")
def f37(spark, sf_dir, a):
    i = F.col("cluster_id")
    t = a.select("cluster_id").distinct().select("cluster_id", F.when(i % 2 == 0, "Night driving").alias("description"), F.when(i % 3 == 0, F.array(F.lit("NIGHT street"))).otherwise(F.array(F.lit("day"))).alias("keywords"))
    return clusters.find_by_keyword(t, clusters.sizes(a, 12), "night", 5).select("cluster_id", "size", "matched")


@query("m01_kmeans", "vectors")
def m01(spark, sf_dir, v):
    a, _ = clusters.fit(v.withColumn("clip_id", F.col("row_id").cast("string")), 10)
    return a


_NEAREST = f"(SELECT v.row_id::STRING AS clip_id, arg_min(c.cluster_id, struct_pack(d := round({_L2.format('c.centre::DOUBLE[]')}, 9), i := c.cluster_id)) AS cluster_id, round(min({_L2.format('c.centre::DOUBLE[]')}), 6) AS distance FROM vectors v, (SELECT (row_number() OVER (ORDER BY row_id) - 1)::INT AS cluster_id, vec AS centre FROM vectors WHERE row_id < 64) c GROUP BY v.row_id)"


@query("m01_assign", "vectors", f"SELECT * FROM {_NEAREST}")
def m01b(spark, sf_dir, v):
    """Every row at the nearest of given centroids."""
    return _assigned(v, v)


@query("m02_cluster_subset", "vectors", f"SELECT * FROM {_NEAREST} ORDER BY md5('1234:' || clip_id) LIMIT (SELECT count(*) // 3 FROM vectors)")
def m02(spark, sf_dir, v):
    """A run over a random third of the clips."""
    ids = v.withColumn("clip_id", F.col("row_id").cast("string"))
    return _assigned(v, windows.random_subset(ids, "clip_id", v.count() // 3, 1234))


def _assigned(v, rows):
    centres = [[float(x) for x in r.vec] for r in v.filter("row_id < 64").orderBy("row_id").collect()]  # 64 given centroids
    a = clusters.assign(rows.withColumn("clip_id", F.col("row_id").cast("string")), centres)
    return a.withColumn("distance", F.round("distance", 6))


@query("m03_projection", "vectors")
def m03(spark, sf_dir, v):
    return clusters.project_2d(v.withColumn("clip_id", F.col("row_id").cast("string")))


@query("m04_topics", "captions")
def m04(spark, sf_dir, c):
    a = c.select("clip_id").distinct().withColumn("cluster_id", (F.col("clip_id").cast("long") % 4).cast("int"))
    return clusters.topics(a, c.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_list("caption")), " ").alias("caption"))).withColumn("keywords", F.array_join("keywords", ", "))


@query("m04_term_weights", "captions", r"""SELECT * FROM (WITH d AS (SELECT clip_id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(string_agg(caption, ' ' ORDER BY caption)), '[#*\-0-9]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: length(w) > 1) AS t FROM captions GROUP BY clip_id),
  e AS (SELECT clip_id, unnest(t) AS term FROM d UNION ALL SELECT clip_id, unnest(list_transform(range(1, length(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d),
  tf AS (SELECT clip_id, term, count(*) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM d),
  df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.6 * (SELECT n FROM n) ORDER BY total DESC, term LIMIT 20000),
  w AS (SELECT clip_id, term, (1 + ln(tf)) * (ln((1 + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term))
  SELECT clip_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY clip_id)), 6) AS w FROM w)""")
def m04b(spark, sf_dir, c):
    d = c.groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_list("caption")), " ").alias("caption"))
    return clusters.term_weights(d).withColumn("w", F.round("w", 6))


@query("m05_train_and_score", "vectors")
def m05(spark, sf_dir, v):
    v = v.withColumn("clip_id", F.col("row_id").cast("string"))
    w, b = classifiers.train(v, v.select("clip_id", (F.col("label") == 3).cast("double").alias("label")))
    return classifiers.score(v, w, b)


@query("m06_score_corpus", "vectors", "SELECT row_id::STRING AS clip_id, round(1 / (1 + exp(-(list_sum(list_transform(list_zip(vec::DOUBLE[], range(64)), lambda x: x[1] * (x[2] - 32) / 8)) + 0.5::DOUBLE))), 6) AS p FROM vectors")
def m06(spark, sf_dir, v):
    v = v.withColumn("clip_id", F.col("row_id").cast("string"))
    return classifiers.score(v, [(i - 32) / 8 for i in range(64)], 0.5).select("clip_id", F.round("p", 6).alias("p"))


@query("m07_keep_top", "scores", "SELECT clip_id, p FROM scores WHERE run_id = 'run0' AND p > 0.3::DOUBLE ORDER BY p DESC, clip_id LIMIT 100")
def m07(spark, sf_dir, s):
    return classifiers.keep_top(s.filter("run_id = 'run0'").select("clip_id", "p"), 0.3, 100)


@query("m08_training_set", "annotations clips")
def m08(spark, sf_dir, a, c):
    return classifiers.training_set(a, c, ["quality"], ["toxic"])


@query("a31_classifier_coverage", "scores clips", "SELECT trim(d) AS data_source, count(*) AS n_clips, count(*) FILTER (p > 0.5::DOUBLE) AS n_hits FROM (SELECT clip_id, unnest(string_split(data_source, ',')) AS d FROM clips) LEFT JOIN (SELECT * FROM scores WHERE run_id = 'run1') USING (clip_id) GROUP BY trim(d)")
def a31(spark, sf_dir, s, c):
    return classifiers.coverage(s, c, "run1", 0.5)


@query("a34_resolve_names", "annotations", """SELECT name, "match" FROM (SELECT key AS name, CASE WHEN key = 'quality' THEN 1.0::DOUBLE ELSE NULL END AS "match" FROM annotations GROUP BY key) WHERE "match" IS NOT NULL""")
def a34(spark, sf_dir, a):
    return classifiers.resolve(a.select(F.col("key").alias("name")).distinct(), "Quality")


def _sims(v):
    """The stated query set against all vectors but a query's own."""
    return vector_search.similarity_rows(v, _queries(v), "row_id").withColumn("score", F.round("score", 3))


_SIMS = """s AS (SELECT q.row_id::STRING AS query_id, v.clip_id, round(max(list_sum(list_transform(list_zip(v.vec::DOUBLE[], q.vec::DOUBLE[]), lambda x: x[1] * x[2]))), 3) AS score FROM vectors v, vectors q WHERE q.row_id % 100 = 0 AND v.row_id <> q.row_id GROUP BY ALL),
  r AS (SELECT query_id, count(*) FILTER (score > t) + 1 + (count(*) FILTER (score = t) - 1) / 2.0::DOUBLE AS rank FROM s JOIN (SELECT s.query_id, score AS t FROM s JOIN vectors q ON q.row_id::STRING = s.query_id AND q.clip_id = s.clip_id) USING (query_id) GROUP BY query_id)"""


def _truth(v):
    return v.filter("row_id % 100 = 0").select(F.col("row_id").cast("string").alias("query_id"), "clip_id")


@query("w05_truth_ranks", "vectors", f"SELECT * FROM (WITH {_SIMS} SELECT query_id, rank FROM r)")
def w05(spark, sf_dir, v):
    return evaluation.truth_ranks(_sims(v), _truth(v))


@query("x01_recall_report", "vectors", f"SELECT * FROM (WITH {_SIMS} SELECT avg((rank <= 1)::INT) AS recall_1, avg((rank <= 5)::INT) AS recall_5, avg((rank <= 10)::INT) AS recall_10, median(rank) AS median_rank, count(*) AS n FROM r)")
def x01(spark, sf_dir, v):
    return evaluation.recall_report(evaluation.truth_ranks(_sims(v), _truth(v)))


@query("x03_failures", "vectors", f"SELECT * FROM (WITH {_SIMS} SELECT query_id, rank, wrong FROM r JOIN (SELECT query_id, min_by(clip_id, (-score, clip_id)) AS wrong FROM s GROUP BY query_id) USING (query_id) JOIN (SELECT row_id::STRING AS query_id, clip_id FROM vectors) USING (query_id) WHERE rank > 10 AND wrong <> clip_id)")
def x03(spark, sf_dir, v):
    return evaluation.failures(_sims(v), _truth(v), 10)


@query("w04_zscore_fusion", "vectors", f"SELECT * FROM (WITH {_SIMS} SELECT query_id, clip_id, round(2 * (score - avg(score) OVER (PARTITION BY query_id)) / (stddev_pop(score) OVER (PARTITION BY query_id) + 1e-8::DOUBLE), 5) AS score FROM s)")
def w04(spark, sf_dir, v):
    s = _sims(v)
    return evaluation.fuse({"a": s, "b": s}, "zscore").withColumn("score", F.round("score", 5))


@query("x02_fusion_grid", "vectors")
def x02(spark, sf_dir, v):
    s = _sims(v)
    return evaluation.fusion_grid({"a": s, "b": s.withColumn("score", -F.col("score")), "c": s}, {"a": "x", "b": "y", "c": "x"}, _truth(v))


@query("x04_label_scores", "vectors", f"""SELECT label, round(sum(CASE WHEN hit THEN hits / rank ELSE 0 END) / 30, 6) AS ap, round(count(*) FILTER (hit AND rank <= 30) / 30.0::DOUBLE, 6) AS r_precision, count(*) FILTER (hit AND rank <= 5) / 5.0::DOUBLE AS p_5, round(count(*) FILTER (hit AND rank <= 5) / 30.0::DOUBLE, 6) AS r_5 FROM (
  SELECT *, sum(hit::INT) OVER (PARTITION BY label ORDER BY rank)::DOUBLE AS hits FROM (SELECT 'near' AS label, row_id % 3 = 0 AND row_id < 90 AS hit, row_number() OVER (ORDER BY {_DOT.format(_Q.format(3))} DESC, row_id)::DOUBLE AS rank FROM vectors)) GROUP BY label""")
def x04(spark, sf_dir, v):
    s = v.select("row_id", F.col("row_id").cast("string").alias("clip_id"), V.dot("vec", V.vector(_vec(v, 3))).alias("s"))
    ranked = s.select(F.lit("near").alias("label"), "clip_id", F.row_number().over(Window.orderBy(F.desc("s"), "row_id")).alias("rank"))
    truth = v.filter("row_id % 3 = 0 and row_id < 90").select(F.lit("near").alias("label"), F.col("row_id").cast("string").alias("clip_id"))
    e = evaluation.label_scores(ranked, truth, (5,))
    return e.select("label", *[F.round(c, 6).alias(c) for c in e.columns[1:]])


@query("u06_caption_scores", "captions")
def u06(spark, sf_dir, c):
    p = c.groupBy("clip_id").agg(F.min_by("caption", "uid").alias("reference"), F.max_by("caption", "uid").alias("prediction"))
    return evaluation.cider(evaluation.score_captions(p, ["bleu", "rouge_1", "rouge_2", "rouge_l", "meteor"])).drop("reference", "prediction")


_WORDS_OF = r"list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> '')"
_TWOS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_OVERLAP = "SELECT clip_id, CASE WHEN sum(least(a, b)) > 0 THEN 2 * sum(least(a, b)) / (sum(a) + sum(b)) ELSE 0 END AS f FROM (SELECT clip_id, g, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (SELECT clip_id, unnest({0}) AS g, 1 AS a, 0 AS b FROM toks UNION ALL SELECT clip_id, unnest({1}), 0, 1 FROM toks) GROUP BY ALL) GROUP BY clip_id"


@query("x07_word_overlap", "captions", f"""SELECT clip_id, round(coalesce(one.f, 0), 9) AS rouge_1, round(coalesce(two.f, 0), 9) AS rouge_2 FROM
  (WITH toks AS (SELECT clip_id, {_WORDS_OF.format("min_by(caption, uid)")} AS r, {_WORDS_OF.format("max_by(caption, uid)")} AS p FROM captions GROUP BY clip_id)
  SELECT t.clip_id, one, two FROM toks t LEFT JOIN ({_OVERLAP.format("r", "p")}) one USING (clip_id) LEFT JOIN ({_OVERLAP.format(_TWOS.format("r"), _TWOS.format("p"))}) two USING (clip_id))""")
def x07(spark, sf_dir, c):
    """Overlaps of words and of word pairs between each clip's first and last caption."""
    p = c.groupBy("clip_id").agg(F.min_by("caption", "uid").alias("reference"), F.max_by("caption", "uid").alias("prediction"))
    s = evaluation.score_captions(p, ["rouge_1", "rouge_2"])
    return s.select("clip_id", F.round("rouge_1", 9).alias("rouge_1"), F.round("rouge_2", 9).alias("rouge_2"))


_PAIRS = "(SELECT clip_id, min_by(caption, uid) AS reference, max_by(caption, uid) AS prediction FROM captions GROUP BY clip_id)"
_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[^\x20\x09-\x0D]+')"
_MATCHED = "SELECT clip_id, sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w) AS v FROM (SELECT clip_id, CASE WHEN sum(idf) OVER (PARTITION BY clip_id) > 0 THEN idf ELSE 1 END AS w, hit FROM (SELECT s.clip_id, s.hit, coalesce(i.idf, (SELECT ln(n + 1) FROM total)) AS idf FROM ({}) s LEFT JOIN idf i USING (token))) GROUP BY clip_id"
_SIDE = "SELECT clip_id, unnest({0}) AS token, list_contains({1}, unnest({0})) AS hit FROM toks WHERE len(r) > 0 AND len(p) > 0"


@query("x08_shared_tokens", "captions", f"""SELECT clip_id, round(coalesce(a.v, 0), 6) AS match_precision, round(coalesce(b.v, 0), 6) AS match_recall, round(CASE WHEN a.v + b.v > 0 THEN 2 * a.v * b.v / (a.v + b.v) ELSE 0 END, 6) AS match_f1 FROM
  (WITH toks AS (SELECT clip_id, {_TOKENS.format("reference")} AS r, {_TOKENS.format("prediction")} AS p FROM {_PAIRS}), total AS (SELECT count(*)::DOUBLE AS n FROM toks),
  idf AS (SELECT token, ln((n + 1) / (count(*) + 1)) AS idf FROM (SELECT DISTINCT clip_id, unnest(r) AS token FROM toks), total GROUP BY token, n)
  SELECT t.clip_id, a, b FROM toks t LEFT JOIN ({_MATCHED.format(_SIDE.format("p", "r"))}) a USING (clip_id) LEFT JOIN ({_MATCHED.format(_SIDE.format("r", "p"))}) b USING (clip_id))""")
def x08(spark, sf_dir, c):
    """Captions against one another with words that are like themselves only: weighted shares of common words."""
    p = c.groupBy("clip_id").agg(F.min_by("caption", "uid").alias("reference"), F.max_by("caption", "uid").alias("prediction"))
    m = evaluation.token_match(p, encoders.same_tokens)
    return m.select("clip_id", *[F.round(x, 6).alias(x) for x in ("match_precision", "match_recall", "match_f1")])


@query("x08_token_match", "captions")
def x08b(spark, sf_dir, c):
    """The same with words as vectors of their letter groups."""
    p = c.groupBy("clip_id").agg(F.min_by("caption", "uid").alias("reference"), F.max_by("caption", "uid").alias("prediction"))
    return evaluation.token_match(p, encoders.GramTokens()).drop("reference", "prediction")


@query("a27_select_scenarios", "annotations clips", """SELECT key, n_clips, n_pred FROM (SELECT *, row_number() OVER (ORDER BY n_clips DESC, key) - 1 AS r, count(*) OVER () AS m FROM (
  SELECT key, count(DISTINCT clip_id) AS n_clips, count(DISTINCT clip_id) FILTER (clip_id::BIGINT % 2 = 0) AS n_pred FROM annotations WHERE value IS NULL GROUP BY key HAVING count(DISTINCT clip_id) >= 5)
  WHERE n_pred > 0) WHERE r % greatest(1, floor(m / 2)::BIGINT) = 0 AND r / greatest(1, floor(m / 2)::BIGINT) < 2""")
def a27(spark, sf_dir, a, c):
    return evaluation.select_scenarios(a, c.filter("cast(clip_id as bigint) % 2 = 0"), 2, 5, 10)


@query("v05_pooled_views", "vectors", f"SELECT clip_id, round(max({_DOT.format(_Q.format(6))}), 6) AS score FROM vectors GROUP BY clip_id")
def v05(spark, sf_dir, v):
    return vector_search.pooled(vector_search.scored(v, _vec(v, 6))).withColumn("score", F.round("score", 6))


@query("v08_image_upload", "vectors", f"SELECT clip_id, round(max({_DOT.format(_Q.format(8))}), 6) AS score FROM vectors GROUP BY clip_id")
def v08(spark, sf_dir, v):
    from ..plans.client import Client
    from ..plans.engine import Catalog, Engine

    c = v.select("clip_id").distinct()
    client = Client(Engine(Catalog(c, c, visual_vectors=v, uploads={"up1": _vec(v, 8)})))
    return client.search_visual_image("up1").rows.select("clip_id", F.round("visual_image_score", 6).alias("score"))


@query("v09_best_rows", "vectors", f"SELECT clip_id, round(max(s), 6) AS score FROM (SELECT clip_id, {_DOT.format(_Q.format(8))} AS s, row_id FROM vectors WHERE clip_id <> 'c8' ORDER BY s DESC, row_id LIMIT 40) GROUP BY clip_id")
def v09(spark, sf_dir, v):
    """The clips of the 40 nearest rows of an uploaded image, within a pool."""
    from ..plans.client import Client
    from ..plans.engine import Catalog, Engine

    c = v.filter("clip_id <> 'c8'").select("clip_id").distinct()
    client = Client(Engine(Catalog(c, c, visual_vectors=v, uploads={"up1": _vec(v, 8)}), visual_rows=40))
    return client.search_visual_image("up1").rows.select("clip_id", F.round("visual_image_score", 6).alias("score"))


@query("v24_row_neighbours", "vectors", f"""SELECT * FROM (SELECT q.row_id::STRING AS query_id, row_number() OVER (PARTITION BY q.row_id ORDER BY {_DOT.format("q.vec::DOUBLE[]").replace("vec::DOUBLE[], q", "v.vec::DOUBLE[], q")} DESC, v.row_id)::INT AS rank, v.row_id, v.clip_id,
  round({_DOT.format("q.vec::DOUBLE[]").replace("vec::DOUBLE[], q", "v.vec::DOUBLE[], q")}, 6) AS score FROM vectors v, vectors q WHERE q.row_id % 100 = 0) WHERE rank <= 10""")
def v24(spark, sf_dir, v):
    """The ten nearest rows of every row whose id is divisible by 100, itself and several of a clip included."""
    return vector_search.row_neighbours(v, _queries(v), 10).withColumn("score", F.round("score", 6))


@query("v24_clip_neighbours", "vectors", f"""SELECT * FROM (SELECT q.clip_id AS query_id, row_number() OVER (PARTITION BY q.clip_id ORDER BY round({_DOT.format("q.vec::DOUBLE[]").replace("vec::DOUBLE[], q", "v.vec::DOUBLE[], q")} / q.len, 9) DESC, v.row_id)::INT AS rank, v.row_id, v.clip_id,
  round({_DOT.format("q.vec::DOUBLE[]").replace("vec::DOUBLE[], q", "v.vec::DOUBLE[], q")} / q.len, 6) AS score FROM vectors v, (SELECT clip_id, min_by(vec, row_id) AS vec, sqrt(list_sum(list_transform(min_by(vec, row_id)::DOUBLE[], lambda x: x * x))) AS len FROM vectors WHERE clip_id IN ('c3', 'c14') GROUP BY clip_id) q)""")
def v24_clips(spark, sf_dir, v):
    """All rows by their nearness to two given clips; an unknown clip has no neighbours."""
    asked = spark.createDataFrame([("c3",), ("c14",), ("nobody",)], "clip_id string")
    return vector_search.clip_neighbours(v, asked, -1).withColumn("score", F.round("score", 6))


@query("v03_text_query", "captions")
def v03b(spark, sf_dir, c):
    """Text search over encoded captions, several rows a clip, two query texts."""
    from ..functions.encoders import HashingEncoder, encode
    from ..plans.client import Client
    from ..plans.engine import Catalog, Engine

    e = HashingEncoder(32)
    v = c.select("clip_id", F.col("uid").alias("row_id"), encode("caption", e).alias("vec"))
    clips = c.select("clip_id").distinct()
    client = Client(Engine(Catalog(clips, clips, caption_vectors=v, encoders={"caption": e.one}), k=25))
    return client.search_caption_embed("the thing in the ring", caption_embed_extra=["der die das"]).rows.select("clip_id", F.round("caption_embed_score", 5).alias("score"))


@query("v20_sample_rows", "vectors")
def v20(spark, sf_dir, v):
    return vector_search.sample_rows(v, 50).select("row_id")


@query("v25_encoding_cache", "captions")
def v25(spark, sf_dir, c):
    from ..functions.encoders import HashingEncoder, encode_cached

    t = c.select(F.col("caption").alias("text"))
    cache = encode_cached(t.limit(20), spark.createDataFrame([], "hash string, vec array<float>"), HashingEncoder(8)).select("hash", "vec")
    return encode_cached(t, cache, HashingEncoder(8)).select("hash", F.size("vec").alias("dims"))


@query("w09_precision_recall", "vectors", f"""SELECT clip_id, rank::BIGINT AS rank, round(sum(hit::INT) OVER (ORDER BY rank) / rank, 6) AS precision, round(sum(hit::INT) OVER (ORDER BY rank) / 30.0::DOUBLE, 6) AS recall FROM (
  SELECT row_id::STRING AS clip_id, row_id % 3 = 0 AND row_id < 90 AS hit, row_number() OVER (ORDER BY {_DOT.format(_Q.format(3))} DESC, row_id)::DOUBLE AS rank FROM vectors)""")
def w09(spark, sf_dir, v):
    s = v.select("row_id", F.col("row_id").cast("string").alias("clip_id"), V.dot("vec", V.vector(_vec(v, 3))).alias("s"))
    ranked = s.select(F.lit("near").alias("label"), "clip_id", F.row_number().over(Window.orderBy(F.desc("s"), "row_id")).cast("long").alias("rank"))
    truth = v.filter("row_id % 3 = 0 and row_id < 90").select(F.lit("near").alias("label"), F.col("row_id").cast("string").alias("clip_id"))
    return evaluation.ranked_hits(ranked, truth).select("clip_id", "rank", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("w20_client_score", "assignments scores", """SELECT a.clip_id, coalesce(CASE WHEN p <= 0.9::DOUBLE THEN p END, 1 / (1 + distance)) AS best FROM assignments a LEFT JOIN scores s ON s.clip_id = a.clip_id AND s.run_id = 'run0'""")
def w20(spark, sf_dir, a, s):
    from ..plans.engine import client_score

    p = F.when(F.col("p") > 0.9, float("nan")).otherwise(F.col("p"))
    r = a.select("clip_id", F.col("distance").alias("cluster_distance")).join(s.filter("run_id = 'run0'").select("clip_id", p.alias("classifier_score")), "clip_id", "left")
    return r.select("clip_id", client_score(r).alias("best"))


@query("o08_score_by_targets", "vectors", """SELECT clip_id, run AS dimension, round(max(score), 6) AS score FROM (SELECT concat('like_', q.row_id) AS run, v.row_id::STRING AS clip_id, list_sum(list_transform(list_zip(v.vec::DOUBLE[], q.vec::DOUBLE[]), lambda x: x[1] * x[2])) AS score FROM vectors v, vectors q WHERE q.row_id % 100 = 0) GROUP BY ALL""")
def o08(spark, sf_dir, v):
    q = v.filter("row_id % 100 = 0").select(F.concat(F.lit("like_"), "row_id").alias("query_id"), "vec")
    return vector_search.similarity_rows(v.withColumn("clip_id", F.col("row_id").cast("string")), q).select("clip_id", F.col("query_id").alias("dimension"), F.round("score", 6).alias("score"))


def _built(spark, v):
    """An index of fitted cells and codes over single rows, stored and opened again."""
    return vector_index.build(v.withColumn("clip_id", F.col("row_id").cast("string")), workdir(spark, "vectors"), cells=16, parts=16, rotations=4, rounds=6)


@query("x05_cell_recall", "vectors")
def x05(spark, sf_dir, v):
    """Mean and least recall of the best 20, by probed cells, over the stated query set."""
    index, q, out = _built(spark, v), _queries(v), None
    exact = similarities(v.withColumn("clip_id", F.col("row_id").cast("string")), q, 20)
    for n in (1, 4, 12, 16):
        r = vector_index.recalls(exact, index.search(q, 20, n)).agg(F.lit(n).alias("n_probe"), F.avg("recall").alias("recall"), F.min("recall").alias("least"))
        out = r if out is None else out.unionByName(r)
    return out


_TOP = """SELECT query_id, clip_id, round(score, 6) AS score, rank FROM (SELECT q.row_id::STRING AS query_id, v.{} AS clip_id, max(list_sum(list_transform(list_zip(v.vec::DOUBLE[], q.vec::DOUBLE[]), lambda x: x[1] * x[2]))) AS score,
  row_number() OVER (PARTITION BY q.row_id ORDER BY max(list_sum(list_transform(list_zip(v.vec::DOUBLE[], q.vec::DOUBLE[]), lambda x: x[1] * x[2]))) DESC, v.{}) AS rank FROM vectors v, vectors q WHERE q.row_id % 100 = 0 GROUP BY q.row_id, v.{}) WHERE rank <= 10"""


@query("v02_residual_index", "vectors", _TOP.format(*["row_id::STRING"] * 3))
def v02_index(spark, sf_dir, v):
    """A stored index whose cells are all probed and whose rows are all judged again is exact; x05 has the recall of fewer."""
    index = _built(spark, v)
    r = index.search(_queries(v), 10, len(index.model.centroids), -(-v.count() // 10))
    return r.select("query_id", "clip_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("j14_block_top", "vectors", _TOP.format(*["clip_id"] * 3))
def j14(spark, sf_dir, v):
    r = similarities(v, _queries(v), 10).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "clip_id")))
    return r.select("query_id", "clip_id", F.round("score", 6).alias("score"), F.col("r").cast("long").alias("rank"))


@query("v02_graph_recall", "vectors")
def v02_graph(spark, sf_dir, v):
    """Recall of the best 20 by stored graphs, for each of the stated queries."""
    v, q = v.withColumn("clip_id", F.col("row_id").cast("string")), _queries(v)
    return vector_index.recalls(similarities(v, q, 20), graph_index.build(v, workdir(spark, "graphs")).search(q, 20))


@query("m03_neighbour_map", "vectors")
def m03_map(spark, sf_dir, v):
    """A layout of a bounded sample, and the places of all rows on it."""
    return projection.project(v, epochs=100).select("row_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
