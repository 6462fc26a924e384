"""Filters, set operators, full text and the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classifiers, clusters, labels, perception, sets, text, trajectory
from ..plans.engine import Catalog, Engine
from ..plans.filters import NumericFilter, SearchFilters
from ..sources.readers import trajectories_of
from ..sources.workdir import workdir
from .base import query

_ANY = "clip_id IN (SELECT clip_id FROM annotations WHERE value IS NULL AND {})"
_SRC = "list_filter(list_transform(string_split(data_source, ','), lambda x: trim(x)), lambda x: x <> '')"


@query("flagship_similar_labelled", "clips annotations", f"""SELECT clip_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, clip_id) AS rank FROM (
  SELECT vec_id::STRING AS clip_id, list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), lambda x: x[1] * x[2])) AS score FROM embeddings) v
  WHERE clip_id IN (SELECT clip_id FROM clips WHERE list_has_any({_SRC}, ['src0', 'src1', 'src7', 'extra'])) AND {_ANY.format("key = 'quality'")} ORDER BY score DESC, clip_id LIMIT 50""")
def flagship(spark, sf_dir, clips, annotations):
    """Clips of given sources with a label, ranked by similarity to a stored clip."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("vec_id").cast("string").alias("clip_id"), F.col("embedding").alias("vec"))
    e = Engine(Catalog(clips, clips.select("clip_id"), annotations, video_vectors=v), k=1_000_000)
    from pyspark.sql import Window

    f = SearchFilters.from_kwargs(semantic_clip="7", filter=["quality"], project_source=["p0", "p1"], data_source=["src0", "src1", "src7", "extra"])
    r = e._labels(e.universe(), f)
    from ..operators.vector_search import search_clip

    s = search_clip(v, "7", 50, r, cutoff=-2.0)
    return s.select("clip_id", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "clip_id")).cast("long").alias("rank"))


@query("universe", "video_paths", "SELECT clip_id FROM video_paths")
def universe(spark, sf_dir, paths):
    return Engine(Catalog(paths, paths)).universe()


def _sets(a):
    return labels.labels_only(a).select(F.col("key").alias("set_id"), "clip_id")


@query("f01_project", "clips annotations", f"SELECT clip_id FROM clips WHERE {_ANY.format('true')}")
def f01(spark, sf_dir, c, a):
    return sets.project(c, labels.labels_only(a)).select("clip_id")


@query("f02_project_any", "clips annotations", f"SELECT clip_id FROM clips WHERE {_ANY.format('true')}")
def f02(spark, sf_dir, c, a):
    return sets.project_any(c, _sets(a)).select("clip_id")


@query("f03_project_all", "clips annotations", "SELECT clip_id FROM clips JOIN (SELECT clip_id FROM annotations WHERE key IN ('quality', 'unsafe') GROUP BY clip_id HAVING count(DISTINCT key) = 2) USING (clip_id)")
def f03(spark, sf_dir, c, a):
    return sets.project_all(c, _sets(a).filter("set_id in ('quality', 'unsafe')"), 2).select("clip_id")


@query("f04_exclude_any", "clips annotations", f"SELECT clip_id FROM clips WHERE NOT {_ANY.format('true')}")
def f04(spark, sf_dir, c, a):
    return sets.exclude_any(c, _sets(a)).select("clip_id")


@query("f05_exclude_all", "clips annotations", "SELECT clip_id FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM annotations WHERE key IN ('quality', 'unsafe') GROUP BY clip_id HAVING count(DISTINCT key) = 2)")
def f05(spark, sf_dir, c, a):
    return sets.exclude_all(c, _sets(a).filter("set_id in ('quality', 'unsafe')"), 2).select("clip_id")


@query("f06_project_scores", "clips scores", """SELECT c.clip_id, a.p AS score_0, b.p AS score_1, b.clip_id::BIGINT AS ord FROM clips c JOIN scores a ON a.clip_id = c.clip_id AND a.run_id = 'run0' JOIN scores b ON b.clip_id = c.clip_id AND b.run_id = 'run1'""")
def f06(spark, sf_dir, c, s):
    one = lambda r: s.filter(F.col("run_id") == r).select("clip_id", F.col("p").alias("score"), F.col("clip_id").cast("long").alias("ord"))
    return sets.project_scores(c.select("clip_id"), one("run0"), one("run1"))


@query("f07_clip_id", "clips", "SELECT * FROM clips WHERE clip_id = '17'")
def f07(spark, sf_dir, c):
    return labels.by_clip(c, "17")


@query("f08_api_tags", "clips", "SELECT clip_id FROM clips WHERE clip_id::BIGINT % 6 = 2 OR clip_id::BIGINT % 4 = 1")
def f08(spark, sf_dir, c):
    n = F.col("clip_id").cast("long")
    apis = c.select("clip_id", F.array_compact(F.array(F.when(n % 6 == 2, "x"), F.when(n % 4 == 1, "y"), F.when(n % 5 == 1, "z"))).alias("apis"))
    return labels.by_api(c, apis, ["x", "y"]).select("clip_id")


@query("f09_country", "clips", "SELECT clip_id FROM clips WHERE coalesce(country, '') = 'DE'")
def f09(spark, sf_dir, c):
    return labels.by_country(c, c, "DE").select("clip_id")


@query("f10_left_hand", "clips", "SELECT clip_id FROM clips WHERE country IN ('FR', 'ES')")
def f10(spark, sf_dir, c):
    return labels.by_left_hand(c, c, ("FR", "ES")).select("clip_id")


@query("f11_labels_any", "clips annotations", f"SELECT clip_id FROM clips WHERE {_ANY.format(chr(34) + 'key' + chr(34) + " IN ('quality', 'toxic') AND project = 'p0'")}")
def f11(spark, sf_dir, c, a):
    return labels.by_labels(c, a, ["quality", "toxic"], ["p0"]).select("clip_id")


@query("f11_labels_all", "clips annotations", "SELECT clip_id FROM clips JOIN (SELECT clip_id FROM annotations WHERE key IN ('quality', 'toxic') AND project IN ('p0', 'p1') GROUP BY clip_id HAVING count(DISTINCT key) = 2) USING (clip_id)")
def f11b(spark, sf_dir, c, a):
    return labels.by_labels(c, a, ["quality", "toxic"], ["p0", "p1"], "all").select("clip_id")


@query("f12_numeric_range", "clips annotations", "SELECT c.clip_id, max(a.value) AS value FROM clips c JOIN annotations a USING (clip_id) WHERE a.key = 'n_chars' AND a.value BETWEEN 500 AND 3000 GROUP BY c.clip_id")
def f12(spark, sf_dir, c, a):
    return labels.by_numeric(c, a, "n_chars", 500, 3000, ["p0", "p1"]).select("clip_id", F.col("numeric_scores")["n_chars"].alias("value"))


@query("f13_sources_any", "clips", f"SELECT clip_id FROM clips WHERE list_has_any({_SRC}, ['src3', 'extra'])")
def f13(spark, sf_dir, c):
    return labels.by_sources(c, c, ["src3", "extra"]).select("clip_id")


@query("f13_sources_all", "clips", f"SELECT clip_id FROM clips WHERE list_has_all({_SRC}, ['src5', 'extra'])")
def f13b(spark, sf_dir, c):
    return labels.by_sources(c, c, ["src5", "extra"], "all").select("clip_id")


@query("f14_granted_sources", "clips", f"SELECT clip_id FROM clips WHERE list_has_any({_SRC}, ['src2'])")
def f14(spark, sf_dir, c):
    return labels.by_sources(c, c, labels.allowed_sources(["src2", "src9"], ["src2", "src4"])).select("clip_id")


@query("f15_timed", "clips annotations", "SELECT clip_id FROM clips WHERE clip_id IN (SELECT clip_id FROM annotations WHERE start_time <> -1)")
def f15(spark, sf_dir, c, a):
    return labels.by_times(c, a, True).select("clip_id")


@query("f16_untimed", "clips annotations", "SELECT clip_id FROM clips WHERE clip_id IN (SELECT clip_id FROM annotations GROUP BY clip_id HAVING count(*) FILTER (start_time <> -1) = 0)")
def f16(spark, sf_dir, c, a):
    return labels.by_times(c, a, False).select("clip_id")


@query("f17_label_types", "clips annotations", f"SELECT clip_id FROM clips WHERE {_ANY.format("label_type = 'autolabel'")}")
def f17(spark, sf_dir, c, a):
    return labels.by_label_types(c, a, ["autolabel"]).select("clip_id")


@query("f18_exclude_labels", "clips annotations", f"SELECT clip_id FROM clips WHERE NOT {_ANY.format("key = 'quality'")}")
def f18(spark, sf_dir, c, a):
    return labels.without_labels(c, a, ["quality"], ["p0", "p1", "p2"]).select("clip_id")


@query("f19_without_annotations", "clips annotations", f"SELECT clip_id FROM clips WHERE NOT {_ANY.format("project = 'p1'")}")
def f19(spark, sf_dir, c, a):
    return labels.without_annotations(c, a, ["p1"]).select("clip_id")


@query("f20_unannotated", "clips annotations", "SELECT clip_id FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM annotations)")
def f20(spark, sf_dir, c, a):
    return labels.unannotated(c, a).select("clip_id")


@query("f21_with_metrics", "clips metrics", "SELECT clip_id FROM clips WHERE clip_id IN (SELECT clip_id FROM metrics)")
def f21(spark, sf_dir, c, m):
    return labels.in_list(c, m.select("clip_id").distinct()).select("clip_id")


@query("f22_perception_count", "clips perception", "SELECT clip_id FROM clips WHERE clip_id IN (SELECT clip_id FROM perception WHERE class = 'click' AND n BETWEEN 10 AND 20)")
def f22(spark, sf_dir, c, p):
    return perception.by_count(c, p, "click", 10, 20).select("clip_id")


@query("f23_perception_range", "clips ticks", """SELECT clip_id FROM clips WHERE clip_id IN (SELECT user_id::STRING FROM ticks GROUP BY user_id HAVING count(*) FILTER (v < 8 OR v * 2 < 8) / 10.0::DOUBLE > 1.5)""")
def f23(spark, sf_dir, c, t):
    loc = F.collect_list(F.array(F.lit(99.0), F.lit(99.0), F.lit(99.0), F.lit(99.0), F.col("v"), F.col("v") * 2))
    p = t.groupBy(F.col("user_id").cast("string").alias("clip_id")).agg(loc.alias("loc"), F.count("*").cast("int").alias("n")).withColumn("class", F.lit("car"))
    return perception.by_range(c, p, "car", ["FRONT", "FRONT_LEFT"], 8.0, 1.5).select("clip_id")


def _tracks(t):
    f = t.select(F.col("user_id").cast("string").alias("clip_id"), F.struct("t", "event_id").alias("frame"), F.col("v").alias("x"), (F.col("v") * 2).alias("y"), F.lit(0.0).alias("z"), (F.floor("v") / 10).alias("speed"), (F.floor("v") % 9 - 4.0).alias("acceleration"), F.lit(0.0).alias("jerk"), (F.floor("v") / 400).alias("curvature"))
    return trajectories_of(f)


@query("f24_motion_expression", "ticks", """SELECT user_id::STRING AS clip_id FROM ticks GROUP BY user_id
  HAVING sum((floor(v) / 10 > 3)::INT) > 12 AND avg((floor(v) / 10)::FLOAT::DOUBLE) < 6""")
def f24(spark, sf_dir, t):
    tr = _tracks(t)
    return trajectory.by_motion(tr.select("clip_id"), tr, "sum(speed > 3.0) > 12 and mean(speed) < 6")


@query("f25_motion_patterns", "ticks", """SELECT user_id::STRING AS clip_id, count(*) FILTER (floor(v)::BIGINT % 9 - 4 < -3) > 10 AS hard_braking, count(*) FILTER ((floor(v) / 400)::FLOAT::DOUBLE > 0.15::DOUBLE) > 10 AS high_curvature,
  count(*) FILTER (floor(v) / 10 < 0.5::DOUBLE) > 150 AS prolonged_stop, coalesce(min(r) FILTER (floor(v) / 10 > 3) > min(r) FILTER (floor(v) / 10 < 0.5::DOUBLE), false) AS stop_go
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM ticks) GROUP BY user_id""")
def f25(spark, sf_dir, t):
    from ..functions.expressions import pattern

    return _tracks(t).select("clip_id", *[pattern(n).alias(n) for n in ("hard_braking", "high_curvature", "prolonged_stop", "stop_go")])


@query("f26_ego_data", "clips ticks", "SELECT clip_id FROM clips WHERE clip_id NOT IN (SELECT user_id::STRING FROM ticks)")
def f26(spark, sf_dir, c, t):
    return labels.in_list(c, t.select(F.col("user_id").cast("string").alias("clip_id")), False).select("clip_id")


@query("f27_clip_list", "clips", "SELECT clip_id FROM clips WHERE clip_id IN ('3', '5', '8', '13')")
def f27(spark, sf_dir, c):
    from ..plans.client import Client

    client = Client(Engine(Catalog(c, c)))
    return client.search_clip_list(client.upload_clip_list(["3", "5", "8", "13", "nope"])).rows.select("clip_id")


@query("f28_cluster_band", "assignments", """SELECT clip_id, distance AS cluster_distance FROM (SELECT *, row_number() OVER (ORDER BY distance, clip_id) - 1 AS r, count(*) OVER () AS n FROM assignments WHERE cluster_id = 3)
  WHERE r >= round_even(n * 10.0::DOUBLE / 100, 0) AND r < round_even(n * 60.0::DOUBLE / 100, 0)""")
def f28(spark, sf_dir, a):
    return clusters.by_cluster(a.select("clip_id"), a, "run1", [3], 10, 60)


@query("f29_probability", "clips scores", "SELECT c.clip_id, s.p AS classifier_score FROM clips c JOIN scores s USING (clip_id) WHERE run_id = 'run1' AND ((p > 0.3::DOUBLE AND p < 0.7::DOUBLE) OR p >= 0.95::DOUBLE)")
def f29(spark, sf_dir, c, s):
    return classifiers.by_probability(c.select("clip_id"), s, "run1", "0.3 < p < 0.7 or p >= 0.95")


@query("f31_ground_truth", "annotations", "SELECT DISTINCT key, clip_id FROM annotations WHERE value IS NULL AND project = 'p0' AND NOT regexp_matches(key, '^uns') AND key IN (SELECT key FROM annotations WHERE value IS NULL AND project = 'p0' GROUP BY key HAVING count(DISTINCT clip_id) >= 3)")
def f31(spark, sf_dir, a):
    return labels.ground_truth(a, "p0", 3, "^uns")


@query("f32_slices", "clips annotations", """SELECT s AS slice, count(*) AS n FROM (
  SELECT 'src1' AS s, clip_id FROM clips WHERE data_source LIKE '%src1%' UNION ALL SELECT 'q%', clip_id FROM clips WHERE clip_id IN (SELECT clip_id FROM annotations WHERE value IS NULL AND key LIKE 'q%')
  UNION ALL SELECT 'src1 & q%', clip_id FROM clips WHERE data_source LIKE '%src1%' AND clip_id IN (SELECT clip_id FROM annotations WHERE value IS NULL AND key LIKE 'q%')) GROUP BY s""")
def f32(spark, sf_dir, c, a):
    return labels.slices(c, a, c, ["src1"], ["q%"]).groupBy("slice").agg(F.count("*").alias("n"))


@query("f34_csv_token", "clips", f"SELECT clip_id FROM clips WHERE list_contains({_SRC}, 'src1')")
def f34(spark, sf_dir, c):
    return c.filter(labels.has_source("src1")).select("clip_id")


def _lists(c):
    n = F.col("clip_id").cast("long")
    out = None
    for k, (m, r) in enumerate(((3, 0), (5, 0), (2, 1))):
        x = c.filter(n % m == r).select(F.lit(k).alias("list_no"), (-n).alias("pos"), "clip_id")
        out = x if out is None else out.unionByName(x)
    return out


@query("o01_union_lists", "clips", """SELECT clip_id, row_number() OVER (ORDER BY l, -clip_id::BIGINT) AS ord FROM (SELECT *, CASE WHEN clip_id::BIGINT % 3 = 0 THEN 0 WHEN clip_id::BIGINT % 5 = 0 THEN 1 ELSE 2 END AS l FROM clips WHERE clip_id::BIGINT % 3 = 0 OR clip_id::BIGINT % 5 = 0 OR clip_id::BIGINT % 2 = 1)""")
def o01(spark, sf_dir, c):
    return sets.union_lists(_lists(c)).withColumn("ord", F.col("ord").cast("long"))


@query("o02_intersect_lists", "clips", "SELECT clip_id, row_number() OVER (ORDER BY -clip_id::BIGINT) AS ord FROM clips WHERE clip_id::BIGINT % 3 = 0 AND clip_id::BIGINT % 5 = 0 AND clip_id::BIGINT % 2 = 1")
def o02(spark, sf_dir, c):
    return sets.intersect_lists(_lists(c), 3).withColumn("ord", F.col("ord").cast("long"))


@query("o03_subtract_lists", "clips", "SELECT clip_id, row_number() OVER (ORDER BY -clip_id::BIGINT) AS ord FROM clips WHERE clip_id::BIGINT % 3 = 0 AND NOT (clip_id::BIGINT % 5 = 0 OR clip_id::BIGINT % 2 = 1)")
def o03(spark, sf_dir, c):
    return sets.subtract_lists(_lists(c)).withColumn("ord", F.col("ord").cast("long"))


@query("o04_combine_searches", "clips", """SELECT clip_id, row_number() OVER (ORDER BY l, p) AS ord FROM (SELECT clip_id, min(l) AS l, min_by(p, l) AS p FROM (
  SELECT * FROM (SELECT 0 AS l, clip_id, row_number() OVER (ORDER BY clip_id::BIGINT) - 1 AS p FROM clips WHERE clip_id::BIGINT % 3 = 0) WHERE p < 20 UNION ALL
  SELECT * FROM (SELECT 1 AS l, clip_id, row_number() OVER (ORDER BY clip_id::BIGINT) - 1 AS p FROM clips WHERE clip_id::BIGINT % 4 = 0) WHERE p < 20) GROUP BY clip_id)""")
def o04(spark, sf_dir, c):
    from pyspark.sql import Window

    n = F.col("clip_id").cast("long")
    one = lambda k, m: c.filter(n % m == 0).select(F.lit(k).alias("list_no"), "clip_id", (F.row_number().over(Window.orderBy(n)) - 1).alias("pos"))
    return sets.combine_searches(one(0, 3).unionByName(one(1, 4)), "union", 2, 20).withColumn("ord", F.col("ord").cast("long"))


@query("o05_combine_classifiers", "scores", "SELECT clip_id, count(*) AS n_hits FROM scores WHERE (run_id = 'run0' AND p > 0.5::DOUBLE) OR (run_id = 'run1' AND p > 0.8::DOUBLE) GROUP BY clip_id HAVING count(*) = 2")
def o05(spark, sf_dir, s):
    return sets.combine_classifiers(s, {"run0": 0.5, "run1": 0.8})


@query("o06_score_vectors", "scores", "SELECT clip_id, round(avg(p), 6) AS aggregate, count(*) AS n FROM scores GROUP BY clip_id")
def o06(spark, sf_dir, s):
    v = sets.score_vectors(s.withColumnsRenamed({"run_id": "dimension", "p": "score"}))
    return v.select("clip_id", F.round("aggregate", 6).alias("aggregate"), F.size("scores").cast("long").alias("n"))


@query("o07_presence_vectors", "scores", "SELECT clip_id, run_id AS dimension, CASE WHEN clip_id::BIGINT < 20 THEN p ELSE 1.0::DOUBLE END AS score FROM scores")
def o07(spark, sf_dir, s):
    x = s.withColumnsRenamed({"run_id": "dimension", "p": "score"})
    return sets.presence_vectors(x.select("clip_id", "dimension", F.col("clip_id").cast("long").alias("pos")), x)


@query("o09_merge_scored", "scores", "SELECT clip_id, run_id AS dimension, greatest(max(v), 0) AS score FROM (SELECT clip_id, run_id, p - 0.5::DOUBLE AS v FROM scores UNION ALL SELECT clip_id, run_id, p / 4 - 0.2::DOUBLE FROM scores) GROUP BY ALL")
def o09(spark, sf_dir, s):
    one = lambda e: s.select("clip_id", F.col("run_id").alias("dimension"), F.expr(e).alias("score"))
    return sets.merge_scored(one("p - 0.5D"), one("p / 4 - 0.2D"))


_TOK = r"regexp_extract_all(lower(string_agg(caption, ' ' ORDER BY uid)), '[\p{L}\p{N}]+')"


_INDEXES = {}


def _index(spark, captions):
    """The index of these captions, written once a session for each table."""
    key = (spark.sparkContext.applicationId, tuple(captions.inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = path = workdir(spark, "text-index")
        text.save_index(captions, path)
    return text.open_index(spark, _INDEXES[key])


@query("t02_phrase_match", "captions", rf"SELECT clip_id FROM (SELECT clip_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS d FROM captions GROUP BY clip_id) WHERE (contains(d, ' of the ') OR contains(d, ' und ')) AND NOT contains(d, ' with ')")
def t02(spark, sf_dir, c):
    return text.search(*_index(spark, c), text.parse('"of the" NOT with OR und NOT with'), limit=None).select("clip_id")


@query("t03_bm25", "captions", rf"""SELECT clip_id, round(greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / avglen)) + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len / avglen)), 6) AS bm25 FROM (
  SELECT *, count(*) OVER ()::DOUBLE AS n, avg(len) OVER () AS avglen, (count(*) FILTER (f1 > 0) OVER ())::DOUBLE AS d1, (count(*) FILTER (f2 > 0) OVER ())::DOUBLE AS d2 FROM (
  SELECT clip_id, length(t)::DOUBLE AS len, length(list_filter(t, lambda x: x = 'tion'))::DOUBLE AS f1, length(list_filter(range(1, length(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'))::DOUBLE AS f2 FROM (SELECT clip_id, {_TOK} AS t FROM captions GROUP BY clip_id))) WHERE f1 > 0 OR f2 > 0""")
def t03(spark, sf_dir, c):
    r = text.search(*_index(spark, c), text.parse_any(["tion", '"of the"', "tion"]), limit=None)
    return r.select("clip_id", F.round("bm25", 6).alias("bm25"))


@query("t04_text_in_sources", "captions", rf"SELECT clip_id FROM (SELECT clip_id, min(data_source) AS s, ' ' || array_to_string({_TOK}, ' ') || ' ' AS d FROM captions GROUP BY clip_id) WHERE s IN ('src1', 'src2', 'src3') AND contains(d, ' the ')")
def t04(spark, sf_dir, c):
    return text.search(*_index(spark, c), text.parse("the"), ["SRC-1", "src2", "src 3"], limit=None).select("clip_id")


@query("t07_update_index", "captions", rf"SELECT term, clip_id, count(*) AS tf FROM (SELECT clip_id, unnest({_TOK}) AS term FROM captions GROUP BY clip_id) GROUP BY ALL")
def t07(spark, sf_dir, c):
    """The index of the first two turns of all clips, updated where more turns came."""
    changed = c.filter("uid % 100 >= 2").select("clip_id").distinct()
    return text.update_index(text.build_index(c.filter("uid % 100 < 2")), c, changed).select("term", "clip_id", F.size("positions").cast("long").alias("tf"))


@query("t08_captions_by_model", "captions", "SELECT clip_id, model_name, count(*) AS n, first(caption ORDER BY start_time, uid) AS first_caption FROM captions GROUP BY clip_id, model_name")
def t08(spark, sf_dir, c):
    return text.captions_by_model(c).select("clip_id", "model_name", F.size("captions").cast("long").alias("n"), F.col("captions")[0]["caption"].alias("first_caption"))


@query("w02_priority_rank", "clips annotations scores", """SELECT clip_id, rank_score FROM (SELECT c.clip_id, -max(a.value) AS rank_score FROM clips c JOIN annotations a USING (clip_id) JOIN scores s ON s.clip_id = c.clip_id AND s.run_id = 'run2' AND s.p > 0.4::DOUBLE
  WHERE a.key = 'n_chars' AND a.value BETWEEN 100 AND 5000 GROUP BY c.clip_id)""")
def w02(spark, sf_dir, c, a, s):
    e = Engine(Catalog(c, c, a, classifier_scores=s))
    f = SearchFilters(numeric_filter=[NumericFilter("n_chars", 100, 5000, "asc")], classifier_run_id="run2", probability_expression="p > 0.4", project_source=["p0", "p1"])
    return e.search(f).select("clip_id", "rank_score")


@query("w01_reciprocal_rank", "clips annotations scores", """SELECT clip_id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY v DESC, clip_id)) + 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY p DESC, clip_id)), 9) AS rank_score FROM (
  SELECT c.clip_id, max(a.value) AS v, max(s.p) AS p FROM clips c JOIN annotations a USING (clip_id) JOIN scores s ON s.clip_id = c.clip_id AND s.run_id = 'run2' AND s.p > 0.4::DOUBLE WHERE a.key = 'n_chars' AND a.value BETWEEN 100 AND 5000 GROUP BY c.clip_id)""")
def w01(spark, sf_dir, c, a, s):
    e = Engine(Catalog(c, c, a, classifier_scores=s))
    f = SearchFilters(numeric_filter=[NumericFilter("n_chars", 100, 5000)], classifier_run_id="run2", probability_expression="p > 0.4", project_source=["p0", "p1"], rank_mode="rrf")
    return e.search(f).select("clip_id", F.round("rank_score", 9).alias("rank_score"))


@query("j01_hydrate_page", "clips video_paths annotations", """SELECT clip_id, data_source, (SELECT count(*) FROM annotations a WHERE a.clip_id = p.clip_id AND project = 'p0') AS n FROM
  (SELECT clip_id, data_source FROM clips WHERE country = 'EN' AND clip_id IN (SELECT clip_id FROM video_paths) ORDER BY clip_id LIMIT 10 OFFSET 10) p""")
def j01(spark, sf_dir, c, v, a):
    from ..plans.engine import hydrate, page

    cat = Catalog(c, v, a)
    r = page(Engine(cat).search(SearchFilters(search_country="EN")), 10, 1)
    return hydrate(r, cat, ["p0"]).select("clip_id", "data_source", F.size("annotations").cast("long").alias("n"))
