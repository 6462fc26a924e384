import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliploom.model import schema
from cliploom.operators import arena, clusters, evaluation, labels, logs, mutations, text, trajectory, vector_search, windows
from cliploom.plans.client import Client
from cliploom.plans.engine import Catalog, Engine, page
from cliploom.plans.filters import NumericFilter, SearchFilters


@pytest.fixture(scope="module")
def catalog(spark):
    clips = spark.createDataFrame([(f"c{i}", "src-A" if i < 5 else "src-B", ["DE", "DE", "DE", "DE", "US", "US", "US", "FR", "FR", "GB"][i]) for i in range(10)], schema("clips"))
    marks = [("c0", "turn_left"), ("c1", "turn_left"), ("c5", "turn_left"), ("c0", "brake"), ("c2", "brake"), ("c6", "brake"), ("c3", "turn_right"), ("c7", "turn_right")]
    ann = [(f"u{k}", "proj-A", c, key, None, -1.0, -1.0, "manual") for k, (c, key) in enumerate(marks)]
    ann.append(("n", "proj-A", "c8", "speed", 3.0, -1.0, -1.0, "numeric"))
    scores = spark.createDataFrame([("r", f"c{i}", (i + 1) / 10) for i in range(10)], schema("classifier_scores"))
    assign = spark.createDataFrame([("run", f"c{i}", i % 2, float(i)) for i in range(10)], schema("cluster_assignments"))
    caps = spark.createDataFrame([(i, f"c{i}", "m", "a red car turns left" if i < 4 else "left turns the car red", "src-A" if i < 5 else "src-B", 0.0, 1.0) for i in range(10)], schema("captions"))
    return Catalog(clips, clips.select("clip_id"), spark.createDataFrame(ann, schema("annotations")), caps, classifier_scores=scores, assignments=assign)


@pytest.mark.parametrize(
    ("query", "n"),
    [
        ({}, 10), ({"data_source": ["src-A"]}, 5), ({"filter": ["turn_left"]}, 3), ({"data_source": ["src-A"], "filter": ["turn_left"]}, 2),
        ({"filter": ["turn_left", "brake"]}, 5), ({"filter": ["turn_left", "brake"], "filter_mode": "all"}, 1), ({"filter": ["turn_left", "turn_right"], "filter_mode": "all"}, 0),
        ({"without_ann": True}, 3), ({"without_ann": False, "filter": ["brake"]}, 10), ({"labels_to_exclude": ["brake"]}, 7), ({"search_country": "DE"}, 4), ({"left_hand_driving": True}, 1),
        ({"search": '"red car"'}, 4), ({"search": "red car"}, 4), ({"search": "red AND car"}, 10), ({"search": "red NOT turns-left"}, 6), ({"search": "nothing OR left"}, 10),
        ({"classifier_run_id": "r", "probability_expression": "p > 0.5"}, 5), ({"classifier_run_id": "x", "probability_expression": "p > 0.5"}, 0),
        ({"cluster_run_id": "run", "cluster_ids": [1]}, 5), ({"cluster_run_id": "run", "cluster_ids": [9]}, 10), ({"numeric_filter": [NumericFilter("speed", 3, 3)]}, 1), ({"clip_id_list_hash": "nope"}, 0), ({"times": True}, 0),
    ],
)
def test_search(spark, catalog, query, n):
    catalog.clip_lists = spark.createDataFrame([], schema("clip_lists"))
    assert len(Client(Engine(catalog)).search(project_source=["proj-A"], **query).clip_ids) == n


def test_grants_order_and_pages(catalog):
    e = Engine(catalog)
    assert Client(e, granted=["src-B"]).search(data_source=["src-A"], project_source=["proj-A"]).clip_ids == []
    r = Client(e).search_classifier("r", "p > 0.3", project_source=["proj-A"])
    assert r.clip_ids == [f"c{i}" for i in range(9, 2, -1)]
    assert [x.clip_id for x in page(r.rows, 3, 1).collect()] == ["c6", "c5", "c4"]
    assert r.as_dataframe().head().best_score == 1.0


def test_filter_object():
    f = SearchFilters.from_kwargs(filter=["b", "a"], cluster_ids=[3, 4], times=True, wm_max_dist=2.5, search_country=None)
    assert (f.filter, f.cluster_ids, f.times, f.wm_max_dist) == (["b", "a"], [3, 4], True, 2.5)
    assert f.key() == SearchFilters.from_kwargs(filter=["a", "b"], cluster_ids=[4, 3], times=True, wm_max_dist=2.5).key()
    assert SearchFilters.from_url("http://h/p?filter=a%7C%7Cb&numeric_filter=k,1,2,asc&wm_min_count=x") == SearchFilters(filter=["a", "b"], numeric_filter=[NumericFilter("k", 1, 2, "asc")])
    assert SearchFilters(numeric_filter=[NumericFilter("k", 1, 2)]).has_prior_filters("search")
    assert not SearchFilters(semantic_text="x").has_prior_filters("semantic_text")


def test_query_parser():
    assert text.sanitize('red car and "big dog" stop-sign') == ['"red car"', "AND", '"big dog"', '"stop sign"']
    assert text.parse("NOT") is None and text.parse("a OR OR b").op == "or"
    assert text.normalize_rewrite("Lane change of the") == "lane change"
    assert text.decompose("a car turning while the pedestrian is crossing") == ["car turning", "pedestrian crossing"]
    assert text.decompose("car") is None


def test_glicko_example():
    """The worked example of Glickman (2013) has three games in one period; one game each way must move as the formulas say."""
    r, rd, vol = arena.glicko2((1500.0, 200.0, 0.06), (1400.0, 30.0, 0.06), 1.0)
    assert 1560 < r < 1567 and 173 < rd < 178 and abs(vol - 0.06) < 1e-4
    a, b = arena.glicko2((1500, 350, 0.06), (1500, 350, 0.06), 0.5), arena.glicko2((1500, 350, 0.06), (1500, 350, 0.06), 1.0)
    assert a[0] == pytest.approx(1500) and b[0] > 1500 and b[1] < 350


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    v = spark.createDataFrame([(i, f"c{i}", [float(x) for x in p]) for i, p in enumerate(pts)], schema("vectors"))
    sse = [clusters.sum_of_squares(clusters.fit(v, k)[0]) for k in (2, 3)]
    assert sse[1] < sse[0] / 20
    a, c = clusters.fit(v, 3)
    assert c.count() == 3 and a.groupBy("cluster_id").count().select(F.min("count")).head()[0] == 40


def test_cells_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, f"c{i}", [float(z) for z in p]) for i, p in enumerate(x)], schema("vectors"))
    c = v.filter("row_id < 10").select(F.col("row_id").cast("int").alias("cluster_id"), "vec")
    celled = vector_search.assign_cells(v, c)
    exact = vector_search.knn(v, x[17].tolist(), 10)
    assert vector_search.recall(exact, vector_search.search_cells(celled, c, x[17].tolist(), 10, 10)) == 1.0
    assert vector_search.recall(exact, vector_search.search_cells(celled, c, x[17].tolist(), 10, 4)) >= 0.4
    assert exact.head().clip_id == "c17"
    assert math.isnan(vector_search.recall(exact.limit(0), exact))


def test_trajectory_shape(spark):
    frames = lambda k: [(float(t), float(t * k), 0.0, 1.0, 0.0, 0.0, 0.0) for t in range(605)]
    t = spark.createDataFrame([("a", frames(1)), ("b", frames(1.01)), ("c", frames(3))], schema("trajectories"))
    assert [r.clip_id for r in trajectory.by_shape(t, "a", 3).collect()] == ["a", "b", "c"]
    assert trajectory.by_shape(t, "nope", 3).count() == 0
    assert [r.clip_id for r in trajectory.by_shape(t, "a", 2, 5.0, 10.0).collect()] == ["a", "b"]
    assert (trajectory.window_tag(0, 6), trajectory.window_tag(0, 15), trajectory.window_tag(None, None)) == ("5s", "10s", "full")


def test_savitzky_golay_keeps_cubics(spark):
    d = spark.createDataFrame([("k", float(t), float(t**3 - 2 * t)) for t in range(30)], "k string, t double, v double")
    assert all(abs(r.s - r.v) < 1e-6 for r in windows.savitzky_golay(d, ["k"], "t", "v", "s").collect())


def test_diverse_windows(spark):
    c = spark.createDataFrame([("v", 0.0, 10.0, "x y", "go"), ("v", 5.0, 15.0, "x y", "stop"), ("v", 20.0, 30.0, "x y", "go"), ("v", 40.0, 50.0, "p q", "go")], "video_id string, a double, b double, cap string, cmd string")
    got = windows.diverse(c, 3).orderBy("pick").collect()
    assert got[0].cmd == "stop" and all(x.b <= y.a or y.b <= x.a for i, x in enumerate(got) for y in got[:i])


def test_logs(spark):
    lines = ['2024-01-02 03:04:05,678 [user=ann] "GET /videos?search=a%20b HTTP/1.1" 200', "2024-01-02 03:04:06,000 k=1 → 0 results in 1.5 s", "2024-01-03T00:00:00,000 Autolabelled 12 clips with label x y for project p took 2.0", "", "garbage"]
    r = logs.parse(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("ts").collect()
    assert [x.kind for x in r] == ["http", "search", "autolabel"] and (r[0].user, r[0].code, r[1]["count"], r[1].sec, r[2].label) == ("ann", 200, 0, 1.5, "x y")


def test_mutations_keep_the_rest(spark, catalog):
    a = catalog.annotations
    assert mutations.add_many(a, a.withColumn("uid", F.concat(F.lit("z"), "uid"))).count() == a.count()
    assert mutations.granted(mutations.set_grants(spark.createDataFrame([("u", "s")], schema("grants")), "u", ["b", "a", "a"]), "u") == ["a", "b"]
    assert labels.allowed_sources([], None) is None and labels.allowed_sources(["x"], ["y"]) == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=2, max_size=8), st.integers(0, 7))
def test_tied_ranks(spark, scores, at):
    at %= len(scores)
    s = spark.createDataFrame([("q", f"c{i}", float(x)) for i, x in enumerate(scores)], "query_id string, clip_id string, score double")
    got = evaluation.truth_ranks(s, spark.createDataFrame([("q", f"c{at}")], "query_id string, clip_id string")).head().rank
    assert got == sum(x > scores[at] for x in scores) + 1 + (sum(x == scores[at] for x in scores) - 1) / 2


def test_caption_scores():
    r = "a red car turns left at the light"
    assert evaluation.bleu(r, r) == pytest.approx(1) and evaluation.rouge_l(r, r) == 1 and evaluation.rouge_n(r, "x", 1) == 0
    assert 0.99 < evaluation.meteor(r, r) <= 1 and evaluation.meteor(r, "") == 0 and evaluation.bleu("", r) == 0
    assert evaluation.rouge_l("a b c d", "a c d") == pytest.approx(6 / 7)
