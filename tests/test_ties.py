"""Rows of equal times or scores."""

import math

from cliploom.operators import block_join, joins, vector_index, vector_search, windows
from cliploom.sources import writers


def test_gradient_of_equal_times(spark):
    """A step of no length gives an infinity or NaN, as numbers do, and no error."""
    rows = [(1, "a", 0.0, 1.0), (2, "a", 0.0, 3.0), (3, "b", 0.0, 1.0), (4, "b", 1.0, 2.0), (5, "b", 1.0, 2.0), (6, "c", 0.0, 9.0)]
    d = spark.createDataFrame(rows, "id int, k string, t double, v double")
    got = {r.id: r.dv for r in windows.gradients(d, ["k"], "t", "v", "dv", ["id"]).collect()}
    assert got[1] == got[2] == math.inf and got[3] == 1.0 and math.isnan(got[4]) and math.isnan(got[5]) and got[6] is None


def _ticks(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, t long, v double")


def test_nearest_of_equal_times(spark):
    """Of right rows at one time the smallest id counts, whatever order they come in, before and after the left row."""
    left = _ticks(spark, [(1, "a", 10, 0.0), (2, "a", 30, 0.0)]).select("id", "k", "t")
    right = [(9, "a", 8, 1.0), (7, "a", 8, 5.0), (8, "a", 8, 3.0), (6, "a", 31, 2.0), (4, "a", 31, 9.0), (5, "a", 31, 4.0)]
    for rows in (right, right[::-1], sorted(right)):
        r = _ticks(spark, rows).coalesce(1)
        got = {x.id: x.v for x in joins.nearest(left, r, ["k"], "t", 50, ["v"], "id").collect()}
        assert got == {1: 5.0, 2: 9.0}
        assert {x.id: x.v for x in joins.nearest(left, r, ["k"], "t", 50, ["v"]).collect()} == {1: 1.0, 2: 2.0}


def test_interpolation_between_equal_times(spark):
    """The largest sample of the time before and the smallest of the time after."""
    left = _ticks(spark, [(1, "a", 10, 0.0), (2, "a", 8, 0.0), (3, "a", 12, 0.0)]).select("id", "k", "t")
    right = [(0, "a", 8, 1.0), (0, "a", 8, 5.0), (0, "a", 8, 3.0), (0, "a", 12, 9.0), (0, "a", 12, 7.0), (0, "a", 12, 8.0)]
    for rows in (right, right[::-1], sorted(right)):
        got = {x.id: x.v for x in joins.interpolate(left, _ticks(spark, rows).coalesce(1), ["k"], "t", ["v"]).collect()}
        assert got == {1: 6.0, 2: 5.0, 3: 9.0}


def test_large_exports_are_whole(spark):
    """Without sizes to keep to, an export of more clips than a browser takes has its annotations."""
    from cliploom.model import schema

    c = spark.range(10_001).selectExpr("cast(id as string) as clip_id", "'s' as data_source", "'ES' as country")
    a = spark.createDataFrame([("u", "p", "7", "k", None, -1.0, -1.0, "manual")], schema("annotations"))
    got = writers.search_export(c.select("clip_id"), c, a)
    assert got.count() == 10_001 and [r.key for r in got.filter("key is not null").collect()] == ["k"]


def test_clips_by_scores_of_nine_places(spark):
    """Rows whose scores differ beyond the ninth place go by row."""
    v = spark.createDataFrame([(0, "q", [1.0, 0.0]), (1, "a", [0.5, 0.3]), (2, "b", [0.5 + 1e-11, 0.1]), (3, "c", [0.5 - 1e-11, 0.2])], "row_id long, clip_id string, vec array<double>")
    for n in (-1, 3):
        got = vector_search.clip_neighbours(v, spark.createDataFrame([("q",)], "clip_id string"), n).orderBy("rank").collect()
        assert [r.row_id for r in got] == [0, 1, 2, 3][: n if n > 0 else 4]


def test_all_pairs_in_small_blocks(spark, monkeypatch):
    """Every pair once, in blocks of bounded size, without a merge by pairs; a clip of very many rows is dealt row by row."""
    monkeypatch.setattr(block_join, "PAIR_ROWS", 8)
    v = spark.range(60).selectExpr("id as row_id", "concat('c', id % 25) as clip_id", "array(id / 7.0D, (id * id) % 11 + 0.0D) as vec")
    q = v.filter("row_id % 10 = 0").selectExpr("cast(row_id as string) as query_id", "vec")
    rows = {r.row_id: r for r in v.collect()}
    want = {(str(i), f"c{c}"): max(sum(a * b for a, b in zip(rows[i].vec, r.vec, strict=True)) for r in rows.values() if r.clip_id == f"c{c}") for i in range(0, 60, 10) for c in range(25)}
    for most in (16_384, 2):
        monkeypatch.setattr(block_join, "ROWS", most)
        s = block_join.similarities(v, q)
        got = {(r.query_id, r.clip_id): r.score for r in s.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and s.count() == len(want)
        assert ("max(score" in s._jdf.queryExecution().toString()) == (most == 2)


def test_index_judges_rows_where_they_are(spark, tmp_path):
    """Whatever is judged again, a row's vector meets its slice's queries once: no join by query and row."""
    v = spark.range(400).selectExpr("id as row_id", "concat('c', id % 150) as clip_id", "transform(sequence(0, 7), i -> cast(sin(id * (i + 1)) as float)) as vec")
    q = v.filter("row_id % 40 = 0").selectExpr("cast(row_id as string) as query_id", "vec")
    found = vector_index.build(v, str(tmp_path / "i"), cells=4, parts=4, rounds=3).search(q, 5, 4, 80)
    exact = block_join.similarities(v, q, 5)
    as_rows = lambda d: {(r.query_id, r["rank"]): (r.clip_id, round(r.score, 9)) for r in d.collect()}
    assert as_rows(found) == as_rows(exact) and "Join" not in found._jdf.queryExecution().executedPlan().toString()
