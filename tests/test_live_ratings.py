"""Ratings of a stream against the replay, over several batches and restarts."""

import time

from cliploom.model import schema
from cliploom.operators import arena
from cliploom.streaming import incremental


def vote(i, match, criterion="c"):
    return (i, match, "ar", "i", f"x{i % 3}", f"x{(i + 1) % 3}", ["a", "b", "tie", "skip", "both_bad"][i % 5], "u", criterion, i, 1)


def drain(spark, tmp_path, keep_ms):
    """Everything new in the folder, a file a batch; the rows of the last update of each model and the state's size."""
    src = spark.readStream.schema(schema("votes")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    q = incremental.start_ratings(src, lambda d, n: d.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ck"), keep_ms)
    ended = q.awaitTermination(60)
    q.stop()
    assert ended and q.exception() is None
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    done = [p for p in q.recentProgress if p["stateOperators"]]
    return done[-1]["stateOperators"][0]["numRowsTotal"]


def add(spark, tmp_path, rows):
    spark.createDataFrame(rows, schema("votes")).coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))


def last(spark, tmp_path):
    out = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        k = (r.criterion, r.model)
        if k not in out or r.n > out[k][1]:
            out[k] = (round(r.rating, 6), r.n)
    return out


def want(spark, rows):
    return {(r.criterion, r.model): (round(r.rating, 6), r.n_votes) for r in arena.ratings(spark.createDataFrame(rows, schema("votes"))).collect()}


def test_batches_restarts_and_repetitions(spark, tmp_path):
    rows = [vote(i, f"m{i}", "cd"[i % 2]) for i in range(24)]
    for part in (rows[:10], rows[10:16]):
        add(spark, tmp_path, part)
    drain(spark, tmp_path, 3_600_000)
    assert last(spark, tmp_path) == want(spark, rows[:16])
    add(spark, tmp_path, [*rows[12:], vote(99, "m3", "d"), vote(100, "m23", "d")])  # again after a restart, and within a batch
    drain(spark, tmp_path, 3_600_000)
    assert last(spark, tmp_path) == want(spark, rows)


def test_state_stays_flat(spark, tmp_path):
    """Matches time out: after four times as many votes the state is no larger."""
    sizes = []
    for n in range(4):
        add(spark, tmp_path, [vote(i, f"m{i}") for i in range(200 * n, 200 * n + 200)])
        sizes.append(drain(spark, tmp_path, 1_000))
        time.sleep(1.5)
    assert max(sizes) <= sizes[0] + 10
    assert last(spark, tmp_path) == want(spark, [vote(i, f"m{i}") for i in range(800)])


def test_query_equals_ratings_of_all_votes(spark):
    from cliploom.queries import QUERIES

    pick = lambda d: {(r.arena, r.criterion, r.model): round(r.rating, 6) for r in d.collect()}
    got = pick(QUERIES["i05_live_ratings"](spark, "/root/testdata/sf0.001"))
    assert got and got == pick(QUERIES["w12_ratings"](spark, "/root/testdata/sf0.001"))
