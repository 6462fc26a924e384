"""Combined histories have every step."""

import math

import pytest

from cliploom.model import schema
from cliploom.operators import arena
from cliploom.queries import QUERIES, base


def mean(ratings):
    p = sum(1 / (1 + 10 ** ((1500 - r) / 400)) for r in ratings) / len(ratings)
    return 1500 + 400 * math.log10(p / (1 - p))


@pytest.mark.parametrize("run", [3, 10_000])
def test_combined_history_is_whole(spark, monkeypatch, run):
    """All steps of all models, through the query itself: more votes than a history of 200 points holds, and criteria of different lengths."""
    monkeypatch.setattr(arena, "RUN", run)
    rows = [(i, f"m{i}", f"ar{i % 2}", "i", f"x{i % 3}", f"x{(i + 1) % 3}", ["a", "b", "tie", "skip"][i * i % 7 % 4], "u", "c0" if i % 5 else "c1", i, 1) for i in range(2400)]
    points = {}
    for ar in ("ar0", "ar1"):
        for c in ("c0", "c1"):
            for a, sa, b, sb in arena.replay_votes([v[4:7] for v in rows if v[2] == ar and v[8] == c]):
                for m, s in ((a, sa), (b, sb)):
                    points.setdefault((ar, m), {}).setdefault(c, []).append(s[0])
    want = {(*k, i + 1): mean([p[min(i, len(p) - 1)] for p in by.values()]) for k, by in points.items() for i in range(max(map(len, by.values())))}
    monkeypatch.setitem(base.STANDINS, "votes", "SELECT * FROM all_votes")
    spark.createDataFrame(rows, schema("votes")).createOrReplaceTempView("all_votes")
    d = QUERIES["w13_combined_history"](spark, "")
    got = {(r.arena, r.model, r.step): r.rating for r in d.collect()}
    assert max(k[2] for k in want) > 400 and got.keys() == want.keys() and d.count() == len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
