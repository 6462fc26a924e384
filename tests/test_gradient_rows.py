"""The gradient query against its SQL where digits and missing values matter."""

import math
from decimal import Decimal

import duckdb

from cliploom.queries import ORACLES, QUERIES, base


def test_gradient_agrees_with_sql(spark, monkeypatch):
    """A derivative whose product with 1e6 is a half but whose digits are below it, and a value that is missing between others."""
    rows = [(i, 1, 7 * i, v, "e") for i, v in enumerate([1.0, None, 4.0, 6.0, None])]
    halves = [math.nextafter((k + 0.5) / 1e6, 0) for k in range(300_000, 301_000)]
    halves = [x for x in halves if x * 1e6 % 1 == 0.5 and Decimal(repr(x)) * 10**6 % 1 < Decimal("0.5")][:200]
    for i, x in enumerate(halves):
        rows += [(10 + 2 * i, 10 + i, 0, 0.0, "e"), (11 + 2 * i, 10 + i, 1, x, "e")]
    monkeypatch.setitem(base.STANDINS, "ticks", "SELECT * FROM some_ticks")
    spark.createDataFrame(rows, "event_id long, user_id long, t long, v double, event_type string").createOrReplaceTempView("some_ticks")
    c = duckdb.connect()
    c.execute("create table some_ticks (event_id bigint, user_id bigint, t bigint, v double, event_type varchar)")
    c.executemany("insert into some_ticks values (?, ?, ?, ?, ?)", rows)
    sql = ORACLES["w10_gradient"]
    sql = "WITH ticks AS (SELECT * FROM some_ticks) " + sql[sql.index("\nSELECT event_id, round") :]
    got = {r.event_id: r.dv for r in QUERIES["w10_gradient"](spark, "").collect()}
    assert halves and got == dict(c.execute(sql).fetchall())
