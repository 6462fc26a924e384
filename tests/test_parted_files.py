"""Files that queries pack stay bounded as a table grows."""

from cliploom.queries import io as q


def test_files_of_bounded_rows(spark):
    d = spark.range(1000).selectExpr("cast(id as string) as clip_id", "concat('src', id % 2) as src", "'x' as text")
    n = q._parted(d, "src", "clip_id", 100).groupBy("at").count().collect()
    assert sum(r["count"] for r in n) == 1000 and max(r["count"] for r in n) <= 100 and {r["at"].rpartition("/")[2] for r in n} == {"src0", "src1"}
    assert {r["at"] for r in q._parted(d, "src", "clip_id", 1000).collect()} == {"0/src0", "0/src1"}
