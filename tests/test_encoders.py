import numpy as np
import pandas as pd  # noqa: F401
from pyspark.sql import functions as F

from cliploom.functions.encoders import HashingEncoder, judge, propose
from cliploom.functions.scalars import llm_json


def test_hashing_encoder():
    e = HashingEncoder(64)
    a, b, c, z = e(["red car turns", "red car stops", "blue sky", ""])
    assert a @ b > a @ c and abs(np.linalg.norm(a) - 1) < 1e-6 and not z.any() and e.one("red car turns") == a.tolist()


def test_propose_and_judge(spark):
    m = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b""))], "clip_id string, content binary")
    views = lambda data: [("full", [0, 0, 1, 1], np.ones(2))] + [(f"v{i}", [0, 0, i, i], np.zeros(2)) for i, _ in enumerate(data)]
    assert sorted((r.clip_id, r.view) for r in propose(m, views).collect()) == [("a", "full"), ("a", "v0"), ("a", "v1"), ("b", "full")]
    assert propose(m, views, full=False).count() == 2
    j = judge(m.select("clip_id"), lambda row: '```json {"score": 7}```' if row["clip_id"] == "a" else 1 / 0)
    assert {r.clip_id: r.x for r in j.select("clip_id", llm_json(F.col("answer")).alias("x")).collect()} == {"a": '{"score": 7}', "b": "{}"}
