"""What goes through the joins that confirm links."""

import numpy as np
from pyspark.sql import functions as F

from cliploom.llm import minhash


def test_only_classes_within_reach_are_joined(spark, monkeypatch):
    """Sets and signatures that links are confirmed on are written tables of the classes that a link can reach, by numbers instead of digests."""
    r = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 1 << 40, n))
    one, other, start = text(200), text(200), text(30)
    rows = [(1, one), (2, f"{one} end"), (3, other), (4, f"{other} end"), *((10 + i, f"{start} {text(170)}") for i in range(6))]
    seen, confirm = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda p, sigs, sets, *a: seen.append((sigs, sets, sigs.count(), sets.count())) or confirm(p, sigs, sets, *a))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: c for k, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3} | {10 + i: 10 + i for i in range(6)} and got[2][0] == 197
    for sigs, sets, n, m in seen:
        assert n == m == 4
        assert dict(sigs.dtypes)["c"] == dict(sets.dtypes)["c"] == "bigint"
        assert sigs.inputFiles() and sigs.select(F.col("c")).schema["c"].dataType.typeName() == "long"
