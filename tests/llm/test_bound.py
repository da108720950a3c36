"""The bound that spares the residual comparison of near-duplicates its pairs never drops a link."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import neardup


def test_bound_keeps_every_link(spark):
    rng = np.random.default_rng(5)
    rows, true = [], {}
    for i in range(120):
        n = int(rng.choice([1, 5, 60, 150, 3000]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        swapped = int(len(a) * rng.choice([0, 0.05, 0.1, 0.11, 0.12, 0.3]))
        b = np.unique(np.concatenate([a[swapped:], rng.integers(0, 1 << 63, swapped).astype(np.uint64)]))
        own = [np.setdiff1d(x, y) for x, y in ((a, b), (b, a))] if i % 2 else [a[:0], b[:0]]
        sides = []
        for s, o in zip((a, b), own, strict=True):
            rest = np.setdiff1d(s, o)
            sides += [len(s), len(rest), *neardup.bitmap(rest).tolist()]
        rows.append((i, *sides))
        true[i] = neardup.jaccard_at_least(a, b)
    names = ["i", *(f"{x}{c}" for x in "ab" for c in ("n", "shared", *(f"m{k}" for k in range(neardup.BITMAP))))]
    may = dict(spark.createDataFrame(rows, names).select("i", neardup._may_link("a", "b").alias("may")).collect())
    assert all(may[i] for i in true if true[i])
    assert any(true.values()) and not all(may.values())


def test_shared_shingles_and_owners(spark):
    texts = [(1, "a b c d e"), (2, "b c d e f"), (3, "x y z w v")]
    held = spark.createDataFrame(texts, "id long, text string")
    got = held.mapInArrow(neardup._owners(4), "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    assert sorted((r.lo, r.hi) for r in got.collect()) == [(1, 1), (1, 2), (2, 2), (3, 3), (3, 3)]
