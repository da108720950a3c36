"""Steps whose shuffled rows and memory grow no faster than their input."""

import numpy as np
import pytest

from gridloom.operators import kernels, match, stencil


def records(spark):
    """Records that all stages up to now have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def plain_matches(a, b, reach, penalty):
    def cost(p, q):
        d2 = sum((s - t) * (s - t) for s, t in zip(p[1:4], q[1:4], strict=True))
        if d2 > reach**2:
            return None
        v, w = p[4], q[4]
        return d2 + (penalty**2 if v is not None and w is not None and abs(v - w) / max((v + w) / 2, 1e-12) > 0.5 else 0.0)

    met = [(cost(p, q), p[0], q[0]) for p in a for q in b]
    met = [m for m in met if m[0] is not None]
    best_a, best_b = {}, {}
    for c, i, j in met:
        best_a[i] = min(best_a.get(i, (c, j)), (c, j))
        best_b[j] = min(best_b.get(j, (c, i)), (c, i))
    return {i: (j, round(c**0.5, 9), best_b[j] == (c, i)) for i, (c, j) in best_a.items()}


@pytest.mark.parametrize("penalty", [5000.0, 0.1])
def test_frame_matches_through_all_cells(spark, monkeypatch, penalty):
    """Clusters, lattices with ties, copies, far points, volumes of all sizes and null: as all pairs give it."""
    monkeypatch.setattr(match, "ALL_PAIRS", 0)
    monkeypatch.setattr(match, "CELL_OBJECTS", 1)
    rng = np.random.default_rng(4)
    at = np.vstack([rng.normal(0, 0.1, (60, 3)), rng.normal(2, 0.01, (60, 3)), rng.integers(-2, 3, (60, 3)) / 8, np.tile([5.0, 5.0, 5.0], (20, 1)), [[1e9, 0, 0], [1e9, 0, 0], [-1e300, 0, 0], [-1e300, 0, 0]]])
    volumes = [None, 0.0, -1.0, 1.0, 1.6, 5 / 3, 2.0, 3.0, 40.0, 1e-13]
    rows = [(i, *map(float, p), volumes[v]) for i, (p, v) in enumerate(zip(at, rng.integers(0, 10, len(at)), strict=True))]
    a, b = rows[::2], rows[1::2]
    schema = "id long, x double, y double, z double, volume double"
    got = match.match_frames(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.3, penalty)
    assert {r.a: (r.b, round(r.match_dist, 9), r.bij_matched) for r in got.collect()} == plain_matches(a, b, 0.3, penalty)


def test_frame_matches_are_not_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *p, float(v)) for i, (p, v) in enumerate(zip(rng.normal(0, 0.1, (4000, 3)).tolist(), rng.integers(1, 4, 4000), strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, volume double").localCheckpoint()
    before = records(spark)
    got = match.match_frames(df.where("id % 2 = 0"), df.where("id % 2 = 1"), 0.3).collect()
    assert len(got) == 2000 and any(r.bij_matched for r in got) and not all(r.bij_matched for r in got)
    assert records(spark) - before < 100 * 4000


def sparse_image(spark, low, high, share):
    rng = np.random.default_rng(6)
    at = [p for p in np.ndindex(*[high - low] * 3) if rng.random() < share]
    rows = [(*(c + low for c in p), float(v)) for p, v in zip(at, rng.integers(0, 100, len(at)), strict=True)]
    return rows, spark.createDataFrame(rows, "x int, y int, z int, v double")


@pytest.mark.parametrize("large", [0, 1 << 40])
def test_stencils_across_blocks(spark, monkeypatch, large):
    """Holes, places below 0, offsets of one side only; blocks narrower than the kernel, and as wide."""
    monkeypatch.setattr(stencil, "LARGE", large)
    rows, df = sparse_image(spark, -5, 4, 0.6)
    at = {r[:3]: r[3] for r in rows}
    monkeypatch.setattr(stencil, "REACHES", 1)
    for block, offsets in ((1, kernels.full(2)), (3, kernels.full(1)), (2, [(3, 0, 0), (1, -1, 2), (0, 0, 0)]), (16, kernels.full(1))):
        monkeypatch.setattr(stencil, "BLOCK", block)
        out = stencil.stencil(df, offsets, n=stencil.F.count("*"), s=stencil.F.sum(stencil.F.col("v") * (stencil.F.col("dx") + 2 * stencil.F.col("dy") + 5)))
        got = {(r.x, r.y, r.z): (r.n, r.s) for r in out.collect()}
        assert out.columns == ["x", "y", "z", "n", "s"] and out.count() == len(rows)
        for p in at:
            near = [(d, at[q]) for d in offsets if (q := tuple(c + e for c, e in zip(p, d, strict=True))) in at]
            assert got[p] == (len(near), sum(v * (d[0] + 2 * d[1] + 5) for d, v in near))


def test_stencil_does_not_shuffle_its_scatter(spark):
    rows, df = sparse_image(spark, 0, 32, 0.9)
    df = df.repartition(4).localCheckpoint()
    before = records(spark)
    assert stencil.box_mean(df).agg(stencil.F.count("v")).first()[0] == len(rows)
    assert records(spark) - before < 2 * len(rows)
