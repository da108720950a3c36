"""Queries against their SQL in DuckDB on the smallest tables."""

import datetime

import pytest

from gridloom.plans import catalog

DIR = "/root/testdata/sf0.001"
NAMES = [
    "tiff_folder", "frames_from_names", "object_csv", "lattice_text", "streamed_frames", "session_windows", "late_events_dropped", "stream_deduplicated", "cogrouped", "numbered_rows", "histogram_buckets",
    "sampled_with_replacement", "pseudo_function_scan", "upserted_rows", "struct_fields", "derived_metrics", "region_growing", "hildebrand_thickness", "bubble_seeds", "watershed_growth", "close_image", "track_chains",
    "kmeans_centres", "flagship_analyze_phase", "laplace_filter_wide", "gray_analysis_full", "local_component_label", "observed_metrics",
]


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [plain(tuple(r)) for r in df.select(*columns).collect()]
    found = duck.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = [plain(tuple(r[i] for i in at)) for r in found.fetchall()]
    assert len(columns) == len(found.description) and sorted(got, key=str) == sorted(want, key=str) and got


def test_orientation_kmeans_finds_axes(spark):
    import numpy as np

    from gridloom.operators import match

    rng = np.random.default_rng(2)
    main = np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]) / np.array([[2**0.5], [1.0]])
    rows = [(main[i % 2] * (-1) ** (i // 2) + rng.normal(size=3) * 0.05).tolist() for i in range(300)]
    axes = match.orientation_kmeans(spark.createDataFrame(rows, "x double, y double, z double"), [[1, 0, 0], [0, 0.2, 1]], ["x", "y", "z"])
    assert all(max(abs(np.dot(a, m)) for a in axes) > 0.995 for m in main)


def test_hull_of_blocks_is_the_hull(spark, monkeypatch):
    import numpy as np

    from gridloom.operators import shape

    rng = np.random.default_rng(3)
    points = [(1, *map(int, p)) for p in rng.integers(0, 40, (400, 3))]
    df = spark.createDataFrame(points, "label long, x int, y int, z int")
    want = shape.hull(np.array([p[1:] for p in points]))
    for block in (64, 7):
        monkeypatch.setattr(shape, "HULL_BLOCK", block)
        r = shape.hulls(df).first()
        assert (r.area, r.hull_volume) == pytest.approx(want[:2])
