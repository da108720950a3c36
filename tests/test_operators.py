"""Operators on analytic images with known values, and against plain versions."""

from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import sqlfn
from gridloom.operators import algebra, components, contour, grow, hist, kernels, match, pointwise, shape, stencil
from gridloom.plans import params, registry
from gridloom.sources import images, phantoms, tables
from gridloom.streaming import frames

KEYS = ["x", "y", "z"]


def voxels(df, value="v"):
    return {(r.x, r.y, r.z): r[value] for r in df.collect()}


def image(spark, array):
    rows = [(int(x), int(y), int(z), float(array[x, y, z])) for x, y, z in np.ndindex(array.shape)]
    return spark.createDataFrame(rows, "x int, y int, z int, v double")


def noise(seed=3, shape_=(6, 5, 4)):
    return np.random.default_rng(seed).integers(0, 100, shape_).astype(float)


def test_kernels():
    assert len(kernels.full()) == 27 and len(kernels.cross()) == 7 and len(kernels.cross(2)) == 13
    assert len(kernels.sphere(1)) == 7 and len(kernels.sphere(1.5)) == 19
    assert len(kernels.forward(kernels.full())) == 13


def test_lines_have_known_components(spark):
    lines = phantoms.grid(spark, (10, 10, 10), phantoms.lines())
    split = components.label(lines, (10, 10, 10), kernels.sphere(1.0)).groupBy("label").count().collect()
    assert len(split) == 50 and {r["count"] for r in split} == {10}
    joined = components.label(lines, (10, 10, 10), kernels.sphere(1.42)).groupBy("label").count().collect()
    assert [r["count"] for r in joined] == [500]


def test_labels_match_flood_fill(spark):
    a = noise(5, (7, 7, 7)) > 60
    got = voxels(components.label(image(spark, a).withColumn("v", F.col("v") > 0), a.shape, kernels.cross()), "label")
    seen = {}
    for start in zip(*np.nonzero(a.transpose(2, 1, 0))):  # in linear index order
        z, y, x = map(int, start)
        if (x, y, z) in seen:
            continue
        stack, name = [(x, y, z)], 1 + x + 7 * (y + 7 * z)
        seen[(x, y, z)] = name
        while stack:
            p = stack.pop()
            for d in kernels.cross():
                q = tuple(c + e for c, e in zip(p, d, strict=True))
                if all(0 <= c < 7 for c in q) and a[q] and q not in seen:
                    seen[q] = name
                    stack.append(q)
    assert got == seen


def test_layered_shape(spark):
    layers = phantoms.grid(spark, (12, 6, 6), phantoms.layered("x", 2)).where("v")
    labels = layers.select(*KEYS, (F.floor(F.col("x") / 4) + 1).cast("long").alias("label"))
    rows = shape.shape_analysis(labels).orderBy("lacuna_number").collect()
    assert [r.volume for r in rows] == [72.0] * 3
    assert rows[0].pos_x == 0.5 and rows[0].proj_x == 1.0 and rows[0].std_x == 0.5
    assert rows[0].pca3_s == pytest.approx(0.5)


def test_two_voxel_object(spark):
    df = spark.createDataFrame([(0, 1, 1, 107), (1, 1, 2, 107)], "x int, y int, z int, label long")
    (r,) = shape.shape_analysis(df).collect()
    assert (r.pos_x, r.pos_y, r.pos_z, r.std_x) == (0.5, 1.0, 1.5, 0.5)


def test_closed_form_eigenvalues(spark):
    rng = np.random.default_rng(1)
    m = [(lambda a: a @ a.T)(rng.normal(size=(3, 3))) for _ in range(20)] + [np.eye(3), np.zeros((3, 3)), np.diag([2.0, 2.0, 1.0])]
    df = spark.createDataFrame([(float(a[0, 0]), float(a[1, 1]), float(a[2, 2]), float(a[0, 1]), float(a[0, 2]), float(a[1, 2])) for a in m], "cxx double, cyy double, czz double, cxy double, cxz double, cyz double")
    got = df.select(*shape.eigenvalues()).collect()
    for a, r in zip(m, got, strict=True):
        assert np.allclose(sorted(np.linalg.eigvalsh(a)), sorted(r), atol=1e-9)


def near(a, p, offsets):
    for d in offsets:
        q = tuple(c + e for c, e in zip(p, d, strict=True))
        if all(0 <= c < n for c, n in zip(q, a.shape, strict=True)):
            yield d, a[q]


@pytest.mark.parametrize("name", ["gaussian", "separable", "median", "laplace", "box"])
def test_filters_against_loops(spark, name):
    a = noise()
    df = image(spark, a)
    got = voxels({"gaussian": lambda: stencil.gaussian(df, 1, 1.5), "separable": lambda: stencil.gaussian(df, 1, 1.5, separable=True), "median": lambda: stencil.median(df), "laplace": lambda: stencil.laplace(df), "box": lambda: stencil.box_mean(df)}[name]())
    assert len(got) == a.size
    for p in np.ndindex(a.shape):
        n = list(near(a, p, kernels.full()))
        v = np.array([x for _, x in n])
        w = np.array([stencil.gaussian_weight(d, 1.5) for d, _ in n])
        edge = np.array([sum(map(abs, d)) > 0 for d, _ in n])
        want = {"gaussian": (w * v).sum() / w.sum(), "separable": (w * v).sum() / w.sum(), "median": np.median(v), "laplace": abs(v[edge].mean() - v[~edge].mean()), "box": v.mean()}[name]
        assert got[p] == pytest.approx(want)


def test_morphology_duality(spark):
    a = noise(9) > 50
    df = image(spark, a).withColumn("v", F.col("v") > 0)
    flipped = df.withColumn("v", ~F.col("v"))
    assert voxels(stencil.dilate(df)) == {k: not v for k, v in voxels(stencil.erode(flipped)).items()}
    opened, closed, base = voxels(stencil.opening(df, kernels.cross())), voxels(stencil.closing(df, kernels.cross())), voxels(df)
    assert all(base[k] or not v for k, v in opened.items()) and all(closed[k] or not v for k, v in base.items())


def test_feature_vectors_and_layouts(spark):
    a = noise()
    df = image(spark, a)
    f = {(r.x, r.y, r.z): r.features for r in stencil.feature_vectors(df, 1, -1.0).collect()}
    assert f[(2, 2, 2)] == a[1:4, 1:4, 1:4].ravel().tolist() and f[(0, 0, 0)][0] == -1.0
    assert voxels(pointwise.to_voxels(pointwise.to_slices(df, 6, 5), 6)) == voxels(df)
    assert voxels(pointwise.crop(df, (1, 1, 1), (2, 2, 2))).keys() == {(x, y, z) for x in (1, 2) for y in (1, 2) for z in (1, 2)}


def test_filter_scale_dimensions(spark):
    out = stencil.filter_scale(image(spark, noise(1, (4, 4, 4))), (4, 4, 4), 3, 2)
    assert {tuple(p) for p in voxels(out)} == set(np.ndindex(6, 6, 6))


def test_algebra(spark):
    a = spark.createDataFrame([(i, 0, 0, float(i)) for i in range(1, 101)], "x int, y int, z int, v double")
    assert pointwise.threshold(a, ">", 50).where("v").count() == 50
    assert pointwise.threshold(pointwise.scalar(a, "-", 1), "<", 10).where("v").count() == 10
    product = voxels(algebra.merge(a, pointwise.invert(a), "*"))
    assert all(v == pytest.approx(1) for v in product.values())
    b = spark.createDataFrame([(1, 0, 0, 4.0), (200, 0, 0, 5.0)], "x int, y int, z int, v double")
    both = voxels(algebra.merge(a, b, "/"))
    assert both[(1, 0, 0)] == 0.25 and both[(200, 0, 0)] == 5.0 and len(both) == 101
    assert voxels(algebra.combine([a, b], "multiply"))[(1, 0, 0)] == 4.0
    assert voxels(algebra.phases([a, b], [7, 9]))[(1, 0, 0)] == 9.0


def test_conversions(spark):
    df = spark.createDataFrame([(2.9,), (-2.9,), (0.0,)], "v double")
    assert [r[0] for r in df.select(pointwise.convert(F.col("v"), "double", "char", signed=True)).collect()] == [129, 124, 127]
    assert [r[0] for r in df.select(pointwise.convert(F.col("v"), "double", "int")).collect()] == [2, -2, 0]
    assert [r[0] for r in df.select(pointwise.convert(F.col("v"), "double", "bool")).collect()] == [True, False, False]


def test_kvoronoi_is_geodesic(spark):
    mask = phantoms.grid(spark, (7, 3, 1), ~((F.col("x") == 3) & (F.col("y") < 2)))
    seeds = spark.createDataFrame([(0, 0, 0, 1), (6, 2, 0, 2)], "x int, y int, z int, label long")
    out = {(r.x, r.y): (r.label, r.dist) for r in grow.kvoronoi(seeds, mask).collect()}
    assert out[(0, 0)] == (1, 0.0) and out[(5, 1)][0] == 2 and out[(5, 1)][1] == pytest.approx(sqrt(2))
    assert out[(4, 0)] == (2, pytest.approx(2 * sqrt(2)))
    limited = {(r.x, r.y): r.label for r in grow.kvoronoi(seeds, mask, 1.0).collect()}
    assert limited[(4, 0)] == 0


def test_distance_and_thickness(spark):
    ball = phantoms.grid(spark, (13, 13, 13), phantoms.ellipsoid((6, 6, 6), (5, 5, 5)))
    dist = grow.distance_map(ball)
    top = dist.orderBy(F.desc("dist")).first()
    assert (top.x, top.y, top.z) == (6, 6, 6) and top.dist == pytest.approx(6, abs=1)
    thick = voxels(grow.thickness(dist, (13, 13, 13)), "thickness")
    assert thick[(6, 6, 6)] == top.dist and max(thick.values()) == top.dist


def test_seeds_and_watershed(spark):
    centres = [(3, 3, 3), (10, 3, 3)]
    dist = phantoms.grid(spark, (14, 7, 7), F.greatest(*[F.lit(3.0) - F.sqrt(sum(((F.col(k) - c) ** 2 for k, c in zip("xyz", p, strict=True)), F.lit(0.0))) for p in centres])).withColumnRenamed("v", "dist").where("dist > 0")
    found = {(r.x, r.y, r.z) for r in grow.seeds(dist).collect()}
    assert found == set(centres)
    labels = spark.createDataFrame([(*p, i + 1) for i, p in enumerate(centres)], "x int, y int, z int, label long")
    parts = voxels(grow.watershed(dist, labels), "label")
    assert {v for k, v in parts.items() if k[0] < 6} == {1} and {v for k, v in parts.items() if k[0] > 7} == {2}


def test_hull_of_a_cube(spark):
    cube = phantoms.grid(spark, (4, 4, 4), F.lit(1)).select(*KEYS, F.lit(1).cast("long").alias("label"))
    (r,) = shape.hulls(cube).collect()
    assert r.area == pytest.approx(54) and r.hull_volume == pytest.approx(27) and r.faces == 12
    flat = cube.where("z = 0")
    assert shape.hulls(flat).first().area == 0


def test_nearest_and_matching(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((60, 3))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)] + [(99, 50.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: r.other for r in match.nearest(df, df, 0.05).collect()}
    every = np.vstack([pts, [[50, 0, 0]]])
    ids = [*range(60), 99]
    d = ((every[:, None] - every[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got == {ids[i]: ids[int(j)] for i, j in enumerate(d.argmin(1))}


def test_chains(spark):
    links = spark.createDataFrame([(0, 5, 6), (1, 6, 7), (0, 1, 1)], "t long, id long, next_id long")
    rows = {(r.t, r.id): (r.chain_t, r.chain_id) for r in match.chains(links.union(spark.createDataFrame([(3, -1, 1 << 40), (4, 1 << 40, 7)], links.schema))).collect()}
    assert rows[(0, 5)] == rows[(1, 6)] == rows[(2, 7)] == (0, 5) and rows[(0, 1)] == rows[(1, 1)] == (0, 1)
    assert rows[(3, -1)] == rows[(4, 1 << 40)] == rows[(5, 7)] == (3, -1)


def test_sql_functions(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, "a-b7-3.5"), (2.0, 4.0, 3.0, "x"), (3.0, 6.0, 0.5, None)], "a double, b double, w double, s string")
    r = df.agg(sqlfn.linfit(F.col("a"), F.col("b")), sqlfn.corr(F.col("a"), F.col("b")), sqlfn.corr(F.col("a"), F.lit(1.0)), sqlfn.wvar(F.col("a"), F.lit(0.0)), sqlfn.wlinfit(F.col("a"), F.col("b"), F.col("w"))).first()
    assert tuple(r) == pytest.approx((2.0, 1.0, 1.0, -1.0, 2.0))
    s = df.select(sqlfn.split(F.col("s"), "-", 0), sqlfn.isplit(F.col("s"), "-", 1), sqlfn.fsplit(F.col("s"), "-", 2)).collect()
    assert tuple(s[0]) == ("a", 7, 3.5) and tuple(s[1]) == ("x", -1, -1.0) and tuple(s[2]) == ("", -1, -1.0)
    assert df.select(sqlfn.fixang(F.lit(190.0)), sqlfn.safe_acos(F.lit(2.0))).first()[:] == (-170.0, 0.0)
    assert sqlfn.t_pvalue(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    one = df.agg(sqlfn.texture(F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()[0]
    assert one == pytest.approx(100.0)


def test_params():
    assert params.parse("-kernel=1 -pos=1,2,3 -name='a b' -flag") == {"kernel": 1, "pos": (1, 2, 3), "name": "a b", "flag": True}
    assert params.parse(params.render({"a": (1, 2, 3), "b": 2.5})) == {"a": (1, 2, 3), "b": 2.5}
    assert params.linear(0, 1, 4) == [0, 0.25, 0.5, 0.75] and params.linear_inclusive(0, 2, 5, whole=True) == [0, 1, 2]
    assert len(params.sweep({"a": [1, 2], "b": [3, 4, 5]})) == 6


def test_registry(spark):
    img = registry.Image(phantoms.grid(spark, (6, 6, 6), F.col("x").cast("double")), (6, 6, 6))
    assert img.run("Filter", "-filter=4").log == ("Filter -filter=4",)
    assert img.threshold(2).component_label("-kernel=1").df.select("v").distinct().count() == 1
    assert img.run("Resize", "-pos=1,1,1 -dim=2,2,2").df.count() == 8
    assert img.threshold(2).run("FractalDimension").count() == 3


def test_tiff_round_trip(spark, tmp_path):
    pages = [np.arange(12, dtype="u2").reshape(3, 4) + 100 * i for i in range(3)]
    for i, p in enumerate(pages):
        (tmp_path / f"s{i}.tif").write_bytes(images.write_tiff(p))
    got = voxels(images.read_volume(spark, str(tmp_path), "*.tif"))
    assert got == {(x, y, z): float(pages[z][y, x]) for x in range(4) for y in range(3) for z in range(3)}
    assert images.packbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])
    slices = pointwise.to_slices(images.read_volume(spark, str(tmp_path), "*.tif"), 4, 3)
    images.export_files(images.encode_slices(slices, 4), str(tmp_path / "out"))
    again = voxels(images.read_volume(spark, str(tmp_path / "out"), "*.tif"))
    assert again == got


def test_tables(spark, tmp_path):
    (tmp_path / "obj.csv").write_text("// a comment\n//LACUNA_NUMBER, POS_X\n1, 2.5\n2, 3\nbad\n")
    assert sorted(tuple(r) for r in tables.read_objects(spark, str(tmp_path / "obj.csv")).collect()) == [(1.0, 2.5), (2.0, 3.0)]
    (tmp_path / "cells.txt").write_text("header\n1 A 0 1 0 0 2 2\nx y\n")
    assert tables.read_lattice(spark, str(tmp_path / "cells.txt")).count() == 2
    v = phantoms.grid(spark, (3, 3, 3), F.lit(1.0))
    tables.write_voxels(v, str(tmp_path / "vox"))
    assert tables.read_voxels(spark, str(tmp_path / "vox")).count() == 27


def test_flat_field_fallbacks(spark):
    only = spark.createDataFrame([(1, [800.0, 1200.0])], "frame long, data array<double>")
    assert frames.flat_field(only).first().data == pytest.approx([800 / 1200, 1.0])
    with_all = spark.createDataFrame([(1, [800.0, 1200.0]), (2, [100.0, 200.0]), (3, [2000.0, 2200.0])], "frame long, data array<double>")
    assert frames.flat_field(with_all).first().data == pytest.approx([700 / 1900, 0.5])


def test_stream_of_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, [800.0, 1200.0]), (2, [100.0, 200.0])], "frame long, data array<double>")
    df.write.parquet(str(tmp_path / "in"))
    stream = frames.file_stream(spark, str(tmp_path / "in"), "frame long, data array<double>")
    frames.each_batch(stream, frames.flat_field, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_box_counts_and_contour(spark):
    full = phantoms.grid(spark, (5, 5, 5), F.lit(True))
    rows = {r.size: (r.filled, r.boxes, r.voxels) for r in hist.box_counts(full, (5, 5, 5)).collect()}
    assert rows[1] == (125, 125, 125) and rows[2] == (27, 27, 216)
    disc = phantoms.grid(spark, (11, 11, 2), phantoms.ellipsoid((5, 5, 0), (3, 3, 9)))
    inside = voxels(contour.contour(disc, "circle"))
    assert inside[(5, 5, 0)] and not inside[(0, 0, 0)]


def test_empty_images(spark):
    none = spark.createDataFrame([], "x int, y int, z int, v boolean")
    assert components.label(none, (4, 4, 4)).count() == 0
    assert grow.distance_map(none).count() == 0
    assert shape.shape_analysis(none.select(*KEYS, F.lit(1).cast("long").alias("label"))).count() == 0

