"""Object statistics: moments, principal axes, gray values, contacts, hulls, derived metrics."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .pointwise import KEYS
from .stencil import offsets_column

PAIRS = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]


def moments(df: DataFrame, by: str = "label") -> DataFrame:
    """One pass: count, means, central second moments / n, extents (max - min) of each object."""
    aggs = [F.count("*").alias("n")] + [F.avg(k).alias(f"m{k}") for k in KEYS]
    aggs += [F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in PAIRS]
    aggs += [(F.max(k) - F.min(k)).cast("double").alias(f"proj_{k}") for k in KEYS]
    return df.groupBy(by).agg(*aggs)


def eigenvalues(c: dict[str, Column] | None = None) -> list[Column]:
    """Eigenvalues of the symmetric 3 x 3 matrix cxx .. cyz, falling, in closed form (trigonometric cubic)."""
    c = c or {a + b: F.col(f"c{a}{b}") for a, b in PAIRS}
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    off = c["xy"] ** 2 + c["xz"] ** 2 + c["yz"] ** 2
    a, b, d = c["xx"] - q, c["yy"] - q, c["zz"] - q
    p = F.sqrt((a**2 + b**2 + d**2 + 2 * off) / 6)
    det = a * (b * d - c["yz"] ** 2) - c["xy"] * (c["xy"] * d - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - b * c["xz"])
    r = F.when(p > 1e-12, det / (2 * p * p * p)).otherwise(F.lit(0.0))
    phi = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + F.lit(2 * pi / 3))
    return [first, 3 * q - first - last, last]


def _axes(frames):
    """Principal axes, largest first, largest component positive; one vectorised eigh a batch."""
    for f in frames:
        m = np.zeros((len(f), 3, 3))
        for a, b in PAIRS:
            i, j = KEYS.index(a), KEYS.index(b)
            m[:, i, j] = m[:, j, i] = f[f"c{a}{b}"]
        values, vectors = np.linalg.eigh(m)
        values, vectors = values[:, ::-1], vectors[:, :, ::-1]
        top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None, :], axis=1)
        vectors = vectors * np.where(top < 0, -1.0, 1.0)
        out = {"label": f["label"]}
        for k in range(3):
            for i, name in enumerate(KEYS):
                out[f"pca{k + 1}_{name}"] = vectors[:, i, k]
            out[f"pca{k + 1}_s"] = np.sqrt(np.maximum(values[:, k], 0))
        yield pd.DataFrame(out)


def shape_analysis(labels: DataFrame) -> DataFrame:
    """The object table: one row a label > 0. Two passes over the voxels: moments, then ranges along the axes."""
    rows = labels.where("label > 0").withColumn("label", F.col("label").cast("long"))
    m = moments(rows)
    names = ["label long"] + [f"pca{k}_{c} double" for k in (1, 2, 3) for c in ("x", "y", "z", "s")]
    axes = m.select("label", *[f"c{a}{b}" for a, b in PAIRS]).mapInPandas(_axes, ", ".join(names))
    table = m.join(axes, "label")
    joined = rows.join(table.select("label", *[f"m{k}" for k in KEYS], *[f"pca{k}_{c}" for k in (1, 2, 3) for c in KEYS]), "label")
    d = {k: F.col(k) - F.col(f"m{k}") for k in KEYS}
    r2 = d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2
    along = [sum((d[c] * F.col(f"pca{k}_{c}") for c in KEYS), F.lit(0.0)) for k in (1, 2, 3)]
    second = joined.groupBy("label").agg(F.avg(F.sqrt(r2)).alias("obj_radius"), F.avg(r2).alias("r2"), *[(F.max(a) - F.min(a)).alias(f"proj_pca{k}") for k, a in zip((1, 2, 3), along, strict=True)])
    return table.join(second, "label").select(
        F.col("label").alias("lacuna_number"), *[F.col(f"m{k}").alias(f"pos_{k}") for k in KEYS], *[F.sqrt(F.greatest(F.col(f"c{k}{k}"), F.lit(0.0))).alias(f"std_{k}") for k in KEYS], *[f"proj_{k}" for k in KEYS],
        *[f"pca{k}_{c}" for k in (1, 2, 3) for c in ("x", "y", "z", "s")], *[f"proj_pca{k}" for k in (1, 2, 3)], "obj_radius", F.sqrt(F.greatest(F.col("r2") - F.col("obj_radius") ** 2, F.lit(0.0))).alias("obj_radius_std"),
        F.col("n").cast("double").alias("volume"), (F.col("proj_pca1") * F.col("proj_pca2") * F.col("proj_pca3")).alias("volume_box"),
    )


def gray_stats(labels: DataFrame, values: DataFrame, over: float | None = None) -> DataFrame:
    """Per label: intensity count, mean, std, min, max, weighted centroid, gradient (weighted - plain centroid), its length."""
    rows = labels.where("label > 0").join(values, KEYS)
    if over is not None:
        rows = rows.where(F.col("v") >= over)
    w = F.sum("v")
    g = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), *[F.avg(k).alias(f"m{k}") for k in KEYS], *[F.try_divide(F.sum(F.col(k) * F.col("v")), w).alias(f"w{k}") for k in KEYS])
    grads = [F.col(f"w{k}") - F.col(f"m{k}") for k in KEYS]
    return g.select("label", "n", "mean", "std", "min", "max", *[f"w{k}" for k in KEYS], *[c.alias(f"grad_{k}") for c, k in zip(grads, KEYS, strict=True)], F.sqrt(sum((c * c for c in grads), F.lit(0.0))).alias("grad"))


def contacts(labels: DataFrame, offsets: Sequence[kernels.Offset] | None = None) -> DataFrame:
    """(a, b, n): voxel contacts of each ordered pair of different labels."""
    offsets = [d for d in offsets or kernels.full() if d != (0, 0, 0)]
    rows = labels.where("label > 0")
    moved = rows.withColumn("o", F.explode(offsets_column(offsets))).select(*[(F.col(k) + F.col(f"o.d{k}")).cast("int").alias(k) for k in KEYS], F.col("label").alias("a"))
    return moved.join(rows.select(*KEYS, F.col("label").alias("b")), KEYS).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def neighbour_counts(labels: DataFrame, offsets: Sequence[kernels.Offset] | None = None) -> DataFrame:
    """(label, neighbours, contacts) of each label that touches another."""
    return contacts(labels, offsets).groupBy(F.col("a").alias("label")).agg(F.count("*").alias("neighbours"), F.sum("n").alias("contacts"))


def append_columns(objects: DataFrame, stats: DataFrame, key: str = "label") -> DataFrame:
    """Objects with further columns by key; nulls where there are none."""
    return objects.join(stats, key, "left")


def density(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """(label, volume, region_volume, density): voxels of each object and of the region grown from it."""
    own = labels.groupBy("label").agg(F.count("*").alias("volume"))
    grown = regions.where("label > 0").groupBy("label").agg(F.count("*").alias("region_volume"))
    return own.join(grown, "label", "left").withColumn("density", F.try_divide(F.col("volume").cast("double"), F.col("region_volume").cast("double")))


def anisotropy(s1: Column, s3: Column) -> Column:
    return F.when(s1 > 0, (s1 - s3) / s1).otherwise(F.lit(0.0))


def oblateness(s1: Column, s2: Column, s3: Column) -> Column:
    """-1 (prolate) to 1 (oblate): 2 (s2 - s3) / (s1 - s3) - 1."""
    return F.when(s1 > s3, 2 * (s2 - s3) / (s1 - s3) - 1).otherwise(F.lit(0.0))


def sphericity(volume: Column, radius: Column) -> Column:
    """Volume over that of a ball whose mean distance to the centre is radius (of radius 4/3 * it)."""
    return F.when(radius > 0, volume / (4 / 3 * pi * F.pow(4 / 3 * radius, 3))).otherwise(F.lit(0.0))


def hull_faces(points: np.ndarray) -> tuple[np.ndarray, set[tuple[int, int, int]], np.ndarray]:
    """Distinct points, the faces of their convex hull, outward, and a point inside; no faces if they lie in a plane."""
    pts = np.unique(points, axis=0).astype(float)
    if len(pts) < 4:
        return pts, set(), pts[:0]
    i0 = 0
    i1 = int(np.argmax(((pts - pts[i0]) ** 2).sum(1)))
    line = pts[i1] - pts[i0]
    i2 = int(np.argmax((np.cross(pts - pts[i0], line) ** 2).sum(1)))
    normal = np.cross(line, pts[i2] - pts[i0])
    side = (pts - pts[i0]) @ normal
    i3 = int(np.argmax(np.abs(side)))
    scale = np.abs(pts).max() + 1
    if abs(side[i3]) <= 1e-9 * scale**3:
        return pts, set(), pts[:0]
    inner = pts[[i0, i1, i2, i3]].mean(0)

    def face(a, b, c):
        n = np.cross(pts[b] - pts[a], pts[c] - pts[a])
        return (a, b, c) if n @ (inner - pts[a]) < 0 else (a, c, b)

    faces = {face(i0, i1, i2), face(i0, i1, i3), face(i0, i2, i3), face(i1, i2, i3)}
    for p in range(len(pts)):
        seen = [f for f in faces if np.cross(pts[f[1]] - pts[f[0]], pts[f[2]] - pts[f[0]]) @ (pts[p] - pts[f[0]]) > 1e-9 * scale**2]
        if seen:
            edges = {e for f in seen for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0]))}
            faces -= set(seen)
            faces |= {(a, b, p) for a, b in edges if (b, a) not in edges}
    return pts, faces, inner


def hull(points: np.ndarray) -> tuple[float, float, int]:
    """Area, volume and number of faces of the convex hull of 3-D points; zeros if they lie in a plane."""
    pts, faces, inner = hull_faces(points)
    area = volume = 0.0
    for a, b, c in faces:
        n = np.cross(pts[b] - pts[a], pts[c] - pts[a])
        area += 0.5 * float(np.linalg.norm(n))
        volume += float(n @ (pts[a] - inner)) / 6
    return area, volume, len(faces)


#: Edge of the blocks whose hulls are taken first.
HULL_BLOCK = 64


def hulls(labels: DataFrame) -> DataFrame:
    """(label, area, hull_volume, faces). Only the ends of each object's x runs, then y runs, go to Python, as inner
    voxels cannot be corners; there each block of the image gives its own hull's corners, and an object's hull is that
    of its blocks' corners."""
    ends = labels.where("label > 0")
    for line in ("x", "y", "z"):
        others = [k for k in KEYS if k != line]
        lo_hi = ends.groupBy("label", *others).agg(F.min(line).alias("lo"), F.max(line).alias("hi"))
        ends = lo_hi.select("label", *others, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(line))
    block = [F.floor(F.col(k) / HULL_BLOCK).alias(f"b{k}") for k in KEYS]

    def corners(key, frame):
        pts, faces, _ = hull_faces(frame[KEYS].to_numpy())
        pts = pts[sorted({i for f in faces for i in f})] if faces else pts
        return pd.DataFrame(pts.astype(int), columns=KEYS).assign(label=key[0])[["label", *KEYS]]

    def one(key, frame):
        return pd.DataFrame([(key[0], *hull(frame[KEYS].to_numpy()))], columns=["label", "area", "hull_volume", "faces"])

    outer = ends.select("label", *KEYS, *block).groupBy("label", *[f"b{k}" for k in KEYS]).applyInPandas(corners, "label long, x int, y int, z int")
    return outer.groupBy("label").applyInPandas(one, "label long, area double, hull_volume double, faces int")


def info(labels: DataFrame) -> DataFrame:
    """One row: the number of objects and their mean volume."""
    return labels.where("label > 0").groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.avg("n").alias("average_volume"))


def gray_columns(labels: DataFrame, values: DataFrame, over: float | None = None, invert: bool = False, mask: DataFrame | None = None) -> DataFrame:
    """gray_stats with covariances of place and value (cov), value-weighted spread about the plain centroid (sov) and the
    angle in degrees between the object's position and its gradient (ang). invert takes values under the threshold; with
    a mask only its true voxels count. One aggregation: the spread comes from moments."""
    rows = labels.where("label > 0").join(values, KEYS)
    if over is not None:
        rows = rows.where(F.col("v") < over if invert else F.col("v") >= over)
    if mask is not None:
        rows = rows.join(mask.where("v").select(*KEYS), KEYS, "left_semi")
    w = F.sum("v")
    means = {k: F.avg(k) for k in KEYS}
    weighted = {k: F.try_divide(F.sum(F.col(k) * F.col("v")), w) for k in KEYS}
    spread = {k: F.sqrt(F.greatest(F.try_divide(F.sum(F.col(k) * F.col(k) * F.col("v")), w) - 2 * means[k] * weighted[k] + means[k] * means[k], F.lit(0.0))) for k in KEYS}
    g = rows.groupBy("label").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        *[F.covar_pop(k, "v").alias(f"cov_{k}") for k in KEYS], *[means[k].alias(f"pos_{k}") for k in KEYS], *[weighted[k].alias(f"com_{k}") for k in KEYS], *[spread[k].alias(f"sov_{k}") for k in KEYS],
    )
    grads = {k: F.col(f"com_{k}") - F.col(f"pos_{k}") for k in KEYS}
    length = F.sqrt(sum((c * c for c in grads.values()), F.lit(0.0)))
    away = F.sqrt(sum((F.col(f"pos_{k}") * F.col(f"pos_{k}") for k in KEYS), F.lit(0.0)))
    dot = F.try_divide(sum((grads[k] * F.col(f"pos_{k}") for k in KEYS), F.lit(0.0)), length * away)
    return g.select("*", *[c.alias(f"grad_{k}") for k, c in grads.items()], length.alias("grad"), F.degrees(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))).alias("ang"))
