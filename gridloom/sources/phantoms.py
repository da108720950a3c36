"""Analytic images as DataFrames: voxels of a range, value by a column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pointwise import xyz_from_index

X, Y, Z = F.col, F.col, F.col


def grid(spark: SparkSession, dim: Sequence[int], value: Column, pos: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """A dense image of a position function: generated in the JVM, split over tasks by range."""
    nx, ny, nz = dim
    xyz = xyz_from_index(F.col("id"), nx, ny)
    moved = [(c + p).cast("int").alias(k) for c, p, k in zip(xyz, pos, "xyz", strict=True)]
    return spark.range(nx * ny * nz).select(*moved).withColumn("v", value)


def x() -> Column:
    return F.col("x")


def y() -> Column:
    return F.col("y")


def z() -> Column:
    return F.col("z")


def diagonal_line() -> Column:
    return (x() == y()) & (y() == z())


def diagonal_plane() -> Column:
    s = x() + y()
    return (F.abs(z() - s) < 0.5) & (s % 2 == z() % 2)


def dots() -> Column:
    return (x() + y() + z()) % 2 == 1


def lines() -> Column:
    return (x() + y()) % 2 == 1


def ellipsoid(centre: Sequence[float], radii: Sequence[float]) -> Column:
    return sum((((F.col(k) - c) / r) ** 2 for k, c, r in zip("xyz", centre, radii, strict=True)), F.lit(0.0)) <= 1


def layered(axis: str, period: int) -> Column:
    return F.floor(F.col(axis) / period) % 2 == 0


def foam(spark: SparkSession, dim: Sequence[int], bubbles: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    """Number of bubbles (x, y, z, r) that cover each voxel; bubbles are parameters, so literals."""
    covered = [(sum(((F.col(k) - c) ** 2 for k, c in zip("xyz", b[:3], strict=True)), F.lit(0.0)) <= b[3] ** 2).cast("int") for b in bubbles]
    return grid(spark, dim, sum(covered, F.lit(0)))
