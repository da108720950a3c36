"""Algebra of several images: equi-joins on voxel keys, with padding, masks and phases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pointwise import KEYS


def merge(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """a op b where both have the voxel, else the one that has it; division is true division."""
    p, q = F.col("va"), F.col("vb")
    both = {"+": p + q, "-": p - q, "*": p * q, "/": F.try_divide(p.cast("double"), q.cast("double"))}[op]
    joined = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), KEYS, "full_outer")
    return joined.select(*KEYS, F.when(p.isNotNull() & q.isNotNull(), both).otherwise(F.coalesce(p, q)).alias("v"))


def slice_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Slices (z, data) of both images, combined element by element."""
    from .pointwise import vector_op

    return a.withColumnRenamed("data", "da").join(b.withColumnRenamed("data", "db"), "z").select("z", vector_op(F.col("da"), F.col("db"), op).alias("data"))


def combine(images: Sequence[DataFrame], how: str) -> DataFrame:
    """Add, average or multiply images on the union of their voxels, in one shuffle."""
    rows = reduce(DataFrame.unionByName, [i.select(*KEYS, F.col("v").cast("double").alias("v")) for i in images])
    zero = F.max(F.when(F.col("v") == 0, 0.0))
    product = F.coalesce(zero, F.round(F.product("v"), 9)) if how == "multiply" else None
    agg = {"add": F.sum("v"), "average": F.avg("v"), "multiply": product}[how]
    return rows.groupBy(*KEYS).agg(agg.alias("v"))


def mask(mask_image: DataFrame, images: Sequence[DataFrame], mode: int = 0) -> DataFrame:
    """Images under a mask, 0 elsewhere: mode 0 the last image, 1 their sum, 2 their product."""
    out = mask_image.withColumnRenamed("v", "m")
    names = []
    for i, image in enumerate(images):
        names.append(F.coalesce(F.col(f"v{i}"), F.lit(0)))
        out = out.join(image.withColumnRenamed("v", f"v{i}"), KEYS, "left")
    value = names[-1] if mode == 0 else reduce(lambda p, q: p + q if mode == 1 else p * q, names)
    return out.select(*KEYS, F.when(F.col("m") > 0, value).otherwise(F.lit(0)).alias("v"))


def phases(images: Sequence[DataFrame], values: Sequence[float]) -> DataFrame:
    """The value of the last image that is above 0 at a voxel, 0 where none is."""
    rows = [i.select(*KEYS, F.when(F.col("v") > 0, F.struct(F.lit(n).alias("n"), F.lit(float(p)).alias("p"))).alias("s")) for n, (i, p) in enumerate(zip(images, values, strict=True))]
    return reduce(DataFrame.unionByName, rows).groupBy(*KEYS).agg(F.coalesce(F.max("s")["p"], F.lit(0.0)).alias("v"))


def zip_slices(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("data", "other"), "z").select("z", F.arrays_zip("data", "other").alias("data"))


def missing(box: DataFrame, image: DataFrame) -> DataFrame:
    """Voxel keys of a box that an image lacks."""
    return box.select(*KEYS).join(image.select(*KEYS), KEYS, "left_anti")
