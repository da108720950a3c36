"""Contours of masks, slice by slice: which voxels of a slice's box are inside a fitted outline."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contour(df: DataFrame, mode: str = "circle", bins: int = 16, scale: float = 1.0, radius: float = 1.0) -> DataFrame:
    """(x, y, z, v) of a dense boolean image: v is true inside the outline of the slice's true voxels. circle: the mean
    radius * 1.5 of a disc; fixed: a given radius about the centre; ellipse: two standard deviations by axis; polygon:
    the largest radius of each angular bin."""
    true = df.where("v")
    centre = true.groupBy("z").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (2 * F.stddev_pop("x")).alias("ax"), (2 * F.stddev_pop("y")).alias("ay"))
    rows = df.join(centre, "z", "left")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    r = F.sqrt(dx * dx + dy * dy)
    if mode == "ellipse":
        a, b = F.greatest(F.col("ax") * scale, F.lit(0.5)), F.greatest(F.col("ay") * scale, F.lit(0.5))
        inside = (dx / a) ** 2 + (dy / b) ** 2 <= 1
    elif mode == "fixed":
        inside = r <= radius
    elif mode == "circle":
        mean_radius = true.join(centre, "z").groupBy("z").agg((F.avg(r) * 1.5 * scale).alias("radius"))
        rows = rows.join(mean_radius, "z", "left")
        inside = r <= F.col("radius")
    else:
        bin_ = F.least(F.floor((F.atan2(dy, dx) + pi) / (2 * pi) * bins), F.lit(bins - 1))
        most = true.join(centre, "z").groupBy("z", bin_.alias("bin")).agg((F.max(r) * scale).alias("radius"))
        rows = rows.withColumn("bin", bin_).join(most, ["z", "bin"], "left")
        inside = r <= F.col("radius")
    return rows.select("x", "y", "z", F.coalesce(inside, F.lit(False)).alias("v"))
