"""Histograms, profiles, box counting and correlation functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, keyed
from .pointwise import KEYS
from .stencil import offsets_column


def bin_of(v: Column, low: float, high: float, n: int) -> Column:
    """Truncated bin, both ends clipped to 0 and n."""
    return F.least(F.greatest(F.floor((v - low) / ((high - low) / n)), F.lit(0)), F.lit(n)).cast("int")


def histogram(df: DataFrame, low: float, high: float, n: int, v: str = "v") -> DataFrame:
    """(bin, left, n): left is the bin's lower edge."""
    out = df.groupBy(bin_of(F.col(v), low, high, n).alias("bin")).agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("bin") * ((high - low) / n) + low).alias("left"), "n")


def auto_histogram(df: DataFrame, n: int, v: str = "v") -> DataFrame:
    """Bins round((v - min) / (max - min) * n): the ends come from one row that is joined in."""
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    frac = F.when(F.col("hi") > F.col("lo"), (F.col(v) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).groupBy(F.round(frac * n).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def factor_histogram(df: DataFrame, by: str = "v") -> DataFrame:
    return df.groupBy(F.col(by).alias("factor")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, along: Column, low: float, high: float, n: int) -> DataFrame:
    """Mean and standard deviation of v along a position function."""
    return df.groupBy(bin_of(along, low, high, n).alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def histogram2d(df: DataFrame, a: Column, b: Column, ranges: Sequence[tuple[float, float, int]], v: str = "v") -> DataFrame:
    """(a, b, n, mean, min, max) in list form."""
    (a0, a1, an), (b0, b1, bn) = ranges
    return df.groupBy(bin_of(a, a0, a1, an).alias("a"), bin_of(b, b0, b1, bn).alias("b")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def matrix(hist: DataFrame, n: int, value: str = "n") -> DataFrame:
    """A 2-D histogram with a column for each b."""
    return hist.groupBy("a").pivot("b", list(range(n + 1))).agg(F.first(value))


def volume_fraction(df: DataFrame) -> DataFrame:
    """Inside and outside counts of a boolean image, and the share inside."""
    return df.agg(F.count_if("v").alias("inside"), F.count_if(~F.col("v")).alias("outside"), F.avg(F.col("v").cast("int")).alias("fraction"))


def box_counts(df: DataFrame, dim: Sequence[int]) -> DataFrame:
    """(size, filled, boxes, voxels): boxes of each size from 1 to half the least dimension; the last box of an axis is
    moved inward. Filled boxes hold a true voxel. Voxels are exploded over sizes and the one or two boxes an axis."""
    top = max(1, min(dim) // 2)
    rows = df.where("v").select(*KEYS, F.explode(F.sequence(F.lit(1), F.lit(top))).alias("size"))
    for k, n in zip(KEYS, dim, strict=True):
        s, c = F.col("size"), F.col(k)
        last = F.floor((F.lit(n) - 1) / s)  # of the last box, which starts at n - size
        starts = F.array(F.when(F.floor(c / s) < last, F.floor(c / s)), F.when(c >= F.lit(n) - s, last))
        rows = rows.withColumn(f"b{k}", F.explode(F.array_compact(starts)))
    filled = rows.groupBy("size", "bx", "by", "bz").agg(F.count("*").alias("v")).groupBy("size").agg(F.count("*").alias("filled"), F.sum("v").alias("voxels"))
    boxes = F.lit(1)
    for n in dim:
        boxes = boxes * F.ceil(F.lit(n) / F.col("size"))
    return filled.select("size", "filled", boxes.cast("long").alias("boxes"), "voxels")


def correlation(df: DataFrame, length: int, min_count: int = 5, start: Column | None = None, value: Column | None = None, sample: int = 1) -> DataFrame:
    """Two-point function (dx, dy, dz, n, mean): over start voxels, the mean value at each offset up to length, of pairs
    with both ends in the image. Empty where n <= min_count, 0 where n is under a quarter of the mean count. sample > 1
    starts from about one voxel in so many, by hash."""
    start = F.col("v") if start is None else start
    value = F.col("v").cast("double") if value is None else value
    begin = df.where(start).select(*KEYS)
    if sample > 1:
        begin = keyed.sample(begin, 1 / sample, KEYS)
    moved = begin.withColumn("o", F.explode(offsets_column(kernels.full(length)))).select(*[(F.col(k) + F.col(f"o.d{k}")).cast("int").alias(k) for k in KEYS], "o.dx", "o.dy", "o.dz")
    pairs = moved.join(df.select(*KEYS, value.alias("value")), KEYS)
    out = pairs.groupBy("dx", "dy", "dz").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where(F.col("n") > min_count)
    mean = out.agg(F.avg("n").alias("all"))
    return out.crossJoin(F.broadcast(mean)).select("dx", "dy", "dz", "n", F.when(F.col("n") < 0.25 * F.col("all"), F.lit(0.0)).otherwise(F.col("mean")).alias("mean"))


def radial(corr: DataFrame) -> DataFrame:
    """A correlation function by rounded distance."""
    r = F.round(F.sqrt((F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2).cast("double"))).cast("int")
    return corr.groupBy(r.alias("r")).agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
