"""Pointwise operators on voxel rows (x, y, z, v): casts, thresholds, look-ups, crops, planes, layout changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["x", "y", "z"]
#: Offsets of signed integer types, and the value of true in function images (fixed values).
SIGNED_OFFSET = {"char": 127, "short": 32768, "int": 32768, "long": 32768}
TRUE_VALUE = 127
SPARK_TYPE = {"bool": "boolean", "char": "smallint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double"}
IMAGE_CLASS = {"boolean": "binary", "tinyint": "label", "smallint": "label", "int": "label", "bigint": "label", "float": "value", "double": "value"}


def convert(v: Column, source: str, target: str, signed: bool = False, scale: float = 1.0) -> Column:
    """Type conversion of a value: v > 0 for bool, truncated v / scale + offset for integers, v * scale back to reals."""
    if source == target:
        return v
    if source == "bool":
        v = F.when(v, F.lit(TRUE_VALUE)).otherwise(F.lit(0))
        return v.cast(SPARK_TYPE[target])
    if target == "bool":
        return v > 0
    if target in SIGNED_OFFSET:
        if source in ("float", "double"):
            whole = v / F.lit(scale) + (SIGNED_OFFSET[target] if signed else 0)
            return F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole)).cast(SPARK_TYPE[target])
        return v.cast(SPARK_TYPE[target])
    if source in SIGNED_OFFSET:
        return ((v - (SIGNED_OFFSET[source] if signed else 0)) * F.lit(scale)).cast(SPARK_TYPE[target])
    return v.cast(SPARK_TYPE[target])


def rgb_to_scalar(r: Column, g: Column, b: Column, mode: str = "mean") -> Column:
    return {"mean": (r + g + b) / 3, "sum": r + g + b, "min": F.least(r, g, b), "max": F.greatest(r, g, b), "int": (r * 65536 + g * 256 + b), "red": r, "green": g, "blue": b}[mode]


def map_values(df: DataFrame, f) -> DataFrame:
    return df.withColumn("v", f(F.col("v")))


def threshold(df: DataFrame, op: str, t: float) -> DataFrame:
    return map_values(df, lambda v: {">": v > t, "<": v < t, "==": v == t, ">=": v >= t, "<=": v <= t}[op])


def scalar(df: DataFrame, op: str, c: float) -> DataFrame:
    """v op c; integer images truncate a quotient back to their type."""
    kind = df.schema["v"].dataType.simpleString()
    v = F.col("v")
    out = {"+": v + c, "-": v - c, "*": v * c, "/": F.try_divide(v.cast("double"), F.lit(float(c)))}[op]
    return df.withColumn("v", out.cast(kind))


def invert(df: DataFrame) -> DataFrame:
    return map_values(df, lambda v: F.try_divide(F.lit(1.0), v.cast("double")))


def vector_op(a: Column, b: Column, op: str) -> Column:
    """Element-wise algebra of array-valued voxels."""
    return F.zip_with(a, b, {"+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q, "/": lambda p, q: F.try_divide(p, q)}[op])


def lookup(df: DataFrame, values: Sequence[float], step: float = 1.0, low: float = 0.0) -> DataFrame:
    """Replace v by a table's entry at floor((v - low) / step), clipped to the table's ends."""
    at = F.least(F.greatest(F.floor((F.col("v") - low) / step).cast("int"), F.lit(0)), F.lit(len(values) - 1))
    return df.withColumn("v", F.element_at(F.array(*[F.lit(x) for x in values]), at + 1))


def bands(df: DataFrame, edges: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Name the band (low, high] of v; voxels in none are left out."""
    band = F.lit(None).cast("string")
    for name, low, high in reversed(edges):
        band = F.when((F.col("v") > low) & (F.col("v") <= high), F.lit(name)).otherwise(band)
    return df.withColumn("band", band).where("band is not null")


def position(fn: str, cx: float = 0.0, cy: float = 0.0, cz: float = 0.0) -> Column:
    """Built-in position functions of a voxel."""
    x, y, z = F.col("x") - cx, F.col("y") - cy, F.col("z") - cz
    r = F.sqrt(x * x + y * y + z * z)
    return {
        "z": F.col("z").cast("double"), "cyl_r": F.sqrt(x * x + y * y), "cyl_theta": F.atan2(y, x), "sph_r": r,
        "sph_phi": F.when(r > 0, F.acos(z / r)).otherwise(F.lit(0.0)), "constant": F.lit(1.0),
    }[fn]


def xyz_from_index(i: Column, nx: int, ny: int) -> list[Column]:
    return [(i % nx).cast("int").alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z")]


def linear_index(nx: int, ny: int) -> Column:
    return (F.col("x") + F.lit(nx).cast("long") * (F.col("y") + F.lit(ny).cast("long") * F.col("z"))).cast("long")


def crop(df: DataFrame, pos: Sequence[int], dim: Sequence[int]) -> DataFrame:
    """Voxels in [pos, pos + dim): the range reaches the Parquet scan as pushed filters."""
    for k, p, d in zip(KEYS, pos, dim, strict=True):
        df = df.where((F.col(k) >= p) & (F.col(k) < p + d))
    return df


def shape_of(df: DataFrame) -> DataFrame:
    """Position and dimension of an image: minima, and maxima - minima + 1."""
    aggs = [F.min(k).alias(f"pos_{k}") for k in KEYS] + [(F.max(k) - F.min(k) + 1).alias(f"dim_{k}") for k in KEYS]
    return df.agg(*aggs)


def find_edges(df: DataFrame, low: float = 0.0) -> DataFrame:
    """Bounding box of the voxels above low."""
    return shape_of(df.where(F.col("v") > low))


def plane(df: DataFrame, axes: tuple[str, str], at: int) -> DataFrame:
    """A plane as (row, col, v): the third axis is fixed."""
    (fixed,) = set(KEYS) - set(axes)
    return df.where(F.col(fixed) == at).select(F.col(axes[0]).alias("row"), F.col(axes[1]).alias("col"), "v")


def rows_of(df: DataFrame) -> DataFrame:
    """Matrix rows (row, values) of (row, col, v), values in column order."""
    return df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("e")).select("row", F.col("e.v").alias("values"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of coordinate matrices (row, col, v)."""
    right = b.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("v").alias("w"))
    return a.join(right, F.col("col") == F.col("k")).groupBy("row", F.col("j").alias("col")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def to_slices(df: DataFrame, nx: int, ny: int, padding: float = 0.0) -> DataFrame:
    """Dense rows (z, data): data[x + nx * y], padding where no voxel is; repeated voxels are summed."""
    one = df.where((F.col("x") >= 0) & (F.col("x") < nx) & (F.col("y") >= 0) & (F.col("y") < ny)).groupBy("z", (F.col("x") + nx * F.col("y")).alias("i")).agg(F.sum("v").alias("v"))
    m = one.groupBy("z").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return m.select("z", F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(padding))).alias("data"))


def to_voxels(slices: DataFrame, nx: int, over: float | None = None) -> DataFrame:
    """Voxel rows of dense slices; with over, only values above it."""
    rows = slices.select("z", F.posexplode("data").alias("i", "v"))
    rows = rows.select((F.col("i") % nx).cast("int").alias("x"), F.floor(F.col("i") / nx).cast("int").alias("y"), "z", "v")
    return rows if over is None else rows.where(F.col("v") > over)


def complete(df: DataFrame, pos: Sequence[int], dim: Sequence[int], padding: float) -> DataFrame:
    """All voxels of a box; missing ones hold padding."""
    (x0, y0, z0), (nx, ny, nz) = pos, dim
    box = df.sparkSession.range(nx * ny * nz)
    x, y, z = xyz_from_index(F.col("id"), nx, ny)
    box = box.select((x + x0).cast("int").alias("x"), (y + y0).cast("int").alias("y"), (z + z0).cast("int").alias("z"))
    return box.join(df, KEYS, "left").withColumn("v", F.coalesce("v", F.lit(padding)))


def tiles(df: DataFrame, levels: int) -> DataFrame:
    """Tile pyramid of a plane (x, y, v): at each level the mean of 2 x 2 of the level before."""
    out = now = df.select(F.lit(0).alias("level"), "x", "y", "v")
    for level in range(1, levels + 1):
        now = now.groupBy(F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.avg("v").alias("v")).select(F.lit(level).alias("level"), "x", "y", "v")
        out = out.unionByName(now)
    return out


def map_voxels(df: DataFrame, **columns: Column) -> DataFrame:
    """Keys and value mapped together by expressions of the old ones; keys stay whole numbers."""
    return df.select(*[columns.get(k, F.col(k)).cast("int").alias(k) for k in KEYS], columns.get("v", F.col("v")).alias("v"))


def magnitude(v: Column) -> Column:
    """Length of an array-valued voxel."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def matrix_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Sum, difference or product, entry by entry, of coordinate matrices; entries that one lacks are 0."""
    p, q = F.coalesce("va", F.lit(0.0)), F.coalesce("vb", F.lit(0.0))
    joined = a.withColumnRenamed("v", "va").join(b.withColumnRenamed("v", "vb"), ["row", "col"], "full_outer")
    return joined.select("row", "col", {"+": p + q, "-": p - q, "*": p * q}[op].alias("v"))


def crop_slices(slices: DataFrame, nx: int, pos: Sequence[int], dim: Sequence[int], padding: float = 0.0) -> DataFrame:
    """Slices (z, data) of the box [pos, pos + dim), each cut to it; slices that are not there are blank."""
    (x0, y0, z0), (mx, my, mz) = pos, dim
    cut = F.flatten(F.transform(F.sequence(F.lit(y0), F.lit(y0 + my - 1)), lambda y: F.slice("data", y * nx + x0 + 1, mx)))
    found = slices.where((F.col("z") >= z0) & (F.col("z") < z0 + mz)).select("z", cut.alias("data"))
    every = slices.sparkSession.range(z0, z0 + mz).select(F.col("id").cast("int").alias("z"))
    return every.join(found, "z", "left").select("z", F.coalesce("data", F.array_repeat(F.lit(padding), mx * my)).alias("data"))
