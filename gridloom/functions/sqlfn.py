"""Scalar and aggregate functions over object tables, as column expressions, and their SQL names."""

from __future__ import annotations

from math import exp, lgamma, log, pi, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shape


def _safe(ok: Column, value: Column) -> Column:
    """Errors give 0."""
    return F.when(ok, value).otherwise(F.lit(0.0))


def safe_sqrt(x: Column) -> Column:
    return _safe(x >= 0, F.sqrt(x))


def safe_ln(x: Column) -> Column:
    return _safe(x > 0, F.ln(x))


def safe_log10(x: Column) -> Column:
    return _safe(x > 0, F.log10(x))


def safe_acos(x: Column) -> Column:
    """Degrees, as all angle functions here."""
    return _safe(F.abs(x) <= 1, F.degrees(F.acos(x)))


def safe_asin(x: Column) -> Column:
    return _safe(F.abs(x) <= 1, F.degrees(F.asin(x)))


def atan_deg(x: Column) -> Column:
    return F.degrees(F.atan(x))


def atan2_deg(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def cos_deg(x: Column) -> Column:
    return F.cos(F.radians(x))


def sin_deg(x: Column) -> Column:
    return F.sin(F.radians(x))


def tan_deg(x: Column) -> Column:
    return F.tan(F.radians(x))


def is_numeric(s: Column) -> Column:
    return s.try_cast("double").isNotNull()


def is_long(s: Column) -> Column:
    return s.try_cast("bigint").isNotNull() & ~F.contains(s, F.lit("."))


def linspace(v: Column, low: float, high: float, bins: int) -> Column:
    """Bin 0 below low, bins above high, else the rounded share."""
    return F.when(v < low, 0).when(v > high, bins).otherwise(F.round((v - low) / (high - low) * bins)).cast("int")


def flinspace(v: Column, low: float, high: float, bins: int) -> Column:
    return linspace(v, low, high, bins) * ((high - low) / bins) + low


def split(s: Column, sep: str, i: int) -> Column:
    """The i-th part (from 0), '' if there is none; sep is literal."""
    return F.coalesce(F.get(F.split(s, "\\Q" + sep + "\\E"), F.lit(i)), F.lit(""))


def isplit(s: Column, sep: str, i: int) -> Column:
    return F.coalesce(F.regexp_replace(split(s, sep, i), "[^0-9]", "").try_cast("bigint"), F.lit(-1).cast("bigint"))


def fsplit(s: Column, sep: str, i: int) -> Column:
    return F.coalesce(split(s, sep, i).try_cast("double"), F.lit(-1.0))


def rdist(a: Column, b: Column, c: Column, x: Column, y: Column, z: Column) -> Column:
    return F.sqrt((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z))


def zame(*parts: Column) -> Column:
    return F.concat_ws(",", *[p.cast("string") for p in parts])


def fixang(a: Column) -> Column:
    """Wrapped to [-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def grid2d(x: Column, y: Column, s: float) -> Column:
    return F.struct(F.floor(x / s).alias("gx"), F.floor(y / s).alias("gy"))


def grid3d(x: Column, y: Column, z: Column, s: float) -> Column:
    return F.struct(F.floor(x / s).alias("gx"), F.floor(y / s).alias("gy"), F.floor(z / s).alias("gz"))


def med(x: Column) -> Column:
    return F.median(x)


def var(x: Column) -> Column:
    return F.abs(F.var_pop(x))


def std(x: Column) -> Column:
    return F.stddev_pop(x)


def unicnt(x: Column) -> Column:
    return F.count_distinct(x)


def wavg(v: Column, w: Column) -> Column:
    return F.try_divide(F.sum(v * w), F.sum(w))


def wvar(v: Column, w: Column) -> Column:
    """-1 where the weights sum to 0."""
    m, s = F.try_divide(F.sum(v * w), F.sum(w)), F.try_divide(F.sum(v * v * w), F.sum(w))
    return F.when(F.sum(w) == 0, -1.0).otherwise(F.abs(s - m * m))


def wstd(v: Column, w: Column) -> Column:
    return F.when(F.sum(w) == 0, -1.0).otherwise(F.sqrt(wvar(v, w)))


def linfit(a: Column, b: Column) -> Column:
    """Slope of b on a, 0 if a does not vary."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.var_pop(a)), F.lit(0.0))


def wlinfit(a: Column, b: Column, w: Column) -> Column:
    sw, sa, sb, saa, sab = F.sum(w), F.sum(w * a), F.sum(w * b), F.sum(w * a * a), F.sum(w * a * b)
    return F.coalesce(F.try_divide(sw * sab - sa * sb, sw * saa - sa * sa), F.lit(0.0))


def corr(a: Column, b: Column) -> Column:
    """1 where either does not vary, 0 without rows."""
    flat = (F.coalesce(F.stddev_pop(a), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(b), F.lit(0.0)) == 0)
    return F.when(F.count(a) < 1, 0.0).when(flat, 1.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def relative_variance(x: Column) -> Column:
    return F.try_divide(F.var_pop(x), F.avg(x) * F.avg(x))


def tstat(a: Column, b: Column) -> Column:
    """Pooled two-sample t statistic of two columns; null where the pooled variance is 0, as no test can be made."""
    n, m = F.count(a), F.count(b)
    pooled = ((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b)) / (n + m - 2)
    return F.try_divide(F.avg(a) - F.avg(b), F.sqrt(pooled * (1 / n + 1 / m)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_pvalue(t: float, freedom: float) -> float:
    return incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t)) if t == t and freedom > 0 else float("nan")


def ttest(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, t, p): statistic by built-in aggregates, p for one row a group; null where neither column varies."""
    rows = df.groupBy(by).agg(tstat(F.col(a), F.col(b)).alias("t"), (F.count(a) + F.count(b) - 2).alias("freedom"))

    @F.pandas_udf("double")
    def p(t: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([t_pvalue(x, n) if x is not None else None for x, n in zip(t, freedom, strict=True)], dtype="float64")

    return rows.select(by, "t", p("t", "freedom").alias("p"))


def texture(x: Column, y: Column, z: Column, w: Column | None = None) -> Column:
    """Alignment 150 * (largest / all - 1/3) of the tensor of directions, 100 for fewer than two."""
    w = F.lit(1.0) if w is None else w
    total = F.sum(w)
    c = {n: F.try_divide(F.sum(w * p * q), total) for n, p, q in (("xx", x, x), ("yy", y, y), ("zz", z, z), ("xy", x, y), ("xz", x, z), ("yz", y, z))}
    largest = shape.eigenvalues(c)[0]
    return F.when(F.count(x) < 2, 100.0).otherwise(150 * (F.try_divide(largest, c["xx"] + c["yy"] + c["zz"]) - F.lit(1 / 3)))


#: SQL bodies, registered as temporary functions: Catalyst inlines them, no Python runs.
SQL_SCALARS = {
    "sq(x DOUBLE)": "x * x",
    "safe_sqrt(x DOUBLE)": "IF(x >= 0, sqrt(x), 0)",
    "safe_ln(x DOUBLE)": "IF(x > 0, ln(x), 0)",
    "cosd(x DOUBLE)": "cos(radians(x))",
    "sind(x DOUBLE)": "sin(radians(x))",
    "tand(x DOUBLE)": "tan(radians(x))",
    "acosd(x DOUBLE)": "IF(abs(x) <= 1, degrees(acos(x)), 0)",
    "asind(x DOUBLE)": "IF(abs(x) <= 1, degrees(asin(x)), 0)",
    "atand(x DOUBLE)": "degrees(atan(x))",
    "atan2d(y DOUBLE, x DOUBLE)": "degrees(atan2(y, x))",
    "is_numeric(s STRING)": "try_cast(s AS DOUBLE) IS NOT NULL",
    "linspace(v DOUBLE, low DOUBLE, high DOUBLE, bins INT)": "CAST(CASE WHEN v < low THEN 0 WHEN v > high THEN bins ELSE round((v - low) / (high - low) * bins) END AS INT)",
    "rdist(a DOUBLE, b DOUBLE, c DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE)": "sqrt((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z))",
    "fixang(a DOUBLE)": "pmod(a + 180, 360.0D) - 180",
}


def register(spark: SparkSession) -> None:
    for signature, body in SQL_SCALARS.items():
        name, args = signature.split("(", 1)
        kind = "BOOLEAN" if name == "is_numeric" else "INT" if name == "linspace" else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args} RETURNS {kind} RETURN {body}")


def rotate_z(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    a = degrees * pi / 180
    from math import cos, sin

    return x * cos(a) - y * sin(a), x * sin(a) + y * cos(a)


def centre_positions(df: DataFrame, by: str, weight: Column) -> DataFrame:
    """Positions relative to the weighted centre of each sample, joined back."""
    keys = ("x", "y", "z")
    centre = df.groupBy(by).agg(*[wavg(F.col(k), weight).alias(f"m{k}") for k in keys])
    out = df.join(centre, by)
    for k in keys:
        out = out.withColumn(k, F.col(k) - F.col(f"m{k}"))
    return out.drop(*[f"m{k}" for k in keys])


def sector_radius(df: DataFrame, theta: Column, radius: Column, n: int, by: str) -> DataFrame:
    """Least, largest and weighted mean radius by sample and angular sector (theta in degrees)."""
    sector = F.floor((theta + 180) / 360 * n).cast("int")
    return df.groupBy(by, sector.alias("sector")).agg(F.min(radius).alias("min_r"), F.max(radius).alias("max_r"), wavg(radius, F.col("weight")).alias("mean_r"))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "sqrt")]
