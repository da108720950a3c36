"""Keyed collections: joins of every kind, grouped folds, counts, samples and numbering, as DataFrame plans.

Rows are keyed by columns. Folds are aggregates with map-side combining; groups come as arrays only where the group is
the result, as in cogroup(). Samples are drawn by hash, so that they are the same on any cluster and after a retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import with_rank


def join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """inner, left, right or full: keys once, then the columns of a and of b."""
    return a.join(b, list(keys), {"full": "full_outer"}.get(how, how))


def cogroup(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(key, one sorted array of values a table): every key of any table, empty arrays where it has none. All tables
    meet in one shuffle."""
    rows = None
    for i, t in enumerate(tables.values()):
        part = t.select(F.col(key), F.lit(i).alias("source"), F.col(value).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    parts = [F.sort_array(F.collect_list(F.when(F.col("source") == i, F.col("value")))).alias(n) for i, n in enumerate(tables)]
    return rows.groupBy(key).agg(*parts)


def subtract_by_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


def zip_rows(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """The n-th row of a beside the n-th of b, in their orders, as far as the shorter one goes."""
    return with_rank(a, list(order_a), "n").join(with_rank(b, list(order_b), "n"), "n")


def number(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Rows numbered from 0 by an order, without one task seeing them all."""
    return with_rank(df, list(order), name, 0)


def reduce_by_key(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def combine_by_key(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, total, least, most): what a combiner of count, sum and extremes leaves of each key."""
    return reduce_by_key(df, by, n=F.count(value), total=F.sum(value), least=F.min(value), most=F.max(value))


def fold(df: DataFrame, value: str, zero: float, op: str) -> DataFrame:
    """One row: zero op all values; op is +, min, max or *."""
    v = F.col(value)
    agg = {"+": F.sum(v), "min": F.min(v), "max": F.max(v), "*": F.product(v)}[op]
    both = {"+": lambda a: a + F.lit(zero), "min": lambda a: F.least(a, F.lit(zero)), "max": lambda a: F.greatest(a, F.lit(zero)), "*": lambda a: a * F.lit(zero)}[op]
    return df.agg(F.coalesce(both(agg), F.lit(zero)).alias("value"))


def fold_by_key(df: DataFrame, by: Sequence[str], value: str, zero: float) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(value) + F.lit(zero)).alias("value"))


def count_by_value(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def bucket_counts(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bucket, low, high, n): half-open buckets, the last one closed; values outside are left out. Empty buckets count
    0."""
    v = F.col(value)
    number_ = sum(((v >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    found = df.where((v >= edges[0]) & (v <= edges[-1])).groupBy(number_.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bucket int, low double, high double")
    return every.join(found, "bucket", "left").select("bucket", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def _uniform(seed: int, keys: Sequence[str], salt: Column | None = None) -> Column:
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], *([] if salt is None else [salt.cast("string")])]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sample(df: DataFrame, share: float, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Each row with probability share, by a hash of its keys."""
    return df.where(_uniform(seed, keys) < share)


def sample_by_key(df: DataFrame, by: str, shares: dict, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Each row with its stratum's probability; strata without one give none."""
    share = F.lit(0.0)
    for k, s in shares.items():
        share = F.when(F.col(by) == k, s).otherwise(share)
    return df.where(_uniform(seed, keys) < share)


def sample_with_replacement(df: DataFrame, rate: float, keys: Sequence[str], seed: int = 0, most: int = 64) -> DataFrame:
    """Each row a Poisson(rate) number of times, with the copy's number from 1; rates of a few. Counts past most, which
    have no probability to speak of, are cut to it."""
    from math import exp

    p, c, cumulative = exp(-rate), exp(-rate), []
    for k in range(1, most + 1):
        cumulative.append(c)
        p *= rate / k
        c += p
    u = _uniform(seed, keys)
    count = F.size(F.filter(F.array(*[F.lit(x) for x in cumulative]), lambda x: x <= u))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), count))).where("copy > 0")


def take_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows, those of smallest hash."""
    return df.orderBy(_uniform(seed, keys), *keys).limit(n)


def glom(df: DataFrame, by: Column, n: int, value: str) -> DataFrame:
    """(part, values): the sorted values of each of n parts that rows are dealt to by a key."""
    return df.groupBy(F.pmod(by, F.lit(n)).cast("int").alias("part")).agg(F.sort_array(F.collect_list(value)).alias("values"))
