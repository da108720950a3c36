"""Table scans by SQL text: fields with pseudo-functions, filters with parameters, groups; and changes of stored rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Pseudo-functions of the query language: each in one pass.
PSEUDO = {
    "CR": lambda a, b: f"CASE WHEN COUNT({a}) < 1 THEN 0.0D WHEN COALESCE(STDDEV_POP({a}), 0) = 0 OR COALESCE(STDDEV_POP({b}), 0) = 0 THEN 1.0D ELSE COVAR_POP({a}, {b}) / (STDDEV_POP({a}) * STDDEV_POP({b})) END",
    "VAR": lambda a: f"ABS(VAR_POP({a}))",
    "RAT": lambda a: f"TRY_DIVIDE(VAR_POP({a}), AVG({a}) * AVG({a}))",
}


def rewrite(text: str) -> str:
    """NAME[a;b] as SQL; brackets may be nested."""
    pattern = re.compile(r"\b(CR|VAR|RAT)\[([^\[\]]*)\]", re.IGNORECASE)
    while (new := pattern.sub(lambda m: PSEUDO[m[1].upper()](*[p.strip() for p in m[2].split(";")]), text)) != text:
        text = new
    return text


def scan(df: DataFrame, fields: str, where: str | None = None, group: str | None = None, order: str | None = None, records: int | None = None, args: list | None = None) -> DataFrame:
    """SELECT fields FROM df; ? in where is filled from args by Spark, never by text."""
    spark = df.sparkSession
    sql = f"SELECT {rewrite(fields)} FROM {{source}}" + "".join(f" {word} {rewrite(part)}" for word, part in (("WHERE", where), ("GROUP BY", group), ("ORDER BY", order)) if part)
    if records is not None:
        sql += f" LIMIT {int(records)}"
    if args and "?" in sql:
        names = [f"p{i}" for i in range(len(args))]
        parts = sql.split("?")
        sql = parts[0] + "".join(f":{n}{p}" for n, p in zip(names, parts[1:], strict=True))
        return spark.sql(sql, args=dict(zip(names, args, strict=True)), source=df)
    return spark.sql(sql, source=df)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes: those of its keys replaced, others added. Nothing is changed in place."""
    return base.join(changes.select(key), key, "left_anti").select(*base.columns).unionByName(changes.select(*base.columns))


def update(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with some columns from changes where that has the key and a value."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = base.join(new, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def register(df: DataFrame, name: str, cached: bool = False) -> str:
    """Name a DataFrame for SQL, and keep it in memory and on disk if cached."""
    df.createOrReplaceTempView(name)
    if cached:
        df.sparkSession.catalog.cacheTable(name)
    return name


def unregister(spark: SparkSession, name: str) -> None:
    if spark.catalog.isCached(name):
        spark.catalog.uncacheTable(name)
    spark.catalog.dropTempView(name)


def observed(df: DataFrame, **metrics: Column) -> dict:
    """Metrics gathered while all rows of df go by; the rows themselves go nowhere."""
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.format("noop").mode("overwrite").save()
    return seen.get
