"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a target share of the corpus's characters; its mean repetition rate is share * epochs * all characters
/ the source's characters. A document's uniform number, from an MD5 of seed and doc_id, is inverted through the Poisson
distribution of its source's rate; the document is exploded by that count and all copies are put in the global order of
a second MD5.

A rate over PART is the sum of equal parts of at most PART, each with a hashed number of its own: a sum of Poisson numbers
is one of the summed rates. A part's table covers 12 standard deviations on both sides of its mean, and is normalised, so
no rate is too large or too small.

Cases: null source is a source of its own; null doc_id hashes as an empty string; a null or empty text has length 0, and
a source without characters has rate epochs; repeated rows get equal counts, each with its own copies; an empty table
gives an empty result. Input columns named like the added ones (copy_no, shuffle_key) are replaced; others may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, table, written

SEED = 17
#: Target share of a source: its characters to this power, over all sources' sum.
ALPHA = 0.7
EPOCHS = 1.0
#: Rate of a part, at most.
PART = 2048.0


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def shuffle_key(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def poisson_table(rate: Column) -> Column:
    """(first, cumulative) of Poisson(rate): the probabilities of at most first, first + 1, ...; less than 2^-53 lies
    outside."""
    reach = 12 * F.sqrt(rate) + 24
    first = F.greatest(F.lit(0), F.floor(rate - reach)).cast("int")
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("c"), F.array(F.lit(1.0)).alias("a"))

    def step(acc, k):
        w = acc["w"] * rate / k  # weights, in units of the first one's
        return F.struct(w.alias("w"), (acc["c"] + w).alias("c"), F.concat(acc["a"], F.array(acc["c"] + w)).alias("a"))

    cumulative = F.aggregate(F.sequence(first + 1, F.ceil(rate + reach).cast("int")), start, step, lambda acc: F.transform(acc["a"], lambda c: c / acc["c"]))
    return F.struct(first.alias("first"), cumulative.alias("cumulative"))


def poisson_count(u: Column, table_: Column) -> Column:
    """The inverse: how many cumulative probabilities are at or below u."""
    return table_["first"] + F.size(F.filter(table_["cumulative"], lambda c: c <= u))


def source_rates(docs: DataFrame, alpha: float = ALPHA, epochs: float = EPOCHS, weights: dict[str, float] | None = None) -> DataFrame:
    """(mix_source, rate): one row a source. weights, if given, are target shares; sources without one get none."""
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(alpha))
    else:
        total = sum(weights.values())
        weight = F.coalesce(*[F.when(F.col("mix_source") == k, F.lit(w / total)) for k, w in weights.items()], F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    totals = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))  # one row
    return sizes.crossJoin(F.broadcast(totals)).select(
        "mix_source", F.when(F.col("size") > 0, F.col("weight") / F.col("all_weight") * F.lit(epochs) * F.col("all_size") / F.col("size")).otherwise(F.lit(epochs)).alias("rate")
    )


def mix(docs: DataFrame, seed: int = SEED, alpha: float = ALPHA, epochs: float = EPOCHS, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents' columns, copy_no (from 1) and shuffle_key, in shuffled order."""
    docs = docs.drop("copy_no", "shuffle_key")
    rates = source_rates(docs, alpha, epochs, weights).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    own = own_name("mixed", docs.columns)
    # Written, so that Spark knows the size of one row a source, and broadcasts it below its own bound.
    rates = written(rates.select("mix_source", "parts", poisson_table(F.col("rate") / F.col("parts")).alias("table")), "rates").select(F.struct("*").alias(own))
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def drawn(i: Column | None = None) -> Column:
        return poisson_count(uniform(F.lit(str(seed)), ids, *([] if i is None else [i.cast("string")])), F.col(f"{own}.table"))

    more = F.aggregate(F.sequence(F.lit(1), F.col(f"{own}.parts") - 1), F.lit(0), lambda n, i: n + drawn(i))
    count = drawn() + F.when(F.col(f"{own}.parts") > 1, more).otherwise(0)
    counted = docs.join(rates, F.col("source").eqNullSafe(F.col(f"{own}.mix_source"))).withColumn("copy_no", count).drop(own)
    copies = counted.where("copy_no > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copy_no"))))
    copies = copies.withColumn("shuffle_key", shuffle_key(F.lit(f"{seed}s"), ids, F.col("copy_no").cast("string")))
    return copies.orderBy("shuffle_key", "doc_id", "copy_no")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy_no", "shuffle_key", "text")


OP2_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(SUM(COALESCE(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN pow(size, {ALPHA}) / (SELECT SUM(pow(size, {ALPHA})) FROM sizes) * {EPOCHS}
    * (SELECT SUM(size) FROM sizes) / size ELSE {EPOCHS} END AS rate FROM sizes),
cum(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cum
  WHERE k < CAST(ceil(rate + 12 * sqrt(rate) + 24) AS INT)),
drawn AS (
  SELECT doc_id, source, text,
    CAST(CAST('0x' || substr(md5('{SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE)
      / 4503599627370496.0 AS u, row_number() OVER () AS row FROM documents),
counted AS (
  SELECT d.doc_id, d.source, d.text, COUNT(*) AS n FROM drawn d JOIN cum c
    ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY d.row, d.doc_id, d.source, d.text)
SELECT doc_id, source, CAST(copy_no AS INT) AS copy_no,
  CAST('0x' || substr(md5('{SEED}s:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy_no AS VARCHAR)), 1, 15) AS BIGINT)
    AS shuffle_key, text
FROM (SELECT doc_id, source, text, unnest(generate_series(1, n)) AS copy_no FROM counted)
"""
