"""Tables and text formats: voxel CSV and Parquet, object CSV, cell-lattice text, histogram text, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXELS = "x int, y int, z int, v double"


def read_voxels_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOXELS).csv(path)


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_voxels(df: DataFrame, path: str, block: int = 64) -> None:
    """Parquet in blocks of slices: readers of a z range prune folders, then row groups."""
    df.withColumn("zb", F.floor(F.col("z") / block).cast("int")).repartition("zb").sortWithinPartitions("z", "y", "x").write.partitionBy("zb").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Object tables (CSV, glob): the header is the // line with the most commas; rows with another number of fields are
    dropped."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    header = lines.where(F.col("value").startswith("//")).agg(F.max(F.struct(F.size(F.split("value", ",")).alias("n"), "value")).alias("h")).select("h.value").first()[0]  # one row
    if header is None:
        return spark.read.csv(path, header=True, inferSchema=True, mode="DROPMALFORMED")
    names = [n.strip() for n in header.lstrip("/").split(",")]
    parts = F.split("value", r"\s*,\s*")
    rows = lines.where(~F.col("value").startswith("//") & (F.size(parts) == len(names)))
    return rows.select(*[F.trim(F.get(parts, F.lit(i))).try_cast("double").alias(n.lower()) for i, n in enumerate(names)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def read_lattice(spark: SparkSession, path: str) -> DataFrame:
    """Cell-lattice text: lines of eight tokens, the id, the type, then x0 x1 y0 y1 z0 z1; exploded to voxels."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.size(parts) == 8) & F.get(parts, F.lit(0)).rlike(r"^\d+$"))
    at = [F.get(parts, F.lit(i)).try_cast("int") for i in range(2, 8)]
    rows = rows.select(F.get(parts, F.lit(0)).cast("bigint").alias("label"), F.get(parts, F.lit(1)).alias("type"), *[c.alias(n) for c, n in zip(at, ("x0", "x1", "y0", "y1", "z0", "z1"), strict=True)])
    rows = rows.where("x0 is not null and x1 >= x0 and y1 >= y0 and z1 >= z0")
    for k in "xyz":
        rows = rows.withColumn(k, F.explode(F.sequence(F.col(f"{k}0"), F.col(f"{k}1"))))
    return rows.select("x", "y", "z", "label", "type")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(bin, n) of two-column text, other lines skipped."""
    parts = F.split(F.trim("value"), r"[\s,;]+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("double").alias("bin"), F.get(parts, F.lit(1)).try_cast("double").alias("n"))
    return rows.where("bin is not null and n is not null")


def histogram_stats(hist: DataFrame) -> DataFrame:
    """Mean and standard deviation of (bin, n) rows."""
    s = hist.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bin")).alias("s"), F.sum(F.col("n") * F.col("bin") * F.col("bin")).alias("q"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    return s.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))).alias("std"))


def subtract_histogram(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("n", "other"), "bin", "full_outer")
    return both.select("bin", (F.coalesce("n", F.lit(0.0)) - F.coalesce("other", F.lit(0.0))).alias("n"))


def import_table(df: DataFrame, filters: dict[str, str], made: dict[str, str]) -> DataFrame:
    """Named SQL filters, then synthesised columns by SQL expressions."""
    for condition in filters.values():
        df = df.where(condition)
    return df.withColumns({n: F.expr(e) for n, e in made.items()})


def merge_point_sets(sets: list[DataFrame], by: str, weight: str) -> DataFrame:
    """Weighted mean position by key over several tables."""
    rows = sets[0]
    for s in sets[1:]:
        rows = rows.unionByName(s)
    w = F.sum(weight)
    return rows.groupBy(by).agg(w.alias(weight), *[F.try_divide(F.sum(F.col(k) * F.col(weight)), w).alias(k) for k in ("x", "y", "z")])
