"""Sessions and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(name: str = "gridloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder: iterations survive lost executors. The shuffle files that
    led to the table go as soon as it is there."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, schema, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema, spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of what a DataFrame reads, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def with_rank(df: DataFrame, order: list, name: str = "rank", start: int = 1) -> DataFrame:
    """The rows with their global rank by some columns: ranges are sorted each in a task, and only their sizes, one
    number a range, come to the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = written(sorted_.select(*df.columns, F.monotonically_increasing_id().alias("__place")), "ranked")
    task = F.shiftright("__place", 33)
    sizes = sorted((r["task"], r["n"]) for r in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    offsets, before = [], start
    for t, size in sizes:
        offsets.append((t, before))
        before += size
    offsets = df.sparkSession.createDataFrame(offsets, "__task long, __before long")
    place = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__task", task).join(F.broadcast(offsets), "__task").select(*df.columns, (F.col("__before") + place).alias(name))
