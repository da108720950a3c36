"""Streams of frames and events: windowed aggregates, flat-field correction, background subtraction, tracking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mean values below which a frame is a dark, and below which it is a projection; else a flat (fixed values).
DARK_BELOW, PROJECTION_BELOW = 700.0, 1750.0


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def binary_stream(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)


def random_frames(spark: SparkSession, nx: int, ny: int, per_second: int = 5) -> DataFrame:
    """Synthetic frames from the rate source."""
    data = F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda i: (F.pmod(F.xxhash64(F.col("value"), i), F.lit(1000)) / 1000.0))
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("timestamp").alias("ts"), F.col("value").alias("frame"), data.alias("data"))


def frame_stats(frames: DataFrame, data: str = "data") -> DataFrame:
    total = F.aggregate(data, F.lit(0.0), lambda a, v: a + v)
    return frames.withColumns({"min": F.array_min(data), "mean": total / F.size(data), "max": F.array_max(data)})


def frame_kind(mean: Column) -> Column:
    return F.when(mean < DARK_BELOW, "dark").when(mean < PROJECTION_BELOW, "projection").otherwise("flat")


def mean_frame(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pixel-wise mean of frames: pixels are exploded and pre-aggregated, so no task collects frames."""
    pixels = frames.select(*(by or []), F.posexplode("data").alias("i", "v"))
    means = pixels.groupBy(*(by or []), "i").agg(F.avg("v").alias("v"))
    return means.groupBy(*(by or [])).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("data"))


def flat_field(frames: DataFrame) -> DataFrame:
    """(frame, data): projections corrected by (p - dark) / (flat - dark) with the batch's mean dark and flat frames.
    Without darks dark is 0; without flats flat is the projection's largest value."""
    kinds = frame_stats(frames).withColumn("kind", frame_kind(F.col("mean")))
    means = mean_frame(kinds.where("kind <> 'projection'"), ["kind"])
    one = means.agg(F.max(F.when(F.col("kind") == "dark", F.col("data"))).alias("dark"), F.max(F.when(F.col("kind") == "flat", F.col("data"))).alias("flat"))
    rows = kinds.where("kind = 'projection'").crossJoin(F.broadcast(one))  # one row of two frames
    n = F.size("data")
    dark = F.coalesce("dark", F.array_repeat(F.lit(0.0), n))
    flat = F.coalesce("flat", F.array_repeat(F.col("max").cast("double"), n))
    span = F.zip_with(flat, dark, lambda a, b: a - b)
    return rows.select("frame", F.zip_with(F.zip_with("data", dark, lambda p, d: p - d), span, lambda a, s: F.when(s != 0, a / s).otherwise(F.lit(0.0))).alias("data"))


def sinograms(projections: DataFrame, nx: int) -> DataFrame:
    """(row, frame, data): projections transposed to sinograms, one image row of each projection."""
    rows = projections.select("frame", F.posexplode("data").alias("i", "v"))
    rows = rows.groupBy(F.floor(F.col("i") / nx).cast("int").alias("row"), "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("data"))
    return rows


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append"):
    """Apply a batch transform to every micro-batch; a batch's folder is overwritten if it is run again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, key: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean by (sliding) event-time window and key, with a watermark that bounds the state."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if stream.isStreaming else stream
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total", "mean")


def subtract_background(frames: DataFrame, limit: float = 20.0) -> DataFrame:
    """Frames minus the batch's mean frame, with the mean absolute difference as score; outliers beyond limit stay."""
    mean = mean_frame(frames).select(F.col("data").alias("background"))
    rows = frames.crossJoin(F.broadcast(mean)).withColumn("data", F.zip_with("data", "background", lambda a, b: a - b)).drop("background")
    score = F.aggregate("data", F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size("data")
    return rows.withColumn("score", score).where(F.col("score") > limit)


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """State accumulated over all batches: an aggregate for complete or update mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max("ts").alias("last"))


def track_cells(frames: DataFrame, threshold: float, nx: int) -> DataFrame:
    """(frame, label, n, x, y): objects of each frame over the threshold, labelled frame by frame by 4-neighbours."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for f in batches:
            out = []
            for frame, data in zip(f["frame"], f["data"], strict=True):
                image = np.asarray(data, dtype=float).reshape(-1, nx) > threshold
                label = np.where(image, np.arange(1, image.size + 1).reshape(image.shape), 0)
                while True:
                    grown = label.copy()
                    for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:, 1:], np.s_[:, :-1])):
                        for p, q in ((a, b), (b, a)):
                            both = image[p] & image[q]
                            grown[p] = np.where(both, np.minimum(grown[p], grown[q]), grown[p])
                    if (grown == label).all():
                        break
                    label = grown
                ys, xs = np.nonzero(label)
                rows = pd.DataFrame({"frame": frame, "label": label[ys, xs], "x": xs, "y": ys})
                out.append(rows.groupby(["frame", "label"], as_index=False).agg(n=("x", "size"), x=("x", "mean"), y=("y", "mean")))
            yield pd.concat(out) if out else pd.DataFrame({"frame": [], "label": [], "n": [], "x": [], "y": []})

    return frames.select("frame", "data").mapInPandas(run, "frame long, label long, n long, x double, y double")


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, n) of each key's session: events less than a gap apart, as a batch or a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
