"""Images by path: the reader or writer is chosen by the path's ending, as are slices and stored images."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pointwise
from . import images, tables


def read_image(spark: SparkSession, path: str, kind: str = "double", reader=None) -> DataFrame:
    """Voxels (x, y, z, v) of a Parquet or CSV table of voxels, else of an image file or folder."""
    low = path.rstrip("/").lower()
    if low.endswith(".parquet"):
        return tables.read_voxels(spark, path).select("x", "y", "z", "v")
    if low.endswith(".csv"):
        return tables.read_voxels_csv(spark, path)
    return images.read_volume(spark, path, kind=kind, reader=reader)


def write_image(df: DataFrame, path: str, nx: int = 0, ny: int = 0, dtype: str = "f8") -> None:
    """Write by the path's ending: .parquet, .csv, or a folder of slices as .tif or .raw (folder that executors mount)."""
    low = path.rstrip("/").lower()
    if low.endswith(".parquet"):
        tables.write_voxels(df, path)
    elif low.endswith(".csv"):
        df.select("x", "y", "z", "v").write.csv(path)
    else:
        to = "raw" if low.endswith("raw") else "tif"
        images.export_files(images.encode_slices(pointwise.to_slices(df, nx, ny), nx, dtype, to), path.removeprefix("file://"))


def read_slice(spark: SparkSession, path: str, z: int) -> DataFrame:
    """(x, y, v) of one slice of a folder written by write_image; other files are not opened."""
    pages = images.decode(images.image_files(spark, path, f"slice{z:06d}.*"))
    rows = pages.select("nx", F.posexplode("data").alias("i", "v"))
    return rows.select((F.col("i") % F.col("nx")).cast("int").alias("x"), F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), "v")


def distribute(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """Voxels of an image that the driver holds, z first: a row a slice is sent, as bytes."""
    rows = [(z, np.ascontiguousarray(p, "<f8").tobytes()) for z, p in enumerate(array)]
    ny, nx = array.shape[1:]
    sent = spark.createDataFrame(rows, "z int, content binary").select(F.col("z").cast("string").alias("path"), "content")
    pages = images.decode(sent, images.raw_reader(nx, ny, "<f8"))
    out = pages.select(F.col("path").cast("int").alias("z"), F.posexplode("data").alias("i", "v"))
    return out.select((F.col("i") % nx).cast("int").alias("x"), F.floor(F.col("i") / nx).cast("int").alias("y"), "z", "v")


def save_object(df: DataFrame, path: str, dim: Sequence[int], pos: Sequence[int] = (0, 0, 0), element: Sequence[float] = (1.0, 1.0, 1.0)) -> None:
    """An image with its geometry: the voxels, and one row beside them."""
    df.write.parquet(f"{path}/voxels")
    df.sparkSession.createDataFrame([(list(map(int, pos)), list(map(int, dim)), list(map(float, element)))], "pos array<int>, dim array<int>, element array<double>").coalesce(1).write.parquet(f"{path}/geometry")


def read_object(spark: SparkSession, path: str) -> tuple[DataFrame, tuple, tuple, tuple]:
    """(voxels, pos, dim, element size) of a stored image."""
    g = spark.read.parquet(f"{path}/geometry").first()
    return spark.read.parquet(f"{path}/voxels"), tuple(g["pos"]), tuple(g["dim"]), tuple(g["element"])
