"""Image files: folders of TIFF, raw and ISQ volumes read through Spark's binaryFile source, and writers.

Readers take any path Spark reads (binaryFile); only decoding is Python, one file a row. Writers make one TIFF or raw
record for each slice in Arrow batches and store the bytes as a table; export_files() puts them where a path is local.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import with_rank, written

#: TIFF tags and field types (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
DTYPE = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def read_tiff(raw: bytes) -> list[np.ndarray]:
    """Pages of a baseline TIFF: one sample a pixel (or the mean of several), stored plain, PackBits or deflate."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    at, pages = struct.unpack(order + "I", raw[4:8])[0], []
    while at:
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            size = FIELD_SIZE.get(kind, 1) * count
            where = at + 2 + 12 * i + 8
            if size > 4:
                (where,) = struct.unpack_from(order + "I", raw, where)
            if kind in FIELD_CODE:
                tags[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", raw, where)
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        samples = tags.get(SAMPLES, (1,))[0]
        dtype = np.dtype(order + DTYPE[(tags.get(BITS, (8,))[0], tags.get(SAMPLE_FORMAT, (1,))[0])])
        strips = [raw[o : o + b] for o, b in zip(tags[STRIP_OFFSETS], tags[STRIP_BYTES], strict=True)]
        how = tags.get(COMPRESSION, (1,))[0]
        if how == 32773:
            strips = [packbits(s) for s in strips]
        elif how in (8, 32946):
            import zlib

            strips = [zlib.decompress(s) for s in strips]
        elif how != 1:
            raise ValueError(f"TIFF compression {how} is not supported")
        page = np.frombuffer(b"".join(strips), dtype)[: width * height * samples].reshape(height, width, samples)
        pages.append(page[..., 0] if samples == 1 else page.mean(axis=2))
    return pages


def write_tiff(page: np.ndarray) -> bytes:
    """A one-page little-endian TIFF, stored plain."""
    page = np.ascontiguousarray(page)
    bits, kind = page.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
    data = page.astype(page.dtype.newbyteorder("<")).tobytes()
    tags = [(WIDTH, 4, page.shape[1]), (HEIGHT, 4, page.shape[0]), (BITS, 3, bits), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (STRIP_OFFSETS, 4, 8), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, page.shape[0]), (STRIP_BYTES, 4, len(data)), (SAMPLE_FORMAT, 3, kind)]
    pad = b"\0" * (len(data) % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(data + pad)) + data + pad + ifd


def read_isq(raw: bytes) -> list[np.ndarray]:
    """ISQ: dimensions at byte 44, data offset in 512-byte blocks at byte 508, then 16-bit slices."""
    nx, ny, nz = struct.unpack_from("<3i", raw, 44)
    (blocks,) = struct.unpack_from("<i", raw, 508)
    return list(np.frombuffer(raw, "<i2", nx * ny * nz, (blocks + 1) * 512).reshape(nz, ny, nx))


def write_isq(slices: np.ndarray) -> bytes:
    """An ISQ volume of 16-bit slices: the header's dimensions and one block before the data."""
    head = bytearray(1024)
    struct.pack_into("<3i", head, 44, *slices.shape[::-1])
    struct.pack_into("<i", head, 508, 1)
    return bytes(head) + slices.astype("<i2").tobytes()


def raw_reader(nx: int, ny: int, dtype: str) -> Callable[[bytes], list[np.ndarray]]:
    return lambda raw: list(np.frombuffer(raw, dtype).reshape(-1, ny, nx))


READERS: dict[str, Callable[[bytes], list[np.ndarray]]] = {"tif": read_tiff, "tiff": read_tiff, "isq": read_isq}


def decode(files: DataFrame, reader: Callable[[bytes], list[np.ndarray]] | None = None) -> DataFrame:
    """(path, page, nx, ny, data) of rows (path, content), by extension unless a reader is given."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                read = reader or READERS[path.rsplit(".", 1)[-1].lower()]
                rows += [(path, i, p.shape[1], p.shape[0], p.astype(float).ravel()) for i, p in enumerate(read(bytes(content)))]
            yield pd.DataFrame(rows, columns=["path", "page", "nx", "ny", "data"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, nx int, ny int, data array<double>")


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def stack(pages: DataFrame) -> DataFrame:
    """(z, nx, ny, data): slices in the order of path and page. The pages are decoded once and written; the rank needs
    their names only."""
    pages = written(pages, "pages")
    names = with_rank(pages.select("path", "page"), ["path", "page"], "z", 0)
    return names.join(pages, ["path", "page"]).select(F.col("z").cast("int").alias("z"), "nx", "ny", "data")


def frames_by_name(pages: DataFrame, pattern: str = r"(\d+)(?!.*\d)") -> DataFrame:
    """(t, nx, ny, data): the frame's number is the last one in its name."""
    return pages.select(F.regexp_extract("path", pattern, 1).try_cast("double").alias("t"), "nx", "ny", "data")


def read_volume(spark: SparkSession, path: str, pattern: str = "*", kind: str = "double", reader=None) -> DataFrame:
    """Voxels (x, y, z, v) of an image file or folder: kind is double, label (bigint) or binary (v > 0)."""
    slices = stack(decode(image_files(spark, path, pattern), reader))
    rows = slices.select("z", "nx", F.posexplode("data").alias("i", "v"))
    v = {"double": F.col("v"), "label": F.col("v").cast("bigint"), "binary": F.col("v") > 0}[kind]
    return rows.select((F.col("i") % F.col("nx")).cast("int").alias("x"), F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), "z", v.alias("v"))


def encode_slices(slices: DataFrame, nx: int, dtype: str = "f4", to: str = "tif") -> DataFrame:
    """(name, content) of dense slices (z, data)."""

    def run(frames):
        for f in frames:
            pages = [np.asarray(d, dtype=float).reshape(-1, nx).astype(dtype) for d in f["data"]]
            yield pd.DataFrame({"name": [f"slice{z:06d}.{to}" for z in f["z"]], "content": [write_tiff(p) if to == "tif" else p.tobytes() for p in pages]})

    return slices.select("z", "data").mapInPandas(run, "name string, content binary")


def export_files(encoded: DataFrame, folder: str) -> None:
    """Write each (name, content) row as a file of a folder that all executors mount."""

    def save(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, r["name"]), "wb") as f:
                f.write(r["content"])

    encoded.foreachPartition(save)
