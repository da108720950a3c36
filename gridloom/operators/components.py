"""Connected components by alternating large-star and small-star, and component labelling of images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import with_rank, written
from . import kernels
from .pointwise import KEYS, linear_index
from .stencil import offsets_column


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    out = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the smallest node of its component. Each round is written
    to the shared folder; only a count and a checksum come to the driver. Links of a node to itself give no row."""

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        edges = written(_star(_star(edges, large=True), large=False), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def adjacency(df: DataFrame, offsets: Sequence[kernels.Offset]) -> DataFrame:
    """(a, b) of voxels (x, y, z, id) that are neighbours: each pair once, by equi-joins on shifted keys."""
    shifted = df.withColumn("o", F.explode(offsets_column(kernels.forward(list(offsets)))))
    shifted = shifted.select(*[(F.col(k) + F.col(f"o.d{k}")).cast("int").alias(k) for k in KEYS], F.col("id").alias("a"))
    return shifted.join(df.select(*KEYS, F.col("id").alias("b")), KEYS).select("a", "b")


def label(df: DataFrame, dim: Sequence[int], offsets: Sequence[kernels.Offset] | None = None, min_voxels: int = 1, max_voxels: int | None = None, relabel: bool = False) -> DataFrame:
    """(x, y, z, label) of an image's true voxels: label is 1 + the smallest linear index of the component.

    min_voxels and max_voxels filter by size; relabel numbers components from 1, largest first, ties by label.
    """
    ids = df.where("v").select(*KEYS, linear_index(dim[0], dim[1]).alias("id"))
    roots = components(adjacency(ids, offsets or kernels.full()))
    out = ids.join(roots, F.col("id") == F.col("node"), "left").select(*KEYS, (F.coalesce("root", "id") + 1).alias("label"))
    if min_voxels > 1 or max_voxels is not None or relabel:
        sizes = out.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_voxels)
        if max_voxels is not None:
            sizes = sizes.where(F.col("n") <= max_voxels)
        if relabel:
            sizes = with_rank(sizes, [F.desc("n"), "label"])
        out = out.join(sizes, "label").select(*KEYS, F.col("rank" if relabel else "label").alias("label"))
    return out


def largest(labels: DataFrame) -> DataFrame:
    """The label with the most voxels, the smaller one on a tie, and its count."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.orderBy(F.desc("n"), "label").limit(1)


def group_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def label_slices(df: DataFrame, dim: Sequence[int]) -> DataFrame:
    """Labels within each slice on its own."""
    return label(df, dim, [d for d in kernels.full() if d[2] == 0])
