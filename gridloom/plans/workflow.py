"""Workflow blocks: functions of named DataFrames, chained; and the pipelines built from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components, grow, kernels, pointwise, shape, stencil

State = dict[str, DataFrame]
Block = Callable[[State], State]


def pipeline(blocks: Sequence[Block], state: State) -> State:
    for block in blocks:
        state = state | block(state)
    return state


def threshold_block(source: str, target: str, low: float, high: float | None = None, flip: bool = False) -> Block:
    def run(s: State) -> State:
        inside = (F.col("v") > low) & (F.lit(True) if high is None else F.col("v") <= high)
        return {target: s[source].withColumn("v", ~inside if flip else inside)}

    return run


def filter_block(source: str, target: str, n: int = 1, r: float = 1.0) -> Block:
    return lambda s: {target: stencil.gaussian(s[source], n, r)}


def resize_block(source: str, target: str, pos: Sequence[int], dim: Sequence[int]) -> Block:
    return lambda s: {target: pointwise.crop(s[source], pos, dim)}


def foam_block(source: str, target: str, low: float, dim: Sequence[int], share: float) -> Block:
    """Threshold, closing, opening, then the components of at least a share of all voxels."""

    def run(s: State) -> State:
        mask = stencil.opening(stencil.closing(pointwise.threshold(s[source], ">", low)))
        least = max(1, int(share * dim[0] * dim[1] * dim[2]))
        return {target: components.label(mask, dim, min_voxels=least)}

    return run


def thickness_block(mask: str, target: str, dim: Sequence[int], pos: Sequence[int] = (0, 0, 0)) -> Block:
    return lambda s: {target: grow.thickness(grow.distance_map(s[mask]), dim, pos)}


def grow_block(labels: str, mask: str, target: str) -> Block:
    return lambda s: {target: grow.kvoronoi(s[labels], s[mask])}


def analyze_phase(mask: DataFrame, dim: Sequence[int], min_voxels: int = 1, offsets: Sequence[kernels.Offset] | None = None) -> State:
    """Label, shape, grown regions, density, contacts: the object table with region columns, and the edge table."""
    labels = components.label(mask, dim, offsets, min_voxels)
    from ..session import written

    labels = written(labels, "labels")  # used five times
    regions = written(grow.kvoronoi(labels, mask.withColumn("v", F.lit(True))), "regions")
    objects = shape.shape_analysis(labels)
    extra = shape.density(labels, regions).select("label", "region_volume", "density")
    edges = shape.contacts(regions.where("label > 0"))
    degree = edges.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("neighbours"))
    table = objects.join(extra, objects["lacuna_number"] == extra["label"], "left").drop("label")
    table = table.join(degree, table["lacuna_number"] == degree["label"], "left").drop("label").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    return {"labels": labels, "regions": regions, "objects": table, "edges": edges}


def phases(values: DataFrame, dim: Sequence[int], bands: Sequence[tuple[str, float, float]]) -> dict[str, State]:
    """analyze_phase for each band of values."""
    return {name: analyze_phase(values.withColumn("v", (F.col("v") > low) & (F.col("v") <= high)), dim) for name, low, high in bands}
