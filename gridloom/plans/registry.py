"""Operators by name, run with parameter strings, and the fluent image wrapper."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components, grow, hist, kernels, pointwise, shape, stencil
from . import params

OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str):
    def add(f):
        OPERATORS[name.lower()] = f
        return f

    return add


def offsets(kernel: int | str = 0, neighborhood: int | tuple = 1, sphradius: float = 1.0) -> list[kernels.Offset]:
    n = max(neighborhood) if isinstance(neighborhood, tuple) else neighborhood
    return kernels.kernel(kernel, n, sphradius)


@dataclass
class Image:
    """Voxels (x, y, z, v) and their box; every method gives a new lazy image or a DataFrame."""

    df: DataFrame
    dim: tuple[int, int, int]
    pos: tuple[int, int, int] = (0, 0, 0)
    log: tuple[str, ...] = ()

    def run(self, name: str, options: str = "") -> Image | DataFrame:
        out = OPERATORS[name.lower()](self, **params.parse(options))
        if isinstance(out, Image):
            out.log = (*self.log, f"{name} {options}".strip())
        return out

    def threshold(self, t: float) -> Image:
        return Image(pointwise.threshold(self.df, ">", t), self.dim, self.pos, (*self.log, f"threshold {t}"))

    def filter(self, options: str = "") -> Image:
        return self.run("Filter", options)

    def component_label(self, options: str = "") -> Image:
        return self.run("ComponentLabel", options)

    def kvoronoi(self, mask: Image) -> DataFrame:
        return grow.kvoronoi(self.df.withColumnRenamed("v", "label"), mask.df)

    def shape_analysis(self) -> DataFrame:
        return shape.shape_analysis(self.df.withColumnRenamed("v", "label"))

    def thickness(self) -> DataFrame:
        return grow.thickness(grow.distance_map(self.df), self.dim, self.pos)

    def write(self, path: str) -> None:
        from ..sources.tables import write_voxels

        write_voxels(self.df, path)


def _like(image: Image, df: DataFrame, dim: Sequence[int] | None = None, pos: Sequence[int] | None = None) -> Image:
    return Image(df, tuple(dim or image.dim), tuple(pos or image.pos))


@operator("Filter")
def _filter(image: Image, filter: int = 1, upfactor=(1, 1, 1), downfactor=(1, 1, 1), radius: float = 1.0, neighborhood: int = 1) -> Image:  # noqa: A002
    """filter: 0 nearest, 1 Gaussian, 2 gradient, 3 Laplace, 4 median; factors scale the image."""
    df = {0: lambda d: d, 1: lambda d: stencil.gaussian(d, neighborhood, radius), 2: lambda d: stencil.gradient(d, neighborhood), 3: lambda d: stencil.laplace(d, neighborhood), 4: lambda d: stencil.median(d, neighborhood)}[filter](image.df)
    up, down = upfactor[0], downfactor[0]
    if up == down:
        return _like(image, df)
    return _like(image, stencil.filter_scale(df, image.dim, up, down, radius), [n * up // down for n in image.dim])


@operator("Morpho")
def _morpho(image: Image, operation: str = "close", occupancy: float = 1.0, iterations: int = 1, **kernel) -> Image:
    at = offsets(**kernel)
    run = {"dilate": lambda: stencil._many(image.df, [stencil.dilate] * iterations, at, occupancy), "erode": lambda: stencil._many(image.df, [stencil.erode] * iterations, at, occupancy), "open": lambda: stencil.opening(image.df, at, occupancy, iterations), "close": lambda: stencil.closing(image.df, at, occupancy, iterations)}
    return _like(image, run[operation]())


@operator("ComponentLabel")
def _label(image: Image, minsize: int = 1, maxsize: int | None = None, relabel: bool = True, **kernel) -> Image:
    out = components.label(image.df, image.dim, offsets(**kernel), minsize, maxsize, relabel)
    return _like(image, out.withColumnRenamed("label", "v"))


@operator("Resize")
def _resize(image: Image, pos=(0, 0, 0), dim=None, find_edges: bool = False) -> Image:
    if find_edges:
        r = pointwise.find_edges(image.df).first()
        pos, dim = [r[f"pos_{k}"] for k in "xyz"], [r[f"dim_{k}"] for k in "xyz"]
    return _like(image, pointwise.crop(image.df, pos, dim or image.dim), dim, pos)


@operator("Peel")
def _peel(image: Image, layers: int = 1, **kernel) -> Image:
    return _like(image, stencil.peel(image.df, layers, offsets(**kernel)))


@operator("kVoronoi")
def _kvoronoi(image: Image, maxdistance: float | None = None) -> DataFrame:
    labels = image.df.where("v > 0").withColumnRenamed("v", "label")
    return grow.kvoronoi(labels, image.df.withColumn("v", F.lit(True)), maxdistance)


@operator("cVoronoi")
def _cvoronoi(image: Image, maxdistance: float | None = None) -> DataFrame:
    return grow.cvoronoi(image.df.where("v > 0").withColumnRenamed("v", "label"), image.df.withColumn("v", F.lit(True)), maxdistance)


@operator("HildThickness")
def _hild(image: Image, minwall: float = grow.MIN_WALL, flat: float = grow.FLAT) -> DataFrame:
    return grow.thickness(grow.distance_map(image.df), image.dim, image.pos, minwall, flat)


@operator("MCThickness")
def _monte_carlo(image: Image, minwall: float = grow.MIN_WALL, flat: float = grow.FLAT, skip: int = 4) -> DataFrame:
    return grow.thickness(grow.distance_map(image.df), image.dim, image.pos, minwall, flat, skip)


@operator("DistLabel")
def _dist_label(image: Image, maxoverlap: float = 40.0) -> DataFrame:
    return grow.seeds(image.df.withColumnRenamed("v", "dist"), maxoverlap)


@operator("DistGrow")
def _dist_grow(image: Image, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    return grow.watershed(image.df.withColumnRenamed("v", "dist"), labels, threshold)


@operator("XDF")
def _xdf(image: Image, length: int = 3, mincount: int = 5, skip: int = 1) -> DataFrame:
    return hist.correlation(image.df, length, mincount, sample=skip)


@operator("ShapeAnalysis")
def _shape(image: Image) -> DataFrame:
    return image.shape_analysis()


@operator("GrayAnalysis")
def _gray(image: Image, values: DataFrame, threshold: float | None = None) -> DataFrame:
    return shape.gray_stats(image.df.withColumnRenamed("v", "label"), values, threshold)


@operator("GrayAnalysis2D")
def _gray2d(image: Image, a: str = "cyl_r", b: str = "z", abins=(0, 10, 10), bbins=(0, 10, 10)) -> DataFrame:
    return hist.histogram2d(image.df, pointwise.position(a), pointwise.position(b), (abins, bbins))


@operator("Neighbors")
def _neighbours(image: Image, **kernel) -> DataFrame:
    return shape.contacts(image.df.withColumnRenamed("v", "label"), offsets(**kernel))


@operator("EasyContour")
def _contour(image: Image, mode: str = "circle", bins: int = 16) -> DataFrame:
    from ..operators.contour import contour

    return contour(image.df, mode, bins)


@operator("FractalDimension")
def _fractal(image: Image) -> DataFrame:
    return hist.box_counts(image.df, image.dim)


@operator("JDZ")
def _tiles(image: Image, z: int = 0, levels: int = 3) -> DataFrame:
    return pointwise.tiles(pointwise.plane(image.df, ("x", "y"), z).select(F.col("row").alias("x"), F.col("col").alias("y"), "v"), levels)


@dataclass(frozen=True)
class Plugin:
    """An implementation of a named operator: the most voxels that it holds (None: any), its speed, and how it runs."""

    name: str
    kind: str
    most_voxels: int | None
    speed: int
    run: Callable[..., DataFrame]


#: Voxels that a plug-in in one task holds, at most.
LOCAL_VOXELS = 1 << 24
PLUGINS: list[Plugin] = []


def best(name: str, voxels: int, kind: str | None = None) -> Plugin:
    """Of the plug-ins of a name (and kind) that hold so many voxels the fastest."""
    able = [p for p in PLUGINS if p.name.lower() == name.lower() and (p.most_voxels is None or voxels <= p.most_voxels) and kind in (None, p.kind)]
    if not able:
        raise KeyError(f"no plug-in {name} for {voxels} voxels")
    return max(able, key=lambda p: p.speed)


def _label_in_task(image: Image, kernel: int | str = 0) -> DataFrame:
    """(x, y, z, label): components of a small image in one task, by label minima over shifted arrays."""
    import numpy as np
    import pandas as pd

    (nx, ny, nz), (x0, y0, z0), at = image.dim, image.pos, kernels.forward(offsets(kernel))

    def run(frames):
        on = np.zeros((nx, ny, nz), dtype=bool)
        for f in frames:
            on[f["x"] - x0, f["y"] - y0, f["z"] - z0] = True
        x, y, z = np.indices(on.shape)
        label = np.where(on, x + nx * (y + ny * z) + 1, 0)
        while True:
            new = label.copy()
            for d in at:
                a = tuple(slice(max(c, 0), n + min(c, 0)) for c, n in zip(d, on.shape, strict=True))
                b = tuple(slice(max(-c, 0), n + min(-c, 0)) for c, n in zip(d, on.shape, strict=True))
                both = on[a] & on[b]
                least = np.minimum(new[a], new[b])
                new[a] = np.where(both, least, new[a])
                new[b] = np.where(both, np.minimum(least, new[b]), new[b])
            if (new == label).all():
                break
            label = new
        x, y, z = np.nonzero(label)
        yield pd.DataFrame({"x": x + x0, "y": y + y0, "z": z + z0, "label": label[x, y, z]})

    return image.df.where("v").select("x", "y", "z").coalesce(1).mapInPandas(run, "x int, y int, z int, label long")


PLUGINS += [
    Plugin("ComponentLabel", "local", LOCAL_VOXELS, 10, _label_in_task),
    Plugin("ComponentLabel", "spark", None, 5, lambda image, kernel=0: components.label(image.df, image.dim, offsets(kernel))),
    *[Plugin(n, "spark", None, 5, f) for n, f in OPERATORS.items() if n != "componentlabel"],
]


def run_all(images: dict[str, Image], name: str, options: str = "") -> dict[str, Image]:
    """A named operator on every image of a set."""
    return {k: image.run(name, options) for k, image in images.items()}


def statistics(images: dict[str, Image]) -> DataFrame:
    """(name, n, min, mean, max, std) of a set of images, in one aggregation."""
    rows = None
    for k, image in images.items():
        part = image.df.select(F.lit(k).alias("name"), F.col("v").cast("double").alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"))
