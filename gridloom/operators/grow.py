"""Growth and distance operators: geodesic Voronoi regions, distance maps, thickness, seeds and watershed growth."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import kernels, keyed
from .pointwise import KEYS
from .stencil import spread, stencil


def kvoronoi(labels: DataFrame, mask: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(x, y, z, label, dist): labels grown into a mask along steps of 1, sqrt 2 and sqrt 3; ties take the smaller label.
    Voxels out of reach have label 0 and distance -1. Only voxels improved in a round spread in the next."""
    steps = [d for d in kernels.full() if d != (0, 0, 0)]
    length = F.array(*[F.struct(*[F.lit(c).alias(n) for n, c in zip(("dx", "dy", "dz"), d, strict=True)], F.lit(sqrt(sum(c * c for c in d))).alias("d")) for d in steps])
    where = mask.where("v").select(*KEYS)
    seeds = labels.select(*KEYS, F.col("label").cast("long").alias("label"), F.lit(0.0).alias("dist"), F.lit(True).alias("new"))
    state = written(where.join(seeds, KEYS, "left").select(*KEYS, "label", "dist", F.coalesce("new", F.lit(False)).alias("new")), "grow")
    while not state.where("new").isEmpty():
        front = state.where("new").withColumn("o", F.explode(length))
        offers = front.select(*[(F.col(k) + F.col(f"o.d{k}")).cast("int").alias(k) for k in KEYS], F.struct(F.round(F.col("dist") + F.col("o.d"), 9).alias("dist"), "label").alias("s"))
        if max_distance is not None:
            offers = offers.where(F.col("s.dist") <= max_distance)
        offers = offers.groupBy(*KEYS).agg(F.min("s").alias("s"))
        better = F.col("s").isNotNull() & (F.col("dist").isNull() | (F.col("s.dist") < F.col("dist")) | (F.col("s.dist") == F.col("dist")) & (F.col("s.label") < F.col("label")))
        state = written(
            state.join(offers, KEYS, "left").select(*KEYS, F.when(better, F.col("s.label")).otherwise(F.col("label")).alias("label"), F.when(better, F.col("s.dist")).otherwise(F.col("dist")).alias("dist"), better.alias("new")), "grow"
        )
    return state.select(*KEYS, F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def distance_map(mask: DataFrame) -> DataFrame:
    """(x, y, z, dist): geodesic distance of every true voxel to the background of a dense boolean image."""
    background = mask.where("not v").select(*KEYS, F.lit(1).alias("label"))
    grown = kvoronoi(background, mask.withColumn("v", F.lit(True)))
    return grown.join(mask.where("v").select(*KEYS), KEYS, "left_semi").select(*KEYS, "dist")


def centroids(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(*[F.avg(k).alias(f"c{k}") for k in KEYS])


def cvoronoi(labels: DataFrame, mask: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(x, y, z, label, dist): the label with the nearest centroid, ties to the smaller; 0 and -1 beyond max_distance.
    Voxels and centroids meet in rings of grid cells, which begin at the centroids' mean spacing."""
    from .match import nearest

    found = written(centroids(labels).select(F.col("label").alias("id"), *[F.col(f"c{k}").alias(k) for k in KEYS]), "centroids")
    points = mask.where("v").select(F.struct(*KEYS).alias("id"), *[F.col(k).cast("double").alias(k) for k in KEYS])
    near = nearest(points, found, exclude_same=False)
    best = near.select("id.x", "id.y", "id.z", F.struct("dist", F.col("other").alias("label")).alias("s"))
    far = F.lit(False) if max_distance is None else F.col("s.dist") > max_distance
    return best.select(*KEYS, F.when(far, F.lit(0)).otherwise(F.col("s.label")).alias("label"), F.when(far, F.lit(-1.0)).otherwise(F.col("s.dist")).alias("dist"))


#: Least distance of a ridge voxel, and largest gradient there (fixed values).
MIN_WALL, FLAT = 3.0, 0.45


def ridge(dist: DataFrame, dim: Sequence[int], pos: Sequence[int] = (0, 0, 0), min_wall: float = MIN_WALL, flat: float = FLAT) -> DataFrame:
    """Voxels over min_wall where the mean local gradient of the distance map is at most flat. The mean is over all
    neighbours in the image's box but the voxel itself; where the map has no row the distance is 0."""
    base = dist.select(*KEYS, F.col("dist").alias("v"))
    g = stencil(base, kernels.full(), **{f"g{k}": F.sum(F.col(f"d{k}") * F.col("v")) for k in KEYS}, dist=F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0), F.col("v"))))
    n = F.lit(1)
    for k, p, m in zip(KEYS, pos, dim, strict=True):
        n = n * (1 + (F.col(k) > p).cast("int") + (F.col(k) < p + m - 1).cast("int"))
    steep = F.sqrt(sum((F.col(f"g{k}") ** 2 for k in KEYS), F.lit(0.0)))
    return g.where((F.col("dist") > min_wall) & (steep <= flat * (n - 1))).select(*KEYS, "dist")


def thickness(dist: DataFrame, dim: Sequence[int], pos: Sequence[int] = (0, 0, 0), min_wall: float = MIN_WALL, flat: float = FLAT, sample: int = 1) -> DataFrame:
    """(x, y, z, thickness): the largest radius of a ridge voxel's sphere that covers a voxel of the distance map; 0
    where none does. sample > 1 keeps about one in so many ridge voxels, chosen by hash (a Monte-Carlo variant)."""
    seeds = ridge(dist, dim, pos, min_wall, flat)
    if sample > 1:
        seeds = keyed.sample(seeds, 1 / sample, KEYS)
    r = F.ceil("dist").cast("int")
    painted = seeds
    for k in KEYS:  # the sphere's box, then the sphere: rows are those of the spheres painted
        painted = painted.withColumn(f"p{k}", F.explode(F.sequence(F.col(k) - r, F.col(k) + r)))
    gap = sum(((F.col(f"p{k}") - F.col(k)) * (F.col(f"p{k}") - F.col(k)) for k in KEYS), F.lit(0))
    painted = painted.where(gap < F.col("dist") * F.col("dist")).groupBy(*[F.col(f"p{k}").cast("int").alias(k) for k in KEYS]).agg(F.max("dist").alias("thickness"))
    return dist.where("dist > 0").select(*KEYS).join(painted, KEYS, "left").select(*KEYS, F.coalesce("thickness", F.lit(0.0)).alias("thickness"))


def local_maxima(dist: DataFrame) -> DataFrame:
    """Voxels whose distance no neighbour exceeds."""
    base = dist.select(*KEYS, F.col("dist").alias("v"))
    top = stencil(base, kernels.full(), top=F.max("v"), dist=F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0), F.col("v"))))
    return top.where(F.col("dist") >= F.col("top")).select(*KEYS, "dist")


def seeds(dist: DataFrame, max_overlap: float = 40.0) -> DataFrame:
    """Bubble seeds (x, y, z, dist): maxima in falling order of radius, each kept unless 100 * (r1 + r2 - d) / r2 with a
    kept one reaches max_overlap. Rounds keep every candidate that no stronger open candidate overlaps."""
    peaks = local_maxima(dist).withColumn("id", F.struct((-F.col("dist")).alias("d"), *KEYS))
    open_ = written(peaks, "peaks")
    kept = None
    cell = open_.agg(F.max("dist")).first()[0]
    if cell is None:
        return open_.drop("id")
    cell = max(1.0, 2 * cell)
    grid = [F.floor(F.col(k) / cell) for k in KEYS]

    def beaten(by: DataFrame, rows: DataFrame) -> DataFrame:
        """(id, winner) of rows overlapped by stronger rows of by."""
        left = by.select(*[F.col(k).alias(f"s{k}") for k in KEYS], F.col("dist").alias("r1"), F.col("id").alias("winner"), *[g.alias(f"g{k}") for g, k in zip(grid, KEYS, strict=True)])
        for k in KEYS:
            left = left.withColumn(f"g{k}", F.explode(F.array(F.col(f"g{k}") - 1, F.col(f"g{k}"), F.col(f"g{k}") + 1)))
        right = rows.select("*", *[g.alias(f"g{k}") for g, k in zip(grid, KEYS, strict=True)])
        d = F.sqrt(sum(((F.col(k) - F.col(f"s{k}")) ** 2 for k in KEYS), F.lit(0.0)))
        over = 100 * (F.col("r1") + F.col("dist") - d) / F.col("dist")
        return right.join(left, [f"g{k}" for k in KEYS]).where((F.col("winner") < F.col("id")) & (over >= max_overlap)).select("id", "winner")

    while not open_.isEmpty():
        now = written(open_.join(beaten(open_, open_).select("id").distinct(), "id", "left_anti"), "seeds")
        kept = now if kept is None else kept.unionByName(now)
        rest = open_.join(now.select("id"), "id", "left_anti")
        open_ = written(rest.join(beaten(now, rest).select("id").distinct(), "id", "left_anti"), "peaks")
    return kept.drop("id")


def watershed(dist: DataFrame, labels: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(x, y, z, label): each voxel follows its steepest uphill neighbour (by over threshold; ties to the first offset)
    until a labelled voxel or a peak; 0 if the peak has no label. Chains are halved each round."""
    base = dist.select(*KEYS, F.col("dist").alias("v"))
    here = F.struct((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("z") + F.col("dz")).alias("z"))
    own = (F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0)
    rows = spread(base, kernels.full()).groupBy(*KEYS).agg(F.min(F.struct((-F.col("v")).alias("v"), here.alias("to"))).alias("best"), F.max(F.when(own, F.col("v"))).alias("mine")).where("mine is not null")
    me = F.struct(*[F.col(k).cast("int").alias(k) for k in KEYS])
    to = F.when(-F.col("best.v") > F.col("mine") + threshold, F.struct(*[F.col(f"best.to.{k}").cast("int").alias(k) for k in KEYS])).otherwise(me)
    marked = labels.select(*KEYS, F.col("label").alias("seed"))
    state = rows.join(marked, KEYS, "left").select(me.alias("id"), F.when(F.col("seed").isNotNull(), me).otherwise(to).alias("to"), "seed")
    state = written(state, "flow")
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"))
        new = written(state.join(ahead, "to").select("id", F.col("next").alias("to"), "seed", (F.col("next") != F.col("to")).alias("moved")), "flow")
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    ends = state.select(F.col("id").alias("to"), F.col("seed").alias("label"))
    return state.join(ends, "to").select("id.x", "id.y", "id.z", F.coalesce("label", F.lit(0)).alias("label"))
