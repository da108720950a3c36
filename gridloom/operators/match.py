"""Matching and tracking of objects, nearest neighbours, chains over time, k-means."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .pointwise import KEYS


def nearest(a: DataFrame, b: DataFrame, cell: float | None = None, exclude_same: bool = True) -> DataFrame:
    """(id, other, dist): for each point (id, x, y, z) of a the nearest of b, with another id if exclude_same is set;
    ties to the smaller. The first cells' width is b's mean spacing unless given.

    Points meet by grid cells. Rings of cells grow by doubling until a point's best distance is within the searched
    ring, so the answer is exact; points still open when a ring covers all of b's box have seen all of b.
    """
    box = b.agg(*[F.min(k).alias(f"lo{k}") for k in KEYS], *[F.max(k).alias(f"hi{k}") for k in KEYS], F.count("*").alias("n")).first()
    if box["lox"] is None:
        return a.select("id").limit(0).select("id", F.col("id").alias("other"), F.lit(0.0).alias("dist"))
    span = a.agg(*[F.min(k).alias(f"lo{k}") for k in KEYS], *[F.max(k).alias(f"hi{k}") for k in KEYS]).first()
    reach = max([max(abs(span[f"hi{k}"] - box[f"lo{k}"]), abs(box[f"hi{k}"] - span[f"lo{k}"])) for k in KEYS] if span["lox"] is not None else [0])
    if cell is None:
        sides = [max(float(box[f"hi{k}"] - box[f"lo{k}"]), 1e-9) for k in KEYS]
        cell = (sides[0] * sides[1] * sides[2] / box["n"]) ** (1 / 3)
    cell = max(cell, reach / 2**40, 1e-12)
    open_, done = a.select("id", *KEYS), None
    while True:
        left = open_
        right = b.select(F.col("id").alias("other"), *[F.col(k).alias(f"o{k}") for k in KEYS])
        for k in KEYS:
            g = F.floor(F.col(k) / cell)
            left = left.withColumn(f"g{k}", F.explode(F.array(g - 1, g, g + 1)))
            right = right.withColumn(f"g{k}", F.floor(F.col(f"o{k}") / cell))
        dist = F.sqrt(sum(((F.col(k) - F.col(f"o{k}")) ** 2 for k in KEYS), F.lit(0.0)))
        best = left.join(right, [f"g{k}" for k in KEYS]).where(F.col("id") != F.col("other") if exclude_same else F.lit(True)).groupBy("id").agg(F.min(F.struct(dist.alias("dist"), "other")).alias("s"))
        whole = cell >= reach
        sure = best if whole else best.where(F.col("s.dist") <= cell)
        sure = written(sure.select("id", F.col("s.other").alias("other"), F.col("s.dist").alias("dist")), "near")
        done = sure if done is None else done.unionByName(sure)
        if whole:
            break
        open_ = written(open_.join(sure, "id", "left_anti"), "open")
        if open_.isEmpty():
            break
        cell *= 2
    return done


def match_frames(a: DataFrame, b: DataFrame, max_distance: float, volume_penalty: float = 5000.0) -> DataFrame:
    """(a, b, match_dist, bij_matched): the best of b for each of a within max_distance by sqrt(squared distance +
    penalty^2 where volumes differ by over half), ties to the smaller, and whether the choice is mutual. Objects are
    (id, x, y, z, volume)."""
    best = written(_cheapest(a, b, max_distance, volume_penalty), "best")
    chosen = b.join(best.select(F.col("other").alias("id")).distinct(), "id", "left_semi")
    back = _cheapest(chosen, a, max_distance, volume_penalty).select(F.col("id").alias("b"), F.col("cost").alias("back_cost"), F.col("other").alias("back"))
    pairs = best.select(F.col("id").alias("a"), F.col("other").alias("b"), "cost").join(back, "b")
    return pairs.select("a", "b", F.sqrt("cost").alias("match_dist"), ((F.col("back") == F.col("a")) & (F.col("back_cost") == F.col("cost"))).alias("bij_matched"))


#: Open places times objects that the last search may meet at once.
ALL_PAIRS = 1 << 22
#: Objects in the fullest of the first search's cells, about.
CELL_OBJECTS = 16
#: Width of a band of volumes' logarithms: those that do not differ by over half are within ln(5 / 3), 0.511.
BAND = 0.52


def _cheapest(of: DataFrame, among: DataFrame, max_distance: float, volume_penalty: float) -> DataFrame:
    """(id, other, cost): for each object the cheapest of the others, as match_frames has it.

    Objects at one place with one volume search, and are found, as one. Cells begin with few objects and double until
    the cheapest is within the searched distance. Objects whose volumes do not differ meet first, by bands of volume;
    those that find none cheaper than the penalty then meet the others.
    """
    place, penalty = [*KEYS, "volume"], float(volume_penalty) ** 2
    finite = " and ".join(f"abs({k}) < double('infinity')" for k in KEYS)
    of, among = of.where(finite).select("id", *place), among.where(finite).select("id", *place)
    targets = written(among.groupBy(*place).agg(F.min("id").alias("other")), "targets")
    none = F.when(F.lit(False), F.struct(F.lit(0.0).alias("cost"), F.lit(None).cast(among.schema["id"].dataType).alias("other")))
    places = written(of.select(*place).distinct().withColumn("best", none), "open")
    differ = F.abs(F.col("volume") - F.col("ovolume")) / F.greatest((F.col("volume") + F.col("ovolume")) / 2, F.lit(1e-12)) > 0.5
    cost = F.when(differ, F.lit(penalty)).otherwise(F.lit(0.0))
    alike = _search(places, targets, max_distance, cost, 0.0, F.coalesce(~differ, F.lit(True)))
    cheap = F.coalesce(F.col("best.cost") < penalty, F.lit(False))
    found = alike.where(cheap).unionByName(_search(alike.where(~cheap), targets, max_distance, cost, penalty)).where("best is not null")
    found = found.select(*[F.col(k).alias(f"o{k}") for k in place], "best")
    rows = of.join(found, [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in place])
    return rows.groupBy("id").agg(F.min("best").alias("best")).select("id", "best.other", "best.cost")


def _search(open_: DataFrame, targets: DataFrame, max_distance: float, cost: Column, least: float, alike: Column | None = None) -> DataFrame:
    """The open places (x, y, z, volume, best) with the cheapest of the targets within max_distance; by bands of volume
    if only alike ones are met. Targets that are met cost their squared distance and least, or more."""
    sizes = lambda d: d.agg(F.count("*").alias("n"), *[F.max(F.abs(k)).alias(k) for k in KEYS], F.count_if(F.col("volume").isNull()).alias("nulls")).first()
    there, here = sizes(targets), sizes(open_)
    if not there["n"] or not here["n"]:
        return open_
    low = F.greatest(F.least(F.col("volume").cast("double"), F.lit(1e300)), F.lit(1e-10))
    band, every, null = F.floor(F.log(low) / BAND), F.lit(-(1 << 40)), F.lit(1 << 40)  # a null volume is like any other
    if alike is None:
        bands, own = F.array(F.lit(0)), F.array(F.lit(0))
    else:
        bands = F.array(band - 1, band, band + 1, *[every] * (here["nulls"] > 0))
        bands = F.when(F.col("volume").isNull(), F.array(every, null)).otherwise(bands)
        own = F.when(F.col("volume").isNull(), F.array(every)).otherwise(F.array(band, *[null] * (there["nulls"] > 0)))

    def width(level: int) -> float:
        return max(2.002 * max_distance / 2**level, 1e-12)

    def cell(k: str, level: int, by: float = 0.0) -> Column:
        return F.floor(F.greatest(F.least(F.col(k) / width(level), F.lit(2.0**40)), F.lit(-(2.0**40))) + by)

    far = max(float(r[k]) for r in (here, there) for k in KEYS)
    deepest = max(0, min(30, int(math.log2(max(max_distance, 1e-12) * 2**30 / far)))) if far else 30
    level, left, done = 0, here["n"], None
    while left * there["n"] > ALL_PAIRS and level < deepest:
        full = targets.groupBy(*[cell(k, level).alias(f"g{k}") for k in KEYS], F.lit(0) if alike is None else band).count().agg(F.max("count")).first()[0]
        if full <= CELL_OBJECTS:
            break
        level = min(deepest, level + max(1, math.ceil(math.log2(full / CELL_OBJECTS) / 3)))
    while left:
        if left * there["n"] <= ALL_PAIRS:
            level = 0
        reach = max_distance / 2**level
        # A cell is over twice as wide as the reach, so a place's ball is in its own cells and the nearer next ones.
        near = open_.select(*open_.columns[:-1], F.explode(own).alias("g"))
        right = targets.select(*[F.col(k).alias(f"o{k}") for k in (*KEYS, "volume")], "other", *[cell(k, level).alias(f"g{k}") for k in KEYS], F.explode(bands).alias("g"))
        for k in KEYS:
            near = near.withColumn(f"g{k}", F.explode(F.array(cell(k, level, -0.5), cell(k, level, 0.5))))
        d2 = sum(((F.col(k) - F.col(f"o{k}")) ** 2 for k in KEYS), F.lit(0.0))
        met = near.join(right, ["g", *[f"g{k}" for k in KEYS]]).where(d2 <= reach**2)
        met = met if alike is None else met.where(alike)
        rows = open_.unionByName(met.select(*KEYS, "volume", F.struct((d2 + cost).alias("cost"), "other").alias("best")))
        state = written(rows.groupBy(*KEYS, "volume").agg(F.min("best").alias("best")), "met")
        sure = F.lit(True) if level == 0 else F.coalesce(F.col("best.cost") < reach**2 + least, F.lit(False))
        done = state.where(sure) if done is None else done.unionByName(state.where(sure))
        open_, level = state.where(~sure), level - 1
        left = open_.count()
    return done


def chains(links: DataFrame) -> DataFrame:
    """(t, id, chain_t, chain_id): objects linked from frame to frame (t, id, next_id at t + 1) share a chain, named by
    its first object. Frames and ids may be any longs."""
    t, i, n = (F.col(c).cast("long") for c in ("t", "id", "next_id"))
    edges = links.select(F.struct(t.alias("t"), i.alias("id")).alias("a"), F.struct((t + 1).alias("t"), n.alias("id")).alias("b"))
    return components(edges).select("node.t", "node.id", F.col("root.t").alias("chain_t"), F.col("root.id").alias("chain_id"))


def displacement(tracks: DataFrame, by: Sequence[str] = ("chain",), time: str = "t") -> DataFrame:
    """Steps from the row before along each track, and the distance so far."""
    w = W.partitionBy(*by).orderBy(time)
    steps = [(F.col(k) - F.lag(k).over(w)).alias(f"d{k}") for k in KEYS]
    out = tracks.select("*", *steps)
    length = F.sqrt(sum((F.col(f"d{k}") ** 2 for k in KEYS), F.lit(0.0)))
    return out.withColumn("step", length).withColumn("path", F.coalesce(F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))


def appearances(presence: DataFrame, by: Sequence[str], time: str = "t") -> DataFrame:
    """Status changes of a present flag: 1 appeared, -1 vanished, 0 same, per key over time."""
    w = W.partitionBy(*by).orderBy(time)
    now, before = F.col("present").cast("int"), F.coalesce(F.lag("present").over(w).cast("int"), F.lit(0))
    return presence.withColumn("change", now - before)


def kmeans_step(points: DataFrame, centres: Sequence[Sequence[float]], features: Sequence[str]) -> DataFrame:
    """(cluster, n, means): points assigned to the nearest of the centres (literals: k is a parameter), ties to the first."""
    dist = [sum(((F.col(f) - float(c)) ** 2 for f, c in zip(features, centre, strict=True)), F.lit(0.0)) for centre in centres]
    cluster = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(dist)]))["i"]
    return points.groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])


def kmeans(points: DataFrame, k: int, features: Sequence[str], order: str, epsilon: float = 1e-3, rounds: int = 50) -> list[list[float]]:
    """Centres from the first k points by order, moved until no centre moves by more than epsilon."""
    centres = [[float(r[f]) for f in features] for r in points.orderBy(order).limit(k).select(*features).collect()]
    for _ in range(rounds):
        found = {r["cluster"]: [r[f] for f in features] for r in kmeans_step(points, centres, features).collect()}  # k rows
        new = [found.get(i, c) for i, c in enumerate(centres)]
        moved = max(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5 for p, q in zip(new, centres, strict=True))
        centres = new
        if moved <= epsilon:
            break
    return centres


def grow_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """Groups of objects whose edges' orientation distance (1 - |cos|) is below threshold: (node, root)."""
    return components(edges.where(F.col("distance") < threshold).select("a", "b"))


def join_edges(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges (a, b) with both ends' positions, midpoint and direction."""
    at = lambda side: objects.select(F.col("id").alias(side), *[F.col(k).alias(f"{side}{k}") for k in KEYS])
    out = edges.join(at("a"), "a").join(at("b"), "b")
    return out.select(*edges.columns, *[((F.col(f"a{k}") + F.col(f"b{k}")) / 2).alias(f"mid_{k}") for k in KEYS], *[(F.col(f"b{k}") - F.col(f"a{k}")).alias(f"dir_{k}") for k in KEYS])


def forces(vertices: DataFrame, edges: DataFrame, rest_length: float) -> DataFrame:
    """(id, fx, fy, fz): orientation * (rest length - length) of every edge, added to its source, taken from its target."""
    joined = join_edges(edges.select("a", "b"), vertices)
    length = F.sqrt(sum((F.col(f"dir_{k}") ** 2 for k in KEYS), F.lit(0.0)))
    force = [F.try_divide(F.col(f"dir_{k}"), length) * (rest_length - length) for k in KEYS]
    rows = joined.select("a", "b", *[F.coalesce(f, F.lit(0.0)).alias(f"f{k}") for f, k in zip(force, KEYS, strict=True)])
    sent = rows.select(F.col("a").alias("id"), *[f"f{k}" for k in KEYS]).unionByName(rows.select(F.col("b").alias("id"), *[(-F.col(f"f{k}")).alias(f"f{k}") for k in KEYS]))
    return sent.groupBy("id").agg(*[F.sum(f"f{k}").alias(f"f{k}") for k in KEYS])


def life_statistics(tracks: DataFrame, by: Sequence[str], time: str = "t") -> DataFrame:
    """(by, born, died, frames, mean_step, max_step) of each track of positions."""
    steps = displacement(tracks, by, time)
    return steps.groupBy(*by).agg(F.min(time).alias("born"), F.max(time).alias("died"), F.count("*").alias("frames"), F.avg("step").alias("mean_step"), F.max("step").alias("max_step"))


def contact_changes(contacts: DataFrame, first: int, last: int) -> DataFrame:
    """(t, a, b, event): contacts (t, a, b) that the frame before had and t has not (lost), or the reverse (gained)."""
    keys = ["t", "a", "b"]
    rows = contacts.select(*keys).distinct()
    later = rows.select((F.col("t") + 1).alias("t"), "a", "b")
    lost = later.where(F.col("t") <= last).join(rows, keys, "left_anti").withColumn("event", F.lit("lost"))
    gained = rows.where(F.col("t") > first).join(later, keys, "left_anti").withColumn("event", F.lit("gained"))
    return lost.unionByName(gained)


def orientation_step(points: DataFrame, axes: Sequence[Sequence[float]], features: Sequence[str]) -> DataFrame:
    """(cluster, n, mean tensor): directions assigned to the axis with the largest |cos|, ties to the first; null vectors
    take no part. The tensor's main axis is the cluster's next one."""
    length = F.sqrt(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)))
    unit = points.where(length > 0).select(*[(F.col(f) / length).alias(f) for f in features])
    near = [-F.abs(sum((F.col(f) * float(c) for f, c in zip(features, axis, strict=True)), F.lit(0.0))) for axis in axes]
    cluster = F.array_min(F.array(*[F.struct(c.alias("d"), F.lit(i).alias("i")) for i, c in enumerate(near)]))["i"]
    pairs = [(p, q) for i, p in enumerate(features) for q in features[i:]]
    return unit.groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"), *[F.avg(F.col(p) * F.col(q)).alias(p + q) for p, q in pairs])


def orientation_kmeans(points: DataFrame, axes: Sequence[Sequence[float]], features: Sequence[str], epsilon: float = 1e-6, rounds: int = 50) -> list[list[float]]:
    """Axes moved to their clusters' main directions until none turns by more than epsilon (1 - |cos|)."""
    import numpy as np

    axes = [list(map(float, a)) for a in axes]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    for _ in range(rounds):
        found = {r["cluster"]: r for r in orientation_step(points, axes, features).collect()}  # a row a cluster
        new = []
        for c, axis in enumerate(axes):
            tensor = np.zeros((len(features), len(features)))
            if c in found:
                for i, j in pairs:
                    tensor[i, j] = tensor[j, i] = found[c][features[i] + features[j]]
                axis = np.linalg.eigh(tensor)[1][:, -1].tolist()
            new.append(axis)
        turned = max(1 - abs(float(np.dot(a, b))) for a, b in zip(axes, new, strict=True))
        axes = new
        if turned <= epsilon:
            break
    return axes
