"""Queries over the test tables, and the SQL they must match.

Voxels come from lineitem: x, y from part and supplier keys, z from the line number, v the summed quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sqlfn
from ..operators import algebra, components, contour, grow, hist, kernels, keyed, match, pointwise, shape, stencil
from ..sources import phantoms, tables
from ..streaming import frames
from . import oracles, params, workflow

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIM = (16, 16, 8)
KEYS = pointwise.KEYS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vox(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    rows = table(spark, d, "lineitem").where(where)
    return rows.groupBy((F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_suppkey") % 16).cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("z")).agg(F.sum("l_quantity").alias("v"))


def vox_sql(where: str = "true", name: str = "vox") -> str:
    return f"{name} AS (SELECT CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_linenumber AS INT) AS z, SUM(l_quantity) AS v FROM lineitem WHERE {where} GROUP BY 1, 2, 3)"


VOX = "WITH " + vox_sql()
OFF = "off AS (SELECT dx, dy, dz FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dz))"
#: Every voxel with each of its neighbours that exist.
NEAR = f"{VOX}, {OFF}, near AS (SELECT a.x, a.y, a.z, b.v, dx, dy, dz FROM vox a CROSS JOIN off JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz)"
DENSE = "dense AS (SELECT x, y, z, v > (SELECT AVG(v) FROM vox) AS v FROM vox)"
NEAR_MASK = f"{VOX}, {OFF}, {DENSE}, near AS (SELECT a.x, a.y, a.z, a.v AS was, b.v, dx, dy, dz FROM dense a CROSS JOIN off JOIN dense b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz)"
LABELS = "lab AS (SELECT x, y, z, CAST((x // 4) * 16 + (y // 4) * 4 + z // 4 + 1 AS BIGINT) AS label, v FROM vox)"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def mask(spark, d) -> DataFrame:
    v = vox(spark, d)
    return v.crossJoin(F.broadcast(v.agg(F.avg("v").alias("t")))).select(*KEYS, (F.col("v") > F.col("t")).alias("v"))


def sparse(spark, d) -> DataFrame:
    """The tenth of the voxels with the largest values, more or less: v over 1.25 times the mean."""
    v = vox(spark, d)
    return v.crossJoin(F.broadcast(v.agg((F.avg("v") * 1.25).alias("t")))).select(*KEYS, (F.col("v") > F.col("t")).alias("v"))


SPARSE = "sparse AS (SELECT x, y, z, v > 1.25 * (SELECT AVG(v) FROM vox) AS v FROM vox)"
CROSS = "(ABS(a.x - b.x) + ABS(a.y - b.y) + ABS(a.z - b.z)) = 1"
COMPONENTS = f"""WITH RECURSIVE {vox_sql()}, {SPARSE},
on_ AS (SELECT x, y, z, CAST(x + 16 * (y + 16 * z) + 1 AS BIGINT) AS id FROM sparse WHERE v),
adj AS (SELECT a.id AS a, b.id AS b FROM on_ a JOIN on_ b ON {CROSS}),
reach AS (SELECT id AS a, id AS b FROM on_ UNION SELECT r.a, j.b FROM reach r JOIN adj j ON r.b = j.a),
lab AS (SELECT o.x, o.y, o.z, MIN(r.b) AS label FROM on_ o JOIN reach r ON r.a = o.id GROUP BY 1, 2, 3)"""


def labelled(spark, d) -> DataFrame:
    lab = (F.floor(F.col("x") / 4) * 16 + F.floor(F.col("y") / 4) * 4 + F.floor(F.col("z") / 4) + 1).cast("long")
    return vox(spark, d).select(*KEYS, lab.alias("label"), "v")


# Sources, pointwise operators and layouts


@query(f"{VOX} SELECT MIN(x) AS pos_x, MIN(y) AS pos_y, MIN(z) AS pos_z, MAX(x) - MIN(x) + 1 AS dim_x, MAX(y) - MIN(y) + 1 AS dim_y, MAX(z) - MIN(z) + 1 AS dim_z FROM vox")
def infer_shape(spark, d):
    return pointwise.shape_of(vox(spark, d))


@query(f"{VOX} SELECT MIN(x) AS pos_x, MIN(y) AS pos_y, MIN(z) AS pos_z, MAX(x) - MIN(x) + 1 AS dim_x, MAX(y) - MIN(y) + 1 AS dim_y, MAX(z) - MIN(z) + 1 AS dim_z FROM vox WHERE v > 300")
def find_edges(spark, d):
    return pointwise.find_edges(vox(spark, d), 300)


@query(f"{VOX} SELECT x, y, z, v FROM vox WHERE v > 100 AND v <= 900")
def filter_voxels(spark, d):
    return vox(spark, d).where("v > 100 and v <= 900")


@query(f"{VOX} SELECT x, y, z, v > 500 AS v FROM vox")
def threshold_image(spark, d):
    return pointwise.threshold(vox(spark, d), ">", 500)


@query(f"{VOX} SELECT x, y, z, ROUND((v + 3) * 2 / 7 - 1, 6) AS v FROM vox")
def scalar_algebra(spark, d):
    out = vox(spark, d)
    for op, c in (("+", 3), ("*", 2), ("/", 7), ("-", 1)):
        out = pointwise.scalar(out, op, c)
    return out.select(*KEYS, *r6("v"))


@query(f"{VOX} SELECT x, y, z, CAST(trunc(v / 2.5 + 127) AS SMALLINT) AS v FROM vox")
def cast_signed_char(spark, d):
    return vox(spark, d).withColumn("v", pointwise.convert(F.col("v"), "double", "char", signed=True, scale=2.5))


@query(f"{VOX} SELECT x, y, z, CASE WHEN v > 500 THEN 127 ELSE 0 END AS v FROM vox")
def cast_bool_to_int(spark, d):
    return pointwise.threshold(vox(spark, d), ">", 500).withColumn("v", pointwise.convert(F.col("v"), "bool", "int"))


@query(f"{VOX} SELECT x, y, z, [0.5, 1.5, 2.5, 3.5][CAST(LEAST(GREATEST(floor(v / 300), 0), 3) AS INT) + 1]::DOUBLE AS v FROM vox")
def lookup_table(spark, d):
    return pointwise.lookup(vox(spark, d), [0.5, 1.5, 2.5, 3.5], 300)


@query(f"{VOX} SELECT x, y, z, v, CASE WHEN v > 0 AND v <= 400 THEN 'small' WHEN v > 400 AND v <= 900 THEN 'medium' ELSE 'large' END AS band FROM vox WHERE v > 0")
def value_bands(spark, d):
    return pointwise.bands(vox(spark, d), [("small", 0, 400), ("medium", 400, 900), ("large", 900, 1e18)])


@query(f"{VOX} SELECT x, y, z, v FROM vox WHERE x >= 2 AND x < 10 AND y >= 3 AND y < 9 AND z >= 1 AND z < 4")
def crop_image(spark, d):
    return pointwise.crop(vox(spark, d), (2, 3, 1), (8, 6, 3))


@query(f"{VOX} SELECT x AS row, z AS col, v FROM vox WHERE y = 5")
def plane_xz(spark, d):
    return pointwise.plane(vox(spark, d), ("x", "z"), 5)


@query(f"{VOX} SELECT x AS row, list(v ORDER BY z) AS values FROM vox WHERE y = 5 GROUP BY x")
def plane_rows(spark, d):
    return pointwise.rows_of(pointwise.plane(vox(spark, d), ("x", "z"), 5))


@query(f"{VOX} SELECT a.x AS row, b.x AS col, SUM(a.v * b.v) AS v FROM vox a JOIN vox b ON a.y = 1 AND b.y = 2 AND a.z = b.z GROUP BY 1, 2")
def plane_product(spark, d):
    v = vox(spark, d)
    b = pointwise.plane(v, ("x", "z"), 2)
    return pointwise.matmul(pointwise.plane(v, ("x", "z"), 1), b.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"))


@query(f"{VOX}, g AS (SELECT z, i, COALESCE(v, 0) AS v FROM (SELECT DISTINCT z FROM vox) CROSS JOIN (SELECT unnest(range(256)) AS i) LEFT JOIN vox USING (z) WHERE false) SELECT z, CAST(SUM(v) AS DOUBLE) AS total, 256 AS n FROM vox GROUP BY z")
def dense_slices(spark, d):
    return pointwise.to_slices(vox(spark, d), 16, 16).select("z", F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("data").alias("n"))


@query(f"{VOX} SELECT x, y, z, v FROM vox WHERE v > 700")
def slices_to_sparse_voxels(spark, d):
    return pointwise.to_voxels(pointwise.to_slices(vox(spark, d), 16, 16), 16, over=700)


@query(f"WITH {vox_sql('l_quantity > 40')}, box AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(16)) AS x), (SELECT unnest(range(16)) AS y), (SELECT unnest(range(8)) AS z)) SELECT x, y, z, COALESCE(v, -1) AS v FROM box LEFT JOIN vox USING (x, y, z)")
def complete_box(spark, d):
    return pointwise.complete(vox(spark, d, "l_quantity > 40"), (0, 0, 0), DIM, -1.0)


@query(f"{VOX}, t0 AS (SELECT x, y, v FROM vox WHERE z = 3), t1 AS (SELECT x // 2 AS x, y // 2 AS y, AVG(v) AS v FROM t0 GROUP BY 1, 2), t2 AS (SELECT x // 2 AS x, y // 2 AS y, AVG(v) AS v FROM t1 GROUP BY 1, 2) SELECT 0 AS level, x, y, ROUND(v, 6) AS v FROM t0 UNION ALL SELECT 1, x, y, ROUND(v, 6) FROM t1 UNION ALL SELECT 2, x, y, ROUND(v, 6) FROM t2")
def tile_pyramid(spark, d):
    p = pointwise.plane(vox(spark, d), ("x", "y"), 3).select(F.col("row").alias("x"), F.col("col").alias("y"), "v")
    return pointwise.tiles(p, 2).select("level", "x", "y", *r6("v"))


@query("WITH g AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(20)) AS x), (SELECT unnest(range(20)) AS y), (SELECT unnest(range(20)) AS z)) SELECT x, y, z, ROUND(sqrt((x - 9.5) * (x - 9.5) + (y - 9.5) * (y - 9.5) + (z - 9.5) * (z - 9.5)), 6) AS v FROM g")
def position_function(spark, d):
    return phantoms.grid(spark, (20, 20, 20), pointwise.position("sph_r", 9.5, 9.5, 9.5)).select(*KEYS, *r6("v"))


@query("WITH g AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(12)) AS x), (SELECT unnest(range(12)) AS y), (SELECT unnest(range(12)) AS z)) SELECT x, y, z, CAST((x-3)*(x-3)+(y-3)*(y-3)+(z-3)*(z-3) <= 9 AS INT) + CAST((x-6)*(x-6)+(y-6)*(y-6)+(z-6)*(z-6) <= 16 AS INT) AS v FROM g")
def synthetic_foam(spark, d):
    return phantoms.foam(spark, (12, 12, 12), [(3, 3, 3, 3), (6, 6, 6, 4)])


# Image algebra

_AB = f"WITH {vox_sql(chr(39).join(['l_returnflag = ', 'A', '']), 'a')}, {vox_sql(chr(39).join(['l_returnflag = ', 'R', '']), 'b')}"


def _pair(spark, d):
    return vox(spark, d, "l_returnflag = 'A'"), vox(spark, d, "l_returnflag = 'R'")


def _merge(name: str, op: str) -> None:
    sql = f"{_AB} SELECT COALESCE(a.x, b.x) AS x, COALESCE(a.y, b.y) AS y, COALESCE(a.z, b.z) AS z, ROUND(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN a.v {op} b.v ELSE COALESCE(a.v, b.v) END, 6) AS v FROM a FULL OUTER JOIN b ON a.x = b.x AND a.y = b.y AND a.z = b.z"

    def run(spark, d):
        return algebra.merge(*_pair(spark, d), op).select(*KEYS, *r6("v"))

    run.__name__ = name
    query(sql)(run)


for _name, _op in (("image_add", "+"), ("image_subtract", "-"), ("image_multiply", "*"), ("image_divide", "/")):
    _merge(_name, _op)


@query(f"{_AB} SELECT x, y, z, ROUND(AVG(v), 6) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY x, y, z")
def images_average(spark, d):
    return algebra.combine(_pair(spark, d), "average").select(*KEYS, *r6("v"))


@query(f"{_AB} SELECT a.x, a.y, a.z, CASE WHEN a.v > 200 THEN COALESCE(b.v, 0) ELSE 0 END AS v FROM a LEFT JOIN b ON a.x = b.x AND a.y = b.y AND a.z = b.z")
def mask_image(spark, d):
    a, b = _pair(spark, d)
    return algebra.mask(a.withColumn("v", F.col("v") > 200).withColumn("v", F.col("v").cast("int")), [b])


@query(f"{_AB} SELECT COALESCE(a.x, b.x) AS x, COALESCE(a.y, b.y) AS y, COALESCE(a.z, b.z) AS z, CASE WHEN b.v > 250 THEN 2.0::DOUBLE WHEN a.v > 250 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM a FULL OUTER JOIN b ON a.x = b.x AND a.y = b.y AND a.z = b.z")
def phase_image(spark, d):
    a, b = (i.withColumn("v", (F.col("v") > 250).cast("int")) for i in _pair(spark, d))
    return algebra.phases([a, b], [1, 2])


@query(f"{VOX}, b AS (SELECT x, y, z, v FROM vox WHERE v > 900) SELECT x, y, z FROM vox EXCEPT SELECT x, y, z FROM b")
def missing_voxels(spark, d):
    v = vox(spark, d)
    return algebra.missing(v, v.where("v > 900"))


@query(f"{_AB}, sa AS (SELECT z, SUM(v) AS v FROM a GROUP BY z), sb AS (SELECT z, SUM(v) AS v FROM b GROUP BY z) SELECT z, sa.v + sb.v AS total FROM sa JOIN sb USING (z)")
def slice_add(spark, d):
    a, b = (pointwise.to_slices(i, 16, 16) for i in _pair(spark, d))
    return algebra.slice_op(a, b, "+").select("z", F.aggregate("data", F.lit(0.0), lambda s, v: s + v).alias("total"))


# Neighbourhoods


@query(f"{NEAR} SELECT x, y, z, ROUND(AVG(v), 6) AS v FROM near GROUP BY x, y, z")
def box_mean(spark, d):
    return stencil.box_mean(vox(spark, d)).select(*KEYS, *r6("v"))


@query(f"{NEAR} SELECT x, y, z, ROUND(SUM(v * exp(-(dx * dx + dy * dy + dz * dz))) / SUM(exp(-(dx * dx + dy * dy + dz * dz))), 6) AS v FROM near GROUP BY x, y, z")
def gaussian_filter(spark, d):
    return stencil.gaussian(vox(spark, d)).select(*KEYS, *r6("v"))


def _axis_sum(a: str, b: str, c: str) -> str:
    return f"SUM({a} * GREATEST(4 - sqrt({b} * {b} + {c} * {c}), 0) * v)"


@query(f"{NEAR} SELECT x, y, z, ROUND(sqrt(pow({_axis_sum('dx', 'dy', 'dz')}, 2) + pow({_axis_sum('dy', 'dx', 'dz')}, 2) + pow({_axis_sum('dz', 'dx', 'dy')}, 2)), 5) AS v FROM near GROUP BY x, y, z")
def gradient_filter(spark, d):
    return stencil.gradient(vox(spark, d)).select(*KEYS, F.round("v", 5).alias("v"))


@query(f"{NEAR} SELECT x, y, z, ROUND(ABS(AVG(v) FILTER (WHERE abs(dx) + abs(dy) + abs(dz) > 0) - AVG(v) FILTER (WHERE abs(dx) + abs(dy) + abs(dz) = 0)), 6) AS v FROM near GROUP BY x, y, z")
def laplace_filter(spark, d):
    return stencil.laplace(vox(spark, d)).select(*KEYS, *r6("v"))


@query(f"{NEAR} SELECT x, y, z, median(v) AS v FROM near GROUP BY x, y, z")
def median_filter(spark, d):
    return stencil.median(vox(spark, d))


@query(f"{NEAR} SELECT x, y, z, list(v ORDER BY dx, dy, dz) AS features FROM near GROUP BY x, y, z HAVING COUNT(*) = 27")
def feature_vectors(spark, d):
    return stencil.feature_vectors(vox(spark, d), 1, -1.0).where(~F.array_contains("features", -1.0))


@query(f"{NEAR_MASK} SELECT x, y, z, bool_or(was) OR COUNT(*) FILTER (WHERE v) > 0 AS v FROM near GROUP BY x, y, z")
def dilate_image(spark, d):
    return stencil.dilate(mask(spark, d))


@query(f"{NEAR_MASK} SELECT x, y, z, bool_or(was) AND COUNT(*) FILTER (WHERE v) >= ROUND(COUNT(*) * 0.6) AS v FROM near GROUP BY x, y, z")
def erode_image(spark, d):
    return stencil.erode(mask(spark, d), occupancy=0.6)


KERNEL = f"((a.x = b.x AND a.y = b.y AND a.z = b.z) OR {CROSS})"


@query(f"{VOX}, {DENSE}, {oracles.morphology('d', 'dense', KERNEL, True)}, {oracles.morphology('e', 'd', KERNEL, False)} SELECT x, y, z, v FROM e")
def close_image(spark, d):
    return stencil.closing(mask(spark, d), kernels.cross())


@query(f"{VOX}, {DENSE}, {oracles.morphology('e', 'dense', KERNEL, False)}, {oracles.morphology('d', 'e', KERNEL, True)} SELECT x, y, z, v FROM d")
def open_image(spark, d):
    return stencil.opening(mask(spark, d), kernels.cross())


@query(f"{VOX}, {DENSE} SELECT a.x, a.y, a.z, true AS v FROM dense a JOIN dense b ON (a.x = b.x AND a.y = b.y AND a.z = b.z) OR {CROSS} WHERE a.v AND b.v GROUP BY a.x, a.y, a.z HAVING COUNT(*) = 7")
def peel_mask(spark, d):
    return stencil.peel(mask(spark, d), 1, kernels.cross())


@query(f"{VOX} SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, ROUND(AVG(v), 6) AS v FROM vox GROUP BY 1, 2, 3")
def downsample_image(spark, d):
    return stencil.downsample(vox(spark, d), 2).select(*KEYS, *r6("v"))


@query(
    f"{VOX}, o AS (SELECT CAST(ox AS INT) AS ox, CAST(oy AS INT) AS oy, CAST(oz AS INT) AS oz FROM (SELECT unnest(range(8)) AS ox), (SELECT unnest(range(8)) AS oy), (SELECT unnest(range(4)) AS oz)), p AS (SELECT ox, oy, oz, v, exp(-(pow(x - 2 * ox, 2) + pow(y - 2 * oy, 2) + pow(z - 2 * oz, 2))) AS w FROM o JOIN vox ON x >= 2 * ox - 2 AND x < 2 * ox + 2 AND y >= 2 * oy - 2 AND y < 2 * oy + 2 AND z >= 2 * oz - 2 AND z < 2 * oz + 2) SELECT ox AS x, oy AS y, oz AS z, ROUND(SUM(v * w) / SUM(w), 6) AS v FROM p GROUP BY 1, 2, 3"
)
def filter_scale_half(spark, d):
    return stencil.filter_scale(vox(spark, d), DIM, 1, 2).select(*KEYS, *r6("v"))


@query(
    f"{VOX}, o AS (SELECT CAST(ox AS INT) AS ox, CAST(oy AS INT) AS oy, CAST(oz AS INT) AS oz FROM (SELECT unnest(range(24)) AS ox), (SELECT unnest(range(24)) AS oy), (SELECT unnest(range(12)) AS oz)), w AS (SELECT ox, oy, oz, ox * 2 / 3 AS px, oy * 2 / 3 AS py, oz * 2 / 3 AS pz FROM o), p AS (SELECT ox, oy, oz, v, exp(-(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2))) AS w FROM w JOIN vox ON x >= floor(px - 2) AND x < ceil(px + 2) AND y >= floor(py - 2) AND y < ceil(py + 2) AND z >= floor(pz - 2) AND z < ceil(pz + 2)) SELECT ox AS x, oy AS y, oz AS z, ROUND(SUM(v * w) / SUM(w), 6) AS v FROM p GROUP BY 1, 2, 3"
)
def filter_scale_up(spark, d):
    return stencil.filter_scale(vox(spark, d), DIM, 3, 2).select(*KEYS, *r6("v"))


# Labels, growth, thickness


@query(f"{COMPONENTS} SELECT x, y, z, label FROM lab")
def component_label(spark, d):
    return components.label(sparse(spark, d), DIM, kernels.cross())


@query(f"{COMPONENTS}, n AS (SELECT label, COUNT(*) AS n FROM lab GROUP BY label HAVING COUNT(*) >= 2), k AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS rank FROM n) SELECT x, y, z, rank AS label FROM lab JOIN k USING (label)")
def component_relabel(spark, d):
    return components.label(sparse(spark, d), DIM, kernels.cross(), min_voxels=2, relabel=True)


@query(f"{COMPONENTS} SELECT label, COUNT(*) AS n FROM lab GROUP BY label ORDER BY n DESC, label LIMIT 1")
def largest_component(spark, d):
    return components.largest(components.label(sparse(spark, d), DIM, kernels.cross()))


@query(COMPONENTS.replace(CROSS, CROSS + " AND a.z = b.z") + " SELECT x, y, z, label FROM lab")
def slice_labels(spark, d):
    return components.label(sparse(spark, d), DIM, [o for o in kernels.cross() if o[2] == 0])


@query(f"{VOX}, {LABELS}, c AS (SELECT label, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM lab WHERE label <= 20 GROUP BY label), p AS (SELECT x, y, z, label, ROUND(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)), 6) AS dist FROM vox CROSS JOIN c) SELECT x, y, z, MIN(dist) AS dist FROM p GROUP BY x, y, z")
def centroid_voronoi(spark, d):
    lab = labelled(spark, d)
    out = grow.cvoronoi(lab.where("label <= 20"), lab.select(*KEYS, F.lit(True).alias("v")))
    return out.select(*KEYS, *r6("dist"))


@query(f"{VOX}, {LABELS}, c AS (SELECT label, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM lab GROUP BY label), p AS (SELECT x, y, z, label, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS dist FROM vox CROSS JOIN c), n AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY dist, label) AS nth FROM p) SELECT x, y, z, label, ROUND(dist, 6) AS dist FROM n WHERE nth = 1")
def centroid_voronoi_labels(spark, d):
    """Of all labels, where centroid_voronoi and its SQL take those up to 20 and give the distance alone."""
    lab = labelled(spark, d)
    out = grow.cvoronoi(lab, lab.select(*KEYS, F.lit(True).alias("v")))
    return out.select(*KEYS, "label", *r6("dist"))


@query(f"{COMPONENTS}, {DENSE}, {OFF}, big AS (SELECT * FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING COUNT(*) >= 3)), t AS (SELECT x, y, z FROM dense WHERE v), {oracles.grown('g', 'big', 't')} SELECT x, y, z, COALESCE(label, 0) AS label, ROUND(COALESCE(dist, -1), 6) AS dist FROM t LEFT JOIN g USING (x, y, z)")
def region_growing(spark, d):
    lab = components.label(sparse(spark, d), DIM, kernels.cross(), min_voxels=3)
    return grow.kvoronoi(lab, mask(spark, d)).select(*KEYS, "label", *r6("dist"))


DISTANCE = f"WITH RECURSIVE {vox_sql()}, {OFF}, {DENSE}, back AS (SELECT x, y, z, 1::BIGINT AS label FROM dense WHERE NOT v), {oracles.grown('g', 'back', 'dense')}, dm AS (SELECT x, y, z, g.dist FROM g JOIN dense USING (x, y, z) WHERE dense.v)"


@query(f"{DISTANCE} SELECT x, y, z, ROUND(dist, 6) AS dist FROM dm")
def distance_to_background(spark, d):
    return grow.distance_map(mask(spark, d)).select(*KEYS, *r6("dist"))


RIDGE = "ridge AS (SELECT a.x, a.y, a.z, a.dist FROM dm a CROSS JOIN off LEFT JOIN dm b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.dist > 0.5 AND NOT (dx = 0 AND dy = 0 AND dz = 0) AND a.x + dx BETWEEN 0 AND 15 AND a.y + dy BETWEEN 0 AND 15 AND a.z + dz BETWEEN 0 AND 7 GROUP BY a.x, a.y, a.z, a.dist HAVING sqrt(pow(SUM(dx * COALESCE(b.dist, 0)), 2) + pow(SUM(dy * COALESCE(b.dist, 0)), 2) + pow(SUM(dz * COALESCE(b.dist, 0)), 2)) <= 0.45 * COUNT(*))"


@query(f"{DISTANCE}, {RIDGE} SELECT dm.x, dm.y, dm.z, ROUND(COALESCE(MAX(r.dist), 0), 6) AS thickness FROM dm LEFT JOIN ridge r ON pow(dm.x - r.x, 2) + pow(dm.y - r.y, 2) + pow(dm.z - r.z, 2) < r.dist * r.dist GROUP BY 1, 2, 3")
def hildebrand_thickness(spark, d):
    return grow.thickness(grow.distance_map(mask(spark, d)), DIM, min_wall=0.5).select(*KEYS, *r6("thickness"))


PEAKS = f"tops AS (SELECT a.x, a.y, a.z, a.v FROM vox a CROSS JOIN off JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4 HAVING MAX(b.v) <= a.v)"


@query(
    f"WITH RECURSIVE {vox_sql()}, {OFF}, {PEAKS}, p AS (SELECT x, y, z, v / 300 AS r, row_number() OVER (ORDER BY v DESC, x, y, z) AS n FROM tops), s(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(x INT, y INT, z INT, r DOUBLE)[] UNION ALL SELECT p.n, CASE WHEN len(list_filter(kept, lambda k: 100 * (k.r + p.r - sqrt(pow(p.x - k.x, 2) + pow(p.y - k.y, 2) + pow(p.z - k.z, 2))) / p.r >= 40)) = 0 THEN list_append(kept, {{'x': p.x, 'y': p.y, 'z': p.z, 'r': p.r}}) ELSE kept END FROM s JOIN p ON p.n = s.n + 1), last AS (SELECT unnest(kept) AS k FROM s WHERE n = (SELECT MAX(n) FROM s)) SELECT k.x AS x, k.y AS y, k.z AS z, ROUND(k.r, 6) AS dist FROM last"
)
def bubble_seeds(spark, d):
    return grow.seeds(vox(spark, d).select(*KEYS, (F.col("v") / 300).alias("dist"))).select(*KEYS, *r6("dist"))


@query(
    f"WITH RECURSIVE {vox_sql()}, {OFF}, {PEAKS}, up AS (SELECT a.x, a.y, a.z, a.v, arg_min({{'x': b.x, 'y': b.y, 'z': b.z}}, {{'v': -b.v, 'x': b.x, 'y': b.y, 'z': b.z}}) AS t, MAX(b.v) AS top FROM vox a CROSS JOIN off JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4), nxt AS (SELECT x, y, z, CASE WHEN top > v THEN t ELSE {{'x': x, 'y': y, 'z': z}} END AS t FROM up), way(x, y, z, t) AS (SELECT x, y, z, t FROM nxt UNION SELECT w.x, w.y, w.z, n.t FROM way w JOIN nxt n ON n.x = w.t.x AND n.y = w.t.y AND n.z = w.t.z), ends AS (SELECT w.x, w.y, w.z, w.t FROM way w JOIN nxt n ON n.x = w.t.x AND n.y = w.t.y AND n.z = w.t.z AND n.t = w.t) SELECT x, y, z, CASE WHEN EXISTS (SELECT 1 FROM tops p WHERE p.x = t.x AND p.y = t.y AND p.z = t.z) THEN CAST(t.x + 16 * (t.y + 16 * t.z) + 1 AS BIGINT) ELSE 0 END AS label FROM ends"
)
def watershed_growth(spark, d):
    dist = vox(spark, d).select(*KEYS, F.col("v").alias("dist"))
    peaks = grow.local_maxima(dist).select(*KEYS, (pointwise.linear_index(16, 16) + 1).alias("label"))
    return grow.watershed(dist, peaks)


@query(f"{VOX}, {DENSE}, t AS (SELECT * FROM dense WHERE v), c AS (SELECT z, AVG(x) AS cx, AVG(y) AS cy, AVG(0) AS q FROM t GROUP BY z), r AS (SELECT z, AVG(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) * 1.5 AS radius FROM t JOIN c USING (z) GROUP BY z) SELECT x, y, z, COALESCE(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) <= radius, false) AS v FROM dense LEFT JOIN c USING (z) LEFT JOIN r USING (z)")
def circle_contour(spark, d):
    return contour.contour(mask(spark, d), "circle")


@query(f"{VOX}, {DENSE}, t AS (SELECT * FROM dense WHERE v), c AS (SELECT z, AVG(x) AS cx, AVG(y) AS cy FROM t GROUP BY z), b AS (SELECT d.x, d.y, d.z, d.v, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS r, LEAST(floor((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 16), 15) AS bin FROM dense d LEFT JOIN c USING (z)), m AS (SELECT z, bin, MAX(r) AS most FROM b WHERE v GROUP BY 1, 2) SELECT x, y, b.z, COALESCE(r <= most, false) AS v FROM b LEFT JOIN m ON m.z = b.z AND m.bin = b.bin")
def polygon_contour(spark, d):
    return contour.contour(mask(spark, d), "polygon")


# Object tables


@query(f"{VOX}, {LABELS} SELECT label, COUNT(*) AS n, ROUND(AVG(x), 6) AS mx, ROUND(AVG(y), 6) AS my, ROUND(AVG(z), 6) AS mz, ROUND(covar_pop(x, x), 6) AS cxx, ROUND(covar_pop(x, y), 6) AS cxy, CAST(MAX(x) - MIN(x) AS DOUBLE) AS proj_x FROM lab GROUP BY label")
def shape_moments(spark, d):
    return shape.moments(labelled(spark, d)).select("label", "n", *r6("mx", "my", "mz", "cxx", "cxy"), "proj_x")


@query(
    f"{VOX}, {LABELS}, m AS (SELECT label, COUNT(*) AS n, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c FROM lab GROUP BY label), k AS (SELECT lab.label, AVG(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS radius FROM lab JOIN m USING (label) GROUP BY lab.label) SELECT label AS lacuna_number, CAST(n AS DOUBLE) AS volume, ROUND(mx, 6) AS pos_x, ROUND(sqrt(a), 6) AS std_x, ROUND(radius, 6) AS obj_radius, ROUND(sqrt(GREATEST(a + b + c - radius * radius, 0)), 6) AS obj_radius_std FROM m JOIN k USING (label)"
)
def shape_analysis(spark, d):
    return shape.shape_analysis(labelled(spark, d).drop("v")).select("lacuna_number", "volume", *r6("pos_x", "std_x", "obj_radius", "obj_radius_std"))


def _axis(k: int) -> str:
    return oracles.largest_eigenvalue("covar_pop(x, x)", "covar_pop(y, y)", "covar_pop(z, z)", "covar_pop(x, y)", "covar_pop(x, z)", "covar_pop(y, z)", k)


@query(f"{COMPONENTS} SELECT label AS lacuna_number, CAST(COUNT(*) AS DOUBLE) AS volume, {', '.join(f'ROUND(AVG({k}), 6) AS pos_{k}, ROUND(stddev_pop({k}), 6) AS std_{k}, CAST(MAX({k}) - MIN({k}) AS DOUBLE) AS proj_{k}' for k in KEYS)}, {', '.join(f'ROUND(sqrt(GREATEST({_axis(k)}, 0)), 4) AS pca{k + 1}_s' for k in range(3))} FROM lab GROUP BY label")
def shape_analysis_full(spark, d):
    """Of real components; the axes' directions are left out, as equal eigenvalues leave them open."""
    out = shape.shape_analysis(components.label(sparse(spark, d), DIM, kernels.cross()))
    return out.select("lacuna_number", "volume", *r6(*[f"{c}_{k}" for k in KEYS for c in ("pos", "std")]), *[f"proj_{k}" for k in KEYS], *[F.round(f"pca{k}_s", 4).alias(f"pca{k}_s") for k in (1, 2, 3)])


@query(f"{VOX}, {LABELS} SELECT label, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(stddev_pop(v), 6) AS std, MIN(v) AS min, MAX(v) AS max, ROUND(SUM(x * v) / SUM(v) - AVG(x), 6) AS grad_x FROM lab WHERE v >= 300 GROUP BY label")
def gray_analysis(spark, d):
    lab = labelled(spark, d)
    return shape.gray_stats(lab.drop("v"), vox(spark, d), 300).select("label", "n", *r6("mean", "std"), "min", "max", *r6("grad_x"))


@query(f"{VOX}, {LABELS}, {OFF} SELECT a.label AS a, b.label AS b, COUNT(*) AS n FROM lab a CROSS JOIN off JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.label <> b.label GROUP BY 1, 2")
def neighbour_contacts(spark, d):
    return shape.contacts(labelled(spark, d).drop("v"))


@query(f"{VOX}, {LABELS}, {OFF}, c AS (SELECT a.label AS a, b.label AS b, COUNT(*) AS n FROM lab a CROSS JOIN off JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.label <> b.label GROUP BY 1, 2) SELECT a AS label, COUNT(*) AS neighbours, CAST(SUM(n) AS BIGINT) AS contacts FROM c GROUP BY a")
def neighbour_counts(spark, d):
    return shape.neighbour_counts(labelled(spark, d).drop("v"))


@query("WITH g AS (SELECT label, a, b, c FROM (SELECT unnest([1, 2, 3]) AS label, unnest([9, 70, 5]) AS a, unnest([4, 7, 5]) AS b, unnest([3, 66, 5]) AS c)) SELECT CAST(label AS BIGINT) AS label, CAST(2 * ((a - 1) * (b - 1) + (a - 1) * (c - 1) + (b - 1) * (c - 1)) AS DOUBLE) AS area, CAST((a - 1) * (b - 1) * (c - 1) AS DOUBLE) AS hull_volume FROM g")
def convex_hulls(spark, d):
    """Of three boxes, one of them over several blocks: the hull of a box is the box."""
    boxes = [phantoms.grid(spark, dim, F.lit(True), pos).select(*KEYS, F.lit(i).cast("long").alias("label")) for i, (dim, pos) in enumerate((((9, 4, 3), (0, 0, 0)), ((70, 7, 66), (20, 0, 0)), ((5, 5, 5), (100, 60, 60))), 1)]
    return shape.hulls(boxes[0].union(boxes[1]).union(boxes[2])).select("label", *r6("area", "hull_volume"))


REGIONS = f"{COMPONENTS}, {OFF}, whole AS (SELECT x, y, z FROM vox), {oracles.grown('g', 'lab', 'whole')}, edges AS (SELECT a.label AS a, b.label AS b, COUNT(*) AS n FROM g a CROSS JOIN off JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.label <> b.label GROUP BY 1, 2)"


@query(
    f"{REGIONS}, m AS (SELECT label, COUNT(*) AS n, {', '.join(f'AVG({k}) AS m{k}, stddev_pop({k}) AS s{k}' for k in KEYS)} FROM lab GROUP BY label), k AS (SELECT lab.label, AVG(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS radius FROM lab JOIN m USING (label) GROUP BY lab.label), w AS (SELECT label, COUNT(*) AS region_volume FROM g GROUP BY label), e AS (SELECT a AS label, COUNT(*) AS neighbours FROM edges GROUP BY a) SELECT label AS lacuna_number, CAST(n AS DOUBLE) AS volume, {', '.join(f'ROUND(m{k}, 6) AS pos_{k}, ROUND(s{k}, 6) AS std_{k}' for k in KEYS)}, ROUND(radius, 6) AS obj_radius, region_volume, ROUND(n / region_volume, 6) AS density, COALESCE(neighbours, 0) AS neighbours FROM m JOIN k USING (label) LEFT JOIN w USING (label) LEFT JOIN e USING (label)"
)
def flagship_analyze_phase(spark, d):
    out = workflow.analyze_phase(sparse(spark, d), DIM, offsets=kernels.cross())
    return out["objects"].select("lacuna_number", "volume", *r6(*[f"{c}_{k}" for k in KEYS for c in ("pos", "std")], "obj_radius"), "region_volume", *r6("density"), "neighbours")


@query(f"{REGIONS} SELECT a, b, n FROM edges")
def analyze_phase_edges(spark, d):
    return workflow.analyze_phase(sparse(spark, d), DIM, offsets=kernels.cross())["edges"]


# Histograms, profiles, correlation


@query("SELECT CAST(LEAST(GREATEST(floor(l_extendedprice / 2000), 0), 50) AS INT) AS bin, CAST(LEAST(GREATEST(floor(l_extendedprice / 2000), 0), 50) * 2000 AS DOUBLE) AS left, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def histogram_1d(spark, d):
    return hist.histogram(table(spark, d, "lineitem"), 0, 100_000, 50, "l_extendedprice")


@query("WITH e AS (SELECT MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem) SELECT CAST(ROUND((l_quantity - lo) / (hi - lo) * 20) AS INT) AS bin, COUNT(*) AS n FROM lineitem, e GROUP BY 1")
def histogram_auto(spark, d):
    return hist.auto_histogram(table(spark, d, "lineitem"), 20, "l_quantity")


@query("SELECT l_returnflag AS factor, COUNT(*) AS n FROM lineitem GROUP BY 1")
def factor_histogram(spark, d):
    return hist.factor_histogram(table(spark, d, "lineitem"), "l_returnflag")


@query("SELECT CAST(LEAST(GREATEST(floor(l_quantity / 5), 0), 10) AS INT) AS a, CAST(LEAST(GREATEST(floor(l_discount / 0.025), 0), 4) AS INT) AS b, COUNT(*) AS n, ROUND(AVG(l_tax), 6) AS mean, MIN(l_tax) AS min, MAX(l_tax) AS max FROM lineitem GROUP BY 1, 2")
def histogram_2d(spark, d):
    return hist.histogram2d(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount"), ((0, 50, 10), (0, 0.1, 4)), "l_tax").select("a", "b", "n", *r6("mean"), "min", "max")


@query(f"{VOX} SELECT CAST(LEAST(GREATEST(floor(z / 0.8), 0), 10) AS INT) AS bin, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(stddev_pop(v), 6) AS std FROM vox GROUP BY 1")
def z_profile(spark, d):
    return hist.profile(vox(spark, d), F.col("z"), 0, 8, 10).select("bin", "n", *r6("mean", "std"))


@query(f"{VOX} SELECT CAST(LEAST(GREATEST(floor(sqrt(pow(x - 7.5, 2) + pow(y - 7.5, 2)) / 1.1), 0), 10) AS INT) AS bin, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(stddev_pop(v), 6) AS std FROM vox GROUP BY 1")
def radial_profile(spark, d):
    return hist.profile(vox(spark, d), pointwise.position("cyl_r", 7.5, 7.5), 0, 11, 10).select("bin", "n", *r6("mean", "std"))


@query(f"{VOX}, {DENSE} SELECT COUNT(*) FILTER (WHERE v) AS inside, COUNT(*) FILTER (WHERE NOT v) AS outside, ROUND(AVG(CAST(v AS INT)), 9) AS fraction FROM dense")
def volume_fraction(spark, d):
    return hist.volume_fraction(mask(spark, d)).select("inside", "outside", F.round("fraction", 9).alias("fraction"))


_STARTS = "(SELECT s, CASE WHEN i * s + s >= {n} THEN {n} - s ELSE i * s END AS a{k} FROM (SELECT unnest(range(1, 5)) AS s), LATERAL (SELECT unnest(range(CAST(ceil({n} / s) AS INT))) AS i))"


@query(
    f"{VOX}, {SPARSE}, bx AS {_STARTS.format(n='16.0', k='x')}, by_ AS {_STARTS.format(n='16.0', k='y')}, bz AS {_STARTS.format(n='8.0', k='z')} SELECT CAST(bx.s AS INT) AS size, COUNT(DISTINCT (ax, ay, az)) AS filled, CAST(ceil(16.0 / bx.s) * ceil(16.0 / bx.s) * ceil(8.0 / bx.s) AS BIGINT) AS boxes, COUNT(*) AS voxels FROM sparse JOIN bx ON x >= ax AND x < ax + bx.s JOIN by_ ON by_.s = bx.s AND y >= ay AND y < ay + bx.s JOIN bz ON bz.s = bx.s AND z >= az AND z < az + bx.s WHERE v GROUP BY bx.s"
)
def box_counting(spark, d):
    return hist.box_counts(sparse(spark, d), DIM)


@query(
    f"{VOX}, {DENSE}, {OFF}, n AS (SELECT dx, dy, dz, COUNT(*) AS n, AVG(CAST(b.v AS INT)) AS mean FROM dense a CROSS JOIN off JOIN dense b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.v GROUP BY 1, 2, 3 HAVING COUNT(*) > 5) SELECT dx, dy, dz, n, ROUND(CASE WHEN n < 0.25 * (SELECT AVG(n) FROM n) THEN 0 ELSE mean END, 6) AS mean FROM n"
)
def two_point_correlation(spark, d):
    return hist.correlation(mask(spark, d), 1).select("dx", "dy", "dz", "n", *r6("mean"))


# SQL functions and aggregates


@query("SELECT l_returnflag, median(l_quantity) AS med, ROUND(var_pop(l_quantity), 6) AS var, ROUND(stddev_pop(l_quantity), 6) AS std, COUNT(DISTINCT l_suppkey) AS unicnt FROM lineitem GROUP BY 1")
def object_statistics(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(sqlfn.med(q).alias("med"), F.round(sqlfn.var(q), 6).alias("var"), F.round(sqlfn.std(q), 6).alias("std"), sqlfn.unicnt(F.col("l_suppkey")).alias("unicnt"))


@query("SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_quantity) / SUM(l_quantity), 4) AS wavg, ROUND(sqrt(ABS(SUM(l_discount * l_discount * l_quantity) / SUM(l_quantity) - pow(SUM(l_discount * l_quantity) / SUM(l_quantity), 2))), 6) AS wstd FROM lineitem GROUP BY 1")
def weighted_statistics(spark, d):
    w = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(sqlfn.wavg(F.col("l_extendedprice"), w), 4).alias("wavg"), F.round(sqlfn.wstd(F.col("l_discount"), w), 6).alias("wstd"))


@query("SELECT l_returnflag, ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope, ROUND(corr(l_quantity, l_extendedprice), 6) AS corr, ROUND(var_pop(l_extendedprice) / pow(AVG(l_extendedprice), 2), 6) AS rat FROM lineitem GROUP BY 1")
def fit_and_correlation(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(sqlfn.linfit(q, p), 4).alias("slope"), F.round(sqlfn.corr(q, p), 6).alias("corr"), F.round(sqlfn.relative_variance(p), 6).alias("rat"))


@query("SELECT l_returnflag, ROUND((SUM(l_tax) * SUM(l_tax * l_quantity * l_discount) - SUM(l_tax * l_quantity) * SUM(l_tax * l_discount)) / (SUM(l_tax) * SUM(l_tax * l_quantity * l_quantity) - pow(SUM(l_tax * l_quantity), 2)), 8) AS slope FROM lineitem GROUP BY 1")
def weighted_fit(spark, d):
    out = sqlfn.wlinfit(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(out, 8).alias("slope"))


@query("SELECT l_returnflag, ROUND((AVG(l_discount) - AVG(l_tax)) / sqrt(((COUNT(l_discount) - 1) * var_samp(l_discount) + (COUNT(l_tax) - 1) * var_samp(l_tax)) / (COUNT(l_discount) + COUNT(l_tax) - 2) * (1.0 / COUNT(l_discount) + 1.0 / COUNT(l_tax))), 5) AS t FROM lineitem GROUP BY 1")
def t_test(spark, d):
    return sqlfn.ttest(table(spark, d, "lineitem"), "l_returnflag", "l_discount", "l_tax").select("l_returnflag", F.round("t", 5).alias("t"))


_POOLED = "(AVG(a) - AVG(b)) / sqrt(((COUNT(a) - 1) * var_samp(a) + (COUNT(b) - 1) * var_samp(b)) / (COUNT(a) + COUNT(b) - 2) * (1.0 / COUNT(a) + 1.0 / COUNT(b)))"


@query(f"WITH t AS (SELECT l_suppkey, {_POOLED} AS t, COUNT(a) + COUNT(b) - 2 AS n FROM (SELECT l_suppkey, l_discount AS a, l_tax * 1.25 AS b FROM lineitem) GROUP BY 1) SELECT l_suppkey, ROUND(t, 5) AS t, ROUND({oracles.t_pvalue('t', 'n')}, 5) AS p FROM t")
def t_test_pvalue(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_discount", (F.col("l_tax") * 1.25).alias("tax"))
    return sqlfn.ttest(rows, "l_suppkey", "l_discount", "tax").select("l_suppkey", F.round("t", 5).alias("t"), F.round("p", 5).alias("p"))


def _texture(w: str) -> str:
    p = {"x": "(x - 7.5)", "y": "(y - 7.5)", "z": "(z - 4.0)"}
    c = [f"SUM({w} * {p[a]} * {p[b]}) / SUM({w})" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    return f"ROUND(CASE WHEN COUNT(*) < 2 THEN 100 ELSE 150 * ({oracles.largest_eigenvalue(*c)} / ({c[0]} + {c[1]} + {c[2]}) - 1 / 3) END, 5)"


@query(f"{VOX}, {LABELS} SELECT label, {_texture('1.0::DOUBLE')} AS texture, {_texture('v')} AS wtexture FROM lab GROUP BY label")
def texture_alignment(spark, d):
    p = [F.col("x") - 7.5, F.col("y") - 7.5, F.col("z") - 4.0]
    return labelled(spark, d).groupBy("label").agg(F.round(sqlfn.texture(*p), 5).alias("texture"), F.round(sqlfn.texture(*p, F.col("v")), 5).alias("wtexture"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice > 200000 THEN 30 ELSE CAST(ROUND((o_totalprice - 1000) / 199000 * 30) AS INT) END AS bin, ROUND(CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice > 200000 THEN 30 ELSE ROUND((o_totalprice - 1000) / 199000 * 30) END * (199000.0 / 30) + 1000, 6) AS low FROM orders")
def linspace_bins(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", sqlfn.linspace(p, 1000, 200_000, 30).alias("bin"), F.round(sqlfn.flinspace(p, 1000, 200_000, 30), 6).alias("low"))


@query("SELECT p_partkey, split_part(p_brand, '#', 2) AS part, CAST(COALESCE(TRY_CAST(regexp_replace(split_part(p_brand, '#', 2), '[^0-9]', '', 'g') AS BIGINT), -1) AS BIGINT) AS number, COALESCE(TRY_CAST(NULLIF(split_part(p_brand, '#', 2), '') AS DOUBLE), -1) AS real, TRY_CAST(p_brand AS DOUBLE) IS NOT NULL AS is_number, p_size || ',' || p_brand AS zame FROM part")
def split_functions(spark, d):
    b = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", sqlfn.split(b, "#", 1).alias("part"), sqlfn.isplit(b, "#", 1).alias("number"), sqlfn.fsplit(b, "#", 1).alias("real"), sqlfn.is_numeric(b).alias("is_number"), sqlfn.zame(F.col("p_size"), b).alias("zame"))


@query("SELECT c_custkey, ROUND(cos(radians(c_acctbal)), 6) AS c, ROUND(sin(radians(c_acctbal)), 6) AS s, ROUND(degrees(atan2(c_acctbal, 100)), 6) AS a, CASE WHEN c_acctbal > 0 THEN ROUND(ln(c_acctbal), 6) ELSE 0 END AS l, CASE WHEN c_acctbal >= 0 THEN ROUND(sqrt(c_acctbal), 6) ELSE 0 END AS r, ROUND((((c_acctbal + 180) % 360) + 360) % 360 - 180, 6) AS wrapped FROM customer")
def scalar_functions(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(sqlfn.cos_deg(b), 6).alias("c"), F.round(sqlfn.sin_deg(b), 6).alias("s"), F.round(sqlfn.atan2_deg(b, F.lit(100.0)), 6).alias("a"), F.round(sqlfn.safe_ln(b), 6).alias("l"), F.round(sqlfn.safe_sqrt(b), 6).alias("r"), F.round(sqlfn.fixang(b), 6).alias("wrapped"))


@query("SELECT c_custkey, ROUND(cos(radians(c_acctbal)), 6) AS c, ROUND(c_acctbal * c_acctbal, 4) AS q, CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 THEN 10 ELSE ROUND(c_acctbal / 9000 * 10) END AS INT) AS b FROM customer")
def sql_functions(spark, d):
    sqlfn.register(spark)
    return spark.sql("SELECT c_custkey, round(cosd(c_acctbal), 6) AS c, round(sq(c_acctbal), 4) AS q, linspace(c_acctbal, 0, 9000, 10) AS b FROM {t}", t=table(spark, d, "customer"))


@query("SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS gx, CAST(floor(l_discount / 0.003 / 10) AS BIGINT) AS gy, COUNT(*) AS n, ROUND(AVG(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1, 2")
def grid_average(spark, d):
    rows = table(spark, d, "lineitem").groupBy(sqlfn.grid2d(F.col("l_quantity"), F.col("l_discount") / 0.003, 10).alias("g"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean")).select("g.gx", "g.gy", "n", "mean")


@query("WITH c AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), m AS (SELECT label, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM c GROUP BY label) SELECT vec_id, ROUND(x - mx, 6) AS x, ROUND(y - my, 6) AS y, ROUND(z - mz, 6) AS z FROM c JOIN m USING (label)")
def centre_samples(spark, d):
    return sqlfn.centre_positions(points(spark, d), "label", F.lit(1.0)).select(F.col("id").alias("vec_id"), *r6("x", "y", "z"))


@query("WITH c AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) SELECT label, CAST(floor((degrees(atan2(y, x)) + 180) / 360 * 8) AS INT) AS sector, ROUND(MIN(sqrt(x * x + y * y)), 6) AS min_r, ROUND(MAX(sqrt(x * x + y * y)), 6) AS max_r, ROUND(AVG(sqrt(x * x + y * y)), 6) AS mean_r FROM c GROUP BY 1, 2")
def sector_radius(spark, d):
    p = points(spark, d).withColumn("weight", F.lit(1.0))
    return sqlfn.sector_radius(p, sqlfn.atan2_deg(F.col("y"), F.col("x")), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 8, "label").select("label", "sector", *r6("min_r", "max_r", "mean_r"))


def points(spark, d) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", *[e[i].cast("double").alias(k) for i, k in enumerate("xyz")])


POINTS = "pts AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


# Matching, tracking, windows


@query(f"WITH {POINTS}, p AS (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM pts a JOIN pts b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS k FROM p) SELECT id, other, ROUND(dist, 6) AS dist FROM r WHERE k = 1")
def nearest_neighbour(spark, d):
    p = points(spark, d)
    return match.nearest(p, p).select("id", "other", *r6("dist"))


@query(
    f"WITH {POINTS}, a AS (SELECT *, 1 + label % 3 AS volume FROM pts WHERE id % 2 = 0), b AS (SELECT *, 1 + label % 3 AS volume FROM pts WHERE id % 2 = 1), p AS (SELECT a.id AS a, b.id AS b, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2, CASE WHEN ABS(a.volume - b.volume) / ((a.volume + b.volume) / 2) > 0.5 THEN 25000000.0 ELSE 0 END AS pen FROM a CROSS JOIN b), q AS (SELECT a, b, d2 + pen AS cost FROM p WHERE d2 <= 0.04), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cost, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY cost, a) AS rb FROM q) SELECT a, b, ROUND(sqrt(cost), 4) AS match_dist, rb = 1 AS bij_matched FROM r WHERE ra = 1"
)
def track_match(spark, d):
    p = points(spark, d).withColumn("volume", 1 + F.col("label") % 3)
    return match.match_frames(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.2).select("a", "b", F.round("match_dist", 4).alias("match_dist"), "bij_matched")


@query("WITH p AS (SELECT event_id, user_id, value AS x, value * value AS y, CAST(event_id % 7 AS DOUBLE) AS z FROM events), s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, user_id, ROUND(dx, 6) AS dx, ROUND(sqrt(dx * dx + dy * dy + dz * dz), 4) AS step, ROUND(COALESCE(SUM(sqrt(dx * dx + dy * dy + dz * dz)) OVER (PARTITION BY user_id ORDER BY event_id), 0), 3) AS path FROM s")
def track_displacement(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("x"), (F.col("value") * F.col("value")).alias("y"), (F.col("event_id") % 7).cast("double").alias("z"))
    return match.displacement(e, ["user_id"], "event_id").select("event_id", "user_id", *r6("dx"), F.round("step", 4).alias("step"), F.round("path", 3).alias("path"))


@query("WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, bool_or(event_type = (SELECT MIN(event_type) FROM events)) AS present FROM events GROUP BY 1, 2) SELECT user_id, day, CAST(present AS INT) - COALESCE(CAST(lag(present) OVER (PARTITION BY user_id ORDER BY day) AS INT), 0) AS change FROM s")
def status_changes(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("first"))
    s = e.crossJoin(F.broadcast(first)).groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.bool_or(F.col("event_type") == F.col("first")).alias("present"))
    return match.appearances(s, ["user_id"], "day").select("user_id", "day", "change")


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT event_id % 50 AS t, user_id % 1000 AS id, event_id % 997 % 1000 AS n FROM events), l AS (SELECT {'t': t, 'id': id} AS a, {'t': t + 1, 'id': n} AS b FROM e), lb AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, a AS b FROM lb UNION SELECT r.a, j.b FROM r JOIN lb j ON r.b = j.a), m AS (SELECT a, MIN(b) AS f FROM r GROUP BY a) SELECT a.t AS t, a.id AS id, f.t AS chain_t, f.id AS chain_id FROM m"
)
def track_chains(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 50).alias("t"), (F.col("user_id") % 1000).alias("id"), (F.col("event_id") % 997 % 1000).alias("next_id"))
    return match.chains(e.distinct())


_CENTRES = [[0.0, 0.0, 0.0], [0.1, 0.1, 0.1], [-0.1, 0.1, 0.0]]


@query(f"WITH {POINTS}, k AS (SELECT *, x * x + y * y + z * z AS d0, pow(x - 0.1, 2) + pow(y - 0.1, 2) + pow(z - 0.1, 2) AS d1, pow(x + 0.1, 2) + pow(y - 0.1, 2) + z * z AS d2 FROM pts) SELECT CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, COUNT(*) AS n, ROUND(AVG(x), 6) AS x, ROUND(AVG(y), 6) AS y, ROUND(AVG(z), 6) AS z FROM k GROUP BY 1")
def kmeans_step(spark, d):
    return match.kmeans_step(points(spark, d), _CENTRES, ["x", "y", "z"]).select("cluster", "n", *r6("x", "y", "z"))


@query(f"WITH {POINTS}, {oracles.lloyd('pts', 'SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS cluster, x, y, z FROM (SELECT * FROM pts ORDER BY id LIMIT 4)', 5, ['x', 'y', 'z'], 4)} SELECT cluster, ROUND(x, 6) AS x, ROUND(y, 6) AS y, ROUND(z, 6) AS z FROM c5")
def kmeans_centres(spark, d):
    centres = match.kmeans(points(spark, d), 4, ["x", "y", "z"], "id", epsilon=0.0, rounds=5)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "cluster int, x double, y double, z double").select("cluster", *r6("x", "y", "z"))


@query(f"WITH {POINTS}, e AS (SELECT id AS a, id + 1 AS b FROM pts) SELECT e.a, e.b, ROUND((p.x + q.x) / 2, 6) AS mid_x, ROUND(q.y - p.y, 6) AS dir_y FROM e JOIN pts p ON p.id = e.a JOIN pts q ON q.id = e.b")
def edge_geometry(spark, d):
    p = points(spark, d)
    return match.join_edges(p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), p).select("a", "b", *r6("mid_x", "dir_y"))


@query(f"WITH {POINTS}, e AS (SELECT p.id AS a, q.id AS b, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM pts p JOIN pts q ON q.id = p.id + 1), f AS (SELECT a, b, CASE WHEN sqrt(dx*dx+dy*dy+dz*dz) > 0 THEN dx / sqrt(dx*dx+dy*dy+dz*dz) * (0.5 - sqrt(dx*dx+dy*dy+dz*dz)) ELSE 0 END AS fx FROM e), s AS (SELECT a AS id, fx FROM f UNION ALL SELECT b, -fx FROM f) SELECT id, ROUND(SUM(fx), 6) AS fx FROM s GROUP BY id")
def graph_forces(spark, d):
    p = points(spark, d)
    return match.forces(p, p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), 0.5).select("id", *r6("fx"))


@query(f"WITH RECURSIVE {POINTS}, e AS (SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q ON q.id = p.id + 1 WHERE abs(q.x - p.x) + abs(q.y - p.y) < 0.15), j AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, a AS b FROM j UNION SELECT r.a, j.b FROM r JOIN j ON r.b = j.a) SELECT a AS node, MIN(b) AS root FROM r GROUP BY a")
def grow_edge_groups(spark, d):
    p = points(spark, d)
    e = match.join_edges(p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), p)
    return match.grow_edges(e.withColumn("distance", F.abs("dir_x") + F.abs("dir_y")), 0.15)


# Sorts, sets, sampling, sweeps


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).subtract(table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query("SELECT c_custkey, n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def named_objects(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE CAST(CAST('0x' || substr(md5('7:' || l_orderkey || ':' || l_linenumber), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < CASE l_returnflag WHEN 'A' THEN 0.1 WHEN 'R' THEN 0.2 WHEN 'N' THEN 0.05 ELSE 0 END")
def stratified_sample(spark, d):
    return keyed.sample_by_key(table(spark, d, "lineitem"), "l_returnflag", {"A": 0.1, "R": 0.2, "N": 0.05}, ["l_orderkey", "l_linenumber"], seed=7).select("l_orderkey", "l_linenumber", "l_returnflag")


@query(f"{VOX} SELECT t AS threshold, s AS scale, COUNT(*) AS n, SUM(v * s) AS total FROM vox, (SELECT unnest([200.0, 400.0, 600.0, 800.0])::DOUBLE AS t), (SELECT unnest([1, 2]) AS s) WHERE v > t GROUP BY 1, 2")
def parameter_sweep(spark, d):
    def run(df, threshold, scale):
        return df.where(F.col("v") > threshold).agg(F.count("*").alias("n"), F.sum(F.col("v") * scale).alias("total"))

    return params.run_sweep(vox(spark, d), {"threshold": params.linear(200, 1000, 4), "scale": [1, 2]}, run)


@query("SELECT SUM(n) AS n, ROUND(SUM(n * bin) / SUM(n), 6) AS mean, ROUND(sqrt(SUM(n * bin * bin) / SUM(n) - pow(SUM(n * bin) / SUM(n), 2)), 6) AS std FROM (SELECT l_quantity AS bin, CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)")
def histogram_metrics(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    return tables.histogram_stats(h).select("n", *r6("mean", "std"))


# Frames and streams


@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 6) AS mean FROM events GROUP BY 1, 2, 3")
def event_windows(spark, d):
    return frames.windowed(table(spark, d, "events"), "event_type", "value", "1 hour").select("start", "end", "event_type", "n", F.round("total", 4).alias("total"), *r6("mean"))


@query("WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, event_type, value FROM events, (SELECT unnest([0, 1, 2]) AS k)) SELECT start, start + INTERVAL 3 HOUR AS end, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 6) AS mean FROM w GROUP BY 1, 2, 3")
def event_sliding_windows(spark, d):
    return frames.windowed(table(spark, d, "events"), "event_type", "value", "3 hours", "1 hour").select("start", "end", "event_type", "n", F.round("total", 4).alias("total"), *r6("mean"))


@query("SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1")
def streamed_totals(spark, d):
    """The events file as a stream, in one run to its end; every batch's state goes to the shared folder, the last is read."""
    import uuid

    from ..session import shared_dir

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*")
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    frames.each_batch(frames.running_totals(stream, "event_type", "value"), lambda b: b, f"{where}/out", f"{where}/state", "complete").awaitTermination()
    out = spark.read.schema("event_type string, n long, total double, last timestamp, batch int").parquet(f"{where}/out")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).select("event_type", "n", F.round("total", 4).alias("total"))


def event_frames(spark, d) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), F.col("l_linenumber").alias("i")).agg(F.sum("l_quantity").alias("v"))
    full = e.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    level = F.element_at(F.array(F.lit(0.0), F.lit(1000.0), F.lit(2000.0)), (F.col("frame") % 3 + 1).cast("int"))
    return full.select("frame", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / 10000 + level).alias("data"))


@query(
    "WITH e AS (SELECT l_suppkey AS frame, l_linenumber AS i, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2), f AS (SELECT frame, CAST(i AS INT) AS i, COALESCE(v, 0) / 10000 + [0.0, 1000.0, 2000.0][CAST(frame % 3 AS INT) + 1]::DOUBLE AS v FROM (SELECT DISTINCT frame FROM e) CROSS JOIN (SELECT unnest(range(1, 8)) AS i) LEFT JOIN e USING (frame, i)), dark AS (SELECT i, AVG(v) AS dark FROM f WHERE frame % 3 = 0 GROUP BY i), flat AS (SELECT i, AVG(v) AS flat FROM f WHERE frame % 3 = 2 GROUP BY i) SELECT frame, list(ROUND((v - dark) / (flat - dark), 6) ORDER BY i) AS data FROM f JOIN dark USING (i) JOIN flat USING (i) WHERE frame % 3 = 1 GROUP BY frame"
)
def flat_field_correction(spark, d):
    return frames.flat_field(event_frames(spark, d)).select("frame", F.transform("data", lambda v: F.round(v, 6)).alias("data"))


@query(
    f"WITH RECURSIVE {vox_sql()}, c AS (SELECT CAST(z AS BIGINT) AS f, x, y, CAST(x + 16 * y + 1 AS BIGINT) AS id FROM vox WHERE v > 900), j AS (SELECT a.f, a.id AS a, b.id AS b FROM c a JOIN c b ON a.f = b.f AND abs(a.x - b.x) + abs(a.y - b.y) = 1), r AS (SELECT f, id AS a, id AS b FROM c UNION SELECT r.f, r.a, j.b FROM r JOIN j ON r.f = j.f AND r.b = j.a), l AS (SELECT f, a AS id, MIN(b) AS label FROM r GROUP BY 1, 2) SELECT c.f AS frame, label, COUNT(*) AS n, ROUND(AVG(x), 6) AS x, ROUND(AVG(y), 6) AS y FROM c JOIN l ON l.f = c.f AND l.id = c.id GROUP BY 1, 2"
)
def cell_tracking(spark, d):
    slices = pointwise.to_slices(vox(spark, d), 16, 16)
    return frames.track_cells(slices.select(F.col("z").cast("long").alias("frame"), "data"), 900, 16).select("frame", "label", "n", *r6("x", "y"))


from . import catalog_files, catalog_tables  # noqa: E402, F401  (they add their queries)
