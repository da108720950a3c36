"""Queries over sources and sinks: what is written to the shared folder must be read back as it was."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import algebra, grow, pointwise, shape, stencil
from ..session import shared_dir
from ..sources import images, phantoms, tables, volumes
from ..streaming import frames
from . import registry, workflow
from .catalog import COMPONENTS, DENSE, DIM, DISTANCE, KEYS, LABELS, OFF, RIDGE, SPARSE, VOX, labelled, mask, query, r6, sparse, table, vox, vox_sql

ALL = f"{VOX} SELECT x, y, z, v FROM vox"


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tiffs(spark, d, name: str = "tiffs", dtype: str = "f8") -> str:
    path = folder(spark, name)
    volumes.write_image(vox(spark, d), path, 16, 16, dtype)
    return path


@query(ALL)
def tiff_folder(spark, d):
    """A folder of TIFF slices, written and read: slices are ranked from 0 by name, those of the table begin at 1."""
    return volumes.read_image(spark, tiffs(spark, d)).where("v > 0").withColumn("z", F.col("z") + 1)


@query(f"{VOX} SELECT x, y, z, CAST(v AS BIGINT) AS v FROM vox")
def tiff_labels(spark, d):
    return volumes.read_image(spark, tiffs(spark, d, dtype="i4"), kind="label").where("v > 0").withColumn("z", F.col("z") + 1)


@query(f"{VOX} SELECT x, y, z, true AS v FROM vox")
def tiff_mask(spark, d):
    return volumes.read_image(spark, tiffs(spark, d, dtype="f4"), kind="binary").where("v").withColumn("z", F.col("z") + 1)


@query(ALL)
def raw_folder(spark, d):
    path = folder(spark, "slices") + "-raw"
    volumes.write_image(vox(spark, d), path, 16, 16)
    return volumes.read_image(spark, path, reader=images.raw_reader(16, 16, "<f8")).where("v > 0").withColumn("z", F.col("z") + 1)


@query(f"{VOX} SELECT x, y, v FROM vox WHERE z = 3")
def single_slice(spark, d):
    return volumes.read_slice(spark, tiffs(spark, d), 3).where("v > 0")


@query(f"{VOX} SELECT CAST(z AS DOUBLE) AS t, COUNT(*) AS n, SUM(v) AS total FROM vox GROUP BY z")
def frames_from_names(spark, d):
    """A stack of independent frames: the number in a file's name is its time."""
    pages = images.decode(images.image_files(spark, tiffs(spark, d), "*.tif"))
    rows = images.frames_by_name(pages).select("t", F.explode("data").alias("v")).where("v > 0")
    return rows.groupBy("t").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("WITH g AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(5)) AS x), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(3)) AS z)) SELECT x, y, z, CAST(x + 10 * y + 100 * z - 50 AS DOUBLE) AS v FROM g")
def isq_volume(spark, d):
    """An ISQ file, as its writer makes it, through the reader."""
    z, y, x = np.mgrid[0:3, 0:4, 0:5]
    files = spark.createDataFrame([("scan.isq", images.write_isq(x + 10 * y + 100 * z - 50))], "path string, content binary")
    pages = images.stack(images.decode(files)).select("z", F.posexplode("data").alias("i", "v"))
    return pages.select((F.col("i") % 5).cast("int").alias("x"), F.floor(F.col("i") / 5).cast("int").alias("y"), "z", "v")


@query("WITH g AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(6)) AS x), (SELECT unnest(range(5)) AS y), (SELECT unnest(range(4)) AS z)) SELECT x, y, z, CAST(x * y + z AS DOUBLE) AS v FROM g")
def driver_image(spark, d):
    z, y, x = np.mgrid[0:4, 0:5, 0:6]
    return volumes.distribute(spark, x * y + z)


@query(f"{ALL} WHERE z >= 2 AND z < 5")
def stored_image(spark, d):
    """An image stored with its geometry, read back and cropped to the slices that geometry gives."""
    path = folder(spark, "object")
    volumes.save_object(vox(spark, d), path, (16, 16, 3), (0, 0, 2))
    df, pos, dim, _ = volumes.read_object(spark, path)
    return pointwise.crop(df, pos, dim).select(*KEYS, "v")


@query(ALL)
def voxel_parquet(spark, d):
    path = folder(spark, "voxels") + ".parquet"
    volumes.write_image(vox(spark, d), path)
    return volumes.read_image(spark, path)


@query(ALL)
def voxel_csv(spark, d):
    path = folder(spark, "voxels") + ".csv"
    volumes.write_image(vox(spark, d), path)
    return volumes.read_image(spark, path)


@query("SELECT x::INT AS x, 0 AS y, z::INT AS z, p_partkey AS label, 'cell' AS type FROM part, LATERAL (SELECT unnest(range(p_partkey % 5, p_partkey % 5 + 3)) AS x), LATERAL (SELECT unnest(range(2)) AS z)")
def lattice_text(spark, d):
    """Cell-lattice lines among others, which are left out."""
    p = table(spark, d, "part")
    x = F.col("p_partkey") % 5
    lines = p.select(F.concat_ws(" ", "p_partkey", F.lit("cell"), x, x + 2, F.lit("0 0 0 1")).alias("value")).union(p.select(F.lit("Include Clusters")).limit(1)).union(p.select(F.lit("1 cell 0 1 0")).limit(1))
    path = folder(spark, "lattice")
    lines.write.text(path)
    return tables.read_lattice(spark, path)


@query("SELECT CAST(p_partkey AS DOUBLE) AS lacuna_number, CAST(p_size AS DOUBLE) AS volume, p_retailprice AS pos_x FROM part")
def object_csv(spark, d):
    """Object tables with // headers; rows with another number of fields are dropped."""
    p = table(spark, d, "part")
    lines = p.select(F.concat_ws(", ", "p_partkey", "p_size", "p_retailprice").alias("value"))
    lines = spark.createDataFrame([("// sample",), ("//LACUNA_NUMBER, VOLUME, POS_X",), ("1, 2",), ("1, 2, 3, 4",)], "value string").union(lines)
    path = folder(spark, "objects")
    lines.coalesce(1).write.text(path)
    return tables.read_objects(spark, path)


@query("SELECT p_partkey AS label, p_size AS volume, n, total FROM part LEFT JOIN (SELECT l_partkey, COUNT(*) AS n, SUM(l_quantity) AS total FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey")
def csv_with_new_columns(spark, d):
    """Columns appended by key to a stored CSV of objects, which is written again and read."""
    first, second = folder(spark, "objects"), folder(spark, "objects")
    tables.write_csv(table(spark, d, "part").select(F.col("p_partkey").alias("label"), F.col("p_size").alias("volume")), first)
    stats = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("label")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    tables.write_csv(shape.append_columns(spark.read.csv(first, header=True, schema="label long, volume int"), stats), second)
    return spark.read.csv(second, header=True, schema="label long, volume int, n long, total double")


@query(f"{VOX}, {LABELS}, {OFF} SELECT a.label AS a, b.label AS b, COUNT(*) AS n FROM lab a CROSS JOIN off JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.label <> b.label GROUP BY 1, 2")
def edge_csv(spark, d):
    path = folder(spark, "edges")
    tables.write_csv(shape.contacts(labelled(spark, d).drop("v")), path)
    return spark.read.csv(path, header=True, schema="a long, b long, n long")


@query("SELECT l_quantity AS bin, CAST(COUNT(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) - COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def histogram_text(spark, d):
    """Histogram text files, read and subtracted."""
    paths = {}
    for flag in "AR":
        paths[flag] = folder(spark, "histogram")
        h = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_quantity").count()
        h.select(F.concat_ws("\t", "l_quantity", "count")).union(spark.createDataFrame([("bin\tcount",)], "s string")).write.text(paths[flag])
    return tables.subtract_histogram(tables.read_histogram(spark, paths["A"]), tables.read_histogram(spark, paths["R"]))


@query("SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1")
def json_scan(spark, d):
    path = folder(spark, "events")
    table(spark, d, "events").select("event_type", "value").write.json(path)
    return spark.read.schema("event_type string, value double").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT n_name || '|' || n_regionkey AS line FROM nation")
def text_sink(spark, d):
    path = folder(spark, "text")
    table(spark, d, "nation").select(F.concat_ws("|", "n_name", "n_regionkey")).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# Streams of files


@query(f"{VOX} SELECT CAST(z AS DOUBLE) AS t, MIN(COALESCE(b.v, 0)) AS min, ROUND(SUM(b.v) / 256, 6) AS mean, MAX(b.v) AS max FROM (SELECT x, y, zz.z, vox.v FROM (SELECT DISTINCT z FROM vox) zz CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y) LEFT JOIN vox USING (x, y, z)) b GROUP BY z")
def streamed_frames(spark, d):
    """TIFF files as a stream, decoded in each micro-batch; the statistics of every frame are read from the sink."""
    where = folder(spark, "stream")
    stream = frames.binary_stream(spark, tiffs(spark, d))

    def stats(batch):
        return frames.frame_stats(images.frames_by_name(images.decode(batch))).select("t", "min", "mean", "max")

    frames.each_batch(stream, stats, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema("t double, min double, mean double, max double").parquet(f"{where}/out/*").select("t", "min", *r6("mean"), "max")


def event_stream(spark, d):
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark, df, name: str, schema: str, mode: str = "append"):
    """The rows that a stream appends in one run to its end, from files in the shared folder."""
    where = folder(spark, name)
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{where}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark, d):
    """The first event of each user and type, duplicates dropped under a watermark that bounds the state."""
    out = event_stream(spark, d).withWatermark("ts", "3650 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    return streamed(spark, out, "dedup", "user_id long, event_type string")


@query("SELECT a.event_id AS a, b.event_id AS b, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def stream_stream_join(spark, d):
    """Pairs of a user's events within an hour: two streams with watermarks, and a time bound that lets state go."""
    a = event_stream(spark, d).select(F.col("event_id").alias("a"), F.col("ts").alias("ta"), F.col("user_id")).withWatermark("ta", "30 days")
    b = event_stream(spark, d).select(F.col("event_id").alias("b"), F.col("ts").alias("tb"), F.col("user_id").alias("user_b")).withWatermark("tb", "30 days")
    near = F.expr("user_id = user_b AND a < b AND tb >= ta AND tb <= ta + INTERVAL 1 HOUR")
    return streamed(spark, a.join(b, near).select("a", "b", "user_id"), "pairs", "a long, b long, user_id long")


@query(
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o) SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOUR AS end, COUNT(*) AS n FROM g GROUP BY user_id, s"
)
def session_windows(spark, d):
    """Sessions of a user: events less than six hours apart."""
    return frames.sessions(table(spark, d, "events"), "user_id", "6 hours")


@query("SELECT COUNT(*) FILTER (WHERE event_id % 10 <> 0) AS n FROM events")
def late_events_dropped(spark, d):
    """Every tenth event comes batches later than all others and years late: the watermark, which is in force a batch
    after it is reached, leaves it out of the windows."""
    where = folder(spark, "late")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    late = spark.sql("SELECT -1L AS event_id, TIMESTAMP '2200-01-01' AS ts")
    for i, part in enumerate((e.where("event_id % 10 <> 0"), late, late, e.where("event_id % 10 = 0"))):
        part.coalesce(1).write.mode("append").parquet(f"{where}/in/p={i}")
    stream = spark.readStream.schema("event_id long, ts timestamp, p int").option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("n", F.col("window.end").alias("end"))
    return streamed(spark, counts, "late", "n long, end timestamp").where("end < '2199-01-01'").agg(F.sum("n").alias("n"))


# Layouts, spreads and statistics of slices


@query(f"WITH {vox_sql(chr(39).join(['l_returnflag = ', 'A', '']), 'a')}, {vox_sql(chr(39).join(['l_returnflag = ', 'R', '']), 'b')}, c AS (SELECT z, x, y FROM (SELECT DISTINCT z FROM a WHERE z IN (SELECT z FROM b)) CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y)) SELECT c.z, CAST(x + 16 * y AS INT) AS i, COALESCE(a.v, 0) AS left_v, COALESCE(b.v, 0) AS right_v FROM c LEFT JOIN a USING (x, y, z) LEFT JOIN b USING (x, y, z)")
def zipped_slices(spark, d):
    a, b = (pointwise.to_slices(vox(spark, d, f"l_returnflag = '{f}'"), 16, 16) for f in "AR")
    out = algebra.zip_slices(a, b).select("z", F.posexplode("data").alias("i", "p"))
    return out.select("z", "i", F.col("p.data").alias("left_v"), F.col("p.other").alias("right_v"))


@query(f"{VOX}, s AS (SELECT z, SUM(v) AS total FROM vox GROUP BY z) SELECT s.z + d::INT AS z, s.z AS source, total FROM s, (SELECT unnest([-1, 0, 1]) AS d)")
def slice_neighbours(spark, d):
    out = stencil.spread_slices(pointwise.to_slices(vox(spark, d), 16, 16), 1)
    return out.select("z", "source", F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query(f"{VOX}, c AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(2, 6)) AS x), (SELECT unnest(range(3, 5)) AS y), (SELECT unnest(range(5, 10)) AS z)) SELECT z, CAST(x - 2 + 4 * (y - 3) AS INT) AS i, COALESCE(v, 0) AS v FROM c LEFT JOIN vox USING (x, y, z)")
def cropped_slices(spark, d):
    """Slices cropped in z and within; slices that are not there are blank."""
    out = pointwise.crop_slices(pointwise.to_slices(vox(spark, d), 16, 16), 16, (2, 3, 5), (4, 2, 5))
    return out.select("z", F.posexplode("data").alias("i", "v"))


@query(f"{VOX}, b AS (SELECT x, y, zz.z, COALESCE(vox.v, 0) AS v FROM (SELECT DISTINCT z FROM vox) zz CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y) LEFT JOIN vox USING (x, y, z)) SELECT z, MIN(v) AS min, ROUND(AVG(v), 6) AS mean, MAX(v) AS max FROM b GROUP BY z")
def slice_statistics(spark, d):
    return frames.frame_stats(pointwise.to_slices(vox(spark, d), 16, 16)).select("z", "min", *r6("mean"), "max")


@query(f"{VOX} SELECT x + 5 AS x, y, z * 2 AS z, ROUND(v + x, 6) AS v FROM vox")
def mapped_voxels(spark, d):
    """Key and value mapped together, into a new geometry."""
    return pointwise.map_voxels(vox(spark, d), x=F.col("x") + 5, z=F.col("z") * 2, v=F.col("v") + F.col("x"))


@query(f"{VOX} SELECT x, y, z, ROUND(2 * v - x, 4) AS a, ROUND(v * v, 4) AS b, ROUND(sqrt((2 * v - x) * (2 * v - x) + v * v * v * v), 3) AS length FROM vox")
def vector_voxels(spark, d):
    """Array-valued voxels: sum, difference, product and length."""
    v, x = F.col("v"), F.col("x").cast("double")
    df = vox(spark, d).select(*KEYS, F.array(v, v).alias("v"), pointwise.vector_op(F.array(v - x, v), F.array(F.lit(0.0), v - 1), "+").alias("w"))
    a = pointwise.vector_op("v", "w", "+")
    out = F.array(a[0], (pointwise.vector_op("v", "v", "*"))[0])
    return df.select(*KEYS, F.round(out[0], 4).alias("a"), F.round(out[1], 4).alias("b"), F.round(pointwise.magnitude(out), 3).alias("length"))


@query(f"{VOX} SELECT x AS row, z AS col, a.v + b.v AS v FROM vox a JOIN vox b USING (x, z) WHERE a.y = 1 AND b.y = 2")
def plane_sum(spark, d):
    v = vox(spark, d)
    return pointwise.matrix_op(pointwise.plane(v, ("x", "z"), 1), pointwise.plane(v, ("x", "z"), 2), "+")


@query(f"{VOX} SELECT x, y, z, ROUND(ABS(COALESCE(AVG(v) FILTER (WHERE r >= 1 AND r <= 2), NULL) - AVG(v) FILTER (WHERE r < 1)), 6) AS v FROM (SELECT a.x, a.y, a.z, b.v, ROUND(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2))) AS r FROM vox a JOIN vox b ON abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2 AND abs(b.z - a.z) <= 2) GROUP BY x, y, z")
def laplace_filter_wide(spark, d):
    return stencil.laplace(vox(spark, d), 2).select(*KEYS, *r6("v"))


@query(f"{VOX}, {LABELS} SELECT label, COUNT(*) AS n FROM lab GROUP BY label")
def label_sizes(spark, d):
    from ..operators import components

    return components.group_counts(labelled(spark, d))


@query(f"{VOX}, {LABELS}, m AS (SELECT label, COUNT(*) AS n FROM lab GROUP BY label) SELECT COUNT(*) AS groups, ROUND(AVG(n), 6) AS average_volume FROM m")
def label_info(spark, d):
    return shape.info(labelled(spark, d)).select("groups", *r6("average_volume"))


@query(
    f"{VOX}, {LABELS}, m AS (SELECT label, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM lab WHERE v < 900 GROUP BY label) SELECT label, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(covar_pop(x, v) + 1e-7, 4) AS cov_x, ROUND(covar_pop(y, v) + 1e-7, 4) AS cov_y, ROUND(covar_pop(z, v) + 1e-7, 4) AS cov_z, ROUND(sqrt(SUM(v * pow(x - cx, 2)) / SUM(v)), 5) AS sov_x FROM lab JOIN m USING (label) WHERE v < 900 GROUP BY label"
)
def gray_analysis_full(spark, d):
    """Inverted threshold; covariances of value and place (moved off the ties of rounding), and the value-weighted spread."""
    lab = labelled(spark, d)
    out = shape.gray_columns(lab.drop("v"), vox(spark, d), 900, invert=True)
    return out.select("label", "n", *r6("mean"), *[F.round(F.col(f"cov_{k}") + 1e-7, 4).alias(f"cov_{k}") for k in KEYS], F.round("sov_x", 5).alias("sov_x"))


@query(f"{VOX} SELECT CAST(LEAST(GREATEST(floor(sqrt(pow(x - 7.5, 2) + pow(y - 7.5, 2)) / 1.2), 0), 10) AS INT) AS a, CAST(LEAST(GREATEST(floor((atan2(y - 7.5, x - 7.5) + 3.2) / 0.8), 0), 8) AS INT) AS b, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, MIN(v) AS min, MAX(v) AS max FROM vox GROUP BY 1, 2")
def polar_histogram(spark, d):
    """Radius by angle, about the image's axis."""
    from ..operators import hist

    out = hist.histogram2d(vox(spark, d), pointwise.position("cyl_r", 7.5, 7.5), pointwise.position("cyl_theta", 7.5, 7.5), ((0, 12, 10), (-3.2, 3.2, 8)))
    return out.select("a", "b", "n", *r6("mean"), "min", "max")


@query(f"{VOX}, {DENSE}, {OFF}, n AS (SELECT dx, dy, dz, COUNT(*) AS n, AVG(CAST(b.v AS INT)) AS mean FROM dense a CROSS JOIN off JOIN dense b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.v GROUP BY 1, 2, 3 HAVING COUNT(*) > 5), f AS (SELECT dx, dy, dz, n, CASE WHEN n < 0.25 * (SELECT AVG(n) FROM n) THEN 0 ELSE mean END AS mean FROM n) SELECT CAST(ROUND(sqrt(dx * dx + dy * dy + dz * dz)) AS INT) AS r, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(mean * n) / SUM(n), 6) AS mean FROM f GROUP BY 1")
def radial_distribution(spark, d):
    from ..operators import hist

    return hist.radial(hist.correlation(mask(spark, d), 1)).select("r", "n", *r6("mean"))


@query(f"{VOX} SELECT x, y, z, v > 300 AND v <= 900 AS v FROM vox")
def threshold_block(spark, d):
    return workflow.pipeline([workflow.threshold_block("image", "mask", 300, 900)], {"image": vox(spark, d)})["mask"]


@query(f"{VOX} SELECT x, y, z, ROUND(SUM(v * exp(-(dx * dx + dy * dy + dz * dz))) / SUM(exp(-(dx * dx + dy * dy + dz * dz))), 6) > 500 AS v FROM (SELECT a.x, a.y, a.z, b.v, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM vox a JOIN vox b ON abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND abs(b.z - a.z) <= 1) GROUP BY x, y, z")
def fluent_filter_threshold(spark, d):
    """The fluent image: an operator by name and parameter string, then a threshold."""
    out = registry.Image(vox(spark, d), DIM).filter("-filter=1 -radius=1.0 -neighborhood=1")
    return registry.Image(out.df.withColumn("v", F.round("v", 6)), DIM).threshold(500).df


@query("SELECT * FROM (VALUES ('ComponentLabel', 64, 'local'), ('ComponentLabel', 100000000000, 'spark')) t(name, voxels, plugin)")
def plugin_choice(spark, d):
    """The best plug-in of a name by an image's size: those that hold it, then the fastest."""
    rows = [("ComponentLabel", n, registry.best("ComponentLabel", n).kind) for n in (64, 100_000_000_000)]
    return spark.createDataFrame(rows, "name string, voxels long, plugin string")


@query(f"{COMPONENTS} SELECT label, COUNT(*) AS n FROM lab GROUP BY label")
def local_component_label(spark, d):
    """The in-memory plug-in on a small image gives the labels of the distributed one."""
    out = registry.best("ComponentLabel", DIM[0] * DIM[1] * DIM[2]).run(registry.Image(sparse(spark, d), DIM), kernel="cross")
    return out.groupBy("label").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(12)) AS x), (SELECT unnest(range(12)) AS y), (SELECT unnest(range(12)) AS z)) SELECT x, y, z, x = y AND y = z AS line, (x + y + z) % 2 = 1 AS dots, (x + y) % 2 = 1 AS lines, x // 3 % 2 = 0 AS layers, abs(z - (x + y)) < 0.5 AND (x + y) % 2 = z % 2 AS plane FROM g")
def phantom_images(spark, d):
    g = phantoms.grid(spark, (12, 12, 12), F.lit(0))
    return g.select(*KEYS, phantoms.diagonal_line().alias("line"), phantoms.dots().alias("dots"), phantoms.lines().alias("lines"), phantoms.layered("x", 3).alias("layers"), phantoms.diagonal_plane().alias("plane"))


# Images whose edge grows with the table


BIG = "WITH e AS (SELECT CAST(ceil(cbrt(COUNT(*) / 2.0)) AS BIGINT) AS e FROM lineitem), big AS (SELECT CAST(l_orderkey % e AS INT) AS x, CAST(l_partkey % e AS INT) AS y, CAST((l_suppkey + l_linenumber) % e AS INT) AS z, SUM(l_quantity) AS v FROM lineitem, e GROUP BY 1, 2, 3)"


def large(spark, d):
    """Two lineitem rows a voxel of a cube, whatever the table's size."""
    rows = table(spark, d, "lineitem")
    e = rows.agg(F.ceil(F.cbrt(F.count("*") / 2.0)).cast("long").alias("e"))
    rows = rows.crossJoin(F.broadcast(e))
    return rows.groupBy((F.col("l_orderkey") % F.col("e")).cast("int").alias("x"), (F.col("l_partkey") % F.col("e")).cast("int").alias("y"), ((F.col("l_suppkey") + F.col("l_linenumber")) % F.col("e")).cast("int").alias("z")).agg(F.sum("l_quantity").alias("v"))


@query(f"{BIG}, {OFF} SELECT a.x, a.y, a.z, ROUND(AVG(b.v), 6) AS v FROM big a CROSS JOIN off JOIN big b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3")
def large_box_mean(spark, d):
    return stencil.box_mean(large(spark, d)).select(*KEYS, *r6("v"))


@query(f"{BIG} SELECT x // 4 AS x, y // 4 AS y, z // 4 AS z, ROUND(AVG(v), 6) AS v FROM big GROUP BY 1, 2, 3")
def large_downsample(spark, d):
    return stencil.downsample(large(spark, d), 4).select(*KEYS, *r6("v"))


@query(f"{BIG}, m AS (SELECT x, y, z, v > 80 AS v FROM big), f AS (SELECT z, COUNT(*) FILTER (WHERE v) AS full_, COUNT(*) AS n FROM m GROUP BY z) SELECT z, full_ AS inside, n - full_ AS outside FROM f")
def large_phase_profile(spark, d):
    m = pointwise.threshold(large(spark, d), ">", 80)
    return m.groupBy("z").agg(F.count_if("v").alias("inside"), F.count_if(~F.col("v")).alias("outside"))


# Variants


@query("WITH g AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT unnest(range(8)) AS x), (SELECT unnest(range(7)) AS y), (SELECT unnest(range(6)) AS z)) SELECT x, y, z, CAST(z AS DOUBLE) AS along, ROUND(sqrt(pow(x - 3.3, 2) + pow(y - 2.9, 2)), 6) AS cyl_r, ROUND(atan2(y - 2.9, x - 3.3), 6) AS cyl_theta, ROUND(acos((z - 2.2) / sqrt(pow(x - 3.3, 2) + pow(y - 2.9, 2) + pow(z - 2.2, 2))), 6) AS sph_phi, 1.0::DOUBLE AS constant FROM g")
def position_functions(spark, d):
    g = phantoms.grid(spark, (8, 7, 6), F.lit(0))
    at = {n: pointwise.position(n, 3.3, 2.9, 2.2) for n in ("cyl_r", "cyl_theta", "sph_phi")}
    return g.select(*KEYS, pointwise.position("z").alias("along"), *[F.round(c, 6).alias(n) for n, c in at.items()], pointwise.position("constant").alias("constant"))


@query(f"{VOX}, c AS (SELECT zz.z, x, y, COALESCE(vox.v, 0) AS v FROM (SELECT DISTINCT z FROM vox) zz CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y) LEFT JOIN vox USING (x, y, z)) SELECT z, CAST(x + 16 * y AS INT) AS i, ROUND(sqrt(v) + z, 6) AS v FROM c")
def mapped_slices(spark, d):
    """A function of value and place over slices, without leaving their layout."""
    out = pointwise.to_slices(vox(spark, d), 16, 16).select("z", F.transform("data", lambda v: F.sqrt(v) + F.col("z")).alias("data"))
    return out.select("z", F.posexplode("data").alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"{VOX} SELECT x, y, z, ROUND(1.0 / v, 9) AS v FROM vox")
def inverted_image(spark, d):
    return pointwise.invert(vox(spark, d)).select(*KEYS, F.round("v", 9).alias("v"))


_CENTRES = "t AS (SELECT * FROM dense WHERE v), c AS (SELECT z, AVG(x) AS cx, AVG(y) AS cy, 2 * stddev_pop(x) AS ax, 2 * stddev_pop(y) AS ay FROM t GROUP BY z)"


@query(f"{VOX}, {DENSE}, {_CENTRES} SELECT x, y, z, COALESCE(pow((x - cx) / GREATEST(ax, 0.5), 2) + pow((y - cy) / GREATEST(ay, 0.5), 2) <= 1, false) AS v FROM dense LEFT JOIN c USING (z)")
def ellipse_contour(spark, d):
    from ..operators.contour import contour

    return contour(mask(spark, d), "ellipse")


@query(f"{VOX}, {DENSE}, {_CENTRES} SELECT x, y, z, COALESCE(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) <= 5.25, false) AS v FROM dense LEFT JOIN c USING (z)")
def fixed_circle_contour(spark, d):
    from ..operators.contour import contour

    return contour(mask(spark, d), "fixed", radius=5.25)


_SHARE = "CAST(CAST('0x' || substr(md5('0:' || {0}x || ':' || {0}y || ':' || {0}z), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < {1}"


@query(f"{DISTANCE}, {RIDGE}, few AS (SELECT * FROM ridge WHERE {_SHARE.format('', 0.25)}) SELECT dm.x, dm.y, dm.z, ROUND(COALESCE(MAX(r.dist), 0), 6) AS thickness FROM dm LEFT JOIN few r ON pow(dm.x - r.x, 2) + pow(dm.y - r.y, 2) + pow(dm.z - r.z, 2) < r.dist * r.dist GROUP BY 1, 2, 3")
def monte_carlo_thickness(spark, d):
    """Of about every fourth ridge voxel."""
    return grow.thickness(grow.distance_map(mask(spark, d)), DIM, min_wall=0.5, sample=4).select(*KEYS, *r6("thickness"))


@query(f"{VOX}, {DENSE}, {OFF}, n AS (SELECT dx, dy, dz, COUNT(*) AS n, AVG(CAST(b.v AS INT)) AS mean FROM dense a CROSS JOIN off JOIN dense b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.v AND {_SHARE.format('a.', 0.5)} GROUP BY 1, 2, 3 HAVING COUNT(*) > 5) SELECT dx, dy, dz, n, ROUND(CASE WHEN n < 0.25 * (SELECT AVG(n) FROM n) THEN 0 ELSE mean END, 6) AS mean FROM n")
def sampled_correlation(spark, d):
    """The two-point function from about every second start voxel."""
    from ..operators import hist

    return hist.correlation(mask(spark, d), 1, sample=2).select("dx", "dy", "dz", "n", *r6("mean"))


@query(f"{VOX}, {SPARSE}, {DENSE}, {OFF}, n AS (SELECT dx, dy, dz, COUNT(*) AS n, AVG(CAST(b.v AS INT)) AS mean FROM dense a CROSS JOIN off JOIN sparse b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.v GROUP BY 1, 2, 3 HAVING COUNT(*) > 5) SELECT dx, dy, dz, n, ROUND(CASE WHEN n < 0.25 * (SELECT AVG(n) FROM n) THEN 0 ELSE mean END, 6) AS mean FROM n")
def two_phase_correlation(spark, d):
    """From voxels of one phase to those of another."""
    from ..operators import hist

    both = mask(spark, d).withColumnRenamed("v", "a").join(sparse(spark, d).withColumnRenamed("v", "b"), KEYS)
    return hist.correlation(both.withColumn("v", F.col("a")), 1, start=F.col("a"), value=F.col("b").cast("double")).select("dx", "dy", "dz", "n", *r6("mean"))


@query(f"{VOX} SELECT y AS row, CAST(z AS BIGINT) AS frame, list(v ORDER BY x) AS data FROM vox GROUP BY 1, 2 HAVING COUNT(*) = 16")
def sinogram_rows(spark, d):
    """Projections transposed to sinograms: a row of each projection."""
    out = frames.sinograms(pointwise.to_slices(vox(spark, d), 16, 16).select(F.col("z").cast("long").alias("frame"), "data"), 16)
    return out.where(~F.array_contains("data", 0.0))


@query(f"{VOX}, c AS (SELECT zz.z, x, y, COALESCE(vox.v, 0) AS v FROM (SELECT DISTINCT z FROM vox) zz CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y) LEFT JOIN vox USING (x, y, z)), m AS (SELECT x, y, AVG(v) AS b FROM c GROUP BY 1, 2), s AS (SELECT z, AVG(abs(v - b)) AS score, SUM(v - b) AS total FROM c JOIN m USING (x, y) GROUP BY z) SELECT z, ROUND(score, 6) AS score, ROUND(total, 4) AS total FROM s WHERE score > 20")
def background_subtracted(spark, d):
    out = frames.subtract_background(pointwise.to_slices(vox(spark, d), 16, 16))
    return out.select("z", *r6("score"), F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"{VOX} SELECT CAST(LEAST(GREATEST(floor((atan2(y - 7.5, x - 7.5) + 3.2) / 0.64), 0), 10) AS INT) AS bin, COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(stddev_pop(v), 6) AS std FROM vox GROUP BY 1")
def angular_profile(spark, d):
    from ..operators import hist

    return hist.profile(vox(spark, d), pointwise.position("cyl_theta", 7.5, 7.5), -3.2, 3.2, 10).select("bin", "n", *r6("mean", "std"))
