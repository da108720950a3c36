"""Queries over object tables and keyed collections: joins, folds, samples, SQL scans, derived metrics, tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlfn
from ..operators import keyed, match, pointwise, shape
from ..sources import tables
from . import oracles, registry, sqlscan
from .catalog import COMPONENTS, DIM, KEYS, LABELS, POINTS, VOX, labelled, points, query, r6, sparse, table, vox

# Joins


@query("SELECT n_nationkey, n_name, c_custkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) RIGHT JOIN nation ON c_nationkey = n_nationkey")
def right_outer_join(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return keyed.join(c, table(spark, d, "nation"), ["n_nationkey"], "right").select("n_nationkey", "n_name", "c_custkey")


@query("SELECT COALESCE(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def full_outer_join(spark, d):
    a = keyed.count_by_value(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")), "k").withColumnRenamed("n", "customers")
    b = keyed.count_by_value(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k").withColumnRenamed("n", "suppliers")
    return keyed.join(a, b, ["k"], "full")


@query("WITH k AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < -900 UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation) SELECT k, COALESCE((SELECT list(c_custkey ORDER BY c_custkey) FROM customer WHERE c_nationkey = k AND c_acctbal < -900), []) AS customers, COALESCE((SELECT list(s_suppkey ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = k), []) AS suppliers, COALESCE((SELECT list(CAST(n_regionkey AS BIGINT)) FROM nation WHERE n_nationkey = k), []) AS regions FROM k")
def cogrouped(spark, d):
    """Three tables grouped together by a key."""
    c = table(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("v"))
    return keyed.cogroup({"customers": c, "suppliers": s, "regions": n}, "k", "v")


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS n FROM supplier) SELECT n, c_custkey, s_suppkey FROM a JOIN b USING (n)")
def zipped_rows(spark, d):
    c, s = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return keyed.zip_rows(c, s, ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"]).select("n", "c_custkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def subtract_by_key(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return keyed.subtract_by_key(c, table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT r_name, n_name FROM region, nation")
def cartesian_product(spark, d):
    """All pairs of two small tables."""
    return table(spark, d, "region").select("r_name").crossJoin(F.broadcast(table(spark, d, "nation").select("n_name")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


# Folds, counts, numbering, samples


@query("SELECT l_suppkey, COUNT(*) AS n, SUM(l_quantity) AS total, MIN(l_quantity) AS least, MAX(l_quantity) AS most FROM lineitem GROUP BY 1")
def combine_by_key(spark, d):
    return keyed.combine_by_key(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@query("SELECT 10 + SUM(l_quantity) AS value FROM lineitem")
def folded(spark, d):
    return keyed.fold(table(spark, d, "lineitem"), "l_quantity", 10.0, "+")


@query("SELECT l_returnflag, SUM(l_quantity) + 1 AS value FROM lineitem GROUP BY 1")
def fold_by_key(spark, d):
    return keyed.fold_by_key(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 1.0)


@query("SELECT l_shipdate, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def count_by_value(spark, d):
    return keyed.count_by_value(table(spark, d, "lineitem"), "l_shipdate", "l_linestatus")


@query("SELECT CAST(b AS INT) AS bucket, e[b + 1] AS low, e[b + 2] AS high, (SELECT COUNT(*) FROM lineitem WHERE l_quantity >= e[b + 1] AND (l_quantity < e[b + 2] OR b = 3 AND l_quantity = e[b + 2])) AS n FROM (SELECT unnest(range(4)) AS b, [0.0, 5.0, 20.0, 21.0, 40.0]::DOUBLE[] AS e)")
def histogram_buckets(spark, d):
    return keyed.bucket_counts(table(spark, d, "lineitem"), "l_quantity", [0.0, 5.0, 20.0, 21.0, 40.0])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders")
def numbered_rows(spark, d):
    return keyed.number(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "index")


@query("SELECT CAST(s_suppkey % 7 AS INT) AS part, list(s_suppkey ORDER BY s_suppkey) AS values FROM supplier GROUP BY 1")
def glommed_parts(spark, d):
    return keyed.glom(table(spark, d, "supplier"), F.col("s_suppkey"), 7, "s_suppkey")


_U = "CAST(CAST('0x' || substr(md5('{}:' || o_orderkey), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@query(f"SELECT o_orderkey FROM orders WHERE {_U.format(3)} < 0.15")
def sampled_rows(spark, d):
    return keyed.sample(table(spark, d, "orders").select("o_orderkey"), 0.15, ["o_orderkey"], 3)


@query(f"SELECT o_orderkey FROM orders ORDER BY {_U.format(4)}, o_orderkey LIMIT 40")
def taken_sample(spark, d):
    return keyed.take_sample(table(spark, d, "orders").select("o_orderkey"), 40, ["o_orderkey"], 4)


@query(f"WITH RECURSIVE c(k, p, c) AS (SELECT 0, exp(-0.8), exp(-0.8) UNION ALL SELECT k + 1, p * 0.8 / (k + 1), c + p * 0.8 / (k + 1) FROM c WHERE k < 63), n AS (SELECT o_orderkey, COUNT(*) AS n FROM orders JOIN c ON c.c <= {_U.format(5)} GROUP BY 1) SELECT o_orderkey, CAST(unnest(range(1, n + 1)) AS INT) AS copy FROM n")
def sampled_with_replacement(spark, d):
    return keyed.sample_with_replacement(table(spark, d, "orders").select("o_orderkey"), 0.8, ["o_orderkey"], 5)


# SQL scans and changes


@query("SELECT l_returnflag, ROUND(AVG(l_quantity), 6) AS q, ROUND(var_pop(l_discount), 8) AS v, ROUND(corr(l_quantity, l_extendedprice), 6) AS c, ROUND(var_pop(l_extendedprice) / pow(AVG(l_extendedprice), 2), 6) AS r FROM lineitem WHERE l_quantity > 10 AND l_linestatus = 'O' GROUP BY l_returnflag")
def pseudo_function_scan(spark, d):
    """Pseudo-functions rewritten, and ? filled by parameters."""
    fields = "l_returnflag, ROUND(AVG(l_quantity), 6) AS q, ROUND(VAR[l_discount], 8) AS v, ROUND(CR[l_quantity;l_extendedprice], 6) AS c, ROUND(RAT[l_extendedprice], 6) AS r"
    return sqlscan.scan(table(spark, d, "lineitem"), fields, "l_quantity > ? AND l_linestatus = ?", "l_returnflag", args=[10, "O"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def limited_scan(spark, d):
    return sqlscan.scan(table(spark, d, "orders"), "o_orderkey, o_totalprice", "o_orderstatus = ?", order="o_totalprice DESC, o_orderkey", records=12, args=["F"])


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey % 10 = 0 THEN 0.5 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'new', s_nationkey, 0.5 FROM supplier WHERE s_suppkey % 10 = 0")
def upserted_rows(spark, d):
    s = table(spark, d, "supplier")
    some = s.where("s_suppkey % 10 = 0").withColumn("s_acctbal", F.lit(0.5))
    changes = some.withColumn("s_nationkey", F.col("s_nationkey") + 1).unionByName(some.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000).withColumn("s_name", F.lit("new")))
    return sqlscan.upsert(s, changes, "s_suppkey")


@query("SELECT s_suppkey, COALESCE(m, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT l_suppkey, MAX(l_extendedprice) AS m FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) ON l_suppkey = s_suppkey")
def updated_column(spark, d):
    new = table(spark, d, "lineitem").where("l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("s_acctbal"))
    return sqlscan.update(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), new, "s_suppkey", ["s_acctbal"])


@query(f"{VOX} SELECT x AS px, CAST(y AS INT) AS py, COUNT(*) AS n, SUM(v) AS total FROM vox WHERE z >= 2 GROUP BY x, y")
def struct_fields(spark, d):
    """Nested images in SQL: fields of a position, elements of a size."""
    images = vox(spark, d).select(F.concat_ws("_", *KEYS).alias("name"), F.struct(F.struct(*KEYS).alias("pos"), F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("elsize"), F.col("v").alias("value")).alias("img"))
    return spark.sql("SELECT img.pos.x AS px, img.pos.y AS py, COUNT(*) AS n, SUM(img.value * img.elsize[2]) / 2 AS total FROM {t} WHERE img.pos.z >= 2 GROUP BY img.pos.x, img.pos.y", t=images)


@query(f"{VOX}, b AS (SELECT zz.z, x, y, COALESCE(vox.v, 0) AS v FROM (SELECT DISTINCT z FROM vox) zz CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y) LEFT JOIN vox USING (x, y, z)) SELECT z, 16 AS nx, ROUND(SUM(v), 4) AS total, MAX(v) AS most FROM b GROUP BY z")
def image_type(spark, d):
    """Images as a struct type (position, size, element size, pixels), used in SQL and read back."""
    slices = pointwise.to_slices(vox(spark, d), 16, 16)
    images = slices.select("z", F.struct(F.array(F.lit(0), F.lit(0), "z").alias("pos"), F.array(F.lit(16), F.lit(16), F.lit(1)).alias("dim"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("element"), F.col("data")).alias("image"))
    return spark.sql("SELECT image.pos[2] AS z, image.dim[0] AS nx, ROUND(AGGREGATE(image.data, 0.0D, (a, v) -> a + v), 4) AS total, ARRAY_MAX(image.data) AS most FROM {t}", t=images)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, 'k' AS first_key, json_extract_string(props, '$.none') AS none FROM events")
def json_properties(spark, d):
    e = table(spark, d, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", m["k"].cast("int").alias("k"), F.array_min(F.map_keys(m)).alias("first_key"), F.try_element_at(m, F.lit("none")).alias("none"))


@query("SELECT event_type, date_trunc('month', ts) AS month, dayofweek(ts) + 1 AS weekday, COUNT(*) AS n, CAST(date_diff('day', TIMESTAMP '2000-01-01', MIN(ts)) AS INT) AS days FROM events GROUP BY 1, 2, 3")
def date_functions(spark, d):
    ts = F.col("ts")
    out = table(spark, d, "events").groupBy("event_type", F.date_trunc("month", ts).alias("month"), F.dayofweek(ts).alias("weekday"))
    return out.agg(F.count("*").alias("n"), F.datediff(F.min(ts), F.lit("2000-01-01").cast("timestamp")).alias("days"))


@query("SELECT l_suppkey, list_sort(list(DISTINCT l_linenumber))[2] AS second, COALESCE(list_sort(list(DISTINCT l_linenumber))[9], -1) AS ninth FROM lineitem GROUP BY 1")
def array_helpers(spark, d):
    """The element at a place, or a default."""
    a = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("a"))
    return a.select("l_suppkey", F.get("a", F.lit(1)).alias("second"), F.coalesce(F.get("a", F.lit(8)), F.lit(-1)).alias("ninth"))


@query("SELECT p_partkey, regexp_full_match(s, '[+-]?[0-9]+') AS is_long, TRY_CAST(s AS DOUBLE) IS NOT NULL AS is_double FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN CAST(p_retailprice AS VARCHAR) ELSE '' END AS s FROM part)")
def numeric_strings(spark, d):
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, F.col("p_brand")).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.col("p_retailprice").cast("string")).otherwise("")
    return table(spark, d, "part").select("p_partkey", sqlfn.is_long(s).alias("is_long"), sqlfn.is_numeric(s).alias("is_double"))


@query("SELECT CAST(i % 7 AS INT) AS x, CAST(i // 7 % 5 AS INT) AS y, CAST(i // 35 AS INT) AS z, i FROM range(140) r(i)")
def index_to_position(spark, d):
    i = F.col("i")
    return spark.range(140).select(F.col("id").alias("i")).select(*pointwise.xyz_from_index(i, 7, 5), "i")


@query(f"WITH {POINTS} SELECT CAST(floor(x / 0.1) AS BIGINT) AS gx, CAST(floor(y / 0.1) AS BIGINT) AS gy, CAST(floor(z / 0.1) AS BIGINT) AS gz, COUNT(*) AS n, ROUND(AVG(x), 6) AS x FROM pts GROUP BY 1, 2, 3")
def grid_cells(spark, d):
    p = points(spark, d)
    out = p.groupBy(sqlfn.grid3d(F.col("x"), F.col("y"), F.col("z"), 0.1).alias("g")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"))
    return out.select("g.gx", "g.gy", "g.gz", "n", "x")


@query(f"WITH {POINTS} SELECT id, ROUND(x * cos(pi() / 6) - y * sin(pi() / 6), 6) AS x, ROUND(x * sin(pi() / 6) + y * cos(pi() / 6), 6) AS y FROM pts")
def rotated_points(spark, d):
    x, y = sqlfn.rotate_z(F.col("x"), F.col("y"), 30)
    return points(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# Imports and derived metrics


@query("SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, l_quantity > 30 AS large FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity > 5")
def imported_table(spark, d):
    """Named filters, then synthesised columns."""
    out = tables.import_table(table(spark, d, "lineitem"), {"returned": "l_returnflag <> 'N'", "not small": "l_quantity > 5"}, {"net": "round(l_extendedprice * (1 - l_discount), 4)", "large": "l_quantity > 30"})
    return out.select("l_orderkey", "l_linenumber", "net", "large")


@query(f"WITH {POINTS}, s AS (SELECT label, id % 5 + 1 AS w, x, y, z FROM pts WHERE id % 2 = 0 UNION ALL SELECT label, id % 5 + 1, x + 1, y, z FROM pts WHERE id % 2 = 1) SELECT label, SUM(w) AS w, ROUND(SUM(x * w) / SUM(w), 6) AS x, ROUND(SUM(y * w) / SUM(w), 6) AS y, ROUND(SUM(z * w) / SUM(w), 6) AS z FROM s GROUP BY label")
def merged_point_sets(spark, d):
    p = points(spark, d).withColumn("w", F.col("id") % 5 + 1)
    a, b = p.where("id % 2 = 0"), p.where("id % 2 = 1").withColumn("x", F.col("x") + 1)
    out = tables.merge_point_sets([a, b], "label", "w")
    return out.select("label", F.col("w").cast("decimal(38,0)").cast("long").alias("w"), *r6("x", "y", "z"))


_S = "SELECT label, sqrt(GREATEST(s1, 0)) AS s1, sqrt(GREATEST(s2, 0)) AS s2, sqrt(GREATEST(s3, 0)) AS s3, n, r FROM (SELECT label, COUNT(*) AS n, {0} AS s1, {1} AS s2, {2} AS s3, ANY_VALUE(r) AS r FROM lab JOIN rad USING (label) GROUP BY label HAVING COUNT(*) > 3)"
_COV = [f"covar_pop({a}, {b})" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]


@query(
    f"{COMPONENTS}, m AS (SELECT label, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM lab GROUP BY label), rad AS (SELECT lab.label, AVG(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS r FROM lab JOIN m USING (label) GROUP BY lab.label), s AS ({_S.format(*[oracles.largest_eigenvalue(*_COV, k) for k in range(3)])}) SELECT label, ROUND((s1 - s3) / s1, 3) AS anisotropy, CASE WHEN s1 - s3 > 1e-6 THEN ROUND(2 * (s2 - s3) / (s1 - s3) - 1, 2) ELSE 0 END AS oblateness, ROUND(n / (4.0 / 3 * pi() * pow(4.0 / 3 * r, 3)), 5) AS sphericity FROM s"
)
def derived_metrics(spark, d):
    from ..operators import components, kernels

    out = shape.shape_analysis(components.label(sparse(spark, d), DIM, kernels.cross(), min_voxels=4))
    s = [F.col(f"pca{k}_s") for k in (1, 2, 3)]
    flat = s[0] - s[2] > 1e-6
    return out.select(F.col("lacuna_number").alias("label"), F.round(shape.anisotropy(s[0], s[2]), 3).alias("anisotropy"), F.when(flat, F.round(shape.oblateness(*s), 2)).otherwise(0.0).alias("oblateness"), F.round(shape.sphericity(F.col("volume"), F.col("obj_radius")), 5).alias("sphericity"))


@query(f"{VOX}, {LABELS}, o AS (SELECT label, COUNT(*) AS volume FROM lab WHERE v > 500 GROUP BY label), g AS (SELECT label, COUNT(*) AS region_volume FROM lab GROUP BY label) SELECT label, volume, region_volume, ROUND(volume / region_volume, 6) AS density FROM o LEFT JOIN g USING (label)")
def region_density(spark, d):
    lab = labelled(spark, d)
    return shape.density(lab.where("v > 500"), lab).select("label", "volume", "region_volume", *r6("density"))


# Tracks


@query(
    "WITH e AS (SELECT user_id, event_id AS t, value AS x, event_type FROM events), s AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id ORDER BY t)) AS step FROM e) SELECT user_id, MIN(t) AS born, MAX(t) AS died, COUNT(*) AS frames, ROUND(AVG(step), 5) AS mean_step, ROUND(MAX(step), 5) AS max_step FROM s GROUP BY user_id"
)
def track_life(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("t"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return match.life_statistics(e, ["user_id"], "t").select("user_id", "born", "died", "frames", F.round("mean_step", 5).alias("mean_step"), F.round("max_step", 5).alias("max_step"))


@query(
    "WITH c AS (SELECT DISTINCT event_id % 4 AS t, user_id % 400 AS a, user_id % 400 + 1 + event_id % 3 AS b FROM events), g AS (SELECT t, a, b FROM c), n AS (SELECT a.t + 1 AS t, a.a, a.b, 'lost' AS event FROM g a WHERE a.t < 3 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.t = a.t + 1 AND b.a = a.a AND b.b = a.b) UNION ALL SELECT b.t, b.a, b.b, 'gained' FROM g b WHERE b.t > 0 AND NOT EXISTS (SELECT 1 FROM g a WHERE a.t = b.t - 1 AND b.a = a.a AND b.b = a.b)) SELECT t, COUNT(*) FILTER (WHERE event = 'lost') AS lost, COUNT(*) FILTER (WHERE event = 'gained') AS gained FROM n GROUP BY t"
)
def topology_events(spark, d):
    """Contacts lost and gained from frame to frame."""
    e, a = table(spark, d, "events"), F.col("user_id") % 400
    contacts = e.select((F.col("event_id") % 4).alias("t"), a.alias("a"), (a + 1 + F.col("event_id") % 3).alias("b")).distinct()
    out = match.contact_changes(contacts, 0, 3)
    return out.groupBy("t").agg(F.count_if(F.col("event") == "lost").alias("lost"), F.count_if(F.col("event") == "gained").alias("gained"))


@query(f"WITH {POINTS}, u AS (SELECT id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM pts) SELECT CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 0 WHEN abs(y) >= abs(z) THEN 1 ELSE 2 END AS cluster, COUNT(*) AS n, ROUND(AVG(x * x), 6) AS xx, ROUND(AVG(y * y), 6) AS yy, ROUND(AVG(x * y), 6) AS xy FROM u GROUP BY 1")
def orientation_kmeans_step(spark, d):
    """Directions without a sign, assigned to the axis at the least angle; a cluster's tensor gives its next axis."""
    out = match.orientation_step(points(spark, d), [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], KEYS)
    return out.select("cluster", "n", *r6("xx", "yy", "xy"))


# Sessions, commands over sets, collected metrics


@query("SELECT w AS word, COUNT(*) AS n, MIN(p_partkey) AS first FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w FROM part) WHERE w <> '' GROUP BY 1")
def flat_mapped_words(spark, d):
    """One row to many, keyed, and folded by key."""
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("word")).where("word <> ''")
    return keyed.reduce_by_key(words, ["word"], n=F.count("*"), first=F.min("p_partkey"))


@query("SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS first FROM nation GROUP BY 1")
def registered_table(spark, d):
    """A table registered by name, cached, queried as SQL, and let go."""
    name = sqlscan.register(table(spark, d, "nation"), "nations", cached=True)
    out = spark.sql(f"SELECT n_regionkey, COUNT(*) AS n, MIN(n_name) AS first FROM {name} GROUP BY n_regionkey").collect()
    sqlscan.unregister(spark, name)
    return spark.createDataFrame(out, "n_regionkey int, n long, first string")


@query("SELECT COUNT(*) AS n, SUM(l_quantity) AS total, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem WHERE l_quantity > 10")
def observed_metrics(spark, d):
    """What accumulators collect beside an action: counts and sums observed while the rows go by."""
    seen = sqlscan.observed(table(spark, d, "lineitem").where("l_quantity > 10"), n=F.count(F.lit(1)), total=F.sum("l_quantity"), returned=F.count_if(F.col("l_returnflag") == "R"))
    return spark.createDataFrame([(seen["n"], seen["total"], seen["returned"])], "n long, total double, returned long")


@query(f"WITH a AS (SELECT l_returnflag AS name, CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_linenumber AS INT) AS z, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4) SELECT name, COUNT(*) AS n, MIN(v) AS min, ROUND(AVG(v), 6) AS mean, MAX(v) AS max, ROUND(stddev_pop(v), 6) AS std FROM a GROUP BY name")
def image_set_statistics(spark, d):
    """Statistics of a set of images, all at once."""
    images = {f: registry.Image(vox(spark, d, f"l_returnflag = '{f}'"), DIM) for f in "ANR"}
    return registry.statistics(images).select("name", "n", "min", *r6("mean"), "max", *r6("std"))


@query(f"WITH a AS (SELECT l_returnflag AS name, CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_linenumber AS INT) AS z, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4), m AS (SELECT p.name, p.x, p.y, p.z, median(q.v) AS v FROM a p JOIN a q ON p.name = q.name AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1 GROUP BY 1, 2, 3, 4) SELECT name, COUNT(*) AS n, MIN(v) AS min, MAX(v) AS max FROM m GROUP BY name")
def image_set_command(spark, d):
    """A command run on every image of a set."""
    images = {f: registry.Image(vox(spark, d, f"l_returnflag = '{f}'"), DIM) for f in "ANR"}
    return registry.statistics(registry.run_all(images, "Filter", "-filter=4")).select("name", "n", "min", "max")
