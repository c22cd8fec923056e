"""Scenes made from the test tables by integer arithmetic, each with its SQL.

terminals from supplier (project: nation), zones from nation (boxes of the same
region), a grid from part, corridors from events, a star tree from terminals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridweave.functions import crs, geom, ids
from gridweave.operators import zones as z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TERMINALS_SQL = """
sup AS (SELECT s_suppkey AS k, s_nationkey AS n, count(*) OVER (PARTITION BY s_nationkey) AS size, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ord FROM supplier),
terminals AS (SELECT 'p' || n AS project_id, ord::INT AS ord, 't' || k AS terminal_id, CASE WHEN ord = 0 THEN 'start' WHEN ord = size - 1 THEN 'end' ELSE 'intermediate' END AS role,
  'terminal:t' || k AS node_id, 500000.0::DOUBLE + (k * 7919 % 2000) AS x_m, 6200000.0::DOUBLE - (k * 104729 % 2000) AS y_m, k FROM sup WHERE size >= 2)
"""


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey")
    k, order = F.col("s_suppkey"), w.orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.count("*").over(w).alias("size"), (F.row_number().over(order) - 1).alias("ord")).filter("size >= 2")
    role = F.when(F.col("ord") == 0, "start").when(F.col("ord") == F.col("size") - 1, "end").otherwise("intermediate")
    name = F.concat(F.lit("t"), k.cast("string"))
    return s.select(
        F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("project_id"),
        "ord",
        name.alias("terminal_id"),
        role.alias("role"),
        ids.terminal_node(name).alias("node_id"),
        (F.lit(500000.0) + k * 7919 % 2000).alias("x_m"),
        (F.lit(6200000.0) - k * 104729 % 2000).alias("y_m"),
        k.alias("k"),
    )


def customer_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as terminals, a project for each nation."""
    k, w = F.col("c_custkey"), Window.partitionBy("c_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.count("*").over(w).alias("size"), (F.row_number().over(w.orderBy("c_custkey")) - 1).alias("ord")).filter("size >= 2")
    name = F.concat(F.lit("c"), k.cast("string"))
    return c.select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("project_id"), "ord", name.alias("terminal_id"), ids.terminal_node(name).alias("node_id"), (F.lit(500000.0) + k * 7919 % 2000).alias("x_m"), (F.lit(6200000.0) - k * 104729 % 2000).alias("y_m"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminals(spark, sf_dir).withColumn("kind", F.lit("terminal"))


ZONES_SQL = """
boxes AS (SELECT n_nationkey AS n, n_regionkey AS r, 500000.0::DOUBLE + 617 * n_nationkey % 1700 AS x0, 6198000.0::DOUBLE + 911 * n_nationkey % 1700 AS y0, 100 + 53 * n_nationkey % 200 AS side FROM nation),
zones AS (SELECT 'p' || p.n AS project_id, b.n::INT AS ord, 'z' || b.n AS zone_id, CASE WHEN b.n % 3 = 0 THEN 'ban' ELSE 'penalty' END AS mode,
  CASE b.n % 3 WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE END AS multiplier, b.x0 AS xmin, b.y0 AS ymin, b.x0 + b.side AS xmax, b.y0 + b.side AS ymax
  FROM boxes p JOIN boxes b ON p.r = b.r)
"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation").select("n_regionkey", n.alias("n"), (F.lit(500000.0) + n * 617 % 1700).alias("x0"), (F.lit(6198000.0) + n * 911 % 1700).alias("y0"), (100 + n * 53 % 200).alias("side"))
    p = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.lit("p"), n.cast("string")).alias("project_id"))
    category = F.element_at(F.create_map(F.lit(1), F.lit("swamp"), F.lit(2), F.lit("floodplain")), F.col("n") % 3)
    own = p.join(b, "n_regionkey").select(
        "project_id",
        F.col("n").alias("ord"),
        F.concat(F.lit("z"), F.col("n").cast("string")).alias("zone_id"),
        F.when(F.col("n") % 3 == 0, "ban").otherwise("penalty").alias("mode"),
        F.when(F.col("n") % 3 != 0, ids.penalty_multiplier(F.lit(None).cast("double"), category)).alias("multiplier"),
        geom.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("side"), F.col("y0") + F.col("side")).alias("geom"),
    )
    return z.zone_table(own)


CELLS_SQL = """
cells AS (SELECT 'grid' AS project_id, (p_partkey // 50)::INT AS "row", (p_partkey % 50)::INT AS col, 100.0::DOUBLE + p_size AS elevation, 500000.0::DOUBLE + (p_partkey % 50 + 0.5::DOUBLE) * 50 AS x_m, 6200000.0::DOUBLE - (p_partkey // 50 + 0.5::DOUBLE) * 50 AS y_m FROM part)
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("grid").alias("project_id"), F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), (F.lit(100.0) + F.col("p_size")).alias("elevation"))


def meta(spark: SparkSession) -> DataFrame:
    """The grid's affine and options: cells of 50 m, nodata 117."""
    return spark.range(1).select(F.lit("grid").alias("project_id"), *(F.lit(v).alias(c) for c, v in (("a", 50.0), ("c", 500000.0), ("e", -50.0), ("f", 6200000.0), ("nodata", 117.0), ("slope_cost_factor", 1.0), ("max_slope_deg", 30.0), ("corridor_buffer_m", 60.0))))


def grid_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones of nation 0's region, on the grid."""
    return zones(spark, sf_dir).filter("project_id = 'p0'").withColumn("project_id", F.lit("grid"))


CORRIDORS_SQL = """
pts AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, 500000.0::DOUBLE + event_id * 37 % 2500 AS x, 6200000.0::DOUBLE - event_id * 91 % 2000 AS y FROM events),
segs AS (SELECT user_id, pos, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY pos))
"""


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each user, through their events in time order."""
    e = F.col("event_id")
    p = geom.point(F.lit(500000.0) + e * 37 % 2500, F.lit(6200000.0) - e * 91 % 2000)
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", p.alias("p")))).alias("all"))
    return own.select(F.lit("grid").alias("project_id"), F.col("user_id").alias("line_ord"), F.transform("all", lambda r: r["p"]).alias("geom"), F.lit(0.5).alias("cost_multiplier"))


TREE_SQL = """
tree AS (SELECT a.project_id, a.node_id AS u, b.node_id AS v, a.x_m AS ux, a.y_m AS uy, b.x_m AS vx, b.y_m AS vy,
  sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS length_m, 2 * sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS weight, b.ord AS v_ord
  FROM terminals a JOIN terminals b ON a.project_id = b.project_id AND a.ord = 0 AND b.ord > 0)
"""


def star_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every terminal tied to the first of its project, at twice the length."""
    pairs = z.node_pairs(terminals(spark, sf_dir)).filter("u_ord = 0")
    line = F.array(geom.point(F.col("ux"), F.col("uy")), geom.point(F.col("vx"), F.col("vy")))
    return pairs.select("project_id", "u", "v", (F.col("length_m") * 2).alias("weight"), "length_m", line.alias("geom"), F.lit("backbone").alias("edge_kind"), F.lit(False).alias("fixed"))


LINKS_SQL = """
links AS (SELECT DISTINCT 'net' AS project_id, 'n' || least(c_nationkey, s_nationkey) AS u, 'n' || greatest(c_nationkey, s_nationkey) AS v, (1 + (c_nationkey * 7 + s_nationkey * 7 + c_nationkey * s_nationkey) % 13)::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey)
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted graph of nations that trade with each other."""
    t = lambda n, *c: table(spark, sf_dir, n).select(*c)
    c, s = F.col("c_nationkey"), F.col("s_nationkey")
    pairs = t("lineitem", "l_orderkey", "l_suppkey").join(t("supplier", F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    pairs = pairs.groupBy("l_orderkey", "s_nationkey").agg(F.lit(1)).join(t("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    pairs = pairs.filter(c != s)
    name = lambda f: F.concat(F.lit("n"), f(c, s).cast("string"))
    return pairs.select(F.lit("net").alias("project_id"), name(F.least).alias("u"), name(F.greatest).alias("v"), (1 + (c * 7 + s * 7 + c * s) % 13).cast("double").alias("weight")).distinct()


REQUESTS_SQL = """
placed AS (SELECT *, 36 + (k % 600) / 100.0::DOUBLE AS lon, (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (20 + (k * 31 % 3000) / 100.0::DOUBLE) AS lat FROM terminals)
"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """terminals with longitudes and latitudes on both sides of the equator."""
    k = F.col("k")
    sign = F.when(k % 2 == 0, 1).otherwise(-1)
    return terminals(spark, sf_dir).withColumn("lon", 36 + k % 600 / F.lit(100.0)).withColumn("lat", sign * (20 + k * 31 % 3000 / F.lit(100.0)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One euclid request for each project; a third of them set some options, a few break rules."""
    t = F.struct(F.col("terminal_id").alias("id"), "role", "lon", (50 + F.col("k") % 7 / F.lit(1000.0)).alias("lat"))
    n = F.substring("project_id", 2, 9).cast("int")
    near = placed(spark, sf_dir).withColumn("lon", 39 + F.col("k") % 11 / F.lit(1000.0))
    own = near.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", t.alias("t")))), lambda r: r["t"]).alias("terminals"))
    options = F.when(n % 3 == 0, F.struct(F.lit(0.05).alias("connector_max_km"), F.lit(12).alias("max_points")))
    mode = F.when(n % 11 == 10, "sideways").otherwise("euclid")
    return own.select(F.to_json(F.struct("project_id", mode.alias("mode"), "terminals", options.alias("options"))).alias("request"))


FULL_SQL = """
spots AS (SELECT project_id, ord, (k * 7) % 59 AS r, (k * 13 + ord * 17) % 59 AS c FROM terminals WHERE ord < 2),
ways AS (SELECT a.project_id, abs(a.r - b.r) AS dr, abs(a.c - b.c) AS dc FROM spots a JOIN spots b ON a.project_id = b.project_id AND a.ord = 0 AND b.ord = 1)
"""


def full_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, cells, meta): the first two terminals of each project on flat ground of 60 x 60 cells of 50 m."""
    spots = terminals(spark, sf_dir).filter("ord < 2").withColumn("r", F.col("k") * 7 % 59).withColumn("c", (F.col("k") * 13 + F.col("ord") * 17) % 59)
    lon, lat = crs.inverse(500000.0 + (F.col("c") + 0.5) * 50, 6200000.0 - (F.col("r") + 0.5) * 50, F.lit(32637))
    one = F.struct("ord", F.struct(F.col("terminal_id").alias("id"), F.when(F.col("ord") == 0, "start").otherwise("end").alias("role"), lon.alias("lon"), lat.alias("lat")).alias("t"))
    own = spots.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["t"]).alias("terminals"))
    terrain = F.struct(F.struct(F.lit("grid").alias("path"), F.lit("EPSG:32637").alias("crs")).alias("elevation_raster"))
    options = F.struct(F.lit(30).alias("candidate_stride_cells"), F.lit(False).alias("normalize_terminal_leaves"), F.lit(False).alias("enforce_attachment_radius"))
    requests = own.select(F.to_json(F.struct("project_id", F.lit("full").alias("mode"), "terminals", terrain.alias("terrain"), options.alias("options"))).alias("request"))
    projects = own.select("project_id")
    cells = projects.select("project_id", F.explode(F.sequence(F.lit(0), F.lit(3599))).alias("id")).select("project_id", F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), F.lit(100.0).alias("elevation"))
    meta = projects.select("project_id", *(F.lit(v).alias(n) for n, v in (("a", 50.0), ("c", 500000.0), ("e", -50.0), ("f", 6200000.0), ("nodata", -9999.0))))
    return requests, cells, meta
