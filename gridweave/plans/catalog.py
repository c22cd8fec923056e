"""The queries of the planning engine over the scenes, and their SQL.

Each entry of QUERIES takes (spark, sf_dir).  Doubles are rounded on both sides,
since engines add in different orders.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweave.functions import crs, geom, ids
from gridweave.operators import checks, graphs, raster, trees, zones as z
from gridweave.operators.components import components
from gridweave.plans import planner, scenes as s
from gridweave.sources import files, requests as rq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL for the same rows if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str | Column, n: int = 3) -> Column:
    """Rounded, under its own name if it has one."""
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


@query(f"WITH {s.TERMINALS_SQL} SELECT project_id, ord, terminal_id, role, node_id, x_m, y_m FROM terminals")
def terminals_load(spark, d):
    return s.terminals(spark, d).drop("k")


@query(f"WITH {s.ZONES_SQL} SELECT project_id, ord, zone_id, mode, multiplier, xmin, ymin, xmax, ymax, 4::INT AS n_edges FROM zones")
def zones_load(spark, d):
    return s.zones(spark, d).select("project_id", "ord", "zone_id", "mode", "multiplier", "xmin", "ymin", "xmax", "ymax", F.size("edges").alias("n_edges"))


@query(f"""WITH {s.TERMINALS_SQL}, ok AS (SELECT DISTINCT project_id, substr(project_id, 2)::INT AS n FROM terminals)
SELECT project_id, 'euclid' AS mode, 'steinerpy' AS solver, CASE WHEN n % 3 = 0 THEN 12 ELSE 50 END::INT AS max_points, CASE WHEN n % 3 = 0 THEN 0.05 ELSE 0.2 END::DOUBLE AS connector_max_km, 'obstacle' AS euclid_routing, 0.1::DOUBLE AS obstacle_buffer_m, true AS normalize_terminal_leaves, 0.5::DOUBLE AS clip_buffer_km FROM ok WHERE n % 11 <> 10""")
def options_defaults(spark, d):
    return rq.load(s.requests(spark, d)).options.select("project_id", "mode", "solver", "max_points", "connector_max_km", "euclid_routing", "obstacle_buffer_m", "normalize_terminal_leaves", "clip_buffer_km")


@query(f"""WITH {s.TERMINALS_SQL} SELECT project_id, ord, terminal_id, role, node_id, 39 + (k % 11) / 1000.0::DOUBLE AS lon, 50 + (k % 7) / 1000.0::DOUBLE AS lat FROM terminals WHERE substr(project_id, 2)::INT % 11 <> 10""")
def request_terminals(spark, d):
    return rq.load(s.requests(spark, d)).terminals.select("project_id", "ord", "terminal_id", "role", "node_id", "lon", "lat")


@query(f"""WITH {s.TERMINALS_SQL} SELECT DISTINCT project_id, 'load' AS stage, 'invalid_request' AS code, 'error' AS severity FROM terminals WHERE substr(project_id, 2)::INT % 11 = 10""")
def request_issues(spark, d):
    return rq.load(s.requests(spark, d)).issues.select("project_id", "stage", "code", "severity")


@query(f"""WITH {s.TERMINALS_SQL}, {s.REQUESTS_SQL} SELECT terminal_id, least(floor((lon + 180) / 6)::INT + 1, 60)::INT AS zone, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(floor((lon + 180) / 6)::INT + 1, 60))::INT AS epsg FROM placed""")
def utm_zone(spark, d):
    return s.placed(spark, d).select("terminal_id", ids.utm_zone(F.col("lon")).alias("zone"), ids.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def _forward_sql() -> str:
    """The projection by another series than the code's: powers of the distance from the meridian and of the eccentricity."""
    e2 = (2 - 1 / 298.257223563) / 298.257223563
    meridian = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072]
    arc = " + ".join([f"{meridian[0]!r}::DOUBLE * phi", *(f"{m!r}::DOUBLE * sin({2 * k} * phi)" for k, m in enumerate(meridian[1:], 1))])
    return f"""WITH {s.TERMINALS_SQL}, {s.REQUESTS_SQL},
a AS (SELECT terminal_id, lat, radians(lat) AS phi, radians(lon - (least(floor((lon + 180) / 6) + 1, 60) * 6.0 - 183.0)) AS turn FROM placed),
b AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t, {e2 / (1 - e2)!r}::DOUBLE * cos(phi) * cos(phi) AS c, turn * cos(phi) AS w, 6378137.0::DOUBLE * ({arc}) AS m FROM a)
SELECT terminal_id, round(500000.0 + 0.9996::DOUBLE * n * (w + (1 - t + c) * w ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - {58 * e2 / (1 - e2)!r}::DOUBLE) * w ** 5 / 120), 1) AS x_m,
 round(0.9996::DOUBLE * (m + n * tan(phi) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * w ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - {330 * e2 / (1 - e2)!r}::DOUBLE) * w ** 6 / 720)) + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END, 1) AS y_m FROM b"""


@query(_forward_sql())
def utm_forward(spark, d):
    x, y = crs.forward(F.col("lon"), F.col("lat"), ids.utm_epsg(F.col("lon"), F.col("lat")))
    return s.placed(spark, d).select("terminal_id", r(x, 1).alias("x_m"), r(y, 1).alias("y_m"))


@query(f"WITH {s.TERMINALS_SQL}, {s.REQUESTS_SQL} SELECT terminal_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM placed")
def utm_inverse(spark, d):
    epsg = ids.utm_epsg(F.col("lon"), F.col("lat"))
    p = s.placed(spark, d).select("terminal_id", epsg.alias("epsg"), *(c.alias(n) for n, c in zip("xy", crs.forward(F.col("lon"), F.col("lat"), epsg))))
    lon, lat = crs.inverse(F.col("x"), F.col("y"), F.col("epsg"))
    return p.select("terminal_id", r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


@query(f"""WITH {s.TERMINALS_SQL}, {s.REQUESTS_SQL} SELECT project_id, ((CASE WHEN avg(lat) >= 0 THEN 32600 ELSE 32700 END) + least(floor((avg(lon) + 180) / 6)::INT + 1, 60))::INT AS epsg FROM placed GROUP BY project_id""")
def working_crs(spark, d):
    return rq.project_crs(s.placed(spark, d))


@query(f"WITH {s.TERMINALS_SQL} SELECT terminal_id, round(x_m + (50 + k % 100) * sin(radians((k * 37) % 360)), 3) AS exit_x, round(y_m + (50 + k % 100) * cos(radians((k * 37) % 360)), 3) AS exit_y FROM terminals")
def fixed_exit_xy(spark, d):
    x, y = ids.exit_point(F.col("x_m"), F.col("y_m"), (F.col("k") * 37 - 3600).cast("double"), (50 + F.col("k") % 100).cast("double"))
    return s.terminals(spark, d).select("terminal_id", r(x).alias("exit_x"), r(y).alias("exit_y"))


@query("SELECT n_nationkey::INT AS n, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey::DOUBLE ELSE CASE n_nationkey % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 ELSE 5.0 END END::DOUBLE AS multiplier FROM nation")
def penalty_multiplier(spark, d):
    n = F.col("n_nationkey")
    category = F.element_at(F.create_map(F.lit(1), F.lit("dry_land"), F.lit(2), F.lit("swamp"), F.lit(3), F.lit("floodplain")), n % 4)
    return s.table(spark, d, "nation").select(n.alias("n"), ids.penalty_multiplier(F.when(n % 5 == 0, n.cast("double")), category).alias("multiplier"))


@query(f"WITH {s.TERMINALS_SQL} SELECT project_id, min(x_m) - 500 AS xmin, min(y_m) - 500 AS ymin, max(x_m) + 500 AS xmax, max(y_m) + 500 AS ymax FROM terminals GROUP BY project_id")
def bbox(spark, d):
    return z.bounding_box(s.terminals(spark, d), F.lit(500.0))


@query(f"""WITH {s.TERMINALS_SQL}, n AS (SELECT project_id, count(*) AS n, count(*) FILTER (role = 'intermediate') AS m FROM terminals GROUP BY project_id)
SELECT project_id, 'too_many_terminals' AS code FROM n WHERE n > 5 UNION ALL SELECT project_id, 'invalid_roles' FROM n WHERE m > 1""")
def role_count_issues(spark, d):
    t = s.terminals(spark, d)
    options = t.select("project_id", F.lit(5).alias("max_points")).distinct()
    doubled = t.withColumn("role", F.when(F.col("role") == "intermediate", "start").otherwise("end"))
    doubled = doubled.withColumn("role", F.when(F.col("role") == "end", "branch").otherwise("start"))
    return checks.count_issues(t, options).unionByName(checks.role_issues(doubled)).select("project_id", "code")


PAIRS_SQL = """pairs AS (SELECT a.project_id, a.node_id AS u, b.node_id AS v, a.x_m AS ux, a.y_m AS uy, b.x_m AS vx, b.y_m AS vy, sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS length_m
 FROM terminals a JOIN terminals b ON a.project_id = b.project_id AND a.ord < b.ord)"""


@query(f"WITH {s.TERMINALS_SQL}, {PAIRS_SQL} SELECT project_id, u, v, round(length_m, 3) AS length_m FROM pairs")
def terminal_pairs(spark, d):
    return z.node_pairs(s.terminals(spark, d)).select("project_id", "u", "v", r("length_m"))


@query(f"""WITH {s.TERMINALS_SQL}, {PAIRS_SQL} SELECT p.project_id, u, v, round(length_m, 3) AS length_m FROM pairs p JOIN (SELECT project_id, count(*) AS n FROM terminals GROUP BY project_id) c ON p.project_id = c.project_id WHERE n <= 3 OR length_m <= 700""")
def pairs_within_distance(spark, d):
    return z.near_pairs(s.terminals(spark, d), 3, 700.0).select("project_id", "u", "v", r("length_m"))


@query(f"""WITH {s.TERMINALS_SQL}, {s.ZONES_SQL} SELECT t.project_id, t.node_id, arg_min(zone_id, z.ord) AS zone_id FROM terminals t JOIN zones z ON t.project_id = z.project_id AND mode = 'ban' AND x_m > xmin AND x_m < xmax AND y_m > ymin AND y_m < ymax GROUP BY t.project_id, t.node_id""")
def terminal_in_ban(spark, d):
    return z.first_zone_at(s.terminals(spark, d), s.zones(spark, d))


@query(f"""WITH {s.TERMINALS_SQL}, {s.ZONES_SQL} SELECT t.project_id, t.node_id, coalesce(product(multiplier), 1.0)::DOUBLE AS multiplier FROM terminals t LEFT JOIN zones z ON t.project_id = z.project_id AND mode = 'penalty' AND x_m BETWEEN xmin AND xmax AND y_m BETWEEN ymin AND ymax GROUP BY t.project_id, t.node_id""")
def point_multiplier_product(spark, d):
    p = z.per_project(s.zones(spark, d), "penalty", "penalties")
    return s.terminals(spark, d).join(p, "project_id", "left").select("project_id", "node_id", z.multiplier_at(F.col("x_m"), F.col("y_m"), F.col("penalties")).alias("multiplier"))


#: Length of a pair's run inside each box, by clipping its parameter range.
CLIP_SQL = """clipped AS (SELECT p.*, z.zone_id, z.mode, greatest(0, least(1, CASE WHEN vx = ux THEN CASE WHEN ux BETWEEN xmin AND xmax THEN 1 ELSE -1 END ELSE greatest((xmin - ux) / (vx - ux), (xmax - ux) / (vx - ux)) END, CASE WHEN vy = uy THEN CASE WHEN uy BETWEEN ymin AND ymax THEN 1 ELSE -1 END ELSE greatest((ymin - uy) / (vy - uy), (ymax - uy) / (vy - uy)) END)
 - greatest(0, CASE WHEN vx = ux THEN 0 ELSE least((xmin - ux) / (vx - ux), (xmax - ux) / (vx - ux)) END, CASE WHEN vy = uy THEN 0 ELSE least((ymin - uy) / (vy - uy), (ymax - uy) / (vy - uy)) END)) * length_m AS inside
 FROM pairs p JOIN zones z ON p.project_id = z.project_id)"""


@query(f"WITH {s.TERMINALS_SQL}, {s.ZONES_SQL}, {PAIRS_SQL}, {CLIP_SQL} SELECT project_id, u, v, round(length_m, 3) AS length_m FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM clipped c WHERE c.project_id = p.project_id AND c.u = p.u AND c.v = p.v AND mode = 'ban' AND inside > 1e-3)")
def visibility_edges(spark, d):
    return z.visibility_edges(z.node_pairs(s.terminals(spark, d)), s.zones(spark, d)).select("project_id", "u", "v", r("length_m"))


@query(f"WITH {s.TERMINALS_SQL}, {s.ZONES_SQL}, {PAIRS_SQL}, {CLIP_SQL} SELECT project_id, u, v, bool_or(mode = 'ban' AND inside > 1e-3) AS crosses_ban FROM clipped GROUP BY project_id, u, v")
def direct_edges_flagged(spark, d):
    return z.direct_edges(z.node_pairs(s.terminals(spark, d)), s.zones(spark, d)).select("project_id", "u", "v", "crosses_ban")


@query(f"WITH {s.TERMINALS_SQL}, {s.ZONES_SQL}, {PAIRS_SQL}, {CLIP_SQL} SELECT project_id, u, v, zone_id, round(inside, 2) AS inside_m FROM clipped WHERE inside > 0.01")
def inside_lengths(spark, d):
    told = z.inside_lengths(z.node_pairs(s.terminals(spark, d)), s.zones(spark, d)).filter("inside_m > 0.01")
    return told.select("project_id", "u", "v", "zone_id", r("inside_m", 2))


@query(f"""WITH {s.TERMINALS_SQL}, {s.ZONES_SQL}, {PAIRS_SQL}, steps AS (SELECT *, greatest(2, floor(length_m / greatest(greatest(2.0, length_m / 80), 1))::INT + 1) AS n FROM pairs),
samples AS (SELECT s.*, i, ux + (vx - ux) * i / (n - 1) AS x, uy + (vy - uy) * i / (n - 1) AS y FROM steps s, unnest(range(n)) AS g(i)),
m AS (SELECT s.project_id, u, v, length_m, n, i, coalesce(product(multiplier), 1.0) AS m FROM samples s LEFT JOIN zones z ON z.project_id = s.project_id AND mode = 'penalty' AND x BETWEEN xmin - 1e-9 AND xmax + 1e-9 AND y BETWEEN ymin - 1e-9 AND ymax + 1e-9 GROUP BY ALL)
SELECT project_id, u, v, round(sum(CASE WHEN i IN (0, n - 1) THEN m / 2 ELSE m END) * any_value(length_m) / (any_value(n) - 1), 2) AS weight FROM m GROUP BY project_id, u, v""")
def penalised_weight(spark, d):
    return z.straight_edges(z.node_pairs(s.terminals(spark, d)), s.zones(spark, d)).select("project_id", "u", "v", r("weight", 2))


@query(f"""WITH {s.CORRIDORS_SQL}, n AS (SELECT user_id, count(*) AS n FROM pts GROUP BY user_id),
picked AS (SELECT n.user_id, i, CASE WHEN n <= 36 THEN i ELSE (i * n // 36) % n END AS pos FROM n, unnest(range(least(n, 36))) AS g(i))
SELECT p.user_id, p.i::INT AS "at", x, y FROM picked p JOIN pts ON pts.user_id = p.user_id AND pts.pos = p.pos""")
def contour_decimate(spark, d):
    own = s.corridors(spark, d).select(F.col("line_ord").alias("user_id"), F.posexplode(geom.decimated(F.col("geom"))).alias("at", "p"))
    return own.select("user_id", "at", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(f"""WITH RECURSIVE {s.TERMINALS_SQL}, fold AS (SELECT project_id, 0 AS ord, [{{'x': x_m, 'y': y_m}}] AS kept, [node_id] AS names FROM terminals WHERE ord = 0
UNION ALL SELECT t.project_id, t.ord, CASE WHEN len(list_filter(kept, lambda e: sqrt((e.x - x_m) * (e.x - x_m) + (e.y - y_m) * (e.y - y_m)) < 400)) = 0 THEN list_append(kept, {{'x': x_m, 'y': y_m}}) ELSE kept END,
 CASE WHEN len(list_filter(kept, lambda e: sqrt((e.x - x_m) * (e.x - x_m) + (e.y - y_m) * (e.y - y_m)) < 400)) = 0 THEN list_append(names, node_id) ELSE names END FROM fold f JOIN terminals t ON t.project_id = f.project_id AND t.ord = f.ord + 1)
SELECT project_id, unnest(names) AS node_id FROM (SELECT project_id, arg_max(names, ord) AS names FROM fold GROUP BY project_id)""")
def greedy_dedupe(spark, d):
    return z.spaced(s.nodes(spark, d), 400.0, always="").select("project_id", "node_id")


@query(f"""WITH {s.TERMINALS_SQL}, {s.ZONES_SQL} SELECT z.project_id, z.zone_id AS node_id, arg_min(t.node_id, (sqrt((x_m - xmin) * (x_m - xmin) + (y_m - ymin) * (y_m - ymin)), t.ord)) AS target_id, round(min(sqrt((x_m - xmin) * (x_m - xmin) + (y_m - ymin) * (y_m - ymin))), 3) AS distance FROM zones z JOIN terminals t ON z.project_id = t.project_id GROUP BY z.project_id, z.zone_id""")
def nearest_terminal(spark, d):
    corners = s.zones(spark, d).select("project_id", F.col("zone_id").alias("node_id"), F.col("xmin").alias("x_m"), F.col("ymin").alias("y_m"))
    return z.nearest(corners, s.terminals(spark, d)).select("project_id", "node_id", "target_id", r("distance"))


SLOPE_SQL = f"""{s.CELLS_SQL}, grad AS (SELECT *, elevation = 117 AS is_nodata,
 CASE WHEN lag(elevation) OVER r IS NOT NULL AND lead(elevation) OVER r IS NOT NULL THEN (lead(elevation) OVER r - lag(elevation) OVER r) / 100 ELSE coalesce((lead(elevation) OVER r - elevation) / 50, (elevation - lag(elevation) OVER r) / 50) END AS gx,
 CASE WHEN lag(elevation) OVER c IS NOT NULL AND lead(elevation) OVER c IS NOT NULL THEN (lead(elevation) OVER c - lag(elevation) OVER c) / 100 ELSE coalesce((lead(elevation) OVER c - elevation) / 50, (elevation - lag(elevation) OVER c) / 50) END AS gy
 FROM cells WINDOW r AS (PARTITION BY "row" ORDER BY col), c AS (PARTITION BY col ORDER BY "row")),
sloped AS (SELECT *, CASE WHEN NOT is_nodata THEN degrees(atan(sqrt(gx * gx + gy * gy))) END AS slope_deg FROM grad)"""
COST_SQL = f"""{s.ZONES_SQL}, {SLOPE_SQL}, burnt AS (SELECT c."row", c.col, any_value(is_nodata) AS is_nodata, any_value(slope_deg) AS slope_deg, any_value(x_m) AS x_m, any_value(y_m) AS y_m, coalesce(bool_or(mode = 'ban'), false) AS banned, coalesce(product(multiplier), 1.0) AS m
 FROM sloped c LEFT JOIN zones z ON z.project_id = 'p0' AND x_m BETWEEN xmin AND xmax AND y_m BETWEEN ymin AND ymax GROUP BY c."row", c.col),
costed AS (SELECT *, CASE WHEN is_nodata OR banned OR coalesce(slope_deg > 30, false) THEN 'infinity'::DOUBLE ELSE 50 * (1 + least(greatest(coalesce(slope_deg, 0) / 30, 0), 1)) * m END AS cost FROM burnt)"""


@query(f'WITH {SLOPE_SQL} SELECT "row", col, is_nodata, round(slope_deg, 6) AS slope_deg FROM sloped')
def slope_grid(spark, d):
    return raster.slope(s.cells(spark, d), s.meta(spark)).select("row", "col", "is_nodata", r("slope_deg", 6))


def _costs(spark, d):
    return raster.cost_raster(s.cells(spark, d), s.meta(spark), s.grid_zones(spark, d))


@query(f'WITH {COST_SQL} SELECT "row", col, CASE WHEN isfinite(cost) THEN round(cost, 4) END AS cost, NOT isfinite(cost) AS closed FROM costed')
def cost_raster(spark, d):
    finite = F.col("cost") < float("inf")
    return _costs(spark, d).select("row", "col", F.when(finite, F.round("cost", 4)).alias("cost"), (~finite).alias("closed"))


@query(f"""WITH {COST_SQL} SELECT 'grid' AS project_id, max("row") + 1 AS "rows", max(col) + 1 AS cols, count(*) FILTER (isfinite(cost)) AS finite_cells, count(*) FILTER (NOT isfinite(cost)) AS banned_cells, round(min(cost), 4) AS min_cost, round(max(cost) FILTER (isfinite(cost)), 4) AS max_cost, round(max(slope_deg), 6) AS max_slope_deg FROM costed""")
def cost_summary(spark, d):
    return raster.summary(_costs(spark, d)).select("project_id", "rows", "cols", "finite_cells", "banned_cells", r("min_cost", 4), r("max_cost", 4), r("max_slope_deg", 6))


NEAR_SQL = """near AS (SELECT DISTINCT c."row", c.col FROM cells c JOIN segs g ON x2 IS NOT NULL AND x_m BETWEEN least(x1, x2) - 5 AND greatest(x1, x2) + 5 AND y_m BETWEEN least(y1, y2) - 5 AND greatest(y1, y2) + 5
 WHERE sqrt(power(x_m - x1 - greatest(0, least(1, ((x_m - x1) * (x2 - x1) + (y_m - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0))) * (x2 - x1), 2) + power(y_m - y1 - greatest(0, least(1, ((x_m - x1) * (x2 - x1) + (y_m - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0))) * (y2 - y1), 2)) <= 5)"""


@query(f'WITH {s.CELLS_SQL}, {s.CORRIDORS_SQL}, {NEAR_SQL} SELECT c."row", c.col, n."row" IS NOT NULL AS in_corridor FROM cells c LEFT JOIN near n ON c."row" = n."row" AND c.col = n.col')
def corridor_mask(spark, d):
    near = raster.near_lines(s.corridors(spark, d), s.meta(spark).select("project_id", "a", "c", "e", "f"), F.lit(5.0)).withColumn("in_corridor", F.lit(True))
    return s.cells(spark, d).join(near, ["project_id", "row", "col"], "left").select("row", "col", F.coalesce("in_corridor", F.lit(False)).alias("in_corridor"))


@query(f"""WITH {s.TERMINALS_SQL}, {s.CELLS_SQL}, {s.CORRIDORS_SQL}, {NEAR_SQL}, hubs AS (SELECT x_m AS hx, y_m AS hy FROM terminals WHERE ord = 0)
SELECT c."row", c.col, n."row" IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hubs WHERE sqrt((x_m - hx) * (x_m - hx) + (y_m - hy) * (y_m - hy)) <= 150) AS excluded FROM cells c LEFT JOIN near n ON c."row" = n."row" AND c.col = n.col""")
def trace_exclusion(spark, d):
    hubs = s.terminals(spark, d).filter("ord = 0").select(F.lit("grid").alias("project_id"), "x_m", "y_m")
    return raster.excluded(s.cells(spark, d), s.meta(spark), s.corridors(spark, d), hubs, 5.0, 150.0).select("row", "col", "excluded")


@query(f"""WITH {COST_SQL} SELECT 'grid:' || "row" || '_' || col AS node_id, x_m, y_m, "row", col FROM costed WHERE "row" % 8 = 0 AND col % 8 = 0 AND isfinite(cost)""")
def grid_candidates(spark, d):
    return raster.grid_candidates(_costs(spark, d), 8).select("node_id", "x_m", "y_m", "row", "col")


@query(f"WITH {s.TERMINALS_SQL} SELECT terminal_id, floor((y_m - 6200000) / -50)::INT AS \"row\", floor((x_m - 500000) / 50)::INT AS col FROM terminals")
def world_to_cell(spark, d):
    row, col = ids.world_to_cell(F.col("x_m"), F.col("y_m"), F.lit(50.0), F.lit(500000.0), F.lit(-50.0), F.lit(6200000.0))
    return s.terminals(spark, d).select("terminal_id", row.alias("row"), col.alias("col"))


def king_moves(reach: int) -> list[tuple[int, int]]:
    """Offsets by distance in king moves, then by the first of their shortest ways, ways in order of their moves."""
    moves, found = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)], {}
    for n in range(reach + 1):
        for way in itertools.product(moves, repeat=n):
            found.setdefault((sum(m[0] for m in way), sum(m[1] for m in way)), None)
    return [*found]


@query(f"""WITH {s.TERMINALS_SQL}, {COST_SQL}, spots AS (SELECT node_id, floor((y_m - 6200000) / -50)::INT AS r, floor((x_m - 500000) / 50)::INT AS c FROM terminals),
offsets AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(king_moves(5)))}) AS o(rank, dr, dc))
SELECT node_id, arg_min(x."row", rank) AS "row", arg_min(x.col, rank) AS col FROM spots, offsets JOIN costed x ON x."row" = r + dr AND x.col = c + dc AND isfinite(cost) GROUP BY node_id""")
def snap_to_finite(spark, d):
    row, col = ids.world_to_cell(F.col("x_m"), F.col("y_m"), F.lit(50.0), F.lit(500000.0), F.lit(-50.0), F.lit(6200000.0))
    points = s.terminals(spark, d).select(F.lit("grid").alias("project_id"), "node_id", row.alias("row"), col.alias("col"))
    return raster.snapped(points, _costs(spark, d)).select("node_id", "row", "col")


@query(f"""WITH {s.CORRIDORS_SQL} SELECT user_id, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 3) AS length_m FROM segs WHERE x2 IS NOT NULL GROUP BY user_id""")
def polyline_length(spark, d):
    return s.corridors(spark, d).select(F.col("line_ord").alias("user_id"), r(geom.line_length(F.col("geom"))).alias("length_m"))


@query(f"""WITH {s.CORRIDORS_SQL}, runs AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) OVER (PARTITION BY user_id ORDER BY pos) AS upto FROM segs WHERE x2 IS NOT NULL),
total AS (SELECT user_id, max(upto) AS total FROM runs GROUP BY user_id), marks AS (SELECT user_id, i AS pos, i * 2000.0 AS d FROM total, unnest(range(floor(total / 2000)::INT + 1)) AS g(i))
SELECT m.user_id, m.pos::INT AS "at", round(arg_min(x1 + (x2 - x1) * CASE WHEN len > 0 THEN (d - (upto - len)) / len ELSE 0 END, r.pos), 2) AS x, round(arg_min(y1 + (y2 - y1) * CASE WHEN len > 0 THEN (d - (upto - len)) / len ELSE 0 END, r.pos), 2) AS y FROM marks m JOIN runs r ON r.user_id = m.user_id AND d <= upto GROUP BY m.user_id, m.pos""")
def corridor_samples(spark, d):
    own = s.corridors(spark, d).select(F.col("line_ord").alias("user_id"), geom.measured(F.col("geom")).alias("marks"))
    own = own.select("user_id", "marks", F.posexplode(F.sequence(F.lit(0), F.floor(F.element_at("marks", -1)["d"] / 2000).cast("int"))).alias("at", "i"))
    p = own.select("user_id", "at", geom.interpolate(F.col("marks"), F.col("i") * 2000.0).alias("p"))
    return p.select("user_id", "at", r(F.col("p.x"), 2).alias("x"), r(F.col("p.y"), 2).alias("y"))


@query(f"""WITH RECURSIVE {s.LINKS_SQL}, both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links), reach AS (SELECT u AS node, u AS seen FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.seen = b.u)
SELECT 'net' AS project_id, node, min(seen) AS component FROM reach GROUP BY node""")
def connected_components(spark, d):
    return components(s.links(spark, d).select("project_id", "u", "v"), ("project_id",))


@query(f"""WITH RECURSIVE {s.LINKS_SQL}, both_ways AS (SELECT u, v, weight FROM links UNION SELECT v, u, weight FROM links), hops AS (SELECT u AS node, 0.0::DOUBLE AS distance, 0 AS n FROM (SELECT min(u) AS u FROM links)
UNION SELECT b.v, h.distance + b.weight, n + 1 FROM hops h JOIN both_ways b ON h.node = b.u WHERE n < 22) SELECT node, min(distance) AS distance FROM hops GROUP BY node""")
def shortest_paths(spark, d):
    net = s.links(spark, d)
    first = net.groupBy("project_id").agg(F.min("u").alias("node_id"))
    return graphs.shortest_paths(net, first).select("node", "distance")


@query()
def steiner_trees(spark, d):
    tree = graphs.straight_trees(s.terminals(spark, d), s.zones(spark, d))
    return tree.groupBy("project_id").agg(r(F.sum("weight")).alias("cost"), F.count("*").alias("edges"), F.min("solver").alias("solver"))


@query()
def least_cost_paths(spark, d):
    costs = _costs(spark, d)
    found = raster.grid_candidates(costs, 8).withColumn("ord", F.col("row") * 50 + F.col("col"))
    paths = graphs.least_cost_paths(costs.join(s.meta(spark).select("project_id", "a", "e"), "project_id"), found, z.near_pairs(found)).filter("reason is null")
    return paths.select("u", "v", r("weight"), r("length_m"), r("objective"), F.size("path").alias("cells"))


@query(f"WITH {s.TERMINALS_SQL}, {s.TREE_SQL} SELECT project_id, node_id, count(*) AS degree FROM (SELECT project_id, u AS node_id FROM tree UNION ALL SELECT project_id, v FROM tree) GROUP BY project_id, node_id")
def node_degree(spark, d):
    return trees.degrees(s.star_tree(spark, d))


HUB_SQL = f"""{s.TREE_SQL}, busy AS (SELECT project_id, u FROM tree GROUP BY project_id, u HAVING count(*) > 1),
hubbed AS (SELECT t.project_id, CASE WHEN b.u IS NULL THEN t.u ELSE 'steiner:hub:' || substr(t.u, 10) END AS u, t.v, weight, length_m, ux, uy, vx, vy, 'backbone' AS edge_kind FROM tree t LEFT JOIN busy b ON b.project_id = t.project_id AND b.u = t.u
 UNION ALL SELECT b.project_id, b.u, 'steiner:hub:' || substr(b.u, 10), 0.0::DOUBLE, 0.1::DOUBLE, x_m, y_m, x_m + 0.1::DOUBLE, y_m, 'connector' FROM busy b JOIN terminals t ON t.project_id = b.project_id AND t.node_id = b.u)"""


@query(f"WITH {s.TERMINALS_SQL}, {HUB_SQL} SELECT project_id, u, v, round(weight, 3) AS weight, round(length_m, 3) AS length_m, edge_kind FROM hubbed")
def hub_rewrite(spark, d):
    tree, _ = trees.with_hubs(s.star_tree(spark, d), s.terminals(spark, d))
    return tree.select("project_id", "u", "v", r("weight"), r("length_m"), "edge_kind")


def _attached(spark, d):
    t = s.terminals(spark, d)
    options = t.select("project_id", F.lit(0.3).alias("connector_max_km")).distinct()
    tree, _ = trees.with_hubs(s.star_tree(spark, d), t)
    return trees.with_attachments(tree, trees.connector_limits(t, options))


ATTACH_SQL = f"""{HUB_SQL}, pieces AS (
 SELECT project_id, u, v, weight, length_m, edge_kind FROM hubbed WHERE edge_kind = 'connector'
 UNION ALL SELECT project_id, v, u, weight, length_m, edge_kind FROM hubbed WHERE edge_kind = 'backbone' AND u LIKE 'steiner:hub:%' AND length_m <= 300 + 1e-6
 UNION ALL SELECT project_id, v, 'steiner:attach:' || substr(v, 10), weight * 300 / length_m, 300, 'connector' FROM hubbed WHERE edge_kind = 'backbone' AND u LIKE 'steiner:hub:%' AND length_m > 300 + 1e-6
 UNION ALL SELECT project_id, 'steiner:attach:' || substr(v, 10), u, weight - weight * 300 / length_m, length_m - 300, 'backbone' FROM hubbed WHERE edge_kind = 'backbone' AND u LIKE 'steiner:hub:%' AND length_m > 300 + 1e-6)"""


@query(f"WITH {s.TERMINALS_SQL}, {ATTACH_SQL} SELECT project_id, u, v, round(weight, 3) AS weight, round(length_m, 3) AS length_m, edge_kind FROM pieces")
def attach_split(spark, d):
    big = s.terminals(spark, d).groupBy("project_id").count().filter("count > 2").select("project_id")
    tree, _, _ = _attached(spark, d)
    return tree.join(big, "project_id", "left_semi").select("project_id", "u", "v", r("weight"), r("length_m"), "edge_kind")


@query(f"""WITH {s.TERMINALS_SQL}, {s.TREE_SQL}, n AS (SELECT *, CASE WHEN length_m > 250 + 1e-6 THEN ceil((length_m - 1e-6) / 250)::INT ELSE 1 END AS n FROM tree), k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n),
w AS (SELECT *, 'steiner:waypoint:' || least(u, v) || '-' || greatest(u, v) || '-' AS stem FROM k)
SELECT project_id, CASE WHEN k = 1 THEN u ELSE stem || (k - 1) END AS u, CASE WHEN k = n THEN v ELSE stem || k END AS v, round(CASE WHEN n = 1 THEN weight WHEN k = n THEN greatest(weight - weight * 250 / length_m * (k - 1), 0) ELSE weight * 250 / length_m END, 3) AS weight, round(CASE WHEN n = 1 THEN length_m WHEN k = n THEN length_m - 250 * (k - 1) ELSE 250 END, 3) AS length_m FROM w""")
def densify(spark, d):
    tree, _ = trees.densified(s.star_tree(spark, d), F.lit(250.0))
    return tree.select("project_id", "u", "v", r("weight"), r("length_m"))


@query(f"WITH {s.TERMINALS_SQL}, {s.TREE_SQL} SELECT project_id, count(*) AS edges, round(sum(weight), 3) AS total_weight, round(sum(length_m), 3) AS total_length_m FROM tree GROUP BY project_id")
def edge_totals(spark, d):
    tree = s.star_tree(spark, d)
    turned = tree.withColumn("a", F.col("v")).withColumn("v", F.col("u")).withColumn("u", F.col("a")).drop("a")
    return trees.undirected_totals(tree.unionByName(turned)).select("project_id", "edges", r("total_weight"), r("total_length_m"))


@query(f"""WITH {s.TERMINALS_SQL}, {HUB_SQL}, nodes AS (SELECT project_id, u AS n FROM hubbed UNION SELECT project_id, v FROM hubbed) SELECT project_id, CASE WHEN n LIKE 'terminal:%' THEN 'terminal' WHEN n LIKE 'steiner:hub:%' THEN 'hub' ELSE 'steiner' END AS kind, count(*) AS n FROM nodes GROUP BY ALL""")
def kind_counts(spark, d):
    tree, _ = trees.with_hubs(s.star_tree(spark, d), s.terminals(spark, d))
    nodes = tree.select("project_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return nodes.groupBy("project_id", ids.node_kind(F.col("node_id")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {s.TERMINALS_SQL}, {HUB_SQL}, both_ways AS (SELECT project_id, u AS a, v AS b FROM hubbed UNION ALL SELECT project_id, v, u FROM hubbed), first AS (SELECT project_id, a, min(b) AS b FROM both_ways GROUP BY ALL),
beyond AS (SELECT project_id, a AS hub, min(b) AS b FROM both_ways WHERE a LIKE 'steiner:hub:%' AND b <> 'terminal:' || substr(a, 13) GROUP BY ALL)
SELECT t.project_id, terminal_id, role, coalesce(y.b, f.b, '') AS attached_to, CASE WHEN f.b LIKE 'steiner:hub:%' THEN 'hub' WHEN f.b LIKE 'steiner:attach:%' THEN 'attach' ELSE 'tree' END AS via
FROM terminals t LEFT JOIN first f ON f.project_id = t.project_id AND f.a = t.node_id LEFT JOIN beyond y ON y.project_id = t.project_id AND y.hub = f.b""")
def terminal_attachments(spark, d):
    tree, _ = trees.with_hubs(s.star_tree(spark, d), s.terminals(spark, d))
    return trees.attachments(tree, s.terminals(spark, d)).drop("ord")


@query("SELECT 'u' || user_id % 7 AS project_id, event_type AS message, min(event_id) AS seq FROM events GROUP BY ALL")
def warnings_unique(spark, d):
    w = s.table(spark, d, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("project_id"), F.col("event_type").alias("message"), F.col("event_id").alias("seq"))
    return checks.unique_messages(w)


@query(f"""WITH RECURSIVE {s.TERMINALS_SQL}, {s.ZONES_SQL}, cand AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS ord, node_id, x_m, y_m FROM (SELECT project_id, ord, 'c' || k AS node_id, x_m + 3 + k % 5 AS x_m, y_m - 4 AS y_m FROM terminals) c
 WHERE NOT EXISTS (SELECT 1 FROM terminals t WHERE t.project_id = c.project_id AND sqrt((t.x_m - c.x_m) * (t.x_m - c.x_m) + (t.y_m - c.y_m) * (t.y_m - c.y_m)) < 6) AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.project_id = c.project_id AND mode = 'ban' AND c.x_m > xmin AND c.x_m < xmax AND c.y_m > ymin AND c.y_m < ymax)),
fold AS (SELECT project_id, 0 AS ord, [{{'x': x_m, 'y': y_m}}] AS kept, [node_id] AS names FROM cand WHERE ord = 0
UNION ALL SELECT t.project_id, t.ord, CASE WHEN len(list_filter(kept, lambda e: sqrt((e.x - x_m) * (e.x - x_m) + (e.y - y_m) * (e.y - y_m)) < 300)) = 0 THEN list_append(kept, {{'x': x_m, 'y': y_m}}) ELSE kept END,
 CASE WHEN len(list_filter(kept, lambda e: sqrt((e.x - x_m) * (e.x - x_m) + (e.y - y_m) * (e.y - y_m)) < 300)) = 0 THEN list_append(names, node_id) ELSE names END FROM fold f JOIN cand t ON t.project_id = f.project_id AND t.ord = f.ord + 1)
SELECT project_id, unnest(names) AS node_id FROM (SELECT project_id, arg_max(names, ord) AS names FROM fold GROUP BY project_id)""")
def candidate_filter(spark, d):
    t = s.terminals(spark, d)
    c = t.select("project_id", "ord", F.concat(F.lit("c"), F.col("k").cast("string")).alias("node_id"), F.lit("steiner_candidate").alias("kind"), (F.col("x_m") + 3 + F.col("k") % 5).alias("x_m"), (F.col("y_m") - 4).alias("y_m"))
    return z.filtered_candidates(c, t, s.zones(spark, d), 300.0, 6.0).select("project_id", "node_id")


@query("""SELECT s_nationkey AS n, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS "at", s_suppkey + 0.25::DOUBLE AS x_m, -s_acctbal AS y_m FROM supplier""")
def bb_parse(spark, d):
    line = F.concat(F.lit("%!PS comment\n % @C "), (F.col("s_suppkey") + 0.25).cast("string"), F.lit("\t"), (-F.col("s_acctbal")).cast("string"), F.lit("\nstroke"))
    texts = s.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return files.steiner_points(texts)


@query(f"WITH {s.TERMINALS_SQL} SELECT project_id, string_agg(printf('%.6f %.6f', x_m, y_m), chr(10) ORDER BY ord) || chr(10) AS input FROM terminals GROUP BY project_id")
def steiner_input(spark, d):
    return files.steiner_input(s.terminals(spark, d))


@query("""WITH m AS (SELECT n_name AS section, 'key' AS metric, n_nationkey * 100.0::DOUBLE AS expected, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey * 100.0::DOUBLE + n_nationkey % 4 END AS actual FROM nation)
SELECT section, metric, expected, actual FROM m WHERE actual IS NULL OR NOT (abs(actual - expected) <= 0.5 OR abs(actual - expected) <= 1e-3 * greatest(abs(actual), abs(expected)))""")
def metric_diff(spark, d):
    n = s.table(spark, d, "nation")
    golden = n.select(F.col("n_name").alias("section"), F.lit("key").alias("metric"), (F.col("n_nationkey") * 100.0).alias("value"))
    actual = n.filter("n_nationkey % 6 <> 5").select(F.col("n_name").alias("section"), F.lit("key").alias("metric"), (F.col("n_nationkey") * 100.0 + F.col("n_nationkey") % 4).alias("value"))
    return checks.metric_differences(golden, actual)


@query("SELECT n_nationkey::INT AS n, 1::INT AS polygons, 5::INT AS points, (n_nationkey + 10) * 4.0::DOUBLE AS perimeter FROM nation")
def geojson_zones(spark, d):
    side = F.col("n_nationkey") + 10
    ring = F.format_string("[[0,0],[%d,0],[%d,%d],[0,%d],[0,0]]", side, side, side, side)
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":['), ring, F.lit("]}}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("]]}"))
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    n = F.col("n_nationkey")
    told = s.table(spark, d, "nation").select(n.alias("n"), rq.rings(F.when(n % 3 == 0, feature).when(n % 3 == 1, multi).otherwise(collection)).alias("shape"))
    return told.select("n", F.size("shape").alias("polygons"), F.size(F.col("shape")[0][0]).alias("points"), geom.line_length(F.col("shape")[0][0]).alias("perimeter"))


@query(f"""WITH RECURSIVE {s.TERMINALS_SQL}, {s.ZONES_SQL}, {PAIRS_SQL}, {CLIP_SQL}, free AS (SELECT project_id, u, v FROM clipped GROUP BY ALL HAVING NOT bool_or(mode = 'ban' AND inside > 1e-3) AND any_value(length_m) < 900),
both_ways AS (SELECT * FROM free UNION SELECT project_id, v, u FROM free), reach AS (SELECT project_id, node_id AS node, node_id AS seen FROM terminals UNION SELECT r.project_id, r.node, b.v FROM reach r JOIN both_ways b ON r.project_id = b.project_id AND r.seen = b.u),
part AS (SELECT project_id, node, min(seen) AS c FROM reach GROUP BY ALL), ends AS (SELECT t.project_id, min(c) FILTER (role = 'start') AS s, min(c) FILTER (role = 'end') AS e FROM terminals t JOIN part p ON p.project_id = t.project_id AND p.node = t.node_id GROUP BY t.project_id)
SELECT project_id, 'route_may_be_blocked' AS code FROM ends WHERE s <> e""")
def connectivity_issues(spark, d):
    edges = z.visibility_edges(z.node_pairs(s.terminals(spark, d)), s.zones(spark, d)).filter("length_m < 900")
    return checks.connectivity_issues(edges, s.terminals(spark, d)).filter("severity = 'error'").select("project_id", "code")


@query(f"""WITH {s.TERMINALS_SQL} SELECT project_id, ord AS seq, 'raster_extent' AS code, terminal_id AS message FROM terminals WHERE NOT (x_m >= 500000 AND x_m < 501000 AND y_m <= 6200000 AND y_m > 6199000)""")
def extent_issues(spark, d):
    t = s.terminals(spark, d)
    meta = t.select("project_id", *(F.lit(v).alias(c) for c, v in (("a", 50.0), ("c", 500000.0), ("e", -50.0), ("f", 6200000.0), ("rows", 20), ("cols", 20)))).distinct()
    return checks.extent_issues(t, meta).select("project_id", "seq", "code", "message")


@query(f"WITH {s.TERMINALS_SQL}, {s.ZONES_SQL}, {PAIRS_SQL}, {CLIP_SQL} SELECT DISTINCT project_id, 'routing_skipped:' || u || ':' || v || ':ban_forbidden_weight' AS message FROM clipped WHERE mode = 'ban' AND inside > 1e-3")
def skipped_pairs(spark, d):
    edges = z.direct_edges(z.node_pairs(s.terminals(spark, d)), s.zones(spark, d)).filter("crosses_ban")
    skipped = edges.select("project_id", F.col("u").alias("a"), F.col("v").alias("b"), F.lit("ban_forbidden_weight").alias("reason"))
    return checks.skipped_warnings(skipped).select("project_id", "message")


@query(f"""WITH {s.TERMINALS_SQL}, {s.ZONES_SQL}, {PAIRS_SQL}, {CLIP_SQL}, told AS (SELECT project_id, u, v, bool_or(mode = 'ban' AND inside > 1e-3) AS crosses FROM clipped GROUP BY ALL)
SELECT project_id, u, v, crosses AS crosses_ban FROM told WHERE NOT (crosses AND substr(project_id, 2)::INT % 2 = 0)""")
def routed_edges(spark, d):
    t = s.terminals(spark, d)
    around = F.substring("project_id", 2, 9).cast("int") % 2 == 0
    options = t.select("project_id", F.when(around, "obstacle").otherwise("direct").alias("euclid_routing")).distinct()
    return z.graph_edges(z.node_pairs(t), s.zones(spark, d), options).select("project_id", "u", "v", "crosses_ban")


@query(f"""WITH {s.TERMINALS_SQL}, {s.ZONES_SQL}, box AS (SELECT project_id AS p, min(x_m) - 300 AS x0, min(y_m) - 300 AS y0, max(x_m) + 300 AS x1, max(y_m) + 300 AS y1 FROM terminals GROUP BY project_id),
corners AS (SELECT project_id, 'penalty:' || zone_id || ':' || k AS node_id, CASE WHEN k IN (0, 3) THEN xmin ELSE xmax END AS x_m, CASE WHEN k < 2 THEN ymin ELSE ymax END AS y_m FROM zones, unnest(range(4)) AS g(k) WHERE mode = 'penalty')
SELECT project_id, node_id, x_m, y_m FROM corners JOIN box ON p = project_id WHERE x_m BETWEEN x0 AND x1 AND y_m BETWEEN y0 AND y1""")
def contour_nodes(spark, d):
    box = z.bounding_box(s.terminals(spark, d), F.lit(300.0))
    return z.contour_nodes(s.zones(spark, d).drop("xmin", "ymin", "xmax", "ymax"), box, "penalty", "penalty_contour", "penalty").select("project_id", "node_id", "x_m", "y_m")


@query(f"""WITH RECURSIVE {s.TERMINALS_SQL}, {PAIRS_SQL}, near AS (SELECT project_id, u, v FROM pairs WHERE length_m < 600), far AS (SELECT project_id, count(*) AS skipped FROM pairs WHERE length_m > 2000 GROUP BY project_id),
both_ways AS (SELECT * FROM near UNION SELECT project_id, v, u FROM near), reach AS (SELECT project_id, node_id AS node, node_id AS seen FROM terminals UNION SELECT r.project_id, r.node, b.v FROM reach r JOIN both_ways b ON r.project_id = b.project_id AND r.seen = b.u),
parts AS (SELECT project_id, count(DISTINCT c) AS components, count(*) AS nodes FROM (SELECT project_id, node, min(seen) AS c FROM reach GROUP BY ALL) GROUP BY project_id),
e AS (SELECT project_id, count(*) AS edges FROM near GROUP BY project_id)
SELECT p.project_id, nodes, coalesce(edges, 0) AS edges, components, coalesce(skipped, 0) AS skipped, (nodes * (nodes - 1) // 2)::BIGINT AS attempts, round(CASE WHEN nodes * (nodes - 1) // 2 > coalesce(skipped, 0) THEN coalesce(edges, 0) / (nodes * (nodes - 1) // 2 - coalesce(skipped, 0))::DOUBLE ELSE 0 END, 6) AS edge_ratio
FROM parts p LEFT JOIN e ON e.project_id = p.project_id LEFT JOIN far f ON f.project_id = p.project_id""")
def routing_summary(spark, d):
    t = s.terminals(spark, d)
    pairs = z.node_pairs(t)
    return checks.routing_summary(t, pairs.filter("length_m < 600"), pairs.filter("length_m > 2000")).select("project_id", "nodes", "edges", "components", "skipped", "attempts", r("edge_ratio", 6))


@query(f"""WITH {s.TERMINALS_SQL}, {s.FULL_SQL} SELECT project_id, round((greatest(dr, dc) + 1) * 50.0::DOUBLE, 3) AS total_cost, round(50.0::DOUBLE * (greatest(dr, dc) - least(dr, dc) + sqrt(2::DOUBLE) * least(dr, dc)), 1) AS total_length_m FROM ways WHERE dr + dc > 0""")
def full_plan(spark, d):
    done = planner.plan_batch(*s.full_batch(spark, d)).responses
    number = lambda name: F.get_json_object("response", f"$.metrics.{name}").cast("double")
    return done.select("project_id", r(number("total_cost")).alias("total_cost"), r(number("total_length_m"), 1).alias("total_length_m"))


@query()
def plan_responses(spark, d):
    return planner.plan_batch(s.requests(spark, d)).responses


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least tree for each nation's customers, round ban zones and through penalty zones."""
    t = s.customer_terminals(spark, sf_dir)
    edges = z.direct_edges(z.node_pairs(t), s.zones(spark, sf_dir))
    tree = graphs.steiner_tree(edges, t)
    return tree.groupBy("project_id").agg(r(F.sum("weight")).alias("cost"), F.count("*").alias("edges"), F.min("solver").alias("solver"))
