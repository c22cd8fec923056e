"""Plan requests: JSON documents to typed tables.  Faults become rows of `issues`."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweave.functions import crs, geom, ids
from gridweave.sources import files

REQUEST = """project_id STRING, mode STRING,
terminals ARRAY<STRUCT<id:STRING, role:STRING, lon:DOUBLE, lat:DOUBLE, attachment_max_km:DOUBLE, outgoing:STRUCT<bearing_deg:DOUBLE, length_m:DOUBLE>>>,
terrain STRUCT<elevation_raster:STRUCT<path:STRING, crs:STRING, nodata:DOUBLE>, clip_buffer_km:DOUBLE,
  zones:ARRAY<STRUCT<id:STRING, mode:STRING, category:STRING, multiplier:DOUBLE, buffer_m:DOUBLE, geometry:STRING, source:STRUCT<path:STRING, layer:STRING>>>,
  corridors:STRUCT<cost_multiplier:DOUBLE, geometry:STRING, source:STRUCT<path:STRING, layer:STRING>>>,
options STRUCT<solver:STRING, max_slope_deg:DOUBLE, slope_cost_factor:DOUBLE, max_points:INT, candidate_stride_cells:INT, corridor_buffer_m:DOUBLE,
  euclid_routing:STRING, obstacle_buffer_m:DOUBLE, euclid_steiner_candidates:BOOLEAN, geosteiner_home:STRING, steiner_candidate_spacing_m:DOUBLE,
  allow_terminal_in_zone_buffer:BOOLEAN, connector_max_km:DOUBLE, steiner_radius_km:DOUBLE, normalize_terminal_leaves:BOOLEAN,
  edge_vertex_spacing_km:DOUBLE, enforce_attachment_radius:BOOLEAN>"""

#: Defaults of the options.
DEFAULTS = {
    "solver": "steinerpy",
    "max_slope_deg": 30.0,
    "slope_cost_factor": 1.0,
    "max_points": 50,
    "candidate_stride_cells": 8,
    "corridor_buffer_m": 15.0,
    "euclid_routing": "obstacle",
    "obstacle_buffer_m": 0.1,
    "euclid_steiner_candidates": True,
    "geosteiner_home": None,
    "steiner_candidate_spacing_m": 1.0,
    "allow_terminal_in_zone_buffer": False,
    "connector_max_km": 0.2,
    "steiner_radius_km": 0.0,
    "normalize_terminal_leaves": True,
    "edge_vertex_spacing_km": 0.0,
    "enforce_attachment_radius": True,
}
CLIP_BUFFER_KM, CORRIDOR_MULTIPLIER = 0.5, 0.5


@dataclass
class Loaded:
    """Tables of a batch of requests."""

    requests: DataFrame
    options: DataFrame
    terminals: DataFrame
    zones: DataFrame
    corridors: DataFrame
    issues: DataFrame


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row `request` for each JSON file below the path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("request"))


def resolved(path: Column, base_dir: str) -> Column:
    """An absolute path as it stands, others below base_dir."""
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(posixpath.join(base_dir, "")), path))


def rings(geojson: Column) -> Column:
    """Shape of an inline GeoJSON polygon, multipolygon, feature or collection of features."""
    coordinates = lambda j, path, kind: F.from_json(F.get_json_object(j, path), kind)
    as_points = lambda r: F.transform(r, lambda p: geom.point(p[0], p[1]))

    def one(j: Column) -> Column:
        inner = F.when(F.get_json_object(j, "$.type") == "Feature", F.get_json_object(j, "$.geometry")).otherwise(j)
        kind = F.get_json_object(inner, "$.type")
        polygon = F.array(F.transform(coordinates(inner, "$.coordinates", "array<array<array<double>>>"), as_points))
        multi = F.transform(coordinates(inner, "$.coordinates", "array<array<array<array<double>>>>"), lambda p: F.transform(p, as_points))
        return F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)

    features = F.from_json(F.get_json_object(geojson, "$.features"), "array<string>")
    return F.when(F.get_json_object(geojson, "$.type") == "FeatureCollection", F.flatten(F.transform(features, one))).otherwise(one(geojson))


def lines(geojson: Column) -> Column:
    """Lines of an inline GeoJSON line, multiline, feature or collection of features."""
    as_points = lambda r: F.transform(r, lambda p: geom.point(p[0], p[1]))

    def one(j: Column) -> Column:
        inner = F.when(F.get_json_object(j, "$.type") == "Feature", F.get_json_object(j, "$.geometry")).otherwise(j)
        single = F.array(as_points(F.from_json(F.get_json_object(inner, "$.coordinates"), "array<array<double>>")))
        multi = F.transform(F.from_json(F.get_json_object(inner, "$.coordinates"), "array<array<array<double>>>"), as_points)
        return F.when(F.get_json_object(inner, "$.type") == "LineString", single).when(F.get_json_object(inner, "$.type") == "MultiLineString", multi)

    features = F.from_json(F.get_json_object(geojson, "$.features"), "array<string>")
    return F.when(F.get_json_object(geojson, "$.type") == "FeatureCollection", F.flatten(F.transform(features, one))).otherwise(one(geojson))


def vector_shapes(good: DataFrame, base_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source_path, source_layer, file_geom) of the files that zones and corridors name, and the refs to files that are missing.

    The names come to the driver, as the files must be listed there; their content
    is read by the executors.
    """
    spark = good.sparkSession
    given = good.select("project_id", F.explode(F.concat(F.coalesce(F.filter(F.transform("r.terrain.zones", lambda z: F.when(z["geometry"].isNull(), z["source"])), lambda s: s.isNotNull()), F.array()), F.when(F.col("r.terrain.corridors.geometry").isNull() & F.col("r.terrain.corridors.source.path").isNotNull(), F.array("r.terrain.corridors.source")).otherwise(F.array()))).alias("s"))
    refs = given.select("project_id", F.col("s.path").alias("source_path"), F.col("s.layer").alias("source_layer")).withColumn("file", resolved(F.col("source_path"), base_dir)).distinct()
    names = [(r["file"], r["source_layer"]) for r in refs.select("file", "source_layer").distinct().collect()]
    there = files.existing(spark, sorted({f for f, _ in names if f}))
    missing = refs.filter(~F.coalesce(F.col("file").isin(*there), F.lit(False)) if there else F.lit(True))
    shapes = spark.createDataFrame([], f"file string, source_layer string, file_geom {geom.SHAPE}")
    for layer in sorted({layer for f, layer in names if f in there}, key=str):
        own = files.read_vector(spark, sorted(f for f, x in names if f in there and x == layer), layer)
        shapes = shapes.unionByName(own.select(files.plain(F.col("path")).alias("file"), F.lit(layer).cast("string").alias("source_layer"), F.col("geom").alias("file_geom")))
    named = refs.select("source_path", "source_layer", files.plain(F.col("file")).alias("file")).distinct()
    return named.join(shapes, (named["file"] == shapes["file"]) & named["source_layer"].eqNullSafe(shapes["source_layer"])).select("source_path", named["source_layer"], "file_geom"), missing


def options_of(parsed: DataFrame) -> DataFrame:
    """project_id, mode, all options with their defaults, clip_buffer_km."""
    own = [F.coalesce(F.col(f"r.options.{k}"), F.lit(d)).alias(k) if d is not None else F.col(f"r.options.{k}").alias(k) for k, d in DEFAULTS.items()]
    return parsed.select("project_id", F.col("r.mode").alias("mode"), *own, F.coalesce("r.terrain.clip_buffer_km", F.lit(CLIP_BUFFER_KM)).alias("clip_buffer_km"))


def project_crs(terminals: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """project_id, epsg: a projected raster's own system, else the UTM zone of the mean place."""
    mean = terminals.groupBy("project_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    own = ids.utm_epsg(F.col("lon"), F.col("lat"))
    if given is None:
        return mean.select("project_id", own.alias("epsg"))
    named = given.select("project_id", F.when(F.col("crs").rlike("^EPSG:32[67][0-9]{2}$"), F.substring("crs", 6, 5).cast("int")).alias("named"))
    return mean.join(named, "project_id", "left").select("project_id", F.coalesce("named", own).alias("epsg"))


def projected_shape(shape: Column, epsg: Column) -> Column:
    def move(p: Column) -> Column:
        x, y = crs.forward(p["x"], p["y"], epsg)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(shape, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, move)))


def with_file_shape(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """rows with file_geom, the shape of the file that they name."""
    told = shapes.select(F.col("source_path").alias("p"), F.col("source_layer").alias("y"), "file_geom")
    return rows.join(told, (F.col("source_path") == F.col("p")) & F.col("source_layer").eqNullSafe(F.col("y")), "left").drop("p", "y")


def load(requests: DataFrame, base_dir: str = ".") -> Loaded:
    """requests: a column `request` with one JSON document a row; relative paths in them are below base_dir."""
    parsed = requests.select("request", F.from_json("request", REQUEST, {"mode": "PERMISSIVE"}).alias("r"))
    parsed = parsed.withColumn("project_id", F.coalesce("r.project_id", F.concat(F.lit("request-"), F.sha2(F.coalesce("request", F.lit("")), 256))))
    mode, terrain = F.col("r.mode"), F.col("r.terrain")
    fault = lambda condition, code, message: F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message")))
    bad_outgoing = F.exists("r.terminals", lambda t: t["outgoing"].isNotNull() & (t["outgoing"]["bearing_deg"].isNull() | t["outgoing"]["length_m"].isNull() | (t["outgoing"]["length_m"] <= 0)))
    zones = F.col("r.terrain.zones")
    zone_mode = lambda z: F.coalesce(z["mode"], F.lit("ban"))
    faults = [
        fault(F.col("r").isNull() | F.col("r.project_id").isNull() | mode.isNull() | F.col("r.terminals").isNull(), "invalid_request", "not JSON, or project_id, mode or terminals missing"),
        fault(F.size("r.terminals") < 2, "invalid_request", "at least two terminals are needed"),
        fault(~mode.isin("full", "euclid"), "invalid_request", "mode must be full or euclid"),
        fault((mode == "full") & (terrain.isNull() | F.col("r.terrain.elevation_raster").isNull()), "terrain_required", "full mode needs terrain.elevation_raster"),
        fault((mode == "euclid") & (F.col("r.terrain.elevation_raster").isNotNull() | F.col("r.terrain.corridors").isNotNull()), "invalid_request", "euclid mode takes no raster and no corridors"),
        fault(F.exists("r.terminals", lambda t: t["id"].isNull() | t["role"].isNull() | t["lon"].isNull() | t["lat"].isNull()), "invalid_request", "a terminal lacks id, role, lon or lat"),
        fault(bad_outgoing, "invalid_request", "outgoing needs bearing_deg and length_m above zero"),
        fault(F.exists(zones, lambda z: ~zone_mode(z).isin("ban", "penalty")), "invalid_request", "zone mode must be ban or penalty"),
        fault(F.exists(zones, lambda z: (zone_mode(z) == "penalty") & z["category"].isNotNull() & ~z["category"].isin(*ids.CATEGORY)), "invalid_request", "unknown penalty category"),
        fault(F.exists(zones, lambda z: z["geometry"].isNull() & z["source"].isNull()), "invalid_request", "a zone needs geometry or source"),
        fault((mode == "euclid") & ~F.coalesce("r.options.euclid_routing", F.lit("obstacle")).isin("direct", "obstacle"), "invalid_request", "euclid_routing must be direct or obstacle"),
        fault(~F.coalesce("r.options.solver", F.lit("steinerpy")).isin("steinerpy", "nx_approx"), "invalid_request", "unknown solver"),
    ]
    found = parsed.select("project_id", F.posexplode(F.array(*faults)).alias("seq", "f")).filter(F.col("f").isNotNull())
    issues = found.select("project_id", F.col("seq"), F.lit("load").alias("stage"), F.col("f.code").alias("code"), F.col("f.message").alias("message"), F.lit("error").alias("severity"))
    good = parsed.join(issues.select("project_id").distinct(), "project_id", "left_anti")
    shapes, missing = vector_shapes(good, base_dir)
    absent = missing.groupBy("project_id").agg(F.min("file").alias("file"))
    absent = absent.select("project_id", F.lit(len(faults)).alias("seq"), F.lit("load").alias("stage"), F.lit("invalid_request").alias("code"), F.concat(F.lit("geometry file not found: "), F.coalesce("file", F.lit(""))).alias("message"), F.lit("error").alias("severity"))
    issues = issues.unionByName(absent)
    options = options_of(good)
    t = good.select("project_id", F.posexplode("r.terminals").alias("ord", "t"))
    t = t.select("project_id", "ord", F.col("t.id").alias("terminal_id"), F.col("t.role").alias("role"), F.col("t.lon").alias("lon"), F.col("t.lat").alias("lat"), F.col("t.attachment_max_km").alias("attachment_max_km"), F.col("t.outgoing.bearing_deg").alias("outgoing_bearing_deg"), F.col("t.outgoing.length_m").alias("outgoing_length_m"))
    epsg = project_crs(t, good.select("project_id", F.col("r.terrain.elevation_raster.crs").alias("crs")))
    x, y = crs.forward(F.col("lon"), F.col("lat"), F.col("epsg"))
    t = t.join(epsg, "project_id").withColumn("x_m", x).withColumn("y_m", y).withColumn("node_id", ids.terminal_node(F.col("terminal_id")))
    z = good.select("project_id", F.posexplode("r.terrain.zones").alias("ord", "z")).join(epsg, "project_id")
    zmode = F.coalesce("z.mode", F.lit("ban"))
    z = z.withColumn("source_path", F.col("z.source.path")).withColumn("source_layer", F.col("z.source.layer"))
    z = with_file_shape(z, shapes)
    core = projected_shape(F.coalesce(rings(F.col("z.geometry")), "file_geom"), F.col("epsg"))
    z = z.select("project_id", "ord", F.coalesce("z.id", F.concat(F.lit("zone-"), F.col("ord").cast("string"))).alias("zone_id"), zmode.alias("mode"), F.when(zmode == "penalty", ids.penalty_multiplier(F.col("z.multiplier"), F.col("z.category"))).alias("multiplier"), F.when(zmode == "penalty", F.col("z.category")).alias("category"), F.coalesce("z.buffer_m", F.lit(0.0)).alias("buffer_m"), core.alias("geom_core"), "source_path", "source_layer")
    z = z.withColumn("geom", F.transform("geom_core", lambda polygon: F.concat(F.array(geom.convex_buffer(polygon[0], F.col("buffer_m"))), F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))))))
    c = good.select("project_id", "r.terrain.corridors", F.col("r.terrain.corridors.source.path").alias("source_path"), F.col("r.terrain.corridors.source.layer").alias("source_layer")).filter("corridors IS NOT NULL")
    own = F.coalesce(lines(F.col("corridors.geometry")), F.transform("file_geom", lambda polygon: polygon[0]))
    c = with_file_shape(c, shapes).select("project_id", F.posexplode(own).alias("line_ord", "l"), F.coalesce("corridors.cost_multiplier", F.lit(CORRIDOR_MULTIPLIER)).alias("cost_multiplier")).join(epsg, "project_id")
    moved = F.transform("l", lambda p: geom.point(*crs.forward(p["x"], p["y"], F.col("epsg"))))
    c = c.select("project_id", "line_ord", moved.alias("geom"), "cost_multiplier")
    return Loaded(good, options.join(epsg, "project_id"), t, z, c, issues)
