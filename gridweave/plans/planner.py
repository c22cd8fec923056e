"""Batches of plan requests to plan responses.

A batch is a set of tables keyed by project_id; every stage maps tables to
tables, and projects that fail a check leave the batch with rows of issues.
Stages that several later ones read are written to scratch tables.
"""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridweave.functions import crs, geom, ids
from gridweave.operators import checks, graphs, raster, trees, zones as z
from gridweave.sources import files, programs, requests as rq
from gridweave.sources.scratch import Scratch

NODE_COLUMNS = ["project_id", "ord", "node_id", "kind", "x_m", "y_m"]
EDGE_COLUMNS = ["project_id", "u", "v", "weight", "length_m", "geom", "crosses_ban", "fixed"]


class PlanRequestError(ValueError):
    """A request that cannot be planned; `code` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Planned:
    responses: DataFrame  # project_id, response (JSON)
    issues: DataFrame


def _numbered(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.withColumn("ord", (F.row_number().over(Window.partitionBy("project_id").orderBy(*order)) - 1).cast("int"))


def steiner_candidates(loaded: rq.Loaded, zones: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(candidates, warnings): points that the external program proposes, clear of terminals, bans and each other."""
    wanted = loaded.options.filter("euclid_steiner_candidates").select("project_id", "geosteiner_home", F.col("steiner_candidate_spacing_m").alias("candidate_gap"))
    asked = programs.steiner_inputs(loaded.terminals.join(wanted, "project_id", "left_semi")).join(wanted, "project_id")
    told = scratch.keep(programs.run_steiner(asked), "programs")
    raw = files.steiner_points(told.filter("output IS NOT NULL").select("project_id", "candidate_gap", "output"), "output")
    raw = raw.withColumns({"ord": F.col("at").cast("int"), "node_id": F.concat(F.lit("raw:"), F.col("at").cast("string")), "kind": F.lit("steiner_candidate")})
    raw = scratch.keep(raw, "raw-candidates")
    left = z.filtered_candidates(raw, loaded.terminals, zones, "candidate_gap")
    left = scratch.keep(left, "candidates")
    n_raw, n_left = raw.groupBy("project_id").agg(F.count("*").alias("raw")), left.groupBy("project_id").agg(F.count("*").alias("kept"))
    counts = told.join(n_raw, "project_id", "left").join(n_left, "project_id", "left").na.fill(0, ["raw", "kept"])
    message = F.when(F.col("output").isNull(), F.array(F.concat(F.lit("geosteiner_unavailable:"), "error")))
    message = message.when(F.col("raw") == 0, F.array(F.lit("geosteiner_unavailable:no_steiner_coordinates_in_bb_output")))
    filtered = F.when(F.col("raw") > F.col("kept"), F.concat(F.lit("geosteiner_candidates_filtered:"), (F.col("raw") - F.col("kept")).cast("string")))
    added = F.when(F.col("kept") > 0, F.concat(F.lit("geosteiner_candidates_added:"), F.col("kept").cast("string")))
    words = counts.select("project_id", F.posexplode(message.otherwise(F.array_compact(F.array(filtered, added)))).alias("seq", "message"))
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("ord")) - 1
    return left.withColumn("at", number.cast("int")).withColumn("node_id", F.concat(F.lit("steiner:candidate:"), F.col("at").cast("string"))), words


def euclid_nodes(loaded: rq.Loaded, zones: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """Terminals, obstacle vertices, penalty vertices and candidates in the project's box, thinned to its spacing."""
    t = loaded.terminals.select("project_id", F.lit(0).alias("family"), F.col("ord").alias("zone_ord"), F.lit(0).alias("at"), "node_id", F.lit("terminal").alias("kind"), "x_m", "y_m")
    box = z.bounding_box(loaded.terminals.join(loaded.options.select("project_id", "clip_buffer_km"), "project_id"), F.lit(0.0))
    box = box.join(loaded.options.select("project_id", "clip_buffer_km"), "project_id")
    box = box.select("project_id", *((F.col(c) + F.col("clip_buffer_km") * (1000 if c.endswith("max") else -1000)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    own = zones.drop("xmin", "ymin", "xmax", "ymax").join(loaded.options.select("project_id", "euclid_routing", "obstacle_buffer_m"), "project_id")
    around = z.contour_nodes(own.filter("euclid_routing = 'obstacle'"), box, "ban", "obstacle", "obstacle", F.col("obstacle_buffer_m"))
    beside = z.contour_nodes(own, box, "penalty", "penalty_contour", "penalty")
    inside = F.col("x_m").between(F.col("xmin"), F.col("xmax")) & F.col("y_m").between(F.col("ymin"), F.col("ymax"))
    proposed = candidates.join(box, "project_id").filter(inside).select("project_id", F.lit(3).alias("family"), F.lit(0).alias("zone_ord"), "at", "node_id", "kind", "x_m", "y_m")
    all_ = t.unionByName(around.withColumn("family", F.lit(1))).unionByName(beside.withColumn("family", F.lit(2))).unionByName(proposed)
    gap = loaded.options.select("project_id", F.col("steiner_candidate_spacing_m").alias("gap"))
    return z.spaced(scratch.keep(_numbered(all_, "family", "zone_ord", "at").select(*NODE_COLUMNS).join(gap, "project_id"), "all-nodes"), "gap")


def with_outgoing(nodes: DataFrame, terminals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with fixed exits, connectors) for terminals that prescribe bearing and length."""
    fixed = terminals.filter("outgoing_bearing_deg IS NOT NULL AND outgoing_length_m IS NOT NULL")
    x, y = ids.exit_point(F.col("x_m"), F.col("y_m"), F.col("outgoing_bearing_deg"), F.col("outgoing_length_m"))
    fixed = fixed.withColumn("ex", x).withColumn("ey", y).withColumn("exit", ids.exit_node(F.col("terminal_id")))
    exits = fixed.select("project_id", (F.col("ord") + 1_000_000).alias("ord"), F.col("exit").alias("node_id"), F.lit("fixed_exit").alias("kind"), F.col("ex").alias("x_m"), F.col("ey").alias("y_m"))
    line = F.array(geom.point(F.col("x_m"), F.col("y_m")), geom.point(F.col("ex"), F.col("ey")))
    connectors = fixed.select("project_id", F.col("node_id").alias("u"), F.col("exit").alias("v"), F.col("outgoing_length_m").alias("weight"), F.col("outgoing_length_m").alias("length_m"), line.alias("geom"), F.lit(False).alias("crosses_ban"), F.lit(True).alias("fixed"))
    return nodes.unionByName(exits), connectors


def outgoing_warnings(exits: DataFrame, zones: DataFrame) -> DataFrame:
    """What happened to the prescribed exits (project_id, seq, message).

    exits: project_id, ord, terminal_id, geom (terminal to exit) and status, which
    is applied, snap_failed or missing_terminal.
    """
    end, first = F.element_at("geom", -1), F.col("geom")[0]
    c = exits.join(z.per_project(zones, "ban", "bans"), "project_id", "left")
    blocked = z.blocking(first["x"], first["y"], end["x"], end["y"], F.col("bans"))
    none = F.array().cast("array<string>")
    inside = F.transform(F.filter("bans", lambda b: geom.inside_open(end["x"], end["y"], b["edges"])), lambda b: F.concat(F.lit("fixed_outgoing_exit_in_ban:"), F.col("terminal_id"), F.lit(":"), b["zone_id"]))
    there = F.concat(F.coalesce(inside, none), F.when(blocked, F.array(F.concat(F.lit("fixed_outgoing_crosses_ban:"), "terminal_id"))).otherwise(none))
    told = F.concat(F.when(F.col("status") == "missing_terminal", none).otherwise(there), F.array(F.concat(F.lit("fixed_outgoing_"), "status", F.lit(":"), "terminal_id")))
    return c.select("project_id", "ord", F.posexplode(told).alias("k", "message")).select("project_id", (F.col("ord") * 10 + F.col("k")).cast("int").alias("seq"), "message")


def euclid_exits(connectors: DataFrame, terminals: DataFrame) -> DataFrame:
    t = terminals.select("project_id", F.col("node_id").alias("u"), "terminal_id", "ord")
    return connectors.join(t, ["project_id", "u"]).select("project_id", "ord", "terminal_id", "geom", F.lit("applied").alias("status"))


def _strip(edges: DataFrame, connectors: DataFrame) -> DataFrame:
    """edges without those of terminals that have a connector."""
    bare = connectors.select("project_id", F.col("u").alias("node_id")).distinct()
    for end in ("u", "v"):
        edges = edges.join(bare.withColumnRenamed("node_id", end), ["project_id", end], "left_anti")
    return edges


def euclid_edges(nodes: DataFrame, connectors: DataFrame, zones: DataFrame, options: DataFrame) -> DataFrame:
    routed = z.graph_edges(z.node_pairs(nodes), zones, options).withColumn("fixed", F.lit(False)).select(*EDGE_COLUMNS)
    return _strip(routed, connectors).unionByName(connectors.select(*EDGE_COLUMNS))


def grids(loaded: rq.Loaded, base_dir: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, meta, issues) of the rasters that full-mode requests name, cut to the box of their terminals."""
    spark = loaded.requests.sparkSession
    own = loaded.requests.filter("r.mode = 'full'").select("project_id", "r.terrain.elevation_raster.*")
    own = own.withColumn("file", rq.resolved(F.col("path"), base_dir)).select("project_id", "crs", "nodata", "file")
    named = sorted(r["file"] for r in own.select("file").distinct().collect() if r["file"])
    there = sorted(files.existing(spark, named))
    absent = own.filter(~F.coalesce(F.col("file").isin(there), F.lit(False)) if there else F.lit(True))
    issues = checks._issue(absent, "load", "raster_not_found", F.concat(F.lit("elevation raster not found: "), F.coalesce("file", F.lit(""))))
    strange = own.filter(F.col("crs").isNotNull() & ~F.col("crs").rlike("^EPSG:32[67][0-9]{2}$"))
    issues = issues.unionByName(checks._issue(strange, "load", "invalid_raster", F.concat(F.lit("not in a UTM system: "), "crs")))
    if there:
        read = files.read_tiff(spark, there).withColumn("file", files.plain(F.col("path")))
    else:
        read = spark.createDataFrame([], files.CELLS + ", file string")
    read = scratch.keep(read.drop("path"), "rasters")
    usable = own.join(absent.unionByName(strange).select("project_id").distinct(), "project_id", "left_anti").withColumn("file", files.plain(F.col("file")))
    broken = usable.join(read.filter("row < 0").select("file").distinct(), "file", "left_semi")
    issues = issues.unionByName(checks._issue(broken, "load", "invalid_raster", F.concat(F.lit("cannot read "), "file")))
    head = read.filter("row >= 0").groupBy("file").agg(*(F.first(k).alias(k) for k in ("a", "c", "e", "f", "file_nodata")))
    meta = usable.join(head, "file").select("project_id", "a", "c", "e", "f", F.coalesce("nodata", "file_nodata").alias("nodata"))
    cells = usable.select("project_id", "file").join(read.filter("row >= 0"), "file").select("project_id", "row", "col", "elevation")
    box = z.bounding_box(loaded.terminals, F.lit(0.0)).join(loaded.options.select("project_id", "clip_buffer_km"), "project_id")
    box = box.select("project_id", *((F.col(c) + F.col("clip_buffer_km") * (1000 if c.endswith("max") else -1000)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    cells, meta = raster.clip(cells, meta, box)
    cells, meta = scratch.keep(cells, "cells"), scratch.keep(meta, "meta")
    outside = meta.join(cells.select("project_id").distinct(), "project_id", "left_anti")
    return cells, meta, issues.unionByName(checks._issue(outside, "load", "raster_extent", F.lit("clip box outside raster")))


def _on_grid(points: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """points with the row and col of the nearest passable cell, its centre as sx, sy, and inside (of the grid)."""
    m = meta.select("project_id", "a", "c", "e", "f")
    size = cells.groupBy("project_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    row, col = ids.world_to_cell(F.col("x_m"), F.col("y_m"), *(F.col(k) for k in "acef"))
    at = points.join(m, "project_id").join(size, "project_id").withColumn("row", row).withColumn("col", col)
    at = at.withColumn("inside", F.col("row").between(0, F.col("last_row")) & F.col("col").between(0, F.col("last_col"))).drop("last_row", "last_col")
    spots = raster.snapped(at.filter("inside"), cells)
    at = at.drop("row", "col").join(spots, ["project_id", "node_id"], "left")
    x, y = ids.cell_to_world(F.col("row"), F.col("col"), *(F.col(k) for k in "acef"))
    return at.withColumn("sx", x).withColumn("sy", y).drop("a", "c", "e", "f")


SAMPLE_M, SPACING_M = 50.0, 5.0


def full_nodes(loaded: rq.Loaded, cells: DataFrame, meta: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, skipped): terminals on their nearest passable cells, grid candidates, corridor samples, thinned to SPACING_M."""
    placed = _on_grid(loaded.terminals, cells, meta)
    t = placed.filter("row IS NOT NULL").select("project_id", F.lit(0).alias("family"), F.col("ord").cast("long").alias("rank"), "node_id", F.lit("terminal").alias("kind"), F.col("sx").alias("x_m"), F.col("sy").alias("y_m"), "row", "col")
    skipped = placed.filter("row IS NULL").select("project_id", F.col("terminal_id").alias("a"), F.col("terminal_id").alias("b"), F.when(F.col("inside"), "no_finite_cell").otherwise("out_of_bounds").alias("reason"))
    stride = loaded.options.select("project_id", "candidate_stride_cells")
    g = cells.join(stride, "project_id").filter("row % greatest(candidate_stride_cells, 1) = 0 AND col % greatest(candidate_stride_cells, 1) = 0").filter(F.col("cost") < float("inf"))
    g = g.select("project_id", F.lit(1).alias("family"), (F.col("row").cast("long") * 10_000_000 + F.col("col")).alias("rank"), ids.grid_node(F.col("row"), F.col("col")).alias("node_id"), F.lit("grid").alias("kind"), "x_m", "y_m", "row", "col")
    marks = loaded.corridors.select("project_id", "line_ord", geom.measured(F.col("geom")).alias("marks")).withColumn("length", F.element_at("marks", -1)["d"]).filter("length > 0")
    marks = marks.select("project_id", "line_ord", "marks", F.posexplode(F.sequence(F.lit(0), F.floor(F.col("length") / SAMPLE_M).cast("int"))).alias("at", "i")).withColumn("p", geom.interpolate(F.col("marks"), F.col("i") * SAMPLE_M))
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("line_ord", "at")) - 1
    c = marks.withColumn("rank", number.cast("long")).select("project_id", "rank", F.concat(F.lit("corridor:"), F.col("rank").cast("string")).alias("node_id"), F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"))
    c = _on_grid(c, cells, meta).filter("row IS NOT NULL").select("project_id", F.lit(2).alias("family"), "rank", "node_id", F.lit("corridor").alias("kind"), F.col("sx").alias("x_m"), F.col("sy").alias("y_m"), "row", "col")
    all_ = scratch.keep(_numbered(t.unionByName(g).unionByName(c), "family", "rank"), "grid-nodes")
    kept = z.admitted(all_.select(*NODE_COLUMNS), SPACING_M)
    return kept.join(all_.select("project_id", "node_id", "row", "col"), ["project_id", "node_id"]), skipped


def full_exits(terminals: DataFrame, nodes: DataFrame, cells: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exits, nodes with the applied ones): prescribed exits on the grid, with status and connector."""
    fixed = terminals.filter("outgoing_bearing_deg IS NOT NULL AND outgoing_length_m IS NOT NULL")
    x, y = ids.exit_point(F.col("x_m"), F.col("y_m"), F.col("outgoing_bearing_deg"), F.col("outgoing_length_m"))
    line = F.array(geom.point(F.col("x_m"), F.col("y_m")), geom.point(x, y))
    fixed = fixed.select("project_id", "ord", "terminal_id", F.col("node_id").alias("terminal"), ids.exit_node(F.col("terminal_id")).alias("node_id"), line.alias("geom"), F.col("outgoing_length_m").alias("length_m"), x.alias("x_m"), y.alias("y_m"))
    here = nodes.select("project_id", F.col("node_id").alias("terminal"), F.lit(True).alias("known"))
    exits = _on_grid(fixed, cells, meta).join(here, ["project_id", "terminal"], "left")
    exits = exits.withColumn("status", F.when(F.col("known").isNull(), "missing_terminal").when(F.col("row").isNull(), "snap_failed").otherwise("applied"))
    applied = exits.filter("status = 'applied'").select("project_id", "node_id", (F.col("ord") + 1_000_000).alias("ord"), F.lit("fixed_exit").alias("kind"), F.col("sx").alias("x_m"), F.col("sy").alias("y_m"), "row", "col")
    return exits, nodes.unionByName(applied)


def full_edges(nodes: DataFrame, exits: DataFrame, cells: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, skipped): least-cost paths between near nodes, and from prescribed exits to all.

    A terminal with an exit keeps its connector alone, and what exits of later
    terminals lead to it; a path from an exit to its own terminal takes the
    connector's place.
    """
    m = meta.select("project_id", "a", "c", "e", "f")
    applied = exits.filter("status = 'applied'").select("project_id", "ord", "terminal", F.col("node_id").alias("exit"), "geom", "length_m")
    inner = z.near_pairs(nodes.filter("kind <> 'fixed_exit'").select(*NODE_COLUMNS)).select("project_id", "u", "v")
    other = nodes.select("project_id", F.col("node_id").alias("v"))
    fixed = applied.select("project_id", F.col("ord").alias("v_ord"), F.explode(F.array("terminal", "exit")).alias("v"))
    outer = applied.select("project_id", "ord", F.col("exit").alias("u")).join(other, "project_id").filter("u <> v").join(fixed, ["project_id", "v"], "left")
    is_exit = F.col("v").startswith(ids.exit_node(F.lit("")))
    outer = outer.filter(F.col("v_ord").isNull() | (F.col("v_ord") < F.col("ord")) | ((F.col("v_ord") == F.col("ord")) & ~is_exit)).select("project_id", "u", "v")
    found = graphs.least_cost_paths(cells.join(m, "project_id"), nodes, inner.unionByName(outer)).join(m, "project_id")
    lost = found.filter("reason IS NOT NULL").select("project_id", F.col("u").alias("a"), F.col("v").alias("b"), "reason")
    # an exit on the cell of another node is no attempt
    lost = lost.filter(~(F.col("a").startswith(ids.exit_node(F.lit(""))) & (F.col("reason") == "same_cell")))
    line = F.transform("path", lambda p: geom.point(*ids.cell_to_world(p["row"], p["col"], *(F.col(k) for k in "acef"))))
    edges = found.filter("reason IS NULL").select("project_id", "u", "v", "weight", "length_m", line.alias("geom"), F.lit(False).alias("crosses_ban"), F.lit(False).alias("fixed"))
    own = applied.select("project_id", F.col("exit").alias("u"), F.col("terminal").alias("v"), F.col("geom").alias("line"), F.col("length_m").alias("straight"))
    routed = edges.join(own, ["project_id", "u", "v"], "left")
    routed = routed.withColumn("fixed", F.col("straight").isNotNull()).drop("line", "straight")
    bare = own.join(edges.select("project_id", "u", "v"), ["project_id", "u", "v"], "left_anti")
    bare = bare.select("project_id", "u", "v", F.col("straight").alias("weight"), F.col("straight").alias("length_m"), F.col("line").alias("geom"), F.lit(False).alias("crosses_ban"), F.lit(True).alias("fixed"))
    from_exit = F.col("u").startswith(ids.exit_node(F.lit("")))
    plain = _strip(routed.filter(~from_exit), own.withColumn("u", F.col("v")))
    return plain.unionByName(routed.filter(from_exit)).unionByName(bare).select(*EDGE_COLUMNS), lost


def final_ban_warnings(tree: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges of the finished tree whose line crosses a ban zone (project_id, seq, message)."""
    s = tree.select("project_id", "u", "v", F.explode(geom.segments(F.col("geom"))).alias("s")).join(z.per_project(zones, "ban", "bans"), "project_id")
    hit = s.filter(z.blocking(F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2"), F.col("bans"))).select("project_id", "u", "v").distinct()
    return hit.select("project_id", F.lit(0).alias("seq"), F.concat(F.lit("edge "), "u", F.lit(" \u2192 "), "v", F.lit(" crosses ban zone")).alias("message"))


def apart_warnings(tree: DataFrame, terminals: DataFrame) -> DataFrame:
    """project_id, ord, message where start and end of the finished tree are not connected."""
    parts = checks.terminal_parts(tree, terminals.join(tree.select("project_id").distinct(), "project_id", "left_semi"))
    ends = parts.groupBy("project_id").agg(*(F.min(F.when(F.col("role") == role, F.col("component"))).alias(role) for role in ("start", "end")))
    return ends.filter(F.col("start") != F.col("end")).select("project_id", F.lit(9_000_000).alias("ord"), F.lit("start_end_not_connected").alias("message"))


def tree_summary(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, terminals, Steiner nodes, edges, total weight and length of each project's tree, and its sorted Steiner ids."""
    used = tree.select("project_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    terminal = F.col("node_id").startswith("terminal:")
    n = used.groupBy("project_id").agg(F.count("*").alias("nodes"), F.count_if(terminal).alias("terminals"), F.count_if(~terminal).alias("steiner_nodes"), F.array_sort(F.collect_list(F.when(~terminal, F.col("node_id")))).alias("steiner_ids"))
    return n.join(tree.groupBy("project_id").agg(F.count("*").alias("edges"), F.sum("weight").alias("total_weight"), F.sum("length_m").alias("total_length_m")), "project_id")


def tree_issues(tree: DataFrame, terminals: DataFrame) -> DataFrame:
    """Trees that are none: other than one edge less than nodes, terminals left out, or more than one part."""
    counts = tree_summary(tree, tree)
    missing = terminals.join(tree.select("project_id").distinct(), "project_id", "left_semi").join(tree.select("project_id", F.explode(F.array("u", "v")).alias("node_id")).distinct(), ["project_id", "node_id"], "left_anti")
    parts = graphs.project_components(tree).groupBy("project_id").agg(F.count_distinct("component").alias("parts"))
    out = checks._issue(counts.filter("nodes <> edges + 1"), "tree", "not_a_tree", F.format_string("%d nodes, %d edges", "nodes", "edges"))
    out = out.unionByName(checks._issue(missing, "tree", "terminal_missing", F.col("terminal_id"), seq=F.col("ord")))
    return out.unionByName(checks._issue(parts.filter("parts > 1"), "tree", "tree_disconnected", F.format_string("%d parts", "parts")))


def pruned(edges: DataFrame, nodes: DataFrame, terminals: DataFrame) -> DataFrame:
    """Edges within the largest component that holds all terminals; a project without one keeps all."""
    parts = graphs.project_components(edges)
    keep = graphs.largest_component_with(edges, nodes, terminals, parts)
    some = keep.select("project_id").distinct().withColumn("whole", F.lit(True))
    named = edges.join(keep.withColumnRenamed("node_id", "u").withColumn("held", F.lit(True)), ["project_id", "u"], "left").join(some, "project_id", "left")
    return named.filter(F.col("held") | F.col("whole").isNull()).drop("held", "whole")


def tree_table(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """Tree edges with what the routing edges know of them."""
    keyed = edges.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
    best = keyed.groupBy("project_id", "a", "b").agg(F.min_by(F.struct("u", "v", "weight", "length_m", "geom", "crosses_ban", "fixed"), "weight").alias("e"))
    joined = tree.filter("u IS NOT NULL").select("project_id", F.col("u").alias("a"), F.col("v").alias("b")).join(best, ["project_id", "a", "b"])
    return joined.select("project_id", "e.*").withColumn("edge_kind", F.when(F.col("fixed"), "connector").otherwise("backbone"))


def adjusted(tree: DataFrame, nodes: DataFrame, terminals: DataFrame, options: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hubs, attachments, repulsion, waypoints: (tree, nodes, warnings)."""
    flags = options.select("project_id", "normalize_terminal_leaves", "enforce_attachment_radius", "steiner_radius_km", "edge_vertex_spacing_km")
    held = lambda df, flag, on: df.join(flags.filter(F.col(flag) if on else ~F.col(flag)).select("project_id"), "project_id", "left_semi")
    own = tree.select(*trees.TREE_COLUMNS)
    used = own.select("project_id", F.explode(F.array("u", "v")).alias("node_id")).distinct()
    places = nodes.join(used, ["project_id", "node_id"], "left_semi").select("project_id", "ord", "node_id", "x_m", "y_m")
    hubbed, hubs = trees.with_hubs(held(own, "normalize_terminal_leaves", True), terminals)
    own = hubbed.unionByName(held(own, "normalize_terminal_leaves", False))
    limited = trees.connector_limits(terminals, options, overrides)
    cut, attach, warned = trees.with_attachments(held(own, "enforce_attachment_radius", True), limited)
    own = cut.unionByName(held(own, "enforce_attachment_radius", False))
    places = places.unionByName(hubs.withColumn("ord", F.lit(2_000_000))).unionByName(attach.withColumn("ord", F.lit(3_000_000)))
    moved = trees.repelled(own, places, flags.select("project_id", (F.col("steiner_radius_km") * 1000).alias("radius_m")))
    warned = warned.unionByName(moved.filter("warning IS NOT NULL").select("project_id", F.lit(0).alias("ord"), F.col("warning").alias("message")))
    spaced = own.join(flags.select("project_id", "edge_vertex_spacing_km"), "project_id")
    dense, points = trees.densified(spaced, F.col("edge_vertex_spacing_km") * 1000.0)
    return dense, moved.select("project_id", "node_id", "x_m", "y_m").unionByName(points), warned


def responses(tree: DataFrame, places: DataFrame, terminals: DataFrame, options: DataFrame, solvers: DataFrame, warnings: DataFrame, metrics: DataFrame) -> DataFrame:
    """project_id, response: one JSON document for each project."""
    epsg = options.select("project_id", "epsg", "mode")
    lonlat = lambda p: F.array(*crs.inverse(p["x"], p["y"], F.col("epsg")))
    edge = F.struct(F.col("u").alias("from"), F.col("v").alias("to"), F.round("length_m", 3).alias("length_m"), F.round("weight", 3).alias("cost"), F.struct(F.lit("LineString").alias("type"), F.transform("geom", lonlat).alias("coordinates")).alias("geometry"))
    edges = tree.join(epsg, "project_id").groupBy("project_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    lon, lat = crs.inverse(F.col("x_m"), F.col("y_m"), F.col("epsg"))
    points = places.filter(ids.node_kind(F.col("node_id")) != "terminal").join(epsg, "project_id")
    points = points.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("id"), lon.alias("lon"), lat.alias("lat")))).alias("steiner_points"))
    ends = trees.attachments(tree, terminals).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("terminal_id").alias("id"), "role", "attached_to", "via"))).alias("t"))
    told = checks.unique_messages(warnings).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("w"))
    totals = trees.undirected_totals(tree)
    out = edges.join(points, "project_id", "left").join(ends, "project_id", "left").join(told, "project_id", "left").join(totals.drop("edges"), "project_id").join(solvers, "project_id").join(metrics, "project_id", "left").join(epsg, "project_id")
    numbers = F.struct(F.round("total_length_m", 3).alias("total_length_m"), F.round("total_weight", 3).alias("total_cost"), *(F.round(F.col(c).cast("double"), 3).alias(c) for c in metrics.columns if c != "project_id"))
    none = F.array().cast("array<string>")
    body = F.struct(
        "project_id",
        "mode",
        "solver",
        F.coalesce(F.transform("w", lambda w: w["message"]), none).alias("warnings"),
        numbers.alias("metrics"),
        F.struct("edges", F.coalesce("steiner_points", F.array().cast("array<struct<id:string,lon:double,lat:double>>")).alias("steiner_points")).alias("network_tree"),
        F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["role"].alias("role"), t["attached_to"].alias("attached_to"), t["via"].alias("via"))).alias("terminals"),
    )
    return out.select("project_id", F.to_json(body).alias("response"))


def plan_batch(requests: DataFrame, cells: DataFrame | None = None, meta: DataFrame | None = None, exact_terminals: int = graphs.EXACT_TERMINALS, base_dir: str = ".") -> Planned:
    """Plans all requests (a column `request`).

    Full-mode projects take their grid from cells and meta, or else from the raster
    that the request names; relative paths are below base_dir.
    cells: project_id, row, col, elevation.  meta: project_id, a, c, e, f, nodata.
    """
    spark = requests.sparkSession
    scratch = Scratch(spark, "plans")
    loaded = rq.load(requests, base_dir)
    loaded.options, loaded.terminals = scratch.keep(loaded.options, "options"), scratch.keep(loaded.terminals, "terminals")
    zones = z.zone_table(loaded.zones).withColumn("core_edges", geom.edges(F.col("geom_core")))
    zones = scratch.keep(zones, "zones")
    loaded.zones = zones
    issues = checks.role_issues(loaded.terminals).unionByName(checks.count_issues(loaded.terminals, loaded.options)).unionByName(checks.ban_issues(loaded.terminals, zones, loaded.options))
    full = loaded.options.filter("mode = 'full'")
    if meta is None and not full.isEmpty():
        cells, meta, found = grids(loaded, base_dir, scratch)
        issues = issues.unionByName(found)
    if meta is not None:
        sized = meta.join(cells.groupBy("project_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")), "project_id")
        issues = issues.unionByName(checks.extent_issues(loaded.terminals, sized))
    issues = scratch.keep(loaded.issues.unionByName(issues), "issues")
    bad = issues.filter("severity = 'error'").select("project_id").distinct()
    alive = lambda df: df.join(bad, "project_id", "left_anti")
    good = rq.Loaded(loaded.requests, alive(loaded.options), alive(loaded.terminals), alive(zones), alive(loaded.corridors), issues)
    of_mode = lambda df, m: df.join(good.options.filter(F.col("mode") == m).select("project_id"), "project_id", "left_semi")
    euclid = rq.Loaded(good.requests, good.options.filter("mode = 'euclid'"), of_mode(good.terminals, "euclid"), of_mode(good.zones, "euclid"), good.corridors, issues)
    candidates, program = steiner_candidates(euclid, euclid.zones, scratch)
    nodes, connectors = with_outgoing(euclid_nodes(euclid, euclid.zones, candidates, scratch), euclid.terminals)
    nodes, connectors = scratch.keep(nodes, "nodes"), scratch.keep(connectors, "connectors")
    edges = scratch.keep(euclid_edges(nodes, connectors, euclid.zones, euclid.options), "edges")
    edges = scratch.keep(pruned(edges, nodes, euclid.terminals), "pruned")
    metrics = euclid.options.select("project_id", F.lit(None).cast("double").alias("max_slope_deg"))
    if meta is not None:
        m = meta.join(full.select("project_id", "slope_cost_factor", "max_slope_deg", "corridor_buffer_m"), "project_id")
        costs = scratch.keep(raster.cost_raster(alive(cells), m, of_mode(good.zones, "full"), of_mode(good.corridors, "full")), "costs")
        part = rq.Loaded(good.requests, good.options.filter("mode = 'full'"), of_mode(good.terminals, "full"), good.zones, good.corridors, issues)
        base, off_grid = full_nodes(part, costs, meta, scratch)
        exits, spots = full_exits(part.terminals, scratch.keep(base, "base-nodes"), costs, meta)
        exits, spots = scratch.keep(exits, "exits"), scratch.keep(spots, "full-nodes")
        ways, lost = full_edges(spots, exits, costs, meta)
        ways, lost = scratch.keep(ways, "full-edges"), scratch.keep(off_grid.unionByName(lost), "lost")
        nodes, edges = nodes.unionByName(spots.select(*NODE_COLUMNS)), edges.unionByName(ways.select(*EDGE_COLUMNS))
        metrics = metrics.unionByName(raster.summary(costs).select("project_id", "max_slope_deg"))
    routing = scratch.keep(checks.connectivity_issues(edges, good.terminals), "routing-issues")
    failed = routing.filter("severity = 'error'").select("project_id").distinct()
    edges, ends = edges.join(failed, "project_id", "left_anti"), good.terminals.join(failed, "project_id", "left_anti")
    by_solver = lambda df, s: df.join(good.options.filter(F.col("solver") == s).select("project_id"), "project_id", "left_semi")
    solved = graphs.steiner_tree(by_solver(edges, "steinerpy"), by_solver(ends, "steinerpy"), True, exact_terminals).unionByName(graphs.steiner_tree(by_solver(edges, "nx_approx"), by_solver(ends, "nx_approx"), False))
    solved = scratch.keep(solved, "solved")
    tree = scratch.keep(tree_table(solved, edges), "tree")
    dense, places, warned = adjusted(tree, nodes, ends, good.options)
    dense, places = scratch.keep(dense, "dense"), scratch.keep(places, "places")
    skipped = edges.filter("crosses_ban").select("project_id", F.col("u").alias("a"), F.col("v").alias("b"), F.lit("ban_forbidden_weight").alias("reason"))
    told_exits = euclid_exits(connectors, euclid.terminals)
    if meta is not None:
        skipped = skipped.unionByName(lost)
        told_exits = told_exits.unionByName(exits.select(*told_exits.columns))
    warned = warned.unionByName(apart_warnings(dense, ends))
    one = lambda df, rank: df.select("project_id", (F.lit(rank * 10_000_000) + F.row_number().over(Window.partitionBy("project_id").orderBy("seq", "message"))).alias("seq"), "message")
    solver_words = solved.select("project_id", F.posexplode("warnings").alias("seq", "message")).distinct()
    as_words = lambda df: df.select("project_id", "seq", "message")
    final_ban = tree.filter("crosses_ban")
    words = [
        one(as_words(issues.filter("severity = 'warning'")), 0),
        one(as_words(routing.filter("severity = 'warning'")), 1),
        one(program, 2),
        one(outgoing_warnings(told_exits, good.zones), 3),
        one(solver_words, 4),
        one(as_words(checks.tree_ban_warnings(final_ban)), 5),
        one(final_ban_warnings(dense, good.zones), 6),
        one(as_words(checks.skipped_warnings(skipped)), 7),
        one(warned.withColumnRenamed("ord", "seq"), 8),
    ]
    all_words = words[0]
    for w in words[1:]:
        all_words = all_words.unionByName(w)
    counts = good.options.select("project_id").join(good.zones.filter("mode = 'ban'").groupBy("project_id").agg(F.count("*").alias("ban_zones")), "project_id", "left")
    counts = counts.join(skipped.groupBy("project_id").agg(F.count("*").alias("routing_edges_skipped")), "project_id", "left").na.fill(0).join(metrics, "project_id", "left")
    solvers = solved.groupBy("project_id").agg(F.min("solver").alias("solver"))
    told = responses(dense, places, ends, good.options, solvers, all_words, counts)
    # a project whose terminals cannot all be joined has no response
    unsolved = checks._issue(solved.filter("u IS NULL"), "tree", "route_may_be_blocked", F.lit("not all terminals can be joined"))
    out = Planned(scratch.keep(told, "responses"), scratch.keep(issues.unionByName(routing).unionByName(unsolved).unionByName(tree_issues(tree, ends)), "all-issues"))
    scratch.drop("options", "terminals", "zones", "issues", "programs", "raw-candidates", "candidates", "all-nodes", "grid-nodes", "nodes", "connectors", "edges", "pruned", "costs", "base-nodes", "exits", "full-nodes", "full-edges", "lost", "routing-issues", "solved", "tree", "dense", "places", "rasters", "cells", "meta")
    return out


def run_plan(spark: SparkSession, request: dict | str, base_dir: str | None = None) -> dict:
    """One request, or the path of its file, to one response; raises PlanRequestError with the first error's code.

    Relative paths in the request are below base_dir, else the file's folder, else the working folder.
    """
    text = request if isinstance(request, str) else json.dumps(request)
    if isinstance(request, str) and not request.lstrip().startswith("{"):
        found = rq.read_requests(spark, request).first() if files.existing(spark, [request]) else None
        if found is None:
            raise PlanRequestError("invalid_request", f"request not found: {request}")
        text, base_dir = found["request"], base_dir or posixpath.dirname(request)
    base = base_dir or os.getcwd()
    done = plan_batch(spark.createDataFrame([(text,)], "request string"), base_dir=base)
    found = done.responses.first()
    if found:
        return json.loads(found["response"])
    error = done.issues.filter("severity = 'error'").orderBy("stage", "seq").first()
    raise PlanRequestError(error["code"] if error else "invalid_request", error["message"] if error else "no plan")
