"""Rewrites of a finished tree, as DataFrame steps.

tree: project_id, u, v, weight, length_m, geom (from u to v), edge_kind, fixed.
nodes: project_id, node_id, x_m, y_m.  terminals: project_id, ord, terminal_id,
role, node_id, x_m, y_m.  All steps keep every other column's meaning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridweave.functions import geom, ids

STUB_M = 0.1
TREE_COLUMNS = ["project_id", "u", "v", "weight", "length_m", "geom", "edge_kind", "fixed"]


def degrees(tree: DataFrame) -> DataFrame:
    """project_id, node_id, degree."""
    return tree.select("project_id", F.explode(F.array("u", "v")).alias("node_id")).groupBy("project_id", "node_id").agg(F.count("*").alias("degree"))


def undirected_totals(tree: DataFrame) -> DataFrame:
    """Edges, weight and length of each project, an edge once whichever way it is told."""
    one = tree.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v")).dropDuplicates(["project_id", "a", "b"])
    return one.groupBy("project_id").agg(F.count("*").alias("edges"), F.sum("weight").alias("total_weight"), F.sum("length_m").alias("total_length_m"))


def with_hubs(tree: DataFrame, terminals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terminals of degree above one hand their edges to a hub at the same place; (tree, hub nodes)."""
    busy = degrees(tree).filter("degree > 1").join(terminals.select("project_id", "terminal_id", "node_id", "x_m", "y_m"), ["project_id", "node_id"])
    busy = busy.withColumn("hub", ids.hub_node(F.col("terminal_id")))
    swap = busy.select("project_id", "node_id", "hub")
    out = tree
    for end in ("u", "v"):
        renamed = swap.select("project_id", F.col("node_id").alias(end), F.col("hub").alias("hub_" + end))
        out = out.join(renamed, ["project_id", end], "left").withColumn(end, F.coalesce("hub_" + end, end)).drop("hub_" + end)
    line = F.array(geom.point(F.col("x_m"), F.col("y_m")), geom.point(F.col("x_m") + STUB_M, F.col("y_m")))
    stubs = busy.select("project_id", F.col("node_id").alias("u"), F.col("hub").alias("v"), F.lit(0.0).alias("weight"), F.lit(STUB_M).alias("length_m"), line.alias("geom"), F.lit("connector").alias("edge_kind"), F.lit(False).alias("fixed"))
    return out.select(*TREE_COLUMNS).unionByName(stubs), busy.select("project_id", F.col("hub").alias("node_id"), "x_m", "y_m")


def connector_limits(terminals: DataFrame, options: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """terminals with limit_m: the override in km if there is one, else the project's."""
    out = terminals.join(options.select("project_id", "connector_max_km"), "project_id")
    if overrides is None:
        return out.withColumn("limit_m", F.col("connector_max_km") * 1000.0)
    return out.join(overrides.select("project_id", "terminal_id", "override_km"), ["project_id", "terminal_id"], "left").withColumn("limit_m", F.coalesce("override_km", "connector_max_km") * 1000.0)


def _piece(u: Column, v: Column, weight: Column, length: Column, line: Column, kind: Column) -> Column:
    return F.struct(u.alias("u"), v.alias("v"), weight.cast("double").alias("weight"), length.cast("double").alias("length_m"), line.alias("geom"), kind.alias("edge_kind"))


def _cut(p: Column, node: Column, terminal: Column, limit: Column, fixed: Column) -> Column:
    """The pieces of edge p, whose end `node` is a leaf terminal with this limit."""
    line = F.when(p["u"] == node, p["geom"]).otherwise(F.reverse(p["geom"]))
    turned = F.struct(node.alias("node"), F.when(p["u"] == node, p["v"]).otherwise(p["u"]).alias("away"), line.alias("line"), geom.line_length(line).alias("along"), p["length_m"].alias("length"), p["weight"].alias("weight"), p["edge_kind"].alias("kind"))

    def pieces(e: Column) -> Column:
        whole = lambda kind: F.array(_piece(e["node"], e["away"], e["weight"], e["length"], e["line"], kind))
        w1 = F.when(e["length"] > 0, e["weight"] * limit / e["length"]).otherwise(e["weight"] / 2)
        first = _piece(e["node"], ids.attach_node(terminal), w1, limit, geom.subline(e["line"], F.lit(0.0), limit), F.lit("connector"))
        rest = _piece(ids.attach_node(terminal), e["away"], e["weight"] - w1, e["length"] - limit, geom.subline(e["line"], limit, e["along"]), F.lit("backbone"))
        return F.when(fixed, whole(F.lit("connector"))).when(e["length"] <= limit + 1e-6, whole(e["kind"])).when(limit >= e["along"] - 1e-6, whole(F.lit("connector"))).otherwise(F.array(first, rest))

    return geom.let(turned, pieces)


def with_attachments(tree: DataFrame, limited: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of leaf terminals cut at their limits; (tree, attach nodes, warnings).

    An edge between two terminals is cut from the earlier one first, and the rest
    from the other.
    """
    leaf = degrees(tree).filter("degree = 1").join(limited.select("project_id", "node_id", "ord", "terminal_id", "limit_m"), ["project_id", "node_id"])
    one = leaf.select("project_id", "node_id", F.struct("ord", "node_id", "terminal_id", "limit_m").alias("t"))
    told = tree.join(one.select("project_id", F.col("node_id").alias("u"), F.col("t").alias("tu")), ["project_id", "u"], "left")
    told = told.join(one.select("project_id", F.col("node_id").alias("v"), F.col("t").alias("tv")), ["project_id", "v"], "left")
    earlier = F.when(F.col("tu").isNull() | (F.col("tv")["ord"] < F.col("tu")["ord"]), F.col("tv")).otherwise(F.col("tu"))
    later = F.when(F.col("tu").isNotNull() & F.col("tv").isNotNull(), F.when(F.col("tv")["ord"] < F.col("tu")["ord"], F.col("tu")).otherwise(F.col("tv")))
    told = told.withColumn("t1", earlier).withColumn("t2", later)
    fixed = F.coalesce("fixed", F.lit(False)) | F.col("u").startswith("steiner:fixed_exit:") | F.col("v").startswith("steiner:fixed_exit:")
    start = _piece(F.col("u"), F.col("v"), F.col("weight"), F.col("length_m"), F.col("geom"), F.col("edge_kind"))
    cut = lambda p, t: geom.let(p, lambda e: _cut(e, t["node_id"], t["terminal_id"], t["limit_m"], fixed))
    once = F.when(F.col("t1").isNull(), F.array(start)).otherwise(cut(start, F.col("t1")))
    # the second terminal is an end of the last piece
    twice = lambda parts: F.when(F.col("t2").isNull(), parts).otherwise(F.concat(F.slice(parts, 1, F.size(parts) - 1), cut(F.element_at(parts, -1), F.col("t2"))))
    told = told.withColumn("parts", geom.let(once, twice))
    out = told.select("project_id", "fixed", F.inline("parts")).select(*TREE_COLUMNS)
    made = out.filter(F.col("v").startswith("steiner:attach:") & F.col("u").startswith("terminal:"))
    end = F.element_at("geom", -1)
    nodes = made.select("project_id", F.col("v").alias("node_id"), end["x"].alias("x_m"), end["y"].alias("y_m"))
    skipped = limited.join(degrees(tree), ["project_id", "node_id"]).filter("degree <> 1").select("project_id", "ord", F.concat(F.lit("attachment_skipped:degree:"), "terminal_id").alias("message"))
    short = told.filter(~fixed & F.col("t1").isNotNull()).withColumn("along", geom.line_length(F.col("geom"))).filter((F.col("length_m") > F.col("t1")["limit_m"] + 1e-6) & (F.col("t1")["limit_m"] >= F.col("along") - 1e-6))
    short = short.select("project_id", F.col("t1")["ord"].alias("ord"), F.concat(F.lit("attachment_limit:"), F.col("t1")["terminal_id"]).alias("message"))
    return out, nodes, skipped.unionByName(short)


def densified(tree: DataFrame, spacing_m: Column) -> tuple[DataFrame, DataFrame]:
    """Edges longer than the spacing (if it is above zero) cut at every multiple of it; (tree, waypoints)."""
    long = (spacing_m > 0) & (F.col("length_m") > spacing_m + 1e-6)
    n = F.when(long, F.ceil((F.col("length_m") - 1e-6) / spacing_m).cast("int")).otherwise(F.lit(1))
    told = tree.withColumn("n", n).withColumn("along", geom.line_length(F.col("geom"))).withColumn("spacing", spacing_m)
    told = told.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    k, last = F.col("k"), F.col("k") == F.col("n")
    name = lambda i: ids.waypoint_node(F.col("u"), F.col("v"), i)
    begin = (k - 1) * F.col("spacing")
    stop = F.when(last, F.col("along")).otherwise(F.least(k * F.col("spacing"), F.col("along")))
    part = F.when(F.col("length_m") > 0, F.col("weight") * F.col("spacing") / F.col("length_m")).otherwise(F.lit(0.0))
    cut = told.select(
        "project_id",
        F.when(k == 1, F.col("u")).otherwise(name(k - 1)).alias("u"),
        F.when(last, F.col("v")).otherwise(name(k)).alias("v"),
        F.when(F.col("n") == 1, F.col("weight")).when(last, F.greatest(F.col("weight") - part * (k - 1), F.lit(0.0))).otherwise(part).alias("weight"),
        F.when(F.col("n") == 1, F.col("length_m")).when(last, F.col("length_m") - begin).otherwise(F.col("spacing")).alias("length_m"),
        F.when(F.col("n") == 1, F.col("geom")).otherwise(geom.subline(F.col("geom"), F.least(begin, F.col("along")), stop)).alias("geom"),
        "edge_kind",
        "fixed",
    )
    end = F.element_at("geom", -1)
    points = cut.filter(F.col("v").startswith("steiner:waypoint:")).select("project_id", F.col("v").alias("node_id"), end["x"].alias("x_m"), end["y"].alias("y_m"))
    return cut, points


REPELLED = "project_id string, node_id string, x_m double, y_m double, warning string"


def repelled(tree: DataFrame, nodes: DataFrame, radius: DataFrame) -> DataFrame:
    """nodes moved out of the radius round their nearest terminal, with a warning where none could be.

    Moves follow each other (a node sees the new places of those before it), so a
    project is one grouped task.  nodes: also ord.  radius: project_id, radius_m.
    """

    def run(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["ord", "node_id"])
        at = {n: np.array([x, y]) for n, x, y in zip(nodes["node_id"], nodes["x_m"], nodes["y_m"])}
        r = float(nodes["radius_m"].iloc[0]) if len(nodes) else 0.0
        beside: dict[str, list[str]] = {}
        for u, v in zip(edges["u"], edges["v"]):
            beside.setdefault(u, []).append(v)
            beside.setdefault(v, []).append(u)
        fixed = [n for n in at if n.startswith("terminal:")]
        told = {}
        for n in at:
            if r <= 0 or n.startswith(("terminal:", "steiner:hub:")) or not fixed:
                continue
            near = min(fixed, key=lambda t: float(np.hypot(*(at[n] - at[t]))))
            gap = float(np.hypot(*(at[n] - at[near])))
            if gap >= r:
                continue
            for other in sorted(beside.get(n, [])):
                way = at[other] - at[n]
                size = float(np.hypot(*way))
                if way @ (at[near] - at[n]) < 0 and size >= 1e-9:
                    at[n] = at[n] + way / size * min(r - gap + 1.0, size / 2)
                    break
            else:
                told[n] = f"steiner_repel_failed:{n}"
        return pd.DataFrame([(nodes["project_id"].iloc[0], n, p[0], p[1], told.get(n)) for n, p in at.items()], columns=["project_id", "node_id", "x_m", "y_m", "warning"])

    n = nodes.join(radius.select("project_id", "radius_m"), "project_id").select(*(F.col(c).alias(c) for c in ("project_id", "node_id", "ord", "x_m", "y_m", "radius_m")))
    return tree.select("project_id", "u", "v").groupBy("project_id").cogroup(n.groupBy("project_id")).applyInPandas(run, REPELLED)


def attachments(tree: DataFrame, terminals: DataFrame) -> DataFrame:
    """project_id, ord, terminal_id, role, attached_to, via of each terminal."""
    both = tree.select("project_id", F.col("u").alias("node_id"), F.col("v").alias("other")).unionByName(tree.select("project_id", F.col("v").alias("node_id"), F.col("u").alias("other")))
    first = both.groupBy("project_id", "node_id").agg(F.min("other").alias("other"))
    t = terminals.join(first, ["project_id", "node_id"], "left")
    beyond = both.filter(F.col("node_id").startswith("steiner:hub:")).withColumnRenamed("node_id", "hub")
    beyond = beyond.filter(F.concat(F.lit("terminal:"), F.substring_index("hub", "steiner:hub:", -1)) != F.col("other"))
    beyond = beyond.withColumnRenamed("other", "next").groupBy("project_id", F.col("hub").alias("other")).agg(F.min("next").alias("beyond"))
    t = t.join(beyond, ["project_id", "other"], "left")
    via = F.when(F.col("other").startswith("steiner:hub:"), "hub").when(F.col("other").startswith("steiner:attach:"), "attach").when(F.col("other").startswith("steiner:fixed_exit:"), "fixed_exit").otherwise("tree")
    return t.select("project_id", "ord", "terminal_id", "role", F.coalesce("beyond", "other", F.lit("")).alias("attached_to"), via.alias("via"))
