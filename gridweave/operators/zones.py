"""Zones, points and straight runs: every spatial join of the euclid mode.

Zones of a project are few and hang on one row per project, so that pairing
nodes stays one equi-join on the project.  The zone tests are higher-order
functions, which the JVM interprets row by row; a bounding box is tested before
any edge list, and what is used more than once is bound to a lambda variable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridweave.functions import geom

BAN_EPS = 1e-3
BAN_WEIGHT = 1e12


def zone_table(zones: DataFrame) -> DataFrame:
    """zones (project_id, ord, zone_id, mode, multiplier, geom) with edge lists and boxes; is_box: the zone is its box."""
    flat = zones.withColumn("edges", geom.edges(F.col("geom")))
    x = F.concat(F.transform("edges", lambda s: s["x1"]), F.transform("edges", lambda s: s["x2"]))
    y = F.concat(F.transform("edges", lambda s: s["y1"]), F.transform("edges", lambda s: s["y2"]))
    flat = flat.withColumns({"xmin": F.array_min(x), "xmax": F.array_max(x), "ymin": F.array_min(y), "ymax": F.array_max(y)})
    corner = lambda s, k: s[f"x{k}"].isin(F.col("xmin"), F.col("xmax")) & s[f"y{k}"].isin(F.col("ymin"), F.col("ymax"))
    # four edges between corners of the box that go round all of it
    twice = F.aggregate("edges", F.lit(0.0), lambda a, s: a + (s["x1"] - F.col("xmin")) * (s["y2"] - F.col("ymin")) - (s["x2"] - F.col("xmin")) * (s["y1"] - F.col("ymin")))
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    is_box = (F.size("edges") == 4) & F.forall("edges", lambda s: corner(s, 1) & corner(s, 2)) & (area > 0) & (F.abs(twice) == 2 * area)
    return flat.withColumn("is_box", F.coalesce(is_box, F.lit(False)))


def per_project(zones: DataFrame, mode: str, name: str) -> DataFrame:
    """project_id, name: the zones of one mode as an array, in their order."""
    one = F.struct("ord", "zone_id", "multiplier", "edges", "xmin", "ymin", "xmax", "ymax", "is_box")
    return zones.filter(F.col("mode") == mode).groupBy("project_id").agg(F.array_sort(F.collect_list(one)).alias(name))


def _in_box(z: Column, x: Column, y: Column, eps: float = geom.EPS) -> Column:
    return (x >= z["xmin"] - eps) & (x <= z["xmax"] + eps) & (y >= z["ymin"] - eps) & (y <= z["ymax"] + eps)


def multiplier_at(x: Column, y: Column, zones: Column) -> Column:
    """Product of the multipliers of all zones that hold the point (boundary included)."""
    return F.aggregate(F.coalesce(zones, F.array()), F.lit(1.0), lambda p, z: F.when(_in_box(z, x, y) & (z["is_box"] | geom.inside_closed(x, y, z["edges"])), p * z["multiplier"]).otherwise(p))


def _beside(z: Column, ax: Column, ay: Column, bx: Column, by: Column, eps: float = geom.EPS) -> Column:
    """Whether the box of the run meets that of the zone."""
    return (F.greatest(ax, bx) >= z["xmin"] - eps) & (F.least(ax, bx) <= z["xmax"] + eps) & (F.greatest(ay, by) >= z["ymin"] - eps) & (F.least(ay, by) <= z["ymax"] + eps)


def length_in(z: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Length of the straight run a-b within the zone; a box needs no list of edges."""
    own = geom.clipped_length(ax, ay, bx, by, *(z[c] for c in ("xmin", "ymin", "xmax", "ymax")))
    return F.when(z["is_box"], own).otherwise(geom.inside_length(ax, ay, bx, by, z["edges"]))


def blocking(ax: Column, ay: Column, bx: Column, by: Column, zones: Column) -> Column:
    """Whether the run has more than BAN_EPS metres inside one of the zones."""
    return F.coalesce(F.exists(zones, lambda z: _beside(z, ax, ay, bx, by, 0.0) & (length_in(z, ax, ay, bx, by) > BAN_EPS)), F.lit(False))


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def penalised_weight(ax: Column, ay: Column, bx: Column, by: Column, zones: Column, step: Column) -> Column:
    """Trapezoid sum of the multiplier along a run, at samples about `step` apart; zones off the run's box are left out first."""
    length = geom.distance(ax, ay, bx, by)

    def along(near: Column, n: Column) -> Column:
        samples = F.transform(F.sequence(F.lit(0), n - 1), lambda i: multiplier_at(ax + (bx - ax) * i / (n - 1), ay + (by - ay) * i / (n - 1), near))
        total = _let(samples, lambda m: F.aggregate(m, F.lit(0.0), lambda s, v: s + v) - (m[0] + F.element_at(m, -1)) / 2)
        return total * length / (n - 1)

    n = F.greatest(F.lit(2), F.floor(length / F.greatest(step, F.lit(1.0))).cast("int") + 1)
    weighed = _let(F.filter(F.coalesce(zones, F.array()), lambda z: _beside(z, ax, ay, bx, by)), lambda near: F.when(F.size(near) == 0, length).otherwise(_let(n, lambda k: along(near, k))))
    return F.when(length <= 0, F.lit(0.0)).otherwise(weighed)


def graph_step(length: Column) -> Column:
    """Distance of samples on graph edges: about 80 at most."""
    return F.greatest(F.lit(2.0), length / 80)


def node_pairs(nodes: DataFrame, parts: int = 16) -> DataFrame:
    """All pairs of a project's nodes, the earlier one first.

    The first nodes of a project are dealt over `parts` keys, each of which meets
    all nodes, so that the pairs of few large projects do not end in as few tasks.
    """
    side = lambda s: nodes.select("project_id", F.col("ord").alias(f"{s}_ord"), F.col("node_id").alias(s), F.col("x_m").alias(f"{s}x"), F.col("y_m").alias(f"{s}y"))
    u = side("u").withColumn("part", F.pmod(F.col("u_ord"), F.lit(parts)).cast("int"))
    v = side("v").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = 4 * nodes.sparkSession.sparkContext.defaultParallelism
    pairs = u.repartition(tasks, "project_id", "part").join(v.hint("merge"), ["project_id", "part"]).filter("u_ord < v_ord").drop("part")
    return pairs.withColumn("length_m", geom.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))


def near_pairs(nodes: DataFrame, most_nodes: int = 80, reach: float = 2000.0) -> DataFrame:
    """Pairs of a project: all if it has few nodes, else those within reach.

    Larger projects meet through square buckets of side `reach`, each node with
    the nine around it, so the join never holds all pairs.
    """
    sized = nodes.join(nodes.groupBy("project_id").agg(F.count("*").alias("n_nodes")), "project_id")
    bucket = lambda c: F.when(F.col("n_nodes") <= most_nodes, F.lit(0)).otherwise(F.floor(F.col(c) / reach)).cast("long")
    at = sized.withColumn("bx", bucket("x_m")).withColumn("by", bucket("y_m"))
    steps = F.when(F.col("n_nodes") <= most_nodes, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (-1, 0, 1))))
    spread = at.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumn("bx", F.col("bx") + F.col("dx")).withColumn("by", F.col("by") + F.col("dy"))
    u = at.select("project_id", "bx", "by", F.col("ord").alias("u_ord"), F.col("node_id").alias("u"), F.col("x_m").alias("ux"), F.col("y_m").alias("uy"), "n_nodes")
    v = spread.select("project_id", "bx", "by", F.col("ord").alias("v_ord"), F.col("node_id").alias("v"), F.col("x_m").alias("vx"), F.col("y_m").alias("vy"))
    pairs = u.join(v, ["project_id", "bx", "by"]).filter("u_ord < v_ord").withColumn("length_m", geom.distance(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))
    return pairs.filter((F.col("n_nodes") <= most_nodes) | (F.col("length_m") <= reach)).drop("bx", "by", "n_nodes")


def straight_edges(pairs: DataFrame, zones: DataFrame) -> DataFrame:
    """Pairs with `blocked` and the penalised weight; zones: from zone_table()."""
    told = pairs.join(per_project(zones, "ban", "bans"), "project_id", "left").join(per_project(zones, "penalty", "penalties"), "project_id", "left")
    ends = [F.col(c) for c in ("ux", "uy", "vx", "vy")]
    told = told.withColumn("blocked", blocking(*ends, F.col("bans")))
    told = told.withColumn("weight", penalised_weight(*ends, F.col("penalties"), graph_step(F.col("length_m"))))
    return told.withColumn("geom", F.array(geom.point(ends[0], ends[1]), geom.point(ends[2], ends[3]))).drop("bans", "penalties")


def inside_lengths(pairs: DataFrame, zones: DataFrame) -> DataFrame:
    """Pairs and zones that meet by their boxes, with inside_m, the length of the run in the zone; others have none."""
    own = zones.select("project_id", "zone_id", "edges", "xmin", "ymin", "xmax", "ymax", "is_box")
    z, ends = {c: own[c] for c in own.columns}, [pairs[c] for c in ("ux", "uy", "vx", "vy")]
    told = pairs.join(own, (pairs["project_id"] == own["project_id"]) & _beside(z, *ends)).drop(own["project_id"])
    return told.withColumn("inside_m", length_in({c: F.col(c) for c in own.columns}, *(F.col(c) for c in ("ux", "uy", "vx", "vy"))))


def visibility_edges(pairs: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges that no ban zone blocks."""
    return straight_edges(pairs, zones).filter(~F.col("blocked")).withColumn("crosses_ban", F.lit(False)).drop("blocked")


def direct_edges(pairs: DataFrame, zones: DataFrame) -> DataFrame:
    """All edges; those across a ban zone are flagged and weigh BAN_WEIGHT."""
    flagged = straight_edges(pairs, zones).withColumnRenamed("blocked", "crosses_ban")
    return flagged.withColumn("weight", F.when(F.col("crosses_ban"), F.lit(BAN_WEIGHT)).otherwise(F.col("weight")))


def graph_edges(pairs: DataFrame, zones: DataFrame, options: DataFrame) -> DataFrame:
    """Edges by each project's routing: blocked ones go if it routes around obstacles and has a ban zone."""
    bans = zones.filter("mode = 'ban'").select("project_id").distinct().withColumn("has_ban", F.lit(True))
    routed = direct_edges(pairs, zones).join(options.select("project_id", "euclid_routing"), "project_id").join(bans, "project_id", "left")
    around = (F.col("euclid_routing") == "obstacle") & F.coalesce("has_ban", F.lit(False))
    return routed.filter(~(around & F.col("crosses_ban"))).drop("euclid_routing", "has_ban")


def first_zone_at(points: DataFrame, zones: DataFrame, mode: str = "ban", buffer_ok: str | None = None) -> DataFrame:
    """points with zone_id of the first zone (by ord) that strictly holds them; others are left out.

    buffer_ok: a flag column; where it is true the zone counts without its buffer.
    """
    own = zones.filter(F.col("mode") == mode)
    core = F.col("core_edges") if "core_edges" in zones.columns else F.col("edges")
    own = own.withColumn("core_edges", core).select("project_id", F.col("ord").alias("zone_ord"), "zone_id", "edges", "core_edges", "xmin", "ymin", "xmax", "ymax")
    used = F.when(F.col(buffer_ok), F.col("core_edges")).otherwise(F.col("edges")) if buffer_ok else F.col("edges")
    joined = points.join(own, (points["project_id"] == own["project_id"]) & points["x_m"].between(own["xmin"], own["xmax"]) & points["y_m"].between(own["ymin"], own["ymax"])).drop(own["project_id"])
    held = joined.filter(geom.inside_open(F.col("x_m"), F.col("y_m"), used))
    return held.groupBy("project_id", "node_id").agg(F.min_by("zone_id", "zone_ord").alias("zone_id"))


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """project_id, node_id, target_id, distance of the nearest target (ties: the smaller ord)."""
    t = targets.select("project_id", F.col("node_id").alias("target_id"), F.col("ord").alias("t_ord"), F.col("x_m").alias("tx"), F.col("y_m").alias("ty"))
    joined = points.join(t, "project_id").withColumn("distance", geom.distance(F.col("x_m"), F.col("y_m"), F.col("tx"), F.col("ty")))
    best = joined.groupBy("project_id", "node_id").agg(F.min(F.struct("distance", "t_ord", "target_id")).alias("b"))
    return best.select("project_id", "node_id", F.col("b.target_id").alias("target_id"), F.col("b.distance").alias("distance"))


def _contested(nodes: DataFrame) -> DataFrame:
    """project_id, node_id of nodes that have another one nearer than their gap; they meet in square buckets."""
    at = nodes.select("project_id", "node_id", "ord", "x_m", "y_m", "gap", F.floor(F.col("x_m") / F.col("gap")).alias("bx"), F.floor(F.col("y_m") / F.col("gap")).alias("by"))
    steps = F.array(*map(F.lit, (-1, 0, 1)))
    spread = at.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    other = spread.select("project_id", (F.col("bx") + F.col("dx")).alias("bx"), (F.col("by") + F.col("dy")).alias("by"), F.col("ord").alias("o"), F.col("x_m").alias("ox"), F.col("y_m").alias("oy"))
    near = (F.col("o") != F.col("ord")) & (geom.distance(F.col("x_m"), F.col("y_m"), F.col("ox"), F.col("oy")) < F.col("gap"))
    return at.join(other, ["project_id", "bx", "by"]).filter(near).select("project_id", "node_id").distinct()


def _thinned(nodes: DataFrame, spacing: float | str, step) -> DataFrame:
    """step(kept, node) folded over the ordered nodes of a project that have another one near; all others stay.

    spacing: metres, or the column that has the project's.
    """
    gap = F.col(spacing) if isinstance(spacing, str) else F.lit(float(spacing))
    own = nodes.select("project_id", "ord", "node_id", "kind", "x_m", "y_m", F.greatest(gap, F.lit(1e-6)).alias("gap"))
    close = _contested(own)
    ordered = own.join(close, ["project_id", "node_id"], "left_semi").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "kind", "x_m", "y_m", "gap"))).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), step)
    return own.join(close, ["project_id", "node_id"], "left_anti").unionByName(ordered.select("project_id", F.inline(kept))).drop("gap")


def _near(n: Column):
    return lambda k: geom.distance(k["x_m"], k["y_m"], n["x_m"], n["y_m"]) < n["gap"]


def spaced(nodes: DataFrame, spacing: float | str, always: str = "terminal") -> DataFrame:
    """Greedy thinning by ord: a node stays if no kept one before it is nearer than spacing; `always` kinds stay.

    Order decides among nodes that are near each other, so these are one fold for
    each project; nodes without a near one need none.
    """
    return _thinned(nodes, spacing, lambda kept, n: F.when((n["kind"] == always) | ~F.exists(kept, _near(n)), F.concat(kept, F.array(n))).otherwise(kept))


def admitted(nodes: DataFrame, spacing: float, first: str = "terminal") -> DataFrame:
    """Greedy thinning by ord in which a node of kind `first` drives out nearer ones of other kinds; any other is turned away."""

    def step(kept: Column, n: Column) -> Column:
        near = F.filter(kept, _near(n))
        stays = (n["kind"] == first) & ~F.exists(near, lambda k: k["kind"] == first)
        left = F.filter(kept, lambda k: ~_near(n)(k))
        return F.when(F.size(near) == 0, F.concat(kept, F.array(n))).when(stays, F.concat(left, F.array(n))).otherwise(kept)

    return _thinned(nodes, spacing, step)


def contour_nodes(zones: DataFrame, boxes: DataFrame, mode: str, kind: str, label: str, grow: Column | None = None) -> DataFrame:
    """Vertices of zones as nodes (at most 36 of a part), inside the closed project box.

    grow: metres by which convex outlines move out first.
    """
    own = zones.filter(F.col("mode") == mode)
    ring = F.transform("geom", lambda polygon: geom.convex_buffer(polygon[0], grow) if grow is not None else polygon[0])
    own = own.withColumn("rings", ring).withColumn("corners", F.flatten(F.transform("rings", lambda r: geom.decimated(F.slice(r, 1, F.size(r) - 1)))))
    out = own.select("project_id", F.col("ord").alias("zone_ord"), "zone_id", F.posexplode("corners").alias("at", "p"))
    out = out.select("project_id", "zone_ord", "at", F.concat_ws(":", F.lit(label), "zone_id", F.col("at").cast("string")).alias("node_id"), F.lit(kind).alias("kind"), F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"))
    inside = out.join(boxes, "project_id").filter(F.col("x_m").between(F.col("xmin"), F.col("xmax")) & F.col("y_m").between(F.col("ymin"), F.col("ymax")))
    return inside.select(*out.columns)


def bounding_box(terminals: DataFrame, buffer_m: Column) -> DataFrame:
    found = terminals.groupBy("project_id").agg(*(f(c).alias(n) for f, c, n in ((F.min, "x_m", "xmin"), (F.min, "y_m", "ymin"), (F.max, "x_m", "xmax"), (F.max, "y_m", "ymax"))))
    return found.withColumns({c: F.col(c) + (buffer_m if c.endswith("max") else -buffer_m) for c in ("xmin", "ymin", "xmax", "ymax")})


def filtered_candidates(candidates: DataFrame, terminals: DataFrame, zones: DataFrame, spacing: float | str = 1.0, clear: float = 5.0) -> DataFrame:
    """Candidates that are clear of terminals and ban zones, thinned greedily."""
    t = terminals.select("project_id", F.col("x_m").alias("tx"), F.col("y_m").alias("ty"))
    close = geom.distance(F.col("x_m"), F.col("y_m"), F.col("tx"), F.col("ty")) < clear
    c = candidates.alias("c")
    left = c.join(t.alias("t"), (F.col("c.project_id") == F.col("t.project_id")) & close, "left_anti")
    banned = first_zone_at(left, zones)
    left = left.join(banned, ["project_id", "node_id"], "left_anti")
    return spaced(left, spacing, always="")
