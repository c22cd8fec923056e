"""Geometry, projection and grid rules on cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from gridweave.functions import crs, geom, ids
from gridweave.operators import graphs, raster


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box():
    return geom.edges(geom.box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)))


@pytest.mark.parametrize("run, inside", [((-5, 5, 15, 5), 10.0), ((0, -5, 0, 15), 10.0), ((-5, -5, -1, 20), 0.0), ((2, 2, 4, 2), 2.0), ((-5, 5, 0, 5), 0.0), ((5, 5, 5, 5), 0.0)])
def test_length_inside_a_box(spark, run, inside):
    # a run along the boundary counts as inside
    assert value(spark, geom.inside_length(*(F.lit(float(x)) for x in run), box())) == pytest.approx(inside)


@pytest.mark.parametrize("x, y, open_, closed", [(5, 5, True, True), (0, 5, False, True), (10, 10, False, True), (11, 5, False, False)])
def test_points_and_boundaries(spark, x, y, open_, closed):
    p = F.lit(float(x)), F.lit(float(y))
    assert value(spark, geom.inside_open(*p, box())) is open_
    assert value(spark, geom.inside_closed(*p, box())) is closed


def test_buffer_of_a_box(spark):
    ring = value(spark, geom.convex_buffer(geom.box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))[0][0], F.lit(2.0)))
    xs, ys = [p["x"] for p in ring], [p["y"] for p in ring]
    assert len(ring) == 21 and ring[0] == ring[-1]
    assert (min(xs), max(xs), min(ys), max(ys)) == pytest.approx((-2, 12, -2, 12))


def test_parts_of_a_line(spark):
    line = F.array(*(geom.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (10, 10))))
    part = value(spark, geom.subline(line, F.lit(5.0), F.lit(15.0)))
    assert [(p["x"], p["y"]) for p in part] == [(5, 0), (10, 0), (10, 5)]
    assert len(value(spark, geom.subline(line, F.lit(7.0), F.lit(7.0)))) == 2


@pytest.mark.parametrize("bearing, x, y", [(0, 1000, 2100), (90, 1100, 2000), (180, 1000, 1900), (45, 1000 + 100 * math.sin(math.pi / 4), 2000 + 100 * math.cos(math.pi / 4)), (-270, 1100, 2000)])
def test_fixed_exits(spark, bearing, x, y):
    got = spark.range(1).select(*ids.exit_point(F.lit(1000.0), F.lit(2000.0), F.lit(float(bearing)), F.lit(100.0))).first()
    assert tuple(got) == pytest.approx((x, y))


def test_projection_and_back(spark):
    e, n = crs.forward(F.lit(39.00160109642316), F.lit(55.94447648880544), F.lit(32637))
    got = spark.range(1).select(e.alias("e"), n.alias("n")).select("e", "n", *crs.inverse(F.col("e"), F.col("n"), F.lit(32637))).first()
    assert got[0] == pytest.approx(500100, abs=1e-4) and got[1] == pytest.approx(6199900, abs=1e-4)
    assert got[2] == pytest.approx(39.00160109642316, abs=1e-9) and got[3] == pytest.approx(55.94447648880544, abs=1e-9)


def test_plane_costs(spark):
    """A tilted plane with a ban box, a penalty box and no corridor."""
    rows = spark.range(2000).select(F.lit("p").alias("project_id"), F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"))
    cells = rows.withColumn("elevation", 100 + 0.5 * F.col("col") + 0.2 * F.col("row"))
    meta = spark.createDataFrame([("p", 10.0, 500000.0, -10.0, 6200000.0, -9999.0, 1.0, 30.0, 20.0)], "project_id string, a double, c double, e double, f double, nodata double, slope_cost_factor double, max_slope_deg double, corridor_buffer_m double")
    from gridweave.operators.zones import zone_table

    zones = spark.createDataFrame([("p", 0, "ban", "ban", None, 500170.0, 6199770.0, 500320.0, 6199880.0), ("p", 1, "pen", "penalty", 5.0, 500400.0, 6199700.0, 500480.0, 6199780.0)], "project_id string, ord int, zone_id string, mode string, multiplier double, x0 double, y0 double, x1 double, y1 double")
    zones = zone_table(zones.withColumn("geom", geom.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).drop("x0", "y0", "x1", "y1"))
    line = [(500100.0, 6199900.0), (500180.0, 6199965.0), (500360.0, 6199965.0), (500450.0, 6199750.0)]
    corridors = spark.createDataFrame([("p", 0, line, 0.5)], f"project_id string, line_ord int, geom {geom.LINE}, cost_multiplier double")
    costs = raster.cost_raster(cells, meta, zones, corridors)
    got = raster.summary(costs).first()
    assert (got["rows"], got["cols"], got["finite_cells"], got["banned_cells"]) == (40, 50, 1835, 165)
    assert got["max_slope_deg"] == pytest.approx(3.0824947102675173)
    assert got["max_cost"] == pytest.approx(55.1374911837792) and got["min_cost"] == pytest.approx(5.51374911837792)


def test_exact_trees_beat_or_meet_near_ones():
    import random

    r = random.Random(5)
    for _ in range(20):
        names = [f"n{i}" for i in range(9)]
        graph = {n: {} for n in names}
        for i, u in enumerate(names):
            for v in names[i + 1 :]:
                if r.random() < 0.5 or v == names[i + 1]:
                    graph[u][v] = graph[v][u] = r.randint(1, 20)
        ends = r.sample(names, 4)
        cost = lambda tree: sum(graph[u][v] for u, v in tree)
        exact, near = (graphs.pruned(f(graph, ends), ends, graph) for f in (graphs.steiner_exact, graphs.steiner_near))
        assert cost(exact) <= cost(near) <= 2 * cost(exact)
        best = min(_spanned(graph, {*ends, *extra}) for extra in _subsets([n for n in names if n not in ends]))
        assert cost(exact) == best


def _subsets(items):
    from itertools import chain, combinations

    return chain.from_iterable(combinations(items, k) for k in range(len(items) + 1))


def _spanned(graph, nodes):
    edges = [(graph[u][v], u, v) for u in nodes for v in graph[u] if v in nodes and u < v]
    tree = graphs._spanning(edges)
    return sum(graph[u][v] for u, v in tree) if len(tree) == len(nodes) - 1 else math.inf


def test_boxes_are_told_from_other_zones_and_give_the_same_lengths(spark):
    """The shorter way of boxes agrees with the general one; what only looks like a box goes the general way."""
    from gridweave.operators import zones as z

    ring = lambda *p: [[[{"x": float(x), "y": float(y)} for x, y in p]]]
    shapes = [
        ("box", ring((2, 1), (8, 1), (8, 5), (2, 5), (2, 1)), True),
        ("turned", ring((2, 5), (8, 5), (8, 1), (2, 1), (2, 5)), True),
        ("folded", ring((2, 1), (8, 1), (2, 1), (2, 5), (2, 1)), False),
        ("tie", ring((2, 1), (8, 5), (8, 1), (2, 5), (2, 1)), False),
        ("corner", ring((2, 1), (8, 1), (8, 5), (2, 1)), False),
        ("flat", ring((2, 1), (8, 1), (8, 1), (2, 1), (2, 1)), False),
        ("five", ring((2, 1), (5, 1), (8, 1), (8, 5), (2, 5), (2, 1)), False),
    ]
    table = spark.createDataFrame([("p", k, n, "ban", None, g) for k, (n, g, _) in enumerate(shapes)], f"project_id string, ord int, zone_id string, mode string, multiplier double, geom {geom.SHAPE}")
    zones = z.zone_table(table)
    assert {r.zone_id: r.is_box for r in zones.collect()} == {n: b for n, _, b in shapes}
    spots = [(x, y) for x in (0, 2, 3, 8, 9) for y in (0, 1, 3, 5, 7)]
    nodes = spark.createDataFrame([("p", k, f"n{k}", float(x), float(y)) for k, (x, y) in enumerate(spots)], "project_id string, ord int, node_id string, x_m double, y_m double")
    pairs = z.node_pairs(nodes)
    assert pairs.count() == len(spots) * (len(spots) - 1) // 2
    got = z.inside_lengths(pairs, zones)
    ends = [F.col(c) for c in ("ux", "uy", "vx", "vy")]
    off = got.withColumn("want", geom.inside_length(*ends, F.col("edges"))).filter("abs(want - inside_m) > 1e-7")
    assert off.count() == 0
    far = pairs.crossJoin(zones.select("zone_id", "edges")).join(got.select("u", "v", "zone_id"), ["u", "v", "zone_id"], "left_anti")
    assert far.filter(geom.inside_length(*ends, F.col("edges")) > 0).count() == 0


def test_pairs_of_one_project_are_dealt_over_tasks(spark):
    from gridweave.operators import zones as z

    nodes = spark.range(0, 400, 1, 1).select(F.when(F.col("id") < 398, "p").otherwise("q").alias("project_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("node_id"), (F.col("id") * 1.0).alias("x_m"), F.lit(0.0).alias("y_m"))
    own = [r[1] for r in z.node_pairs(nodes).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(own) == 398 * 397 // 2 + 1 and max(own) < sum(own) / 2


def test_snapping_does_not_broadcast_the_cells(spark):
    """Points of one cell are tried once, and the cells of the grid meet them by a shuffle."""
    cells = spark.range(400).select(F.lit("g").alias("project_id"), F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(math.inf).alias("cost"))
    points = spark.range(50).select(F.lit("g").alias("project_id"), F.col("id").cast("string").alias("node_id"), F.lit(4).alias("row"), (F.col("id") % 2).cast("int").alias("col"))
    got = raster.snapped(points, cells)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "row#" in line and "col#" in line for line in plan.splitlines())
    assert {(r.node_id, r.row, r.col) for r in got.collect()} == {(str(k), 4 if k % 2 else 3, 1 if k % 2 else 0) for k in range(50)}


def test_trees_grown_from_nodes_equal_those_of_all_pairs(spark):
    """Same rows as steiner_tree() on direct_edges(), with coinciding nodes, overlapping zones, bans and a zone that is no box."""
    from gridweave.operators import zones as z

    rows = [(f"p{p}", k, f"n{k * 7919 % 101}", float(k * 37 % 40 * 5 + p), float(k * 53 % 31 * 7)) for p, n in enumerate((45, 30, 6, 14)) for k in range(n)]
    nodes = spark.createDataFrame(rows, "project_id string, ord int, node_id string, x_m double, y_m double")
    box = lambda a, b, c, d: [[[{"x": float(x), "y": float(y)} for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))]]]
    own = [("p0", 0, "a", "penalty", 2.0, box(20, 20, 120, 90)), ("p0", 1, "b", "penalty", 0.4, box(60, 50, 160, 180)), ("p0", 2, "c", "ban", None, box(90, 0, 95, 230)), ("p2", 0, "d", "ban", None, box(10, 10, 60, 60))]
    own += [("p3", 0, "e", "penalty", 3.0, [[[{"x": 10.0, "y": 10.0}, {"x": 150.0, "y": 20.0}, {"x": 60.0, "y": 170.0}, {"x": 10.0, "y": 10.0}]]])]
    zones = z.zone_table(spark.createDataFrame(own, f"project_id string, ord int, zone_id string, mode string, multiplier double, geom {geom.SHAPE}"))
    rows = lambda t: sorted((r.project_id, r.u, r.v, round(r.weight, 6), r.solver, *r.warnings) for r in t.collect())
    want = rows(graphs.steiner_tree(z.direct_edges(z.node_pairs(nodes), zones), nodes))
    assert rows(graphs.straight_trees(nodes, zones)) == want
    assert {(r[0], r[4]) for r in want} == {("p0", "nx_approx"), ("p1", "nx_approx"), ("p2", "steinerpy"), ("p3", "nx_approx")}
    assert max(r[3] for r in want) == z.BAN_WEIGHT
