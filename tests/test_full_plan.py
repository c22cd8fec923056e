"""Full mode from files: rasters, zones and corridors that a request names."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from gridweave.functions import crs
from gridweave.operators import graphs, zones as z
from gridweave.plans import planner

from .test_files import tiff

EPSG = 32637


@pytest.fixture(scope="module")
def lonlat(spark):
    def move(points):
        df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "k int, x double, y double")
        lon, lat = crs.inverse(F.col("x"), F.col("y"), F.lit(EPSG))
        return [(r.lon, r.lat) for r in df.select("k", lon.alias("lon"), lat.alias("lat")).orderBy("k").collect()]

    return move


def shapefile(ring):
    body = struct.pack("<i4d2i1i", 5, 0, 0, 0, 0, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    return b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory, lonlat):
    at = tmp_path_factory.mktemp("plans")
    (at / "flat.tif").write_bytes(tiff(60, 60, [100.0] * 3600))
    (at / "broken.tif").write_bytes(b"no raster")
    wall = lonlat([(500200, 6199400), (500200, 6199900), (500230, 6199900), (500230, 6199400), (500200, 6199400)])
    (at / "wall.shp").write_bytes(shapefile(wall))
    return at


def request(lonlat, project, places, raster="flat.tif", terrain=None, outgoing=None, **options):
    names = ["start", "end", "branch"]
    terminals = [{"id": f"t{k}", "role": names[k], "lon": lon, "lat": lat} for k, (lon, lat) in enumerate(lonlat(places))]
    if outgoing:
        terminals[0]["outgoing"] = outgoing
    return {"project_id": project, "mode": "full", "terminals": terminals, "terrain": {"elevation_raster": {"path": raster, "crs": f"EPSG:{EPSG}"}, "clip_buffer_km": 0.3} | (terrain or {}), "options": {"candidate_stride_cells": 30, "normalize_terminal_leaves": False, "enforce_attachment_radius": False} | options}


TWO = [(500105, 6199795), (500405, 6199795)]


@pytest.fixture(scope="module")
def batch(spark, folder, lonlat):
    corridor = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [list(p) for p in lonlat([(500105, 6199700), (500405, 6199700)])]}}]}
    docs = [
        request(lonlat, "plain", TWO),
        request(lonlat, "wall", TWO, terrain={"zones": [{"id": "w", "mode": "ban", "source": {"path": "wall.shp"}}]}),
        request(lonlat, "absolute", TWO, raster=str(folder / "flat.tif")),
        request(lonlat, "corridor", TWO, terrain={"corridors": {"geometry": corridor, "cost_multiplier": 0.1}}),
        request(lonlat, "exit", TWO, outgoing={"bearing_deg": 180.0, "length_m": 60.0}),
        request(lonlat, "far-exit", TWO, outgoing={"bearing_deg": 270.0, "length_m": 900.0}),
        request(lonlat, "same", [*TWO, (500407, 6199797)]),
        request(lonlat, "lost", TWO, raster="none.tif"),
        request(lonlat, "broken", TWO, raster="broken.tif"),
        request(lonlat, "outside", [(x + 50_000, y) for x, y in TWO]),
        request(lonlat, "no-zone-file", TWO, terrain={"zones": [{"id": "w", "mode": "ban", "source": {"path": "none.shp"}}]}),
    ]
    done = planner.plan_batch(spark.createDataFrame([(json.dumps(d),) for d in docs], "request string"), base_dir=str(folder))
    return {r.project_id: json.loads(r.response) for r in done.responses.collect()}, {(i.project_id, i.code) for i in done.issues.collect() if i.severity == "error"}


def test_files_that_fail(batch):
    assert {("lost", "raster_not_found"), ("broken", "invalid_raster"), ("outside", "raster_extent"), ("no-zone-file", "invalid_request")} <= batch[1]
    assert not {"lost", "broken", "outside", "no-zone-file"} & set(batch[0])


def test_flat_ground(batch):
    # 31 cells of 10 m in a row
    for name in ("plain", "absolute"):
        assert batch[0][name]["metrics"]["total_cost"] == pytest.approx(310)
        assert batch[0][name]["metrics"]["total_length_m"] == pytest.approx(300)
        assert batch[0][name]["metrics"]["max_slope_deg"] == 0


def test_zone_of_a_file_is_walked_round(batch):
    plan = batch[0]["wall"]
    assert plan["metrics"]["ban_zones"] == 1
    assert 380 < plan["metrics"]["total_length_m"] < 500  # a diagonal step costs as many cells as a straight one
    assert not any(w.startswith("edge ") for w in plan["warnings"])


def test_corridor_attracts(batch):
    plan = batch[0]["corridor"]
    assert 31 <= plan["metrics"]["total_cost"] < 310 < plan["metrics"]["total_length_m"] + 15


def test_exits(batch):
    plan = batch[0]["exit"]
    assert "fixed_outgoing_applied:t0" in plan["warnings"]
    edges = {frozenset((e["from"], e["to"])) for e in plan["network_tree"]["edges"]}
    assert frozenset(("terminal:t0", "steiner:fixed_exit:t0")) in edges
    assert sum("terminal:t0" in e for e in edges) == 1
    assert "fixed_outgoing_snap_failed:t0" in batch[0]["far-exit"]["warnings"]


def test_terminals_of_one_cell(batch):
    """The second one of a cell is no node, and its project cannot be planned."""
    assert ("same", "route_may_be_blocked") in batch[1] and "same" not in batch[0]


def test_run_plan_reads_a_file(spark, folder, lonlat):
    (folder / "request.json").write_text(json.dumps(request(lonlat, "plain", TWO)))
    plan = planner.run_plan(spark, str(folder / "request.json"))
    assert plan["metrics"]["total_cost"] == pytest.approx(310)
    with pytest.raises(planner.PlanRequestError) as e:
        planner.run_plan(spark, str(folder / "nothing.json"))
    assert e.value.code == "invalid_request"


def test_paths_and_reasons(spark):
    """A closed wall with one gap, against a plain relaxation over all cells."""
    inf = float("inf")
    cost = {(r, c): 1.0 + (r * 7 + c * 3) % 5 for r in range(9) for c in range(9)}
    cost |= {(r, 4): inf for r in range(9) if r != 7} | {(0, 8): inf}
    cells = spark.createDataFrame([("p", r, c, x, 10.0, -10.0) for (r, c), x in cost.items()], "project_id string, row int, col int, cost double, a double, e double")
    spots = {"u": (1, 1), "v": (2, 7), "w": (1, 1), "x": (0, 8)}
    nodes = spark.createDataFrame([("p", n, k, r, c) for k, (n, (r, c)) in enumerate(spots.items())], "project_id string, node_id string, ord int, row int, col int")
    got = {(p.u, p.v): p for p in graphs.least_cost_paths(cells, nodes).collect()}
    best = {spots["u"]: 0.0}
    for _ in range(81):
        for (r, c), d in list(best.items()):
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    to = (r + dr, c + dc)
                    if (dr or dc) and cost.get(to, inf) < inf:
                        best[to] = min(best.get(to, inf), d + (dr * dr + dc * dc) ** 0.5 * (cost[r, c] + cost[to]) / 2)
    assert got["u", "v"].objective == pytest.approx(best[spots["v"]])
    assert got["u", "v"].weight == pytest.approx(sum(cost[p.row, p.col] for p in got["u", "v"].path))
    assert got["u", "w"].reason == "same_cell" and got["u", "x"].reason == got["v", "x"].reason == "no_route"


def test_thinning_equals_one_pass_over_all_nodes(spark):
    import random

    r = random.Random(2)
    rows = [("p", k, f"n{k}", r.choice(["terminal", "grid", "corridor"]), r.random() * 60, r.random() * 60) for k in range(150)]
    nodes = spark.createDataFrame(rows, "project_id string, ord int, node_id string, kind string, x_m double, y_m double")
    near = lambda a, b: ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5 < 4
    plain, evicting = [], []
    for n in rows:
        if n[3] == "terminal" or not any(near(n, k) for k in plain):
            plain.append(n)
        close = [k for k in evicting if near(n, k)]
        if not close or (n[3] == "terminal" and all(k[3] != "terminal" for k in close)):
            evicting = [k for k in evicting if k not in close] + [n]
    assert {x.node_id for x in z.spaced(nodes, 4.0).collect()} == {n[2] for n in plain}
    assert {x.node_id for x in z.admitted(nodes, 4.0).collect()} == {n[2] for n in evicting}


def test_trees_and_their_faults(spark):
    edges = spark.createDataFrame([("good", "terminal:a", "s", 1.0, 2.0), ("good", "s", "terminal:b", 3.0, 4.0), ("loop", "terminal:a", "s", 1.0, 1.0), ("loop", "s", "q", 1.0, 1.0), ("loop", "q", "terminal:a", 1.0, 1.0), ("apart", "terminal:a", "s", 1.0, 1.0), ("apart", "q", "terminal:b", 1.0, 1.0)], "project_id string, u string, v string, weight double, length_m double")
    terminals = spark.createDataFrame([(p, f"terminal:{t}", t, k, r) for p in ("good", "loop", "apart") for k, (t, r) in enumerate((("a", "start"), ("b", "end")))], "project_id string, node_id string, terminal_id string, ord int, role string")
    summary = {r.project_id: r for r in planner.tree_summary(edges, edges).collect()}
    assert (summary["good"].nodes, summary["good"].edges, summary["good"].steiner_ids, summary["good"].total_weight) == (3, 2, ["s"], 4.0)
    assert {(i.project_id, i.code) for i in planner.tree_issues(edges, terminals).collect()} == {("loop", "not_a_tree"), ("loop", "terminal_missing"), ("apart", "not_a_tree"), ("apart", "tree_disconnected")}
    assert [r.project_id for r in planner.apart_warnings(edges, terminals).collect()] == ["apart", "loop"] or {r.project_id for r in planner.apart_warnings(edges, terminals).collect()} == {"apart", "loop"}
