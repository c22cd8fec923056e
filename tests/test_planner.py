"""Whole plans."""

import json

import pytest

from gridweave.plans import planner
from gridweave.sources import programs

PLACES = [("t-start", "start", 39.00160109642316, 55.94447648880544), ("t-mid", "intermediate", 39.0072047670713, 55.94357778592078), ("t-end", "end", 39.00768494254051, 55.942858954676176), ("t-north", "branch", 39.004002805924074, 55.94510538599134)]


def request(**more):
    terminals = [{"id": i, "role": role, "lon": lon, "lat": lat} for i, role, lon, lat in PLACES]
    return {"project_id": "p", "mode": "euclid", "terminals": terminals, "options": {"connector_max_km": 0.05}} | more


@pytest.fixture(scope="module")
def batch(spark):
    """One batch of several requests; a plan is the same alone and in company."""
    ban = {"id": "wall", "mode": "ban", "geometry": {"type": "Polygon", "coordinates": [[[39.0050, 55.9430], [39.0058, 55.9430], [39.0058, 55.9448], [39.0050, 55.9448], [39.0050, 55.9430]]]}}
    exits = request(project_id="exit")
    exits["terminals"][1]["outgoing"] = {"bearing_deg": 90.0, "length_m": 80.0}
    half = request(project_id="half")
    half["terminals"][0]["outgoing"] = {"bearing_deg": 90.0}
    doubled = request(project_id="doubled")
    doubled["terminals"][1]["role"] = "start"
    docs = [request(project_id="plain"), request(project_id="wall", terrain={"zones": [ban]}), exits, half, doubled, request(project_id="raster", terrain={"elevation_raster": {"path": "x.tif"}})]
    rows = [(json.dumps(d),) for d in docs] + [("{broken",)]
    done = planner.plan_batch(spark.createDataFrame(rows, "request string"))
    return {r["project_id"]: json.loads(r["response"]) for r in done.responses.collect()}, done.issues.collect()


def test_plain(batch):
    plan = batch[0]["plain"]
    assert plan["metrics"]["total_cost"] == pytest.approx(513.458, abs=2e-3)
    assert plan["metrics"]["total_length_m"] == pytest.approx(513.658, abs=2e-3)
    assert len(plan["network_tree"]["edges"]) == 7 and len(plan["network_tree"]["steiner_points"]) == 4
    assert {t["id"]: t["via"] for t in plan["terminals"]} == {"t-start": "attach", "t-mid": "hub", "t-end": "attach", "t-north": "hub"}


def test_wall_is_walked_round(batch):
    plan = batch[0]["wall"]
    assert plan["metrics"]["ban_zones"] == 1
    assert 513.46 < plan["metrics"]["total_cost"] < 1e9


def test_prescribed_exit(batch):
    plan = batch[0]["exit"]
    first = next(e for e in plan["network_tree"]["edges"] if "steiner:fixed_exit:t-mid" in (e["from"], e["to"]) and "terminal:t-mid" in (e["from"], e["to"]))
    assert first["length_m"] == pytest.approx(80, abs=1)
    assert "fixed_outgoing_applied:t-mid" in plan["warnings"]


def test_faults_are_rows(batch):
    plans, issues = batch
    codes = {(i["project_id"], i["code"]) for i in issues if i["severity"] == "error"}
    assert {("half", "invalid_request"), ("doubled", "invalid_roles"), ("raster", "invalid_request")} <= codes
    assert set(plans) == {"plain", "wall", "exit"}
    assert sum(i["project_id"].startswith("request-") for i in issues) == 1


def generator(folder, points, code=0):
    """Stand-ins for the two programs: the first passes its input on, the second tells points."""
    folder.mkdir()
    lines = "\n".join(f"echo ' % @C {x} {y}'" for x, y in points)
    for name, body in (("efst", f"cat; exit {code}"), ("bb", f"cat >/dev/null\n{lines}")):
        (folder / name).write_text(f"#!/bin/sh\n{body}\n")
        (folder / name).chmod(0o755)
    return str(folder)


def test_candidates_of_the_external_program(spark, tmp_path):
    from gridweave.sources import requests as rq

    at = rq.load(spark.createDataFrame([(json.dumps(request()),)], "request string")).terminals.orderBy("ord").collect()
    x, y = sum(t.x_m for t in at) / 4, sum(t.y_m for t in at) / 4
    points = [(x, y), (x + 0.5, y), (at[0].x_m + 1, at[0].y_m), (x + 30, y), (x + 1e6, y)]
    homes = {"good": generator(tmp_path / "good", points), "none": generator(tmp_path / "none", []), "bad": generator(tmp_path / "bad", [], 3), "absent": str(tmp_path / "absent")}
    docs = [request(project_id=k, options={"connector_max_km": 0.05, "geosteiner_home": v}) for k, v in homes.items()]
    docs += [request(project_id="off", options={"euclid_steiner_candidates": False, "geosteiner_home": homes["good"]}), request(project_id="wide", options={"geosteiner_home": homes["good"], "steiner_candidate_spacing_m": 40.0})]
    done = planner.plan_batch(spark.createDataFrame([(json.dumps(d),) for d in docs], "request string"))
    plans = {r["project_id"]: json.loads(r["response"]) for r in done.responses.collect()}
    told = {k: [w for w in p["warnings"] if w.startswith("geosteiner")] for k, p in plans.items()}
    assert told == {
        "good": ["geosteiner_candidates_filtered:2", "geosteiner_candidates_added:3"],
        "none": ["geosteiner_unavailable:no_steiner_coordinates_in_bb_output"],
        "bad": ["geosteiner_unavailable:efst failed: " + programs.steiner_inputs(rq.load(spark.createDataFrame([(json.dumps(request()),)], "request string")).terminals).first().input.strip()],
        "absent": ["geosteiner_unavailable:" + programs.MISSING],
        "off": [],
        "wide": ["geosteiner_candidates_filtered:3", "geosteiner_candidates_added:2"],
    }
    assert plans["good"]["metrics"]["total_cost"] <= plans["off"]["metrics"]["total_cost"] + 1e-6
