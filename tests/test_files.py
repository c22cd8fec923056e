"""Readers and writers on files made here."""

import json
import struct

import pytest

from gridweave.plans import export, service
from gridweave.plans.planner import PlanRequestError
from gridweave.sources import files

RESPONSE = {
    "network_tree": {"edges": [{"from": "terminal:a", "to": "steiner:x", "length_m": 1.5, "cost": 3.0, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}}], "steiner_points": [{"id": "steiner:x", "lon": 3.0, "lat": 4.0}]},
    "terminals": [{"id": "a", "role": "start", "attached_to": "steiner:x", "via": "tree"}, {"id": "lost", "role": "end", "attached_to": "", "via": "tree"}],
}


def tiff(rows, cols, values, nodata=b"-9999\0"):
    """A minimal little-endian TIFF of doubles in one strip."""
    entries = [(256, 4, 1, cols), (257, 4, 1, rows), (258, 3, 1, 64), (259, 3, 1, 1), (273, 4, 1, None), (277, 3, 1, 1), (279, 4, 1, rows * cols * 8), (339, 3, 1, 3), (33550, 12, 3, None), (33922, 12, 6, None), (42113, 2, len(nodata), None)]
    at = 8 + 2 + 12 * len(entries) + 4
    extra = {33550: struct.pack("<3d", 10, 10, 0), 33922: struct.pack("<6d", 0, 0, 0, 500000, 6200000, 0), 42113: nodata, 273: b""}
    where, blob = {}, b""
    for tag in (33550, 33922, 42113):
        where[tag] = at + len(blob)
        blob += extra[tag]
    where[273] = at + len(blob)
    body = struct.pack("<H", len(entries))
    for tag, kind, n, value in entries:
        value = where[tag] if value is None else value
        body += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return b"II*\0" + struct.pack("<I", 8) + body + b"\0" * 4 + blob + struct.pack(f"<{rows * cols}d", *values)


def test_tiff(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(2, 3, [1, 2, 3, 4, 5, -9999]))
    got = sorted((r.row, r.col, r.elevation) for r in files.read_tiff(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, -9999)]
    first = files.read_tiff(spark, str(tmp_path)).first()
    assert (first.a, first.c, first.e, first.f, first.file_nodata) == (10, 500000, -10, 6200000, -9999)


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
    points = ring + hole
    body = struct.pack("<i4d2i2i", 5, 0, 0, 10, 10, 2, len(points), 0, 5) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "z.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    shape = files.read_vector(spark, str(tmp_path)).first().geom
    assert len(shape) == 1 and [len(r) for r in shape[0]] == [5, 5]


def test_geopackage_round_trip(spark, tmp_path):
    path = tmp_path / "plan.gpkg"
    path.write_text("old")
    assert export.write_geopackage(str(path), RESPONSE) == {"network_edges": 1, "steiner_points": 1, "terminals": 1}
    shape = files.read_vector(spark, str(tmp_path), "network_edges").first().geom
    assert [(p.x, p.y) for p in shape[0][0]] == [(1, 2), (3, 4)]


def test_response_file(tmp_path):
    export.write_response(str(tmp_path / "deep" / "r.json"), RESPONSE)
    assert json.loads((tmp_path / "deep" / "r.json").read_text()) == RESPONSE


def test_service_answers():
    def plan(text):
        if text == "bad":
            raise PlanRequestError("invalid_roles", "two starts")
        if text == "worse":
            raise RuntimeError("boom")
        return {"ok": True}

    assert service.answer("GET", "/health", b"", plan)[0] == 200
    assert service.answer("POST", "/plan", b"{}", plan) == (200, {"ok": True})
    assert service.answer("POST", "/plan", b"bad", plan) == (422, {"errors": [{"code": "invalid_roles", "message": "two starts"}]})
    assert service.answer("POST", "/plan", b"worse", plan)[0] == 500
    assert service.answer("GET", "/x", b"", plan)[0] == 404


def test_snapshots(spark, tmp_path):
    m = spark.createDataFrame([("tree", "cost", 1.5)], "section string, metric string, value double")
    export.save_snapshot(m, str(tmp_path / "m"))
    assert [tuple(r) for r in export.load_snapshot(spark, str(tmp_path / "m")).collect()] == [("tree", "cost", 1.5)]


def test_faulty_tiff():
    with pytest.raises(ValueError):
        files.tiff_band(b"II\0\0" + b"\0" * 20)


def test_service_folders_and_fixtures(tmp_path, monkeypatch):
    (tmp_path / "one.json").write_text('{"project_id": "p"}')
    (tmp_path / "note.txt").write_text("no fixture")
    ask = lambda path, method="GET": service.answer(method, path, b"", lambda text: {}, str(tmp_path))
    assert ask("/fixtures") == (200, {"fixtures": ["one"]}) and ask("/fixtures/one") == (200, {"project_id": "p"})
    assert ask("/fixtures/../one")[0] == 404 and ask("/plan", "OPTIONS")[0] == 204
    assert service.answer("POST", "/plan", b" " * (service.MOST_BYTES + 1), lambda text: {})[0] == 413
    with pytest.raises(PlanRequestError):
        service.planned(None, "/etc/hostname", ".")
    monkeypatch.setenv(service.VARIABLE, "/from/env")
    assert service.base_folder({}) == "/from/env" and service.base_folder({}, "/given") == "/given" and service.base_folder({service.HEADER: "/head"}, "/given") == "/head"


def test_names_of_the_package():
    import gridweave

    assert all(callable(getattr(gridweave, n)) for n in gridweave.__all__)
