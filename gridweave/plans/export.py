"""Responses as files: JSON, GeoPackage, metric snapshots."""

from __future__ import annotations

import json
import os
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The layers of a plan's GeoPackage and their attributes.
LAYERS = {
    "network_edges": ("LINESTRING", {"from_id": "TEXT", "to_id": "TEXT", "length_m": "REAL", "cost": "REAL"}),
    "steiner_points": ("POINT", {"id": "TEXT"}),
    "terminals": ("POINT", {"id": "TEXT", "role": "TEXT", "attached_to": "TEXT", "via": "TEXT"}),
}


def write_response(path: str, response: dict) -> None:
    """One response as indented UTF-8 JSON; missing folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(response, f, ensure_ascii=False, indent=2)


def write_responses(responses: DataFrame, path: str) -> None:
    """A batch of responses, one JSON line each, in a folder for each project."""
    responses.select("project_id", F.col("response").alias("value")).write.mode("overwrite").partitionBy("project_id").text(path)


def node_places(response: dict) -> dict[str, tuple[float, float]]:
    """Where the nodes of a response are: Steiner points first, then ends of edges."""
    out = {p["id"]: (p["lon"], p["lat"]) for p in response["network_tree"]["steiner_points"]}
    for e in response["network_tree"]["edges"]:
        line = e["geometry"]["coordinates"]
        if line:
            out.setdefault(e["from"], tuple(line[0]))
            out.setdefault(e["to"], tuple(line[-1]))
    return out


def _blob(points: list[tuple[float, float]], line: bool) -> bytes:
    """A GeoPackage geometry in EPSG:4326 without envelope."""
    flat = [c for p in points for c in p]
    head = struct.pack("<2sBBi", b"GP", 0, 1, 4326)
    return head + (struct.pack(f"<BII{len(flat)}d", 1, 2, len(points), *flat) if line else struct.pack("<BI2d", 1, 1, *flat))


def write_geopackage(path: str, response: dict) -> dict[str, int]:
    """Layers of one response; an old file is replaced, empty layers are left out. Returns rows by layer."""
    places = node_places(response)
    tree = response["network_tree"]
    rows = {
        "network_edges": [(_blob([tuple(p) for p in e["geometry"]["coordinates"]], True), e["from"], e["to"], e["length_m"], e["cost"]) for e in tree["edges"]],
        "steiner_points": [(_blob([(p["lon"], p["lat"])], False), p["id"]) for p in tree["steiner_points"]],
        "terminals": [(_blob([at], False), t["id"], t["role"], t["attached_to"], t["via"]) for t in response["terminals"] if (at := places.get(f"terminal:{t['id']}"))],
    }
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    if os.path.exists(path):
        os.remove(path)
    db = sqlite3.connect(path)
    db.executescript(
        """PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT CURRENT_TIMESTAMP, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]', NULL), ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL);"""
    )
    for layer, (kind, attributes) in LAYERS.items():
        if rows[layer]:
            db.execute(f"CREATE TABLE {layer} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom {kind}, {', '.join(f'{a} {t}' for a, t in attributes.items())})")
            db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, 4326)", (layer, layer))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 4326, 0, 0)", (layer, kind))
            db.executemany(f"INSERT INTO {layer} (geom, {', '.join(attributes)}) VALUES (?{', ?' * len(attributes)})", rows[layer])
    db.commit()
    db.close()
    return {layer: len(r) for layer, r in rows.items() if r}


def save_snapshot(metrics: DataFrame, path: str) -> None:
    """Metrics (section, metric, value) as JSON lines."""
    metrics.select("section", "metric", "value").write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, metric string, value double").json(path)
