"""Rasters and vector files as tables, read with binaryFile by the executors.

Native storage of grids is Parquet in long form; these readers bring in other
formats: TIFF (uncompressed, strips or tiles are not mixed), shapefiles and
GeoPackage layers, and the point lines of a Steiner program's output.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweave.functions.geom import SHAPE

_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def tiff_band(raw: bytes) -> tuple[np.ndarray, tuple[float, float, float, float], float | None]:
    """(first band, (a, c, e, f), nodata) of an uncompressed TIFF in strips."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    if struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n, value = struct.unpack(order + "HHI4s", raw[at + 2 + 12 * k : at + 14 + 12 * k])
        form = f"{order}{n}{_TYPES.get(kind, 'B')}"
        size = struct.calcsize(form)
        start = struct.unpack(order + "I", value)[0]
        tags[tag] = struct.unpack(form, value[:size] if size <= 4 else raw[start : start + size])
    if tags.get(259, (1,))[0] != 1 or 273 not in tags:
        raise ValueError("only uncompressed strips are read")
    cols, rows, bits, kind = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}".replace(" ", ""))
    data = b"".join(raw[o : o + n] for o, n in zip(tags[273], tags[279]))
    band = np.frombuffer(data, dtype)[: rows * cols * tags.get(277, (1,))[0]].reshape(rows, cols, -1)[:, :, 0].astype(np.float64)
    scale, tie = tags.get(33550, (1.0, 1.0)), tags.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    affine = (scale[0], tie[3] - tie[0] * scale[0], -scale[1], tie[4] + tie[1] * scale[1])
    none = tags[42113][0].rstrip(b"\0").strip() if 42113 in tags else None
    return band, affine, float(none) if none else None


CELLS = "path string, row int, col int, elevation double, a double, c double, e double, f double, file_nodata double"


def existing(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of the paths that are there, in whatever store they name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = {p: jvm.org.apache.hadoop.fs.Path(p) for p in paths}
    return {p for p, at in named.items() if at.getFileSystem(conf).exists(at)}


def plain(path: Column) -> Column:
    """A path without the scheme of local files, as requests name it."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_tiff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells of every TIFF below the path, with the grid's affine on each row; a file that is no such grid gives one row with row -1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"]):
                try:
                    band, affine, none = tiff_band(bytes(raw))
                except (ValueError, KeyError, IndexError, struct.error):
                    yield pd.DataFrame({"path": [name], "row": [-1], "col": [-1], "elevation": [None], **{k: [None] for k in "acef"}, "file_nodata": [None]})
                    continue
                step = max(1, 100_000 // band.shape[1])
                for at in range(0, band.shape[0], step):  # bounded pieces, row by row
                    cut = band[at : at + step]
                    r, c = np.indices(cut.shape)
                    yield pd.DataFrame({"path": name, "row": (r + at).ravel(), "col": c.ravel(), "elevation": cut.ravel(), **dict(zip("acef", affine)), "file_nodata": none})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def _ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def shapefile_parts(raw: bytes) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """(shape type, parts) of each record of a .shp file."""
    out, at = [], 100
    while at + 12 <= len(raw):
        size = struct.unpack(">i", raw[at + 4 : at + 8])[0] * 2
        body = raw[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            out.append((kind, [[struct.unpack("<2d", body[4:20])]]))
        elif kind in (3, 5):
            n_parts, n_points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
            points = [*zip(flat[::2], flat[1::2])]
            out.append((kind, [points[a:b] for a, b in zip(starts, starts[1:])]))
        at += 8 + size
    return out


def wkb_parts(raw: bytes) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """(3 lines or 5 polygons, parts) of a WKB geometry."""
    at = 0

    def take(form: str):
        nonlocal at
        size = struct.calcsize(form)
        got = struct.unpack(form, raw[at : at + size])
        at += size
        return got

    def points(o: str) -> list[tuple[float, float]]:
        flat = take(f"{o}{2 * take(o + 'I')[0]}d")
        return [*zip(flat[::2], flat[1::2])]

    def one() -> list[tuple[int, list]]:
        o = "<" if take("B")[0] else ">"
        kind = take(o + "I")[0] % 1000
        if kind == 1:
            return [(1, [[take(o + "2d")]])]
        if kind == 2:
            return [(3, [points(o)])]
        if kind == 3:
            return [(5, [points(o) for _ in range(take(o + "I")[0])])]
        return [x for _ in range(take(o + "I")[0]) for x in one()]

    return one()


def geopackage_parts(raw: bytes, layer: str | None) -> list[tuple[int, list]]:
    with tempfile.TemporaryDirectory() as folder:  # sqlite opens files only; the copy lives as long as this call
        name = os.path.join(folder, "in.gpkg")
        with open(name, "wb") as f:
            f.write(raw)
        db = sqlite3.connect(name)
        tables = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        table, column = next((t for t in tables if layer in (None, t[0])), tables[0])
        out = []
        for (blob,) in db.execute(f'SELECT "{column}" FROM "{table}"'):
            if blob:
                envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
                out += wkb_parts(blob[8 + envelope :])
        db.close()
    return out


def _shape(parts: list[tuple[int, list]]) -> list[list[list[dict]]]:
    """All polygons (clockwise rings start one, others are holes) and lines (a polygon of one open ring each)."""
    as_rows = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    out = []
    for kind, rings in parts:
        if kind == 3:
            out += [[as_rows(r)] for r in rings]
        elif kind == 5:
            for k, r in enumerate(rings):
                if k == 0 or _ring_area(r) < 0 or not out:
                    out.append([as_rows(r)])
                else:
                    out[-1].append(as_rows(r))
    return out


def read_vector(spark: SparkSession, path: str | list[str], layer: str | None = None) -> DataFrame:
    """path, geom: all features of each .shp or .gpkg file as one shape."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw in zip(part["path"], part["content"]):
                found = geopackage_parts(bytes(raw), layer) if name.endswith(".gpkg") else shapefile_parts(bytes(raw))
                yield pd.DataFrame({"path": [name], "geom": [_shape(found)]})

    return spark.read.format("binaryFile").load(path).filter(F.col("path").rlike(r"\.(shp|gpkg)$")).select("path", "content").mapInPandas(run, f"path string, geom {SHAPE}")


#: Fixed format: a comment line with the tag @C and two numbers.
POINT_LINE = r"(?m)^\s*%\s*@C\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)"


def steiner_points(texts: DataFrame, column: str = "text") -> DataFrame:
    """All other columns, at, x_m, y_m: the points of a Steiner program's output."""
    x = F.regexp_extract_all(column, F.lit(POINT_LINE), 1)
    y = F.regexp_extract_all(column, F.lit(POINT_LINE), 2)
    others = [c for c in texts.columns if c != column]
    found = texts.select(*others, F.posexplode(F.arrays_zip(x.alias("x"), y.alias("y"))).alias("at", "p"))
    return found.select(*others, "at", F.col("p.x").cast("double").alias("x_m"), F.col("p.y").cast("double").alias("y_m"))


def steiner_input(terminals: DataFrame) -> DataFrame:
    """project_id, input: the points of each project, one line of six decimals each."""
    line = F.format_string("%.6f %.6f", "x_m", "y_m")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ord"), line.alias("line"))))
    return terminals.groupBy("project_id").agg(F.concat(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"), F.lit("\n")).alias("input"))
