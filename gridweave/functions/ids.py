"""Node identifiers and other scalar rules of the planning domain, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Multipliers of penalty categories, and of a penalty zone without one.
CATEGORY = {"dry_land": 1.0, "swamp": 2.0, "floodplain": 3.0}
NO_CATEGORY = 5.0


def _join(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def terminal_node(terminal: Column) -> Column:
    return _join(F.lit("terminal"), terminal)


def hub_node(terminal: Column) -> Column:
    return _join(F.lit("steiner:hub"), terminal)


def attach_node(terminal: Column) -> Column:
    return _join(F.lit("steiner:attach"), terminal)


def exit_node(terminal: Column) -> Column:
    return _join(F.lit("steiner:fixed_exit"), terminal)


def waypoint_node(a: Column, b: Column, i: Column) -> Column:
    return F.concat(F.lit("steiner:waypoint:"), F.least(a, b), F.lit("-"), F.greatest(a, b), F.lit("-"), i.cast("string"))


def grid_node(row: Column, col: Column) -> Column:
    return F.concat(F.lit("grid:"), row.cast("string"), F.lit("_"), col.cast("string"))


def node_kind(node: Column) -> Column:
    """Kind of a node of the finished tree, by its identifier."""
    out = F.lit("steiner")
    for start, kind in (("steiner:candidate:", "steiner_candidate"), ("steiner:fixed_exit:", "fixed_exit"), ("steiner:waypoint:", "waypoint"), ("steiner:attach:", "attach"), ("steiner:hub:", "hub"), ("terminal:", "terminal")):
        out = F.when(node.startswith(start), kind).otherwise(out)
    return out


def penalty_multiplier(explicit: Column, category: Column) -> Column:
    """The explicit multiplier, else the category's, else the default."""
    table = F.create_map(*(F.lit(x) for pair in CATEGORY.items() for x in pair))
    return F.coalesce(explicit, F.element_at(table, category), F.lit(NO_CATEGORY))


def utm_zone(lon: Column) -> Column:
    """1..60; the antimeridian belongs to zone 60."""
    return F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def exit_point(x: Column, y: Column, bearing_deg: Column, length_m: Column) -> tuple[Column, Column]:
    """End of a straight run: bearing 0 is north, clockwise."""
    theta = F.radians(F.pmod(bearing_deg, F.lit(360.0)))
    return x + length_m * F.sin(theta), y + length_m * F.cos(theta)


def slope_multiplier(slope: Column, factor: Column, max_slope: Column) -> Column:
    share = F.least(F.greatest(slope / F.greatest(max_slope, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    return F.when(factor <= 0, F.lit(1.0)).otherwise(1.0 + factor * share)


def world_to_cell(x: Column, y: Column, a: Column, c: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """(row, col) of a point on a north-up grid; the caller checks the bounds."""
    return F.floor((y - f) / e).cast("int"), F.floor((x - c) / a).cast("int")


def cell_to_world(row: Column, col: Column, a: Column, c: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """Centre of a cell."""
    return c + (col + 0.5) * a, f + (row + 0.5) * e
