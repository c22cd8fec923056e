"""Planar geometry on nested arrays, as column expressions.

A line is array<struct<x,y>>, a ring a closed line, a polygon an array of rings
(the outer one first), a shape an array of polygons.  Tests on shapes take the
flat list of their edges, array<struct<x1,y1,x2,y2>>, made once per shape.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"
SHAPE = f"array<array<{LINE}>>"
EPS = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """body(value), with value told (and worked out) once."""
    return F.transform(F.array(value), body)[0]


def segments(line: Column) -> Column:
    """Edges of a line."""
    return F.zip_with(
        F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))),
        F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def edges(shape: Column) -> Column:
    """All edges of all rings of a shape."""
    return F.flatten(F.transform(F.flatten(shape), segments))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle as a shape."""
    return F.array(F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_segment(px: Column, py: Column, s: Column) -> Column:
    """Distance of a point from an edge."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((px - s["x1"]) * dx + (py - s["y1"]) * dy) / square).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return distance(px, py, s["x1"] + t * dx, s["y1"] + t * dy)


def line_distance(px: Column, py: Column, segs: Column) -> Column:
    """Distance of a point from a line's edges."""
    return F.array_min(F.transform(segs, lambda s: point_segment(px, py, s)))


def on_edge(px: Column, py: Column, segs: Column, eps: float = EPS) -> Column:
    return F.exists(segs, lambda s: point_segment(px, py, s) <= eps)


def even_odd(px: Column, py: Column, segs: Column) -> Column:
    hits = F.filter(segs, lambda s: ((s["y1"] > py) != (s["y2"] > py)) & (px < (s["x2"] - s["x1"]) * (py - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
    return F.size(hits) % 2 == 1


def inside_open(px: Column, py: Column, segs: Column) -> Column:
    """Strictly inside."""
    return even_odd(px, py, segs) & ~on_edge(px, py, segs)


def inside_closed(px: Column, py: Column, segs: Column) -> Column:
    """Inside or on the boundary."""
    return even_odd(px, py, segs) | on_edge(px, py, segs)


def inside_length(ax: Column, ay: Column, bx: Column, by: Column, segs: Column) -> Column:
    """Length of the straight run a-b within the closed shape.

    The run is cut at every crossing with an edge (and at the ends of edges it
    runs along); pieces whose middle is inside count.
    """
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)

    def cuts(s: Column) -> Column:
        ex, ey = s["x2"] - s["x1"], s["y2"] - s["y1"]
        cross = dx * ey - dy * ex
        wx, wy = s["x1"] - ax, s["y1"] - ay
        square = dx * dx + dy * dy
        t, u = (wx * ey - wy * ex) / cross, (wx * dy - wy * dx) / cross
        along = F.array((wx * dx + wy * dy) / square, ((s["x2"] - ax) * dx + (s["y2"] - ay) * dy) / square)
        none = F.array().cast("array<double>")
        crossed = F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.array(t)).otherwise(none)
        flat = F.when(F.abs(wx * dy - wy * dx) <= 1e-9 * F.greatest(length, F.lit(1.0)), along).otherwise(none)
        return F.when(F.abs(cross) > 1e-12, crossed).otherwise(flat)

    found = F.filter(F.flatten(F.transform(segs, cuts)), lambda t: (t > 0) & (t < 1))
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), found)))
    pieces = let(ts, lambda ts: F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    at = lambda p: F.struct((ax + (p["a"] + p["b"]) / 2 * dx).alias("x"), (ay + (p["a"] + p["b"]) / 2 * dy).alias("y"))
    kept = F.filter(pieces, lambda p: let(at(p), lambda q: inside_closed(q["x"], q["y"], segs)))
    return F.when(length > 0, length * _sum(F.transform(kept, lambda p: p["b"] - p["a"]))).otherwise(F.lit(0.0))


def clipped_length(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Length of the straight run a-b within the closed box: inside_length() of a rectangle, without lists."""
    length = distance(ax, ay, bx, by)

    def part(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d, low, high = b - a, low - EPS, high + EPS
        first = F.when(d == 0, F.lit(0.0)).when(d > 0, (low - a) / d).otherwise((high - a) / d)
        last = F.when(d == 0, F.when(a.between(low, high), 1.0).otherwise(-1.0)).when(d > 0, (high - a) / d).otherwise((low - a) / d)
        return first, last

    (x_first, x_last), (y_first, y_last) = part(ax, bx, x0, x1), part(ay, by, y0, y1)
    share = F.least(F.lit(1.0), x_last, y_last) - F.greatest(F.lit(0.0), x_first, y_first)
    return F.when(length > 0, length * F.greatest(F.lit(0.0), share)).otherwise(F.lit(0.0))


def line_length(line: Column) -> Column:
    return _sum(F.transform(segments(line), lambda s: distance(s["x1"], s["y1"], s["x2"], s["y2"])))


def measured(line: Column) -> Column:
    """Points of a line with their distance from its start: array<struct<x,y,d>>."""
    mark = lambda x, y, d: F.struct(x.alias("x"), y.alias("y"), d.alias("d"))

    def step(acc: Column, p: Column) -> Column:
        return let(F.element_at(acc, -1), lambda m: F.concat(acc, F.array(mark(p["x"], p["y"], m["d"] + distance(m["x"], m["y"], p["x"], p["y"])))))

    return F.aggregate(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), F.array(mark(line[0]["x"], line[0]["y"], F.lit(0.0))), step)


def interpolate(marks: Column, d: Column) -> Column:
    """The point at distance d along a measured line (clamped to its ends); marks should be a name."""

    def between(s: Column) -> Column:
        t = F.when(s["b"]["d"] > s["a"]["d"], (s["at"] - s["a"]["d"]) / (s["b"]["d"] - s["a"]["d"])).otherwise(F.lit(0.0))
        return let(t, lambda t: F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y")))

    def ends(at: Column) -> Column:
        a = F.element_at(F.filter(marks, lambda m: m["d"] <= at), -1)
        b = F.element_at(F.filter(marks, lambda m: m["d"] >= at), 1)
        return let(F.struct(at.alias("at"), a.alias("a"), b.alias("b")), between)

    return let(F.least(F.greatest(d, F.lit(0.0)), F.element_at(marks, -1)["d"]), ends)


def subline(line: Column, start: Column, stop: Column) -> Column:
    """The part of a line between two distances; two equal points if it is empty."""

    def part(marks: Column) -> Column:
        inner = F.transform(F.filter(marks, lambda m: (m["d"] > start + EPS) & (m["d"] < stop - EPS)), lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y")))
        return F.concat(F.array(interpolate(marks, start)), inner, F.array(interpolate(marks, stop)))

    return let(measured(line), part)


def oriented(line: Column, x: Column, y: Column) -> Column:
    """The line, turned round if its end is nearer to (x, y) than its start."""
    first, last = line[0], F.element_at(line, -1)
    return F.when(distance(last["x"], last["y"], x, y) < distance(first["x"], first["y"], x, y), F.reverse(line)).otherwise(line)


def decimated(points: Column, most: int = 36) -> Column:
    """At most `most` points of an open contour, evenly by number."""
    n = F.size(points)
    return F.when(n <= most, points).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(points, (F.floor(i * n / most) % n).cast("int") + 1)))


def contour(shape: Column) -> Column:
    """Outer vertices of all polygons, without the closing one."""
    return F.flatten(F.transform(shape, lambda polygon: F.slice(polygon[0], 1, F.greatest(F.size(polygon[0]) - 1, F.lit(0)))))


def convex_buffer(ring: Column, r: Column, quarter: int = 4) -> Column:
    """Outline of a convex ring (closed) moved out by r, corners rounded by `quarter` steps a right angle.

    Non-convex rings get the outline of their vertices' discs seen from outside
    only at convex corners; containment tests on them use distances instead.
    """
    area = _sum(F.transform(segments(ring), lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]))
    open_ = F.slice(ring, 1, F.size(ring) - 1)
    pi = 3.141592653589793

    def outline(ccw: Column) -> Column:
        n = F.size(ccw)

        def fan(c: Column) -> Column:
            p, a, b = c["p"], c["a"], c["b"]
            # the outward normal of an edge (dx, dy) of a counter-clockwise ring is (dy, -dx)
            start = F.atan2(a["x"] - p["x"], p["y"] - a["y"])
            turn = F.pmod(F.atan2(p["x"] - b["x"], b["y"] - p["y"]) - start, F.lit(2 * pi))
            arc = F.struct(p.alias("p"), start.alias("start"), turn.alias("turn"), F.greatest(F.ceil(turn / (pi / (2 * quarter)) - 1e-9).cast("int"), F.lit(1)).alias("n"))
            return let(arc, lambda v: F.transform(F.sequence(F.lit(0), v["n"]), lambda k: F.struct((v["p"]["x"] + r * F.cos(v["start"] + v["turn"] * k / v["n"])).alias("x"), (v["p"]["y"] + r * F.sin(v["start"] + v["turn"] * k / v["n"])).alias("y"))))

        at = lambda k: F.element_at(ccw, (F.pmod(k, n) + 1).cast("int"))
        corners = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i).alias("p"), at(i - 1 + n).alias("a"), at(i + 1).alias("b")))
        return let(F.flatten(F.transform(corners, fan)), lambda out: F.concat(out, F.array(out[0])))

    ccw = F.when(area < 0, F.reverse(open_)).otherwise(open_)
    return F.when(r > 0, let(ccw, outline)).otherwise(ring)
