"""Geometry on columns: points are x and y doubles, lines arrays of (x, y) structs, polygons arrays of rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"


def point(x, y) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def line(*points: Column) -> Column:
    return F.array(*points)


def steps(c: Column) -> Column:
    """Consecutive vertex pairs (a, b) of a line; none for fewer than two vertices."""
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def step_length(s: Column) -> Column:
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def length(c: Column) -> Column:
    return F.aggregate(steps(c), F.lit(0.0), lambda acc, s: acc + step_length(s))


def bounds(c: Column) -> Column:
    xs, ys = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct t, x, y: the point of segment a-b closest to p, t its place from 0 to 1."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / squared))).otherwise(F.lit(0.0))
    return F.struct(t.alias("t"), (ax + t * dx).alias("x"), (ay + t * dy).alias("y"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    f = foot(px, py, ax, ay, bx, by)
    return F.hypot(px - f["x"], py - f["y"])


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Closed segments a-b and c-d share a point."""
    s1, s2 = F.signum(turn(ax, ay, bx, by, cx, cy)), F.signum(turn(ax, ay, bx, by, dx, dy))
    s3, s4 = F.signum(turn(cx, cy, dx, dy, ax, ay)), F.signum(turn(cx, cy, dx, dy, bx, by))
    between = lambda px, py, qx, qy, rx, ry: (rx >= F.least(px, qx)) & (rx <= F.greatest(px, qx)) & (ry >= F.least(py, qy)) & (ry <= F.greatest(py, qy))
    return (
        ((s1 * s2 < 0) & (s3 * s4 < 0)) | ((s1 == 0) & between(ax, ay, bx, by, cx, cy)) | ((s2 == 0) & between(ax, ay, bx, by, dx, dy))
        | ((s3 == 0) & between(cx, cy, dx, dy, ax, ay)) | ((s4 == 0) & between(cx, cy, dx, dy, bx, by))
    )


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """The single point shared by segments a-b and c-d, null if there is none or they are parallel."""
    den = F.nullif((bx - ax) * (dy - cy) - (by - ay) * (dx - cx), F.lit(0.0))
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
    inside = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return F.when(inside, F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring."""
    return F.aggregate(steps(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def ring_centroid(ring: Column) -> Column:
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    six = ring_area(ring) * 6
    part = lambda k: F.aggregate(steps(ring), F.lit(0.0), lambda acc, s: acc + (s["a"][k] + s["b"][k]) * cross(s)) / six
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def covers(rings: Column, x: Column, y: Column) -> Column:
    """The polygon holds the point, its boundary included: an odd number of ring steps to the right."""
    edges = F.flatten(F.transform(rings, steps))
    on = F.exists(edges, lambda s: (turn(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], x, y) == 0) & (x >= F.least(s["a"]["x"], s["b"]["x"])) & (x <= F.greatest(s["a"]["x"], s["b"]["x"])) & (y >= F.least(s["a"]["y"], s["b"]["y"])) & (y <= F.greatest(s["a"]["y"], s["b"]["y"])))
    right = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < s["a"]["x"] + (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]))
    return on | (F.pmod(F.size(F.filter(edges, lambda s: F.coalesce(right(s), F.lit(False)))), F.lit(2)) == 1)


def densified(c: Column, distance: float) -> Column:
    """Vertices at most `distance` apart: each step is cut into equal parts."""
    def cut(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(step_length(s) / distance).cast("int"))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * i / n).alias("x"), (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * i / n).alias("y")))

    return F.when(F.size(c) < 2, c).otherwise(F.concat(F.slice(c, 1, 1), F.flatten(F.transform(steps(c), cut))))


def running_length(c: Column) -> Column:
    """Distance from the start at every vertex."""
    start = F.array(F.lit(0.0))
    return F.aggregate(steps(c), start, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + step_length(s))))


def at_distance(c: Column, d: Column) -> Column:
    """The point at a distance from the start, held to the ends; null for an empty line."""
    zero = F.struct(F.lit(0.0).alias("left"), F.lit(None).cast(POINT).alias("at"))

    def walk(acc: Column, s: Column) -> Column:
        n, left = step_length(s), F.greatest(F.lit(0.0), d) - acc["left"]
        here = F.when(acc["at"].isNull() & (left <= n), F.struct((s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * F.when(n > 0, left / n).otherwise(0.0)).alias("x"), (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * F.when(n > 0, left / n).otherwise(0.0)).alias("y")))
        return F.struct((acc["left"] + n).alias("left"), F.coalesce(acc["at"], here).alias("at"))

    return F.aggregate(steps(c), zero, walk, lambda acc: F.coalesce(acc["at"], F.try_element_at(c, F.lit(-1))))


def points_along(c: Column, spacing: float) -> Column:
    """Points every `spacing` from the start of a line."""
    n = F.floor(length(c) / spacing).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: at_distance(c, i * F.lit(float(spacing))))


def offset_step(s: Column, distance: float) -> Column:
    """A step moved sideways; positive is left."""
    n = step_length(s)
    nx, ny = -(s["b"]["y"] - s["a"]["y"]) / n * distance, (s["b"]["x"] - s["a"]["x"]) / n * distance
    return F.struct(F.struct((s["a"]["x"] + nx).alias("x"), (s["a"]["y"] + ny).alias("y")).alias("a"), F.struct((s["b"]["x"] + nx).alias("x"), (s["b"]["y"] + ny).alias("y")).alias("b"))


def perpendicular(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column, radius: float = 20.0, width: float = 60.0) -> Column:
    """A line of `width` across the direction a-b, centred `radius` from (x, y) in that direction."""
    n = F.hypot(bx - ax, by - ay)
    ux, uy = (bx - ax) / n, (by - ay) / n
    cx, cy = x + ux * radius, y + uy * radius
    return line(point(cx - uy * (width / 2), cy + ux * (width / 2)), point(cx + uy * (width / 2), cy - ux * (width / 2)))


def edge_distance(rings: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest edge of the rings; null without edges."""
    edges = F.flatten(F.transform(rings, steps))
    return F.array_min(F.transform(edges, lambda s: segment_distance(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def polygon_distance(rings: Column, x: Column, y: Column) -> Column:
    """0 inside a polygon and on its edge, else the distance to the nearest edge."""
    return F.when(covers(rings, x, y), F.lit(0.0)).otherwise(edge_distance(rings, x, y))


def centroid(ring: Column) -> Column:
    """Centre of area of a closed ring; the mean of its vertices if it has no area."""
    start = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    ox, oy = ring[0]["x"], ring[0]["y"]  # from the first vertex, so that far coordinates cost no digits

    def add(acc: Column, s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"] - ox, s["a"]["y"] - oy, s["b"]["x"] - ox, s["b"]["y"] - oy
        cross = ax * by - bx * ay
        return F.struct((acc["area"] + cross).alias("area"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y"))

    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[c]) / F.size(ring)
    return F.aggregate(steps(ring), start, add, lambda a: F.when(a["area"] != 0, F.struct((ox + a["x"] / (3 * a["area"])).alias("x"), (oy + a["y"] / (3 * a["area"])).alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y"))))


def line_crossings(a: Column, b: Column) -> Column:
    """The single points that steps of two lines share; stretches along each other give none."""
    at = lambda s, t: crossing(*[p[k] for p in (s["a"], s["b"], t["a"], t["b"]) for k in "xy"])
    return F.array_compact(F.flatten(F.transform(steps(a), lambda s: F.transform(steps(b), lambda t: at(s, t)))))


def approach(a: Column, b: Column) -> Column:
    """Struct d, x, y: the distance of two lines and the place on the second where they are closest; null if either has no step.

    Two steps that do not cross are closest at one of their four ends, so these and the crossing are all there is to look at.
    """
    def gap(p: Column, s: Column) -> Column:
        return segment_distance(p["x"], p["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])

    def place(d: Column, p: Column) -> Column:
        return F.struct(d.alias("d"), p["x"].alias("x"), p["y"].alias("y"))

    def pair(s: Column, t: Column) -> Column:
        onto = [place(gap(p, t), foot(p["x"], p["y"], t["a"]["x"], t["a"]["y"], t["b"]["x"], t["b"]["y"])) for p in (s["a"], s["b"])]
        ends = F.array_min(F.array(*onto, *[place(gap(p, s), p) for p in (t["a"], t["b"])]))
        at = crossing(*[p[k] for p in (s["a"], s["b"], t["a"], t["b"]) for k in "xy"])
        return F.when(at.isNotNull(), place(F.lit(0.0), at)).otherwise(ends)

    return F.array_min(F.flatten(F.transform(steps(a), lambda s: F.transform(steps(b), lambda t: pair(s, t)))))


def surface_point(rings: Column) -> Column:
    """A place inside a polygon: the middle of its widest stretch half-way up its first ring; null without one."""
    box, edges = bounds(rings[0]), F.flatten(F.transform(rings, steps))
    y = (box["ymin"] + box["ymax"]) / 2
    over = F.filter(edges, lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
    xs = F.array_sort(F.transform(over, lambda s: s["a"]["x"] + (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"])))
    wide = F.transform(F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2)), lambda i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("w"), ((F.get(xs, i + 1) + F.get(xs, i)) / 2).alias("x")))
    return F.when(F.size(xs) > 1, F.struct(F.array_max(wide)["x"].alias("x"), y.alias("y")))
