"""Where points and lines of the trench stage meet the sidewalks: projections, pseudo points, bridges, breaks, merged feeders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import approach, at_distance, densified, foot, length, line, line_crossings, point, running_length, step_length, steps
from .network import gardens
from .relational import global_rank
from .spatial import box_pairs, ever_nearest, near_cells, own_cell, segments


def node_text(x: Column, y: Column, eps: float) -> Column:
    """Name of the graph node at a place."""
    return F.concat_ws(":", F.rint(x / eps).cast("long"), F.rint(y / eps).cast("long"))


def supply_point(points: DataFrame, selected: DataFrame | None = None, name: str = "MFG_ID") -> DataFrame:
    """The one supply point (fid, ...): the first of the selected ones, of all if none is selected; without an id MFG00001.

    Raises if there is no point at all: nothing can be routed then.
    """
    chosen = points if selected is None else points.join(selected.select("fid").distinct(), "fid", "left_semi")
    first = (points if selected is not None and chosen.isEmpty() else chosen).orderBy("fid").limit(1)
    if first.isEmpty():
        raise ValueError("there is no supply point")
    given = F.col(name).cast("string") if name in points.columns else F.lit(None).cast("string")
    return first.withColumn(name, F.coalesce(given, F.lit("MFG00001")))


def projections(points: DataFrame, left: DataFrame, right: DataFrame, reach: float = 100.0) -> DataFrame:
    """fid, sidewalk, method, dist_m, x, y, line: the pseudo point of each point (fid, x, y) on the nearer sidewalk and the way there.

    Left wins ties; a point without a sidewalk within reach is left out.
    """
    hit = gardens(points.select("fid", "x", "y"), left, right, reach).where("d IS NOT NULL")
    j = hit.join(points.select("fid", F.col("x").alias("px"), F.col("y").alias("py")), "fid")
    side = F.when(F.col("side") == "L", "left").otherwise("right")
    return j.select("fid", side.alias("sidewalk"), F.lit("nearest").alias("method"), F.round("d", 3).alias("dist_m"), F.col("fx").alias("x"), F.col("fy").alias("y"), line(point(F.col("px"), F.col("py")), point(F.col("fx"), F.col("fy"))).alias("line"))


def pseudo_homes(lines: DataFrame, left: DataFrame, right: DataFrame, size: float = 50.0) -> DataFrame:
    """fid, sidewalk, method, dist_m, x, y: where a garden line (fid, line) meets a sidewalk (fid, line).

    First a sidewalk that it crosses, left before right, at the crossing nearest to its end; else of the sidewalks in its
    bounding box the nearest one; else the left sidewalk nearest to its end, a right one only if there is no left one. Ties go to
    left, then to the least id.
    """
    sides = left.select("fid", "line", F.lit(0).alias("rank")).unionByName(right.select("fid", "line", F.lit(1).alias("rank")))
    other = sides.select("rank", F.col("fid").alias("other"), F.col("line").alias("other_line"))
    whole = lines.select("fid", "line").where(F.size("line") > 1)
    end = F.element_at("line", -1)
    spots = F.transform(line_crossings(F.col("line"), F.col("other_line")), lambda p: F.struct(F.hypot(p["x"] - end["x"], p["y"] - end["y"]).alias("far"), p["x"].alias("x"), p["y"].alias("y")))
    met = box_pairs(whole, other, size).select("fid", "rank", "other", F.array_min(spots).alias("cross"), approach(F.col("line"), F.col("other_line")).alias("near"))
    crossed = F.col("cross").isNotNull()
    d = F.when(crossed, F.lit(0.0)).otherwise(F.col("near.d"))
    pick = F.struct(
        F.when(crossed, "intersection").otherwise("nearest").alias("method"), "rank", d.alias("d"),
        *[F.when(crossed, F.col(f"cross.{c}")).otherwise(F.col(f"near.{c}")).alias(c) for c in "xy"],
    )
    best = met.groupBy("fid").agg(F.min_by(pick, F.struct(F.when(crossed, 0).otherwise(1), F.round(d, 9), "rank", "other")).alias("b")).select("fid", "b.*")

    far = whole.join(best.select("fid"), "fid", "left_anti")
    side, rank = (right, 1) if left.isEmpty() else (left, 0)
    ends = far.select("fid", end["x"].alias("x"), end["y"].alias("y"))
    beside = ever_nearest(ends, segments(side.select(F.col("fid").alias("other"), "line"), "other"), 4 * size, ["other"])
    j = beside.select("fid", "other").join(far, "fid").join(side.select(F.col("fid").alias("other"), F.col("line").alias("other_line")), "other")
    last = j.withColumn("near", approach(F.col("line"), F.col("other_line"))).select("fid", F.lit("nearest").alias("method"), F.lit(rank).alias("rank"), "near.d", "near.x", "near.y")
    return best.unionByName(last).select("fid", F.when(F.col("rank") == 0, "left").otherwise("right").alias("sidewalk"), "method", F.round("d", 3).alias("dist_m"), "x", "y")


def bridges(left: DataFrame, right: DataFrame, eps: float = 0.05, size: float = 200.0) -> DataFrame:
    """node, x, y: graph nodes where a left and a right sidewalk (fid, line) cross, once each; healing ties them to both sides."""
    other = right.select(F.col("fid").alias("other"), F.col("line").alias("other_line"))
    p = box_pairs(left.select("fid", "line"), other, size).select(F.explode(line_crossings(F.col("line"), F.col("other_line"))).alias("p"))
    return p.groupBy(node_text(F.col("p.x"), F.col("p.y"), eps).alias("node")).agg(F.min(F.struct("p.x", "p.y")).alias("p")).select("node", "p.x", "p.y")


def spokes(left: DataFrame, right: DataFrame, step: float = 2.0, eps: float = 0.05, size: float = 200.0) -> DataFrame:
    """node, side (L, R), other, w: edges that tie every node of bridges() to the nearest node of the left and of the right sidewalks
    (fid, line) cut every step; ties go to the least name. A node that is one already needs no edge."""
    at = bridges(left, right, eps, size)
    each = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(densified(F.col("line"), step)).alias("p"))
    ends = each(left, "L").unionByName(each(right, "R")).select("side", F.col("p.x").alias("ox"), F.col("p.y").alias("oy")).distinct()
    d = F.round(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")), 9)
    near = near_cells(at, F.col("x"), F.col("y"), step).join(own_cell(ends, F.col("ox"), F.col("oy"), step), ["cx", "cy"]).withColumn("w", d).where(F.col("w") <= step)
    best = near.groupBy("node", "side").agg(F.min(F.struct("w", node_text(F.col("ox"), F.col("oy"), eps).alias("other"))).alias("s"))
    return best.select("node", "side", "s.other", "s.w").where("other != node")


def virtual_nodes(points: DataFrame, lines: DataFrame, tolerance: float = 1.5, step: float = 0.5, end: float = 0.25, size: float = 100.0) -> DataFrame:
    """fid, road, node, along, broken: the node of each point (fid, x, y) on the nearest line (fid, line).

    Lines count whose bounding box comes within six tolerances. Within `end` of either end of the line the node is that end, else
    the line is to be broken `along` metres from its start. A point without such a line is left out; ties go to the least id.
    """
    spot = points.select("fid", "x", "y", line(point(F.col("x"), F.col("y"))).alias("line"))
    roads = lines.where(F.size("line") > 1).select(F.col("fid").alias("road"), F.col("line").alias("other_line"))
    walked = F.zip_with(steps(F.col("other_line")), F.slice(running_length(F.col("other_line")), 1, F.size("other_line") - 1), lambda s, before: F.struct(s.alias("s"), before.alias("before")))

    def reached(w: Column) -> Column:
        s = w["s"]
        f = foot(F.col("x"), F.col("y"), s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
        return F.struct(F.hypot(F.col("x") - f["x"], F.col("y") - f["y"]).alias("d"), (w["before"] + f["t"] * step_length(s)).alias("along"), f["x"].alias("x"), f["y"].alias("y"))

    near = box_pairs(spot, roads, size, 6 * tolerance).withColumn("near", F.array_min(F.transform(walked, reached)))
    best = near.groupBy("fid").agg(F.min_by(F.struct("road", "near", "other_line"), F.struct(F.round("near.d", 9), "road")).alias("b")).select("fid", "b.*")
    n = length(F.col("other_line"))
    start, stop = F.col("near.along") <= end, n - F.col("near.along") <= end
    at = F.when(start, at_distance(F.col("other_line"), F.lit(0.0))).when(stop, F.element_at("other_line", -1)).otherwise(F.struct("near.x", "near.y"))
    return best.withColumn("at", at).select("fid", "road", node_text(F.col("at.x"), F.col("at.y"), step).alias("node"), F.col("near.along").alias("along"), (~(start | stop)).alias("broken"))


def merged_feeders(feeders: DataFrame, connectors: DataFrame, points: DataFrame) -> DataFrame:
    """id, fid, dist_m, POLYGON_ID, PDP_ID, connector, parts: each feeder (fid, PDP_ID, line, dist_m) with the connector
    (connector, PDP_ID, line) of its point that is nearest to it.

    Feeders without a point are left out, those without a connector stay alone. POLYGON_ID and PDP_ID come from the points
    (point, POLYGON_ID, PDP_ID); an unknown point keeps its own id. Ties go to the least connector; ids count from 1 by fid.
    """
    f = feeders.where(F.coalesce(F.col("PDP_ID").cast("string"), F.lit("")) != "").select("fid", F.col("PDP_ID").cast("string").alias("_pid"), "line", F.coalesce("dist_m", length(F.col("line"))).alias("dist_m"))
    c = connectors.select("connector", F.col("PDP_ID").cast("string").alias("_pid"), F.col("line").alias("other_line"))
    d = F.round(approach(F.col("line"), F.col("other_line"))["d"], 9)
    best = f.select("fid", "_pid", "line").join(c, "_pid").withColumn("d", d).where("d IS NOT NULL").groupBy("fid").agg(F.min_by(F.struct("connector", "other_line"), F.struct("d", "connector")).alias("b"))
    known = points.groupBy(F.col("point").cast("string").alias("_pid")).agg(F.min(F.struct("POLYGON_ID", "PDP_ID")).alias("k"))
    j = global_rank(f.join(best, "fid", "left").join(known, "_pid", "left"), "fid", "id")
    parts = F.array_compact(F.array(F.col("line"), F.col("b.other_line")))
    return j.select("id", "fid", F.round("dist_m", 2).alias("dist_m"), F.col("k.POLYGON_ID").alias("POLYGON_ID"), F.coalesce("k.PDP_ID", "_pid").alias("PDP_ID"), F.col("b.connector").alias("connector"), parts.alias("parts"))


def clear_of(lines: DataFrame, buildings: DataFrame, margin: float = 0.3, size: float = 50.0) -> DataFrame:
    """Lines (fid, line) that keep more than `margin` from every building (poly, rings); a line inside a building does not.

    Lines that start inside a building are found in cells first, without pairs; only the others are measured against the buildings near them.
    """
    from ..functions.geometry import covers
    from .celled import inside_of
    from .graph import checkpoints
    from .overlay import polygon_edges

    cut = checkpoints(lines)
    own = cut(lines.select("fid", "line").withColumn("pid", F.monotonically_increasing_id()))
    shapes = cut(buildings.where("rings IS NOT NULL").select("rings").withColumn("poly", F.monotonically_increasing_id()))
    start = F.get(F.col("line"), 0)
    starts = own.select("pid", F.lit(0).alias("side"), start["x"].alias("x"), start["y"].alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    held = cut(inside_of(starts, polygon_edges(shapes, ["poly", F.lit("b").alias("role")]), [], size, "b").select("pid"))
    rings = shapes.select(F.col("poly").alias("other"), "rings", F.flatten("rings").alias("other_line"))
    gap = F.array_min(F.transform(F.col("rings"), lambda r: approach(F.col("line"), r)["d"]))
    hit = box_pairs(own.join(held, "pid", "left_anti").select("fid", "line"), rings, size, margin).where((gap <= margin) | covers(F.col("rings"), start["x"], start["y"])).select("fid")
    return lines.join(hit.unionByName(own.join(held, "pid").select("fid")).distinct(), "fid", "left_anti")
