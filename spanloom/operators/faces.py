"""Faces of a net of lines: every piece of line has two sides, what follows on each side is a join, and sides that follow each other
in a ring are told apart by doubling pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds, covers, ring_area
from ..sources.shared import discard, stored
from .chains import ranked
from .overlay import GRAIN, cut_up, meetings, numbered_segments
from .spatial import box_cells, own_cell


def net(lines: DataFrame, size: float, tolerance: float, key: str = "fid", digits: int = 5) -> DataFrame:
    """e, ax..by: the pieces of lines (key, line) between their meetings, each once, at rounded places."""
    s = numbered_segments(lines, key)
    p = cut_up(s, meetings(s, s, [], size, tolerance), tolerance)
    at = lambda e: F.struct(F.round(e + "x", digits).alias("x"), F.round(e + "y", digits).alias("y"))
    p = p.select(at("a").alias("p"), at("b").alias("q")).where("p != q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    return stored(p.select(F.monotonically_increasing_id().alias("e"), *[F.col(f"{n}.{c}").alias(e + c) for n, e in (("p", "a"), ("q", "b")) for c in "xy"]))


def sides(net: DataFrame) -> DataFrame:
    """h, next, ax..by: both sides of every piece (h: twice its number, one more for the way back) and the side that follows with the face
    on the left: at the end of a piece the first one clockwise from the way back."""
    there = net.select((F.col("e") * 2).alias("h"), "ax", "ay", "bx", "by")
    back = net.select((F.col("e") * 2 + 1).alias("h"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    half = there.unionByName(back).withColumn("angle", F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    fan = half.groupBy("ax", "ay").agg(F.array_sort(F.collect_list(F.struct("angle", "h"))).alias("f"))
    twin = lambda h: F.when(h % 2 == 0, h + 1).otherwise(h - 1)
    follows = F.transform("f", lambda s, i: F.struct(twin(s["h"]).alias("h"), F.when(i == 0, F.element_at("f", -1)["h"]).otherwise(F.get("f", i - 1)["h"]).alias("next")))
    return stored(fan.select(F.explode(follows).alias("s")).select("s.*").join(half.drop("angle"), "h"))


def labelled(half: DataFrame, rounds: int = 60) -> DataFrame:
    """h, face: the least side of the ring that a side is in."""
    now = stored(half.select("h", F.col("next").alias("to"), F.least("h", "next").alias("face")))
    for _ in range(rounds):
        ahead = now.select(F.col("h").alias("to"), F.col("to").alias("further"), F.col("face").alias("seen"))
        new = stored(now.join(ahead, "to").select("h", F.col("further").alias("to"), F.least("face", "seen").alias("face"), (F.col("seen") < F.col("face")).alias("changed")))
        discard(now)
        now = new
        if now.where("changed").isEmpty():
            return now.select("h", "face")
    raise RuntimeError("faces did not settle")


def rings_of(half: DataFrame) -> DataFrame:
    """face, ring (closed), area_m2 (positive for faces, negative around what is connected)."""
    named = labelled(half)
    j = half.join(named, "h")
    order = ranked(j.select("h", F.when(F.col("next") != F.col("face"), F.col("next")).alias("next")))
    ring = j.join(order.select("h", "dist"), "h").groupBy("face").agg(F.reverse(F.array_sort(F.collect_list(F.struct("dist", F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("p"))))).alias("s"))
    path = F.transform("s", lambda s: s["p"])
    return ring.select("face", F.concat(path, F.slice(path, 1, 1)).alias("ring")).withColumn("area_m2", ring_area(F.col("ring")))


def polygonised(lines: DataFrame, size: float, tolerance: float = GRAIN, key: str = "fid") -> DataFrame:
    """face, rings, area_m2: the faces that lines (key, line) enclose, with the holes that other parts of the net make in them.

    Pieces with the same face on both sides (loose ends, bridges) bound nothing and are taken out first. What lies inside a
    face without touching it is a hole of the least face around it.
    """
    pieces = net(lines, size, tolerance, key)
    half = sides(pieces)
    both = labelled(half).select(F.floor(F.col("h") / 2).alias("e"), "face").groupBy("e").agg(F.min("face").alias("p"), F.max("face").alias("q"))
    rings = stored(rings_of(sides(stored(pieces.join(both.where("p != q").select("e"), "e", "left_semi")))))
    inner = rings.where("area_m2 > 0").select("face", "ring", "area_m2")
    rim = rings.where("area_m2 < 0").select(F.col("ring").alias("hole"), F.col("area_m2").alias("minus"), F.col("face").alias("n"))
    spot = rim.select("n", "hole", "minus", F.col("hole")[0]["x"].alias("x"), F.col("hole")[0]["y"].alias("y"))
    own = own_cell(spot.select("n", "x", "y", "minus"), F.col("x"), F.col("y"), 8 * size)
    around = box_cells(inner.select("face", "ring", "area_m2"), bounds(F.col("ring")), 8 * size)
    on_ring = F.exists("ring", lambda p: (p["x"] == F.col("x")) & (p["y"] == F.col("y")))
    held = own.join(around, ["cx", "cy"]).where((F.col("area_m2") > -F.col("minus")) & covers(F.array("ring"), F.col("x"), F.col("y")) & ~on_ring)
    holes = held.groupBy("n").agg(F.min(F.struct("area_m2", "face")).alias("s")).select("n", "s.face").join(spot.select("n", "hole", "minus"), "n")
    holes = holes.groupBy("face").agg(F.array_sort(F.collect_list("hole")).alias("holes"), F.sum("minus").alias("minus"))
    out = inner.join(holes, "face", "left")
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return out.select("face", F.concat(F.array("ring"), F.coalesce("holes", none)).alias("rings"), (F.col("area_m2") + F.coalesce("minus", F.lit(0.0))).alias("area_m2"))
