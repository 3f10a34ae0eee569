"""Faces of nets, repaired and simplified polygons, trimmed trenches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import geometry
from spanloom.operators import faces, overlay, trenches

P = "struct<x:double,y:double>"


def turn(points, angle=0.37, x=50.0, y=-20.0):
    c, s = math.cos(angle), math.sin(angle)
    return [{"x": px * c - py * s + x, "y": px * s + py * c + y} for px, py in points]


def test_faces_of_a_known_net(spark):
    lines = [[(0, 0), (30, 0), (30, 20), (0, 20), (0, 0)], [(10, 0), (10, 20)], [(10, 8), (35, 8)], [(15, 12), (18, 12), (18, 15), (15, 15), (15, 12)], [(3, 3), (6, 6)], [(16, 13), (16, 14)], [(40, 0), (45, 0)], [(30, 10), (50, 10)], [(50, 10), (55, 10), (52, 14), (50, 10)], None]
    df = spark.createDataFrame([(i, None if p is None else turn(p)) for i, p in enumerate(lines)], f"fid long, line array<{P}>")
    got = sorted((round(r.area_m2, 3), len(r.rings)) for r in faces.polygonised(df, 15.0, 1e-4).collect())
    assert got == [(9, 1), (10, 1), (160, 1), (200, 1), (231, 2)]
    assert faces.polygonised(df.limit(0), 15.0).count() == 0


def test_faces_of_random_lines_fill_what_they_enclose(spark):
    rng = random.Random(3)
    lines = [(i, [{"x": rng.uniform(0, 100), "y": rng.uniform(0, 100)} for _ in range(2)]) for i in range(22)]
    got = faces.polygonised(spark.createDataFrame(lines, f"fid long, line array<{P}>"), 30.0).collect()
    nodes = {}
    for i, (_, (a, b)) in enumerate(lines):
        for j, (_, (c, d)) in enumerate(lines[:i]):
            den = (b["x"] - a["x"]) * (d["y"] - c["y"]) - (b["y"] - a["y"]) * (d["x"] - c["x"])
            t = ((c["x"] - a["x"]) * (d["y"] - c["y"]) - (c["y"] - a["y"]) * (d["x"] - c["x"])) / den
            u = ((c["x"] - a["x"]) * (b["y"] - a["y"]) - (c["y"] - a["y"]) * (b["x"] - a["x"])) / den
            if 0 <= t <= 1 and 0 <= u <= 1:
                nodes.setdefault(i, []).append(j)
                nodes.setdefault(j, []).append(i)
    cross = sum(map(len, nodes.values())) // 2
    group = list(range(22))
    for i, near in nodes.items():
        for j in near:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    # Euler: every line with n crossings has n + 1 pieces; places are the crossings and all ends
    pieces = sum(len(nodes.get(i, [])) + 1 for i in range(22))
    assert len(got) == pieces - (cross + 44) + len(set(group))
    x, y = np.random.default_rng(1).uniform(0, 100, (2, 20_000))
    held = sum(sum_inside(r.rings, x, y).astype(int) for r in got)
    assert held.max() == 1 and sum(r.area_m2 for r in got) == pytest.approx(held.mean() * 1e4, rel=0.03)


def sum_inside(rings, xs, ys):
    odd = np.zeros(xs.shape, bool)
    for r in rings:
        for a, b in zip(r[:-1], r[1:], strict=True):
            if a["y"] != b["y"]:
                odd ^= ((a["y"] > ys) != (b["y"] > ys)) & (xs < a["x"] + (ys - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"]))
    return odd


def test_repair_and_surface_points(spark):
    shapes = [(1, [turn([(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)])]), (2, [turn([(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)]), turn([(5, 5), (25, 5), (25, 15), (5, 15), (5, 5)])]), (3, [turn([(0, 0), (5, 0), (0, 0)])]),
              (4, [turn([(0, 0), (30, 0), (30, 30), (28, 30), (28, 2), (0, 2), (0, 0)], 0.0)])]
    df = spark.createDataFrame(shapes, f"fid long, rings array<array<{P}>>")
    got = {r.fid: r for r in overlay.repaired(df, 12.0).collect()}
    assert {k: ([len(p) for p in r.parts], round(r.area_m2, 3)) for k, r in got.items()} == {1: ([1, 1], 50), 2: ([1, 1], 300), 4: ([1], 116)}
    at = {r.fid: r.p for r in df.select("fid", geometry.surface_point(F.col("rings")).alias("p")).collect()}
    assert all(sum_inside(rings, np.array([at[f].x]), np.array([at[f].y]))[0] for f, rings in shapes if f in (2, 4))


def test_simplified_rings_keep_their_members(spark):
    rng = random.Random(2)
    ring = [((40 + rng.uniform(-3, 3)) * math.cos(t / 60 * 2 * math.pi), (40 + rng.uniform(-3, 3)) * math.sin(t / 60 * 2 * math.pi)) for t in range(60)]
    ring = [{"x": x, "y": y} for x, y in [*ring, ring[0]]]
    rim = [(7, p["x"] * 0.995, p["y"] * 0.995) for p in ring[::6]]
    df, none = spark.createDataFrame([(7, [ring])], f"area long, rings array<array<{P}>>"), spark.createDataFrame([], "area long, x double, y double")
    free = overlay.simplified(df, none, 4.0).first().rings[0]
    assert len(free) < 25
    old = np.array([[p["x"], p["y"]] for p in ring])
    new = np.array([[p["x"], p["y"]] for p in free])
    d = new[1:] - new[:-1]
    t = np.clip(((old[:, None] - new[None, :-1]) * d).sum(axis=2) / (d * d).sum(axis=1), 0, 1)
    assert np.hypot(*np.moveaxis(old[:, None] - new[None, :-1] - t[..., None] * d, 2, 0)).min(axis=1).max() <= 4
    kept = overlay.simplified(df, spark.createDataFrame(rim, "area long, x double, y double"), 4.0).first().rings[0]
    x, y = np.array([r[1:] for r in rim]).T
    assert len(free) < len(kept) <= len(ring) and (sum_inside([kept], x, y) == sum_inside([ring], x, y)).all()


def test_trenches_stop_at_buildings(spark):
    house = spark.createDataFrame([(1, [turn([(10, -5), (20, -5), (20, 5), (10, 5), (10, -5)])])], f"poly long, rings array<array<{P}>>")
    lines = spark.createDataFrame([(1, turn([(0, 0), (30, 0)])), (2, turn([(0, 5.2), (30, 5.2)])), (3, turn([(0, 9), (30, 9)]))], f"fid long, line array<{P}>")
    got = {}
    for r in trenches.clear_trenches(lines, house).collect():
        got.setdefault(r.fid, []).append(round(r.length, 2))
    assert {k: sorted(v) for k, v in got.items()} == {1: [9.7, 9.7], 2: pytest.approx([9.78, 9.78], abs=0.02), 3: [30]}
