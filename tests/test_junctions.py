"""Trench junctions, reports and gates on small cases with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import geometry
from spanloom.operators import checks, junctions, trenches

LINE = "fid long, line array<struct<x:double,y:double>>"


def lines(spark, rows, schema=LINE):
    return spark.createDataFrame(rows, schema)


def gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_approach_equals_dense_sampling(spark):
    rng = random.Random(3)
    rows = [(i, *[[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(2, 4))] for _ in range(2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    for r in df.select("i", "a", "b", geometry.approach(F.col("a"), F.col("b")).alias("n")).collect():
        a, b = [tuple(p) for p in r.a], [tuple(p) for p in r.b]
        on_a = [(p[0] + (q[0] - p[0]) * k / 200, p[1] + (q[1] - p[1]) * k / 200) for p, q in zip(a, a[1:]) for k in range(201)]
        dense = min(gap(p, s, t) for p in on_a for s, t in zip(b, b[1:]))
        assert r.n.d <= dense + 1e-9 and dense - r.n.d < 0.05
        assert min(gap((r.n.x, r.n.y), s, t) for s, t in zip(b, b[1:])) < 1e-9
        assert abs(min(gap((r.n.x, r.n.y), s, t) for s, t in zip(a, a[1:])) - r.n.d) < 1e-9


def test_pseudo_homes_tiers(spark):
    left = lines(spark, [(1, [(0.0, 0.0), (0.0, 100.0)])])
    right = lines(spark, [(2, [(6.0, 0.0), (6.0, 100.0)]), (3, [(900.0, 0.0), (900.0, 9.0)])])
    g = lines(spark, [(1, [(-3.0, 5.0), (9.0, 5.0)]), (2, [(3.0, 5.0), (9.0, 5.0)]), (3, [(5.0, 98.0), (7.0, 104.0)]), (4, [(950.0, 4.0), (940.0, 4.0)]), (5, [(1.0, 1.0)]), (6, None)])
    got = {r.fid: (r.sidewalk, r.method, r.dist_m, round(r.x, 3), round(r.y, 3)) for r in junctions.pseudo_homes(g, left, right).collect()}
    assert got[1] == ("left", "intersection", 0.0, 0.0, 5.0)
    assert got[2] == ("right", "intersection", 0.0, 6.0, 5.0)
    assert got[3][:2] == ("right", "nearest") and got[3][3:] == (6.0, 100.0)
    assert got[4] == ("left", "nearest", 940.0, 0.0, 4.0)
    assert set(got) == {1, 2, 3, 4}
    none = left.limit(0)
    assert {r.sidewalk for r in junctions.pseudo_homes(g, none, right).collect()} == {"right"}
    assert junctions.pseudo_homes(g.where("fid > 1"), none, none).count() == 0


def test_projections_skip_what_is_far(spark):
    side = "fid long, seq int, ax double, ay double, bx double, by double"
    left, right = spark.createDataFrame([(1, 0, 0.0, 3.0, 50.0, 3.0)], side), spark.createDataFrame([(1, 0, 0.0, -3.0, 50.0, -3.0)], side)
    p = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, -1.0), (3, 10.0, 500.0)], "fid long, x double, y double")
    got = {r.fid: (r.sidewalk, r.dist_m, [tuple(v) for v in r.line]) for r in junctions.projections(p, left, right).collect()}
    assert got == {1: ("left", 3.0, [(10.0, 0.0), (10.0, 3.0)]), 2: ("right", 2.0, [(10.0, -1.0), (10.0, -3.0)])}


def test_bridges_and_virtual_nodes(spark):
    a, b = lines(spark, [(1, [(0.0, 0.0), (10.0, 10.0)]), (2, [(0.0, 1.0), (5.0, 1.0)])]), lines(spark, [(1, [(0.0, 10.0), (10.0, 0.0)]), (2, [(0.5, 1.0), (9.0, 1.0)])])
    assert {r.node for r in junctions.bridges(a, b).collect()} == {"100:100", "20:20"}
    p = spark.createDataFrame([(1, 0.1, 1.0), (2, 4.0, 2.0), (3, 9.9, 5.0), (4, 500.0, 0.0), (5, 7.0, 1.2)], "fid long, x double, y double")
    road = lines(spark, [(7, [(0.0, 0.0), (6.0, 0.0), (6.0, 0.0), (10.0, 0.0)]), (8, [])])
    got = {r.fid: (r.road, r.node, round(r.along, 6), r.broken) for r in junctions.virtual_nodes(p, road).collect()}
    assert got == {1: (7, "0:0", 0.1, False), 2: (7, "8:0", 4.0, True), 3: (7, "20:0", 9.9, False), 5: (7, "14:0", 7.0, True)}


def test_merged_feeders(spark):
    f = spark.createDataFrame([(5, "a", [(0.0, 0.0), (4.0, 0.0)], 4.126), (6, "b", [(0.0, 9.0), (4.0, 9.0)], None), (7, None, [(0.0, 0.0), (1.0, 0.0)], 1.0), (8, "", [(0.0, 0.0), (1.0, 0.0)], 1.0)], "fid long, PDP_ID string, line array<struct<x:double,y:double>>, dist_m double")
    c = spark.createDataFrame([(1, "a", [(4.0, 7.0), (4.0, 9.0)]), (2, "a", [(4.0, 1.0), (4.0, 2.0)]), (3, "a", [(0.0, 1.0), (0.0, 2.0)]), (4, "z", [(0.0, 0.0), (0.0, 2.0)]), (5, "a", None)], "connector long, PDP_ID string, line array<struct<x:double,y:double>>")
    known = spark.createDataFrame([("a", "POLY1", "PDP1")], "point string, POLYGON_ID string, PDP_ID string")
    got = [(r.id, r.fid, r.dist_m, r.POLYGON_ID, r.PDP_ID, r.connector, len(r.parts)) for r in junctions.merged_feeders(f, c, known).orderBy("id").collect()]
    assert got == [(1, 5, 4.13, "POLY1", "PDP1", 2, 2), (2, 6, 4.0, None, "b", None, 1)]


def test_clear_of(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    b = spark.createDataFrame([("B", [ring])], "poly string, rings array<array<struct<x:double,y:double>>>")
    l = lines(spark, [(1, [(2.0, 2.0), (3.0, 3.0)]), (2, [(10.2, 0.0), (10.2, 5.0)]), (3, [(10.4, 0.0), (10.4, 5.0)]), (4, [(-5.0, 5.0), (15.0, 5.0)])])  # noqa: E741
    assert [r.fid for r in junctions.clear_of(l, b).collect()] == [3]


def test_supply_point(spark):
    p = spark.createDataFrame([(3, "M3"), (1, None), (2, "M2")], "fid long, MFG_ID string")
    pick = lambda *a: tuple(junctions.supply_point(p, *a).first())
    assert pick() == (1, "MFG00001") and pick(p.where("fid > 1").select("fid")) == (2, "M2") and pick(p.limit(0).select("fid")) == (1, "MFG00001")
    with pytest.raises(ValueError, match="no supply point"):
        junctions.supply_point(p.limit(0))


def test_growth_report_and_networks(spark):
    rings = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]]
    polys = spark.createDataFrame([("A", rings), ("B", rings)], "poly string, rings array<array<struct<x:double,y:double>>>")
    m = spark.createDataFrame([(1, "a", "A", 1.0, 1.0, 9), (2, "b", "A", 2.0, 2.0, 9), (3, "c", "A", 50.0, 2.0, 9), (4, "a", "B", 3.0, 3.0, 2), (5, "d", None, 3.0, 3.0, 2)], "fid long, addr_id string, area string, x double, y double, hh int")
    assert tuple(checks.growth_report(m, polys, 20, 30).first()) == (2, 4, 29, 1, 1, 1, 1, 1)
    assert tuple(checks.growth_report(m.limit(0), polys, 20, 30).first()) == (0, 0, 0, 0, 0, 0, 0, 0)
    n = checks.networks(polys.select("poly"), spark.createDataFrame([("A", "P2"), ("A", "P1"), ("X", "P3")], "poly string, PDP_ID string"), m.select(F.col("area").alias("poly"), "addr_id"))
    assert sorted(map(tuple, n.collect())) == [("A", "P1", 3), ("B", None, 1)]
    with pytest.raises(ValueError, match="twice"):
        checks.networks(polys.unionByName(polys).select("poly"), polys.select("poly", F.lit("P").alias("PDP_ID")), m.select(F.col("area").alias("poly")))
    assert sorted(map(tuple, checks.layer_counts({"polys": polys, "members": m}).collect())) == [("members", 5), ("polys", 2)]


def test_gates(spark):
    some, none = spark.createDataFrame([("P", 1)], "Pdp_Id string, addr_id long"), spark.createDataFrame([], "pdp_id string")
    bare = spark.createDataFrame([(1,)], "n long")
    assert checks.cable_gate(some, some, some) == [] and len(checks.cable_gate(none, some, some)) == 1
    for args, why in (((None, some, some), "missing: feeder"), ((none, none, none), "all trenches are empty"), ((some, bare, some), "without a point id: garden")):
        with pytest.raises(ValueError, match=why):
            checks.cable_gate(*args)
    checks.duct_gate(some, some, some, some)
    for args, why in (((none, some, some, some), "none"), ((some, None, some, some), "supply point"), ((some, some, some, bare), "point id and a household id"), ((some, some, some, None), "point id")):
        with pytest.raises(ValueError, match=why):
            checks.duct_gate(*args)


def test_owned_takes_missing_areas_from_points(spark):
    known = spark.createDataFrame([("p", "A", None), ("q", "B", "Q2"), ("r", None, "R2")], "point string, POLYGON_ID string, PDP_ID string")
    rows = spark.createDataFrame([(1, "p", " "), (2, " q ", None), (3, "q", "Z"), (4, "null", "NULL"), (5, "x", None), (6, "r", None)], "n int, pdp_id string, polygon_id string")
    got = {r.n: (r.POLYGON_ID, r.PDP_ID) for r in trenches.owned(rows, known).collect()}
    assert got == {1: ("A", "p"), 2: ("B", "Q2"), 3: ("Z", "q"), 4: (None, None), 5: (None, "x"), 6: (None, "R2")}
    assert trenches.owned(rows.select("n"), known).columns == ["n", "POLYGON_ID", "PDP_ID"]
