"""Searches that must end, ids that must stay whole, and log lines read by their parts."""

import math

from pyspark.sql import functions as F

from spanloom.operators import logs, relational, spatial


def test_nearest_searches_end_on_missing_places_and_reach_far(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 5e6, -7e6), (5, float("inf"), 0.0), (6, 40.0, 0.0)], "fid long, x double, y double")
    o = spark.createDataFrame([(i, 100.0 * i, 3.0) for i in range(60)] + [(99, None, None)], "node long, x double, y double")
    got = {r.fid: (r.node, round(r.d, 6)) for r in spatial.ring_nearest(p, o, [2.0, 8.0]).collect()}
    assert got == {1: (0, 3.0), 6: (0, round(math.hypot(40, 3), 6)), 4: (59, round(math.hypot(5e6 - 5900, 7e6 + 3), 6))}
    assert spatial.ring_nearest(p, o.where("node = 99"), [2.0]).count() == 0
    segs = spark.createDataFrame([(0, 10.0, 10.0, 10.0, 20.0), (1, None, 0.0, 1.0, 1.0)], "seq int, ax double, ay double, bx double, by double")
    got = {r.fid: round(r.d, 6) for r in spatial.ever_nearest(p, segs, 3.0, []).collect()}
    assert got == {1: round(math.hypot(10, 10), 6), 6: round(math.hypot(30, 10), 6), 4: round(math.hypot(5e6 - 10, 7e6 + 10), 6)}


def test_far_search_equals_all_distances(spark):
    pts = [(i, (i * 7919) % 1009 * 50.0, (i * 6151) % 1013 * 50.0) for i in range(120)]
    others = [(i, (i * 613) % 997 * 1.0, (i * 419) % 991 * 1.0) for i in range(300)]
    got = {r.fid: (r.node, round(r.d, 6)) for r in spatial.ring_nearest(spark.createDataFrame(pts, "fid long, x double, y double"), spark.createDataFrame(others, "node long, x double, y double"), [5.0]).collect()}
    assert got == {f: min((round(math.hypot(x - a, y - b), 6), n) for n, a, b in others)[::-1] for f, x, y in pts}


def test_ids_stay_apart_beyond_their_width(spark):
    n = 100_003
    ids = relational.numbered(spark.range(n), "id", "PDP", "pdp")
    assert ids.select("pdp").distinct().count() == n
    assert [r.pdp for r in ids.where("id IN (0, 99998, 99999, 100002)").orderBy("id").collect()] == ["PDP00001", "PDP99999", "PDP100000", "PDP100003"]
    assert spark.range(1).select(relational.padded(F.lit(None).cast("long"), 5)).first()[0] is None


def test_log_lines(spark):
    lines = [logs.START, "  [timing] Cable Layer: 12 features, 3.5s", "  [timing] Duct Layer: 42.5s", "  [timing] a.gpkg: put in place in 1.25s", "  [timing] .gpkg: x in 1s", "  [timing] b.gpkg: x in 1.2x",
             "  [timing] Object Layer: n: 7s", "  [timing] Polygon Layer: s", "[timing] Total pipeline: 9.5s"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    plain = {r.line_no: (r.kind, r.name, r.info, r.seconds) for r in logs.parsed(df).collect()}
    assert plain[1] == ("stage", "Cable Layer", "12 features", 3.5) and plain[2] == ("stage", "Duct Layer", None, 42.5) and plain[3] == ("write", "a.gpkg", "put in place", 1.25)
    assert plain[8] == ("total", None, None, 9.5) and 4 not in plain and 5 not in plain and 7 not in plain
    loose = {r.line_no: (r.kind, r.name, r.info, r.seconds) for r in logs.parsed(df, compat=True).collect()}
    assert loose[1] == ("stage", "Cable Layer", "12 features", 3.5) and loose[2] == ("stage", "Duct Layer", "4", 2.5) and loose[6] == ("stage", "Object Layer", "n:", 7.0) and 7 not in loose
