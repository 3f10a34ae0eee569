"""Planning queries against their SQL on the smallest tables, golden vectors, and invariants of the results SQL has no form for."""

import math
import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions import geometry, numeric, projection, text
from spanloom.operators import ducts, geocode, graph, logs, network, pricing, regions, relational, spatial, territories
from spanloom.plans import queries
from spanloom.sources import shared, sinks, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted(tuple("~" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(got.select(*names).collect()) == plain(want)


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    "hh, total, ports, util, ok, label",
    [
        (0, 0, 0, 0.0, 0, "-"), (-3, 0, 0, 0.0, 0, "-"), (None, 0, 0, 0.0, 0, "-"), (1, 1, 8, 12.5, 0, "1x1:8"), (7, 1, 8, 87.5, 1, "1x1:8"), (8, 1, 16, 50.0, 0, "1x1:16"), (9, 1, 16, 56.2, 0, "1x1:16"),
        (10, 1, 16, 62.5, 1, "1x1:16"), (15, 2, 24, 62.5, 1, "1x1:16 + 1x1:8"), (16, 2, 24, 66.7, 1, "1x1:16 + 1x1:8"), (32, 2, 40, 80.0, 1, "1x1:32 + 1x1:8"), (50, 1, 64, 78.1, 1, "1x1:64"), (57, 1, 64, 89.1, 1, "1x1:64"),
        (58, 2, 72, 80.6, 1, "1x1:64 + 1x1:8"), (64, 2, 72, 88.9, 1, "1x1:64 + 1x1:8"), (100, 2, 128, 78.1, 1, "2x1:64"), (115, 2, 128, 89.8, 1, "2x1:64"), (128, 3, 144, 88.9, 1, "2x1:64 + 1x1:16"),
    ],
)
def test_splitter_plan(spark, hh, total, ports, util, ok, label):
    p = values(spark, numeric.splitter_plan(F.col("hh")), [(hh,)], "hh int")[0]
    assert (p["total"], p["ports"], p["util"], p["ok"], p["label"]) == (total, ports, util, ok, label)


@pytest.mark.parametrize("cell, value", [("1.234,56 €", 1234.56), ("1,234.5", 1234.5), ("12,50", 12.5), ("1.234", 1.234), ("1.234.567", None), ("(3,00)", -3.0), ("-5", -5.0), ("EP 12,5 / 3", 3.0), ("-", None), ("nan", None), ("", None), (None, None), ("no price", None), ("--", None), ("12,-", 12.0), ("EUR - 7.50 net", -7.5), ("1.234,5,6", None), ("a-b 3", 3.0)])
def test_price_cells(spark, cell, value):
    assert values(spark, numeric.price(F.col("c")), [(cell,)], "c string") == [value]


def test_texts(spark):
    t = lambda c, v: values(spark, c(F.col("c")), [(v,)], "c string")[0]
    assert t(text.slug, "Köln Straße") == "Köln Strasse" and t(text.slug, None) == ""
    assert t(text.normalized_street, "Berliner Str. 12") == t(text.normalized_street, "Berliner Straße 12") == "Berliner Straße 12"
    assert t(text.normalized_street, "lange strasse") == "lange straße" and t(text.normalized_street, "Hauptstr. 5") == "Hauptstr. 5"
    assert t(text.key, "  PDP00001 ") == "pdp00001" and t(text.key, None) == ""
    assert t(text.layer_name, "Feeder Ducts (v2).gpkg") == "Feeder_Ducts_v2_gpkg" and t(text.layer_name, "") == "layer"
    assert t(text.layer_uri, "path.gpkg|layername=foo|layername=foo") == "path.gpkg|layername=foo"
    assert t(text.ascii_text, "Größe é") == "Große e" and t(text.null_like, " NULL ") is None
    assert [t(lambda c: numeric.quantized(c.cast("double"), 0.05), v) for v in ("0.125",)] == [pytest.approx(0.1)]


def test_majority(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None)], "g int, v string")
    assert dict(relational.majority(df, ["g"], "v").collect()) == {1: "a", 2: None}


def test_address_ids_continue(spark):
    df = spark.createDataFrame([("ADDR00007", "z", "1", "1", 1), (None, "b", "12a", "1", 2), (" ", "b", "3", "1", 3)], "addr_id string, s string, h string, p string, t int")
    got = {r.t: r.addr_id for r in relational.address_ids(df, "ADDR", F.col("s"), F.col("h"), F.col("p"), F.col("t")).collect()}
    assert got == {1: "ADDR00007", 3: "ADDR00008", 2: "ADDR00009"}


def test_names_and_roads(spark):
    assert relational.unique_names(["a", "A", "a"]) == ["a", "A_NEW", "a_NEW_v2"]
    df = spark.createDataFrame([("motorway", 1), ("path", 2)], "Highway string, fid int")
    assert relational.first_field(df, ["fclass", "highway"]) == "Highway"
    assert relational.candidate_roads(df).count() == 2 and relational.diggable(df).count() == 1
    assert relational.thin(df, ["FID", "x"]).columns == ["fid"] and relational.with_missing(df, {"FID": F.lit(0), "z": F.lit(1)}).columns == ["Highway", "fid", "z"]


@pytest.mark.parametrize("crs", ["EPSG:25832", "EPSG:25833", "EPSG:3857"])
def test_projection_round_trip(spark, crs):
    lon, lat = (13.4, 52.5)
    p = projection.reprojected(F.lit(lon), F.lit(lat), "EPSG:4326", crs)
    row = spark.range(1).select(p.alias("p")).select("p", projection.reprojected(F.col("p.x"), F.col("p.y"), crs, "EPSG:4326").alias("q")).first()
    assert row.q["x"] == pytest.approx(lon, abs=1e-8) and row.q["y"] == pytest.approx(lat, abs=1e-8)
    if crs == "EPSG:25833":
        mid = spark.range(1).select(projection.to_utm(F.lit(15.0), F.lit(52.0), crs)["x"]).first()[0]
        assert mid == pytest.approx(500000, abs=1e-6) and row.p["x"] == pytest.approx(391_000, abs=2000) and row.p["y"] == pytest.approx(5_817_900, abs=2000)


def test_line_functions(spark):
    g = spark.range(1).select(geometry.line(geometry.point(0, 0), geometry.point(3, 4), geometry.point(3, 10)).alias("l"))
    r = g.select(geometry.length(F.col("l")), geometry.at_distance(F.col("l"), F.lit(8.0)), F.size(geometry.densified(F.col("l"), 2.0)), geometry.running_length(F.col("l")), F.size(geometry.points_along(F.col("l"), 3.0))).first()
    assert r[0] == 11 and (r[1]["x"], r[1]["y"]) == (3, 7) and r[2] == 7 and r[3] == [0, 5, 11] and r[4] == 4
    square = F.array(geometry.line(*[geometry.point(x, y) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]))
    assert [spark.range(1).select(geometry.covers(square, F.lit(x), F.lit(y))).first()[0] for x, y in ((1.0, 1.0), (4.0, 2.0), (5.0, 2.0), (0.0, 0.0), (-1.0, 4.0))] == [True, True, False, True, False]


def test_log_compat_and_runs(spark):
    lines = ["noise", logs.START, "Algorithm started at: 2024-01-01T00:00:00", "  [timing] Object Layer: 15.200s", "  [timing] Polygon Layer: 850 features, 12.350s", "  [timing] Polygons.gpkg: written to /x in 0.234s", "  [timing] Other Layer: 3 features, 1.0s", "[timing] Total pipeline: 120.450s", logs.START, "Execution FAILED after 3", "  [timing] Cable Layer: Feeder: 12, Dist: 45 features, 8.150s"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    for compat, want in ((True, ("1", 5.2)), (False, (None, 15.2))):
        e = logs.parsed(df, compat)
        first = e.where("name = 'Object Layer'").first()
        assert (first["info"], first["seconds"]) == want
    assert e.where("name = 'Polygon Layer'").first()["info"] == "850 features" and e.where("name = 'Cable Layer'").first()["info"] == "Feeder: 12, Dist: 45 features"
    runs = {r.run: r for r in logs.runs(e).collect()}
    assert runs[1].total == 120.45 and not runs[1].failed and runs[1].stamp == "2024-01-01T00:00:00" and runs[2].failed and runs[2].total == 8.15


def test_price_table_and_match(spark):
    cells = [("a", 0, ["Title"]), ("a", 1, ["Pos", "Beschreibung", "Einheit", "EP"]), ("a", 2, ["1", "Trench  open", "m", "12,50"]), ("a", 3, ["2", "Duct small", "m", "3,00"]), ("a", 4, ["3", "", "m", "1"]), ("b", 0, ["Pos", "Item", "Unit", "Preis"]), ("b", 1, ["9", "x", "m", ""])]
    t = pricing.price_table(spark.createDataFrame(cells, "sheet string, row int, cells array<string>"))
    assert [(r.code, r.unit_price) for r in t.orderBy("row").collect()] == [("1", 12.5), ("2", 3.0)]
    items = spark.createDataFrame([(1, "small duct", "m", 2.0), (2, "anything", "pcs", 3.0), (3, "mapped", "m", 4.0)], "item_id int, item string, unit string, quantity double")
    hints = spark.createDataFrame([("small duct", "duct"), ("small duct", "small")], "item string, hint string")
    codes = spark.createDataFrame([("mapped", "2")], "item string, code string")
    got = {r.item_id: (r.code, r.amount) for r in pricing.matched(items, t, codes, hints).collect()}
    assert got == {1: ("2", 6.0), 2: ("1", 37.5), 3: ("2", 12.0)}


def test_areas_keep_their_limits(spark):
    rows = [(i, float((i * 37) % 211 * 5), float((i * 53) % 197 * 5), 1 + i % 12) for i in range(220)] + [(999, 90000.0, 90000.0, 3)]
    p = spark.createDataFrame(rows, "fid long, x double, y double, hh int")
    limits = regions.Limits()
    areas = regions.service_areas(p, None, limits)
    got = areas.collect()
    assert sorted(r.fid for r in got) == sorted(r[0] for r in rows)
    where, group = {r[0]: r for r in rows}, defaultdict(list)
    for r in got:
        group[r.area].append(where[r.fid])
    assert all(sum(m[3] for m in g) <= round(1.1 * limits.most) for g in group.values())
    for g in group.values():
        cx, cy = sum(m[1] for m in g) / len(g), sum(m[2] for m in g) / len(g)
        assert max(math.hypot(m[1] - cx, m[2] - cy) for m in g) <= 2 * limits.radius
    assert len(group[999]) == 1 and next(r.review for r in got if r.fid == 999)
    assert all(r.area_m2 > 0 for r in regions.hulls(p, areas).collect())


def test_voronoi_cells_tile(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 0.0, 10.0)], "fid long, x double, y double")
    ring = {r.fid: [(round(q["x"], 6), round(q["y"], 6)) for q in r.ring] for r in territories.voronoi(p, 20.0).collect()}
    assert max(x for x, _ in ring[1]) == 5 and max(y for _, y in ring[1]) == 5 and min(x for x, _ in ring[2]) == 5


def test_ducts_hold_their_caps(spark):
    rows = [("p", "L", str(i), [f"n{k}" for k in range(i + 1)], float(i)) for i in range(25)]
    d = ducts.distribution_ducts(spark.createDataFrame(rows, "pdp_id string, side string, id string, path array<string>, dist double"), 10).collect()
    assert [r.hh_count for r in d] == [10, 10, 5] and d[0].color == "#e53935" and sorted(i for r in d for i in r.hh_ids.split(",")) == sorted(r[2] for r in rows)
    one = ducts.feeder_ducts(spark.createDataFrame([("m", "a", ["s1", "s2"], [1.0, 2.0])], "mfg_id string, id string, path array<string>, lengths array<double>")).collect()
    assert [(r.part, r.pdp_count, r.color) for r in one] == [("trunk", 0, "#808080")]


def test_paths(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "u string, v string, w double")
    got = {r.node: (r.dist, r.label) for r in graph.relaxed(e, spark.createDataFrame([("a", "A")], "node string, label string"), 5).collect()}
    assert got == {"a": (0.0, "A"), "b": (1.0, "A"), "c": (2.0, "A")}
    p = spark.createDataFrame([(1, [1, 2, 3]), (1, [1, 2, 4]), (2, [7])], "g int, path array<int>")
    assert dict(graph.common_prefix(p, "g").collect()) == {1: 2, 2: 1}


def test_mitred_sidewalks(spark):
    road = spark.range(1).select(F.lit(1).cast("long").alias("fid"), geometry.line(geometry.point(0, 0), geometry.point(10, 0), geometry.point(10, 10)).alias("line"))
    s = {r.side: [(round(p["x"], 6), round(p["y"], 6)) for p in r.line] for r in network.sidewalks(road).collect()}
    assert s["L"] == [(0, 3), (7, 3), (7, 10)] and s["R"] == [(0, -3), (13, -3), (13, 10)]
    assert {r.snapped for r in spatial.snapped(spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 50.0)], "fid long, x double, y double"), spatial.segments(road, "fid"), 6.0).collect()} == {True, False}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("Unnamed: 0,Unnamed: 1,Unnamed: 2\nAdresse,Lat,X\nWeg,,4\nPfad,,5\n,,\n")
    df = tables.sheet(spark, str(tmp_path / "sheet.csv"))
    assert df.columns == ["Adresse", "Lat", "X"] and df.count() == 2
    assert tables.mapping(df) == {"address": "Adresse"}  # no row has both coordinates
    (tmp_path / "c.jsonl").write_text('{"key":"a","lon":1,"lat":2}\nbroken\n{"key":"a","lon":3,"lat":4}\n{"key":"b","lon":null,"lat":1}\n')
    assert [tuple(r) for r in tables.cache(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", 3.0, 4.0)]
    assert tables.layer(spark, str(tmp_path / "none.parquet")) is None and tables.quantities(spark, str(tmp_path / "no.csv")).count() == 0
    path = sinks.write_layer(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), str(tmp_path / "points"))
    assert spark.read.parquet(path).first()["geom"][:5] == b"\x01\x01\x00\x00\x00"
    assert tables.profile(None, addr_prefix="A")["addr_prefix"] == "A" and geocode.counts(spark.createDataFrame([("ok",)], "status string")).first()["ok"] == 1


def test_every_result_without_sql_has_rows(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES)):
        assert queries.QUERIES[name](spark, SF).count() > 0, name


def test_choice():
    options = {"fast": "Fast way", "exact": "Exact way"}
    assert [relational.choice(v, options, "fast") for v in (1, "1", "EXACT", " exact way ", 7, None, True)] == ["exact", "exact", "exact", "exact", "fast", "fast", "fast"]


def test_the_last_ring_is_endless(spark):
    points, others = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0)], "fid long, x double, y double"), spark.createDataFrame([("a", 3.0, 4.0)], "node string, x double, y double")
    assert {r.fid: r.d for r in spatial.ring_nearest(points, others, [1.0, 10.0]).collect()} == {1: 5.0, 2: pytest.approx(999997.0, abs=0.01)}
    assert [r.fid for r in spatial.ring_nearest(points, others, [10.0], endless=False).collect()] == [1] and spatial.ring_nearest(points, others.limit(0), [1.0]).count() == 0


def test_only_the_first_header_row_goes(spark):
    df = spark.createDataFrame([("Straße", "Street"), ("A", "1"), ("Straße", "Street")], "_c0 string, _c1 string").coalesce(1)
    out = tables.promoted(df)
    assert out.columns == ["Straße", "Street"] and sorted(r[0] for r in out.collect()) == ["A", "Straße"]


def test_hints_without_trigrams_or_matches(spark):
    prices = spark.createDataFrame([(1, "1", "Erdkabel 10 m", "m", 2.0), (2, "2", "Rohr", "m", 3.0), (3, "3", "Kabel x", "pcs", 5.0)], "row int, code string, desc string, unit string, unit_price double")
    items = spark.createDataFrame([(i, n, "m", 1.0) for i, n in enumerate(["a", "b", "c", "long Rohr", "e"])], "item_id int, item string, unit string, quantity double")
    hints = spark.createDataFrame([("a", "kabel"), ("b", "x"), ("c", ""), ("long Rohr", "absent"), ("e", "none here")], "item string, hint string")
    assert [r.code for r in pricing.matched(items, prices, None, hints).orderBy("item_id").collect()] == ["1", "3", "1", None, "1"]


def test_plan(spark):
    r = queries.V.roads(spark, SF).where("town < 2")
    p = queries.V.premises(spark, SF).where("town < 2").select("fid", "x", "y", "hh", "town")
    layers = queries.plan(p, r)
    rows = {n: df.collect() for n, df in layers.items()}
    homes = {x.fid for x in p.collect()}
    assert {x.fid for x in rows["objects"]} == homes and len(rows["mfg"]) == 2 and all(rows.values())
    assert {x.fid for x in rows["garden_trench"]} == homes and {x.fid for x in rows["distribution_trench"]} <= homes
    points = {x.fid: x.PDP_ID for x in rows["objects"]}
    assert all(points[x.fid] == x.PDP_ID for x in rows["distribution_trench"]) and len({x.PDP_ID for x in rows["pdp"]}) == len(rows["pdp"])


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = type("Conf", (), {"get": lambda self, name, other=None: other, "set": lambda self, name, value: None})(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())
    Context.master = "local[4]"
    assert os.path.isdir(shared.shared_folder(Session()))
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_prices_of_equal_text_are_looked_up_once(spark, monkeypatch):
    items = spark.createDataFrame([(i, name, unit, 2.0) for i, (name, unit) in enumerate([("Duct 50", "m"), ("Duct 50", "x"), (None, "m")])], "item_id int, item string, unit string, quantity double")
    prices = spark.createDataFrame([(9 - i, f"c{9 - i}", "Duct blue" if i < 8 else "Cable", "m" if i % 2 else "St", float(i)) for i in range(10)], "row int, code string, desc string, unit string, unit_price double")
    hints = spark.createDataFrame([("Duct 50", "duct")], "item string, hint string")
    seen, holding = [], pricing.holding
    monkeypatch.setattr(pricing, "holding", lambda names, texts: seen.append(texts.count()) or holding(names, texts))
    got = {r.item_id: (r.code, r.amount) for r in pricing.matched(items, prices, None, hints).collect()}
    assert got == {0: ("c2", 14.0), 1: ("c2", 14.0)}
    assert max(seen) == 2


def scattered(n=300):
    """Places on a grid of 0.25, with copies and exact distances, and some far off it."""
    from random import Random

    r = Random(5)
    near = [(i, r.randrange(-60, 60) / 4, r.randrange(-60, 60) / 4) for i in range(n)]
    return near + [(n + i, r.uniform(-40, 40), r.uniform(-40, 40)) for i in range(n // 3)] + [(2 * n, 0.1, 500.0)]


def test_neighbour_sums_form_no_pairs(spark, monkeypatch):
    spots = scattered()
    monkeypatch.setattr(spatial, "neighbour_pairs", None)
    got = {tuple(r) for r in spatial.neighbour_sums(spark.createDataFrame(spots, "fid long, x double, y double"), 2.5).collect()}
    want = set()
    for i, x, y in spots:
        near = [(d2, j) for j, a, b in spots if j != i and (d2 := (x - a) * (x - a) + (y - b) * (y - b)) <= 6.25]
        if near:
            want.add((i, len(near), min(near)[0], sum(j for _, j in near)))
    assert got == want


def test_typical_spacing_looks_no_farther_than_it_must(spark, monkeypatch):
    from statistics import median

    spots = [(i, "far" if y > 100 else "ab"[i % 2], x, y) for i, x, y in scattered()]
    monkeypatch.setattr(spatial, "neighbour_pairs", None)
    got = {r.area: r.spacing for r in spatial.typical_spacing(spark.createDataFrame(spots, "fid long, area string, x double, y double"), 9.0, 5).collect()}
    all_d = defaultdict(list)
    for _, area, x, y in spots:
        all_d[area] += sorted(d for _, _, a, b in spots if 0 < (d := math.sqrt((x - a) * (x - a) + (y - b) * (y - b))) <= 9.0)[:5]
    assert got == {area: pytest.approx(median(all_d[area]) if all_d[area] else 1.0) for area in ("a", "b", "far")}


def test_pools_of_small_polygons_meet_few_candidates(spark):
    """A thin polygon in a dense place: what is joined before the exact tests is near its box, not all of a wide cell."""
    spots = spark.range(2500).selectExpr("id AS cand", "CAST(id % 50 * 2 AS DOUBLE) AS x", "CAST(id DIV 50 * 2 AS DOUBLE) AS y")
    ring = "array(array(named_struct('x', {0}, 'y', {1}), named_struct('x', {2}, 'y', {1}), named_struct('x', {2}, 'y', {3}), named_struct('x', {0}, 'y', {3}), named_struct('x', {0}, 'y', {1})))"
    polys = spark.sql("SELECT 'thin' AS poly, " + ring.format("11D", "11D", "15D", "15D") + " AS rings UNION ALL SELECT 'strip', " + ring.format("19D", "51D", "90D", "55D") + " UNION ALL SELECT 'wide', " + ring.format("-5D", "-5D", "200D", "200D"))
    tested, covers = [], spatial.covers
    got = defaultdict(set)
    spatial.covers = lambda rings, x, y: tested.append((rings, x, y)) or covers(rings, x, y)
    try:
        for r in spatial.candidate_pool(polys, spots, 100.0).collect():
            got[r.poly].add((r.cand, r.tier))
    finally:
        spatial.covers = covers
    places = [(i, i % 50 * 2.0, i // 50 * 2.0) for i in range(2500)]
    assert got["thin"] == {(i, 1) for i, x, y in places if math.hypot(x - 13, y - 13) <= 10}
    assert got["strip"] == {(i, 1) for i, x, y in places if math.hypot(x - 54.5, y - 53) <= 10}
    assert got["wide"] == {(i, 0) for i, _, _ in places}


def test_free_pairs_are_judged_where_they_are_formed(spark):
    spots = scattered(120)
    walls = [(0.0, -20.0, 0.0, 20.0), (-30.0, 3.3, 30.0, 3.3), (5.0, 5.0, 5.0, 5.0)]
    got = {tuple(r) for r in spatial.free_pairs(spark.createDataFrame(spots, "fid long, x double, y double"), spark.createDataFrame(walls, "ax double, ay double, bx double, by double"), 4.0).collect()}
    side = lambda v: (v > 0) - (v < 0)
    cut = lambda p, q, at: side(p - at) * side(q - at) <= 0

    def barred(x1, y1, x2, y2):
        up = cut(x1, x2, 0.0) and (abs(y1) <= 20 or abs(y2) <= 20)
        return up or cut(y1, y2, 3.3) and min(abs(x1), abs(x2)) <= 30 or (x1, y1) == (5.0, 5.0) or (x2, y2) == (5.0, 5.0)

    clear = [s for s in spots if abs(s[1]) < 15 and abs(s[2]) < 15]
    ids = {s[0] for s in clear}
    want = {(i, j) for i, a, b in clear for j, c, d in clear if i < j and (a - c) * (a - c) + (b - d) * (b - d) <= 16 and not barred(a, b, c, d)}
    through = {(i, j) for i, a, b in clear for j, c, d in clear if (a - 5) * (d - 5) == (b - 5) * (c - 5) and (a - 5) * (c - 5) <= 0 and (b - 5) * (d - 5) <= 0}
    assert {p for p in got if p[0] in ids and p[1] in ids} == want - through


def test_global_rank_deals_one_file_out_before_it_compares(spark):
    df = spark.range(2000).selectExpr("id", "named_struct('s', CAST(id * 7919 % 37 AS STRING), 't', -id) AS o").coalesce(1)
    ranked = relational.global_rank(df, "o", "rank")
    want = {i: n for n, (_, _, i) in enumerate(sorted((str(i * 7919 % 37), -i, i) for i in range(2000)), 1)}
    assert {r.id: r.rank for r in ranked.collect()} == want
    assert "REPARTITION_BY_NUM" in ranked._jdf.queryExecution().toString()
