"""Registered planning queries with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, numeric, projection, text
from ..operators import chains, checks, ducts, faces, geocode, graph, junctions, logs, network, overlay, pricing, regions, relational, routing, spatial, territories, trenches
from . import views as V
from .pipeline import plan

#: The splitter rule in SQL: candidates are multiples of 8, ranked by band, count, ports.
PLAN_SQL = """
cand AS (SELECT DISTINCT hh, k * 8 AS p FROM hhs, range(1, 400) r(k) WHERE hh > 0 AND k * 8 >= greatest(hh, (hh * 10 + 8) // 9, 8) AND k * 8 <= greatest(greatest(hh, (hh * 10 + 8) // 9, 8) + 64, hh * 5 // 3 + 64)),
counted AS (SELECT hh, p, p // 64 AS n64, (p % 64) // 32 AS n32, (p % 32) // 16 AS n16, (p % 16) // 8 AS n8, CASE WHEN hh * 100 BETWEEN p * 60 AND p * 90 THEN 0 ELSE 1 END AS miss FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hh ORDER BY miss, n64 + n32 + n16 + n8, p) AS rn FROM counted),
plan AS (SELECT hh, CAST(n64 + n32 + n16 + n8 AS INTEGER) AS total, CAST(p AS INTEGER) AS ports, round_even(hh * 100.0 / p, 1) AS util, CAST(1 - miss AS INTEGER) AS ok,
  concat_ws(' + ', CASE WHEN n64 > 0 THEN n64 || 'x1:64' END, CASE WHEN n32 > 0 THEN n32 || 'x1:32' END, CASE WHEN n16 > 0 THEN n16 || 'x1:16' END, CASE WHEN n8 > 0 THEN n8 || 'x1:8' END) AS label
  FROM ranked WHERE rn = 1)"""


def service_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homes, buildings, splitter plan, density and review flag per quarter of a town: the flagship."""
    p = V.premises(spark, sf_dir)
    g = p.groupBy((F.col("town") * 4 + F.floor((F.col("x") - F.col("town") * V.TOWN) / 505) * 2 + F.floor(F.col("y") / 507)).cast("long").alias("area")).agg(F.sum("hh").cast("int").alias("homes"), F.count("*").alias("buildings"))
    g = g.withColumn("plan", numeric.splitter_plan(F.col("homes")))
    return g.select("area", "homes", "buildings", F.col("plan.total").alias("splitters"), F.col("plan.ports").alias("ports"), F.col("plan.label").alias("label"), F.col("plan.ok").alias("ok"), numeric.density(F.col("homes"), F.lit(255000.0)).alias("density"), F.when((F.col("buildings") < 3) | (F.col("homes") < 32), 1).otherwise(0).alias("review"))


SERVICE_SQL = f"""WITH {V.PREMISES_SQL}, g AS (SELECT CAST(town * 4 + floor((x - town * 20000) / 505) * 2 + floor(y / 507) AS BIGINT) AS area, CAST(sum(hh) AS INTEGER) AS homes, count(*) AS buildings FROM premises GROUP BY 1),
hhs AS (SELECT DISTINCT homes AS hh FROM g), {PLAN_SQL.replace("range(1, 400)", "range(1, 3000)")}
SELECT area, homes, buildings, total AS splitters, ports, label, ok, round_even(homes / 25.5, 2) AS density, CAST(CASE WHEN buildings < 3 OR homes < 32 THEN 1 ELSE 0 END AS INTEGER) AS review FROM g JOIN plan ON homes = plan.hh"""


def splitter_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hhs = V.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700 - 3).cast("int").alias("hh")).distinct()
    return hhs.withColumn("plan", numeric.splitter_plan(F.col("hh"))).select("hh", *[F.col(f"plan.{c}").alias(c) for c in ("total", "ports", "util", "ok", "label")])


SPLITTER_SQL = f"""WITH hhs AS (SELECT DISTINCT CAST(c_custkey % 700 - 3 AS INTEGER) AS hh FROM customer), {PLAN_SQL}
SELECT hhs.hh, coalesce(total, 0) AS total, coalesce(ports, 0) AS ports, CAST(coalesce(util, 0.0) AS DOUBLE) AS util, coalesce(ok, 0) AS ok, coalesce(label, '-') AS label FROM hhs LEFT JOIN plan USING (hh)"""


def address_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ADDR"), relational.padded(F.col("c_custkey"), 5))).when(F.col("c_custkey") % 3 == 1, F.lit(" nan ".strip())).alias("addr_id"), "c_mktsegment", (F.col("c_custkey") * 7 % 50).cast("string").alias("house"), (F.col("c_nationkey") + 10000).cast("string").alias("code"))
    return relational.address_ids(c, "ADDR", F.col("c_mktsegment"), F.col("house"), F.col("code"), F.col("c_custkey")).select("c_custkey", "addr_id")


ADDRESS_SQL = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ADDR' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') END AS addr_id, c_mktsegment, c_custkey * 7 % 50 AS house, CAST(c_nationkey + 10000 AS VARCHAR) AS code FROM customer),
m AS (SELECT coalesce(max(CAST(substr(addr_id, 5) AS BIGINT)), 0) AS m FROM c WHERE addr_id IS NOT NULL),
r AS (SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), house, code, c_custkey) + (SELECT m FROM m) AS n FROM c WHERE addr_id IS NULL)
SELECT c_custkey, addr_id FROM c WHERE addr_id IS NOT NULL UNION ALL SELECT c_custkey, 'ADDR' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0') FROM r"""


def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.neighbour_sums(V.premises(spark, sf_dir), 60.0)


NEIGHBOUR_SQL = f"""WITH {V.PREMISES_SQL} SELECT a.fid, count(*) AS neighbours, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS nearest_d2, CAST(sum(b.fid) AS BIGINT) AS other_sum
FROM premises a JOIN premises b ON a.town = b.town AND a.fid <> b.fid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600 GROUP BY a.fid"""


def road_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spatial.segments(V.roads(spark, sf_dir).where("fclass = 'residential'").select("fid", "line"), "fid")
    return spatial.within(V.premises(spark, sf_dir).select("fid", "x", "y"), s, 20.0).select("fid", F.col("near").alias("has_access"))


BOX_D = "sqrt(power(greatest(ax - x, 0, x - bx), 2) + power(greatest(ay - y, 0, y - by_), 2))"
ACCESS_SQL = f"""WITH {V.PREMISES_SQL}, {V.ROADS_SQL} SELECT fid, EXISTS (SELECT 1 FROM roads r WHERE r.town = p.town AND r.fclass = 'residential' AND {BOX_D} <= 20) AS has_access FROM premises p"""


def nearest_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spatial.segments(V.roads(spark, sf_dir).select(F.col("fid").alias("road"), "line"), "road")
    n = spatial.nearest(V.premises(spark, sf_dir).select("fid", "x", "y"), s, 100.0, ["road"])
    return n.select("fid", "road", F.round("d", 3).alias("d"), F.round("fx", 3).alias("fx"), F.round("fy", 3).alias("fy"))


NEAREST_SQL = f"""WITH {V.PREMISES_SQL}, {V.ROADS_SQL}, d AS (SELECT p.fid, r.fid AS road, {BOX_D} AS d, least(greatest(x, ax), bx) AS fx, least(greatest(y, ay), by_) AS fy FROM premises p JOIN roads r ON p.town = r.town),
k AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY round(d, 9), road) AS rn FROM d WHERE d <= 100) SELECT fid, road, round(d, 3) AS d, fx, fy FROM k WHERE rn = 1"""


def points_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.premises(spark, sf_dir)
    hit = spatial.last_polygon(spatial.point_in_polygon(p, V.quarters(spark, sf_dir), 250.0))
    return p.join(hit, "fid").groupBy("poly").agg(F.count("*").alias("objects"), F.sum("hh").alias("homes"))


AREAS_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, h AS (SELECT fid, hh, max_by(poly, seq) AS poly FROM premises JOIN quarters ON x BETWEEN x0 AND x0 + 500 AND y BETWEEN y0 AND y0 + 500 GROUP BY 1, 2)
SELECT poly, count(*) AS objects, CAST(sum(hh) AS BIGINT) AS homes FROM h GROUP BY poly"""


def object_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.premises(spark, sf_dir)
    hit = spatial.last_polygon(spatial.point_in_polygon(p, V.quarters(spark, sf_dir), 250.0))
    a = hit.select("fid", F.col("poly").alias("POLYGON_ID"), F.concat(F.lit("PDP"), F.substring("poly", 5, 9)).alias("PDP_ID"))
    return relational.linked(p.select("fid", "addr_id"), a)


LINKS_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, h AS (SELECT fid, max_by(poly, seq) AS poly FROM premises JOIN quarters ON x BETWEEN x0 AND x0 + 500 AND y BETWEEN y0 AND y0 + 500 GROUP BY 1)
SELECT p.fid, 'ADDR' || lpad(CAST(p.fid AS VARCHAR), 9, '0') AS addr_id, poly AS "POLYGON_ID", 'PDP' || substr(poly, 5) AS "PDP_ID", 'MFG00001' AS "MFG_ID" FROM premises p LEFT JOIN h USING (fid)"""


def intersection_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spatial.segments(V.roads(spark, sf_dir).select("fid", "line"), "fid")
    return spatial.crossings(s, s, 100.0).groupBy("x", "y").agg(F.count("*").alias("pairs"))


CENTRES_SQL = f"""WITH {V.ROADS_SQL} SELECT v.ax AS x, h.ay AS y, count(*) AS pairs FROM roads h JOIN roads v ON h.town = v.town AND h.v = 0 AND v.v = 1 GROUP BY 1, 2"""


def barrier_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.premises(spark, sf_dir).select("fid", "x", "y")
    r = V.roads(spark, sf_dir).where(relational.restricted(F.col("fclass")))
    return spatial.free_pairs(p, spatial.segments(r.select("fid", "line"), "fid"), 50.0)


BARRIER_SQL = f"""WITH {V.PREMISES_SQL}, {V.ROADS_SQL}, p2 AS (SELECT a.fid AS a, b.fid AS b, a.town, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM premises a JOIN premises b ON a.town = b.town AND a.fid < b.fid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2500)
SELECT a, b FROM p2 WHERE NOT EXISTS (SELECT 1 FROM roads r WHERE r.town = p2.town AND fclass IN ('primary', 'motorway_link') AND CASE v
 WHEN 0 THEN least(y1, y2) <= ay AND greatest(y1, y2) >= ay AND CASE WHEN y1 = y2 THEN least(x1, x2) <= bx AND greatest(x1, x2) >= ax ELSE x1 + (ay - y1) / (y2 - y1) * (x2 - x1) BETWEEN ax AND bx END
 ELSE least(x1, x2) <= ax AND greatest(x1, x2) >= ax AND CASE WHEN x1 = x2 THEN least(y1, y2) <= by_ AND greatest(y1, y2) >= ay ELSE y1 + (ax - x1) / (x2 - x1) * (y2 - y1) BETWEEN ay AND by_ END END)"""


def majority_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.majority(V.premises(spark, sf_dir), ["town"], "segment")


MAJORITY_SQL = f"""WITH {V.PREMISES_SQL}, c AS (SELECT town, segment, count(*) AS n FROM premises WHERE segment IS NOT NULL GROUP BY 1, 2), t AS (SELECT town, max(n) AS n FROM c GROUP BY 1)
SELECT town, CASE WHEN count(*) = 1 THEN min(segment) END AS segment FROM c JOIN t USING (town, n) GROUP BY town"""


def group_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = relational.group_aggregates(V.premises(spark, sf_dir).select("town", "x", "y", "hh", "fid", "segment"), ["town"])
    return g.select("town", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "hh", "fid", "segment")


AGGREGATES_SQL = f"""WITH {V.PREMISES_SQL}, c AS (SELECT town, segment, count(*) AS n FROM premises WHERE segment IS NOT NULL GROUP BY 1, 2), t AS (SELECT town, max(n) AS n FROM c GROUP BY 1), m AS (SELECT town, CASE WHEN count(*) = 1 THEN min(segment) END AS segment FROM c JOIN t USING (town, n) GROUP BY town),
a AS (SELECT town, round(avg(x), 3) AS x, round(avg(y), 3) AS y, CAST(sum(hh) AS BIGINT) AS hh, CAST(sum(fid) AS BIGINT) AS fid FROM premises GROUP BY town) SELECT a.*, segment FROM a LEFT JOIN m USING (town)"""


def road_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.roads(spark, sf_dir)
    return r.select("fid", "fclass", relational.trench_road(r).alias("trench"), relational.road_group(r).alias("road_group"), relational.restricted(F.col("fclass")).alias("restricted"), F.col("fclass").isin(relational.DIGGABLE).alias("candidate"), (~F.col("fclass").isin(relational.NO_DIG)).alias("diggable"))


FILTER_SQL = f"""WITH {V.ROADS_SQL} SELECT fid, fclass, fclass IN ('residential', 'service', 'primary') AND coalesce(bridge, 'F') <> 'T' AS trench,
CASE WHEN fclass = 'footway' AND lower(coalesce(area, 'f')) <> 't' THEN 'footway' WHEN fclass = 'service' THEN 'service' ELSE 'vehicular' END AS road_group,
fclass IN ('primary', 'motorway_link') AS restricted, fclass IN ('residential', 'primary', 'service') AS candidate, fclass <> 'motorway_link' AS diggable FROM roads"""


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("EP "), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.when(F.col("p_partkey") % 5 == 0, " (-)").otherwise(" €"))
    return V.table(spark, sf_dir, "part").select("p_partkey", raw.alias("cell")).select("p_partkey", numeric.price(F.col("cell")).alias("price"))


PRICE_SQL = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN -round(p_retailprice, 2) ELSE round(p_retailprice, 2) END AS price FROM part"


def price_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with hints from their own words, against all priced rows."""
    q = V.quantities(spark, sf_dir)
    hints = q.select("item").distinct().where(F.pmod(F.length("item"), F.lit(2)) == 0).select("item", F.lower(F.split("item", " ")[0]).alias("hint"))
    return pricing.matched(q.select("item_id", "item", "unit", "quantity"), V.prices(spark, sf_dir), None, hints).select("item_id", "code", "unit_price", "amount")


MATCH_SQL = f"""WITH {V.QUANTITIES_SQL}, {V.PRICES_SQL}, names AS (SELECT DISTINCT item, unit, CASE WHEN length(item) % 2 = 0 THEN lower(split_part(item, ' ', 1)) END AS hint FROM quantities),
c AS (SELECT item, n.unit, p.code, p.unit_price, row_number() OVER (PARTITION BY item, n.unit ORDER BY CASE WHEN lower(p.unit) = n.unit THEN 0 ELSE 1 END, row_) AS rn FROM names n JOIN prices p ON hint IS NULL OR contains(lower(desc_), hint))
SELECT item_id, code, unit_price, round(quantity * unit_price, 2) AS amount FROM quantities JOIN c USING (item, unit) WHERE rn = 1"""


def bill_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.totals(V.quantities(spark, sf_dir).select("section", F.col("quantity").alias("amount")))


TOTALS_SQL = f"WITH {V.QUANTITIES_SQL} SELECT section, round(sum(quantity), 2) AS total FROM quantities GROUP BY ROLLUP (section)"


def stage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = logs.parsed(V.stage_log(spark, sf_dir), by=["log"])
    p = logs.comparison(e, by=["log"])
    return p.select("log", "run", *[F.col(s).alias(s.lower().replace(" ", "_")) for s in logs.STAGES])


STAGE_COLUMNS = ", ".join(f"min_by(secs, event_id) FILTER (WHERE st = {i}) AS {s.lower().replace(' ', '_')}" for i, s in enumerate(logs.STAGES))
PIVOT_SQL = f"WITH {V.LOG_SQL} SELECT log, CAST(run AS BIGINT) AS run, {STAGE_COLUMNS} FROM numbered WHERE run > 0 GROUP BY log, run"


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.runs(logs.parsed(V.stage_log(spark, sf_dir), by=["log"]), by=["log"]).select("log", "run", "stages", "stage_seconds", "total", "failed")


SUMMARY_SQL = f"""WITH {V.LOG_SQL} SELECT log, CAST(run AS BIGINT) AS run, count(*) AS stages, CAST(sum(CAST(secs AS DECIMAL(18, 3))) AS DOUBLE) AS stage_seconds,
coalesce(max_by(secs, event_id) FILTER (WHERE event_id % 10 = 7), CAST(sum(CAST(secs AS DECIMAL(18, 3))) AS DOUBLE)) AS total, false AS failed FROM numbered WHERE run > 0 GROUP BY log, run"""


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer")
    q = text.structured_query(F.concat_ws("  ", F.initcap("c_mktsegment"), F.lit("Str.")), (F.col("c_custkey") % 97).cast("string"), F.lit("Köln"), (F.col("c_nationkey") + 10000).cast("string"), F.lit(None).cast("string"), F.lit("Mitte"))
    c = c.select("c_custkey", q.alias("q"))
    return c.select("c_custkey", F.col("q.street").alias("street"), F.col("q.city").alias("city"), text.cache_key(F.col("q.street"), F.col("q.city"), F.col("q.postalcode"), F.col("q.country")).alias("key"))


CACHE_SQL = """WITH c AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg, CAST(c_custkey % 97 AS VARCHAR) AS h, CAST(c_nationkey + 10000 AS VARCHAR) AS code FROM customer),
s AS (SELECT c_custkey, seg || ' Straße' || CASE WHEN contains(seg || '  Str.', h) THEN '' ELSE ' ' || h END AS street, 'Mitte, Ko' || chr(776) || 'ln' AS city, code FROM c)
SELECT c_custkey, street, city, sha1(lower(replace(street, 'ß', 'ss')) || '|' || lower(city) || '|' || code || '|germany') AS key FROM s"""


def geocode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a cache that knows some full addresses, some without postcode, some without street."""
    c = V.table(spark, sf_dir, "customer")
    q = F.struct(F.col("c_mktsegment").alias("street"), F.concat(F.lit("Town "), F.col("c_nationkey").cast("string")).alias("city"), (F.col("c_custkey") % 50).cast("string").alias("postalcode"), F.lit("Germany").alias("country"))
    rows = c.select(F.col("c_custkey").alias("fid"), F.when(F.col("c_custkey") % 4 == 0, "13.5").alias("lon"), F.when(F.col("c_custkey") % 4 == 0, "52.25").alias("lat"), q.alias("q"))
    keys = rows.select("q", "fid").distinct()
    tries = dict(geocode.attempts(F.col("q"), ascii_only=True))
    known = keys.where("fid % 5 = 1").select(tries["full"].alias("key"), F.lit(1.0).alias("lon")).union(keys.where("fid % 7 = 1").select(tries["no_postcode"], F.lit(2.0))).union(keys.where("fid % 3 = 1").select(tries["no_street"], F.lit(4.0)))
    cache = known.groupBy("key").agg(F.min("lon").alias("lon")).withColumn("lat", F.lit(50.0))
    return geocode.objects(rows, cache, ascii_only=True).select("fid", "lon", "lat", "x", "y", "status", "source")


GEOCODE_SQL = """WITH c AS (SELECT c_custkey AS fid, c_mktsegment AS street, c_nationkey AS city, c_custkey % 50 AS code FROM customer),
f AS (SELECT DISTINCT street, city, code FROM c WHERE fid % 5 = 1), p AS (SELECT DISTINCT street, city FROM c WHERE fid % 7 = 1), s AS (SELECT DISTINCT city, code FROM c WHERE fid % 3 = 1),
r AS (SELECT c.fid, CASE WHEN fid % 4 = 0 THEN 13.5 WHEN EXISTS (SELECT 1 FROM f WHERE f.street = c.street AND f.city = c.city AND f.code = c.code) THEN 1.0 WHEN EXISTS (SELECT 1 FROM p WHERE p.street = c.street AND p.city = c.city) THEN 2.0 WHEN EXISTS (SELECT 1 FROM s WHERE s.city = c.city AND s.code = c.code) THEN 4.0 END AS lon FROM c)
SELECT fid, CAST(lon AS DOUBLE) AS lon, CASE WHEN fid % 4 = 0 THEN 52.25 WHEN lon IS NOT NULL THEN 50.0 END::DOUBLE AS lat, CAST(coalesce(lon, 0.0) AS DOUBLE) AS x, CASE WHEN fid % 4 = 0 THEN 52.25 WHEN lon IS NOT NULL THEN 50.0 ELSE 85.0 END::DOUBLE AS y,
CASE WHEN lon IS NULL THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN fid % 4 = 0 THEN 'sheet_lonlat' WHEN lon IS NULL THEN 'nominatim' ELSE 'nominatim_cache' END AS source FROM r"""


def text_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "pages")
    uri = F.concat(F.col("url"), F.lit("||layername=a|x|layername=b"))
    return p.select("page_id", text.layer_name(F.col("url")).alias("layer"), text.layer_uri(uri).alias("uri"), text.shortened(F.col("url"), 20).alias("short"), text.key(F.concat(F.lit("  "), F.upper("url"), F.lit(" "))).alias("key"))


TEXT_SQL = """SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 63) AS layer, url || '|layername=a|x' AS uri,
CASE WHEN length(url) > 20 THEN left(url, 19) || '…' ELSE url END AS short, lower(url) AS key FROM pages"""


def number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    return c.select("c_custkey", numeric.homes_bucket((k % 40).cast("string")).alias("bucket"), F.round(numeric.quantized(k / 8, 0.25), 6).alias("quantized"), numeric.cell(F.col("c_acctbal"), 100.0).alias("cell"), numeric.branch_colour((k % 7).cast("int")).alias("colour"), numeric.side_colour(F.when(k % 2 == 0, "left").otherwise("R"), (k % 5).cast("int")).alias("side_colour"), numeric.households(F.when(k % 3 == 0, (k % 9).cast("string")).otherwise("x")).alias("hh"))


NUMBER_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 40 = 0 THEN '0 HH' WHEN c_custkey % 40 = 1 THEN '1 HH' WHEN c_custkey % 40 = 2 THEN '2 HH' WHEN c_custkey % 40 <= 31 THEN '3 ≤ HH ≤ 31' ELSE 'HH ≥ 32' END AS bucket,
round_even(c_custkey / 8.0 / 0.25, 0)::DOUBLE * 0.25 AS quantized, CAST(floor(c_acctbal / 100.0) AS BIGINT) AS cell,
(['#d81b60', '#1e88e5', '#43a047', '#8e24aa', '#fb8c00', '#00897b', '#5e35b1'])[CAST(c_custkey % 7 + 1 AS INTEGER)] AS colour,
CASE WHEN c_custkey % 2 = 0 THEN (['#e53935', '#43a047'])[CAST(c_custkey % 5 % 2 + 1 AS INTEGER)] ELSE (['#1e88e5', '#fdd835'])[CAST(c_custkey % 5 % 2 + 1 AS INTEGER)] END AS side_colour,
CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 ELSE 0 END AS INTEGER) AS hh FROM customer"""


def link_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("a"), (F.col("o_orderkey") % 5000).cast("string").alias("b"))
    keys = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return relational.link_overlap(rows, ["a", "b"], keys, "k")


OVERLAP_SQL = """WITH k AS (SELECT c_custkey AS k FROM customer) SELECT 'a' AS name, count(DISTINCT o_custkey) AS overlap FROM orders WHERE o_custkey IN (SELECT k FROM k)
UNION ALL SELECT 'b', count(DISTINCT o_orderkey % 5000) FROM orders WHERE o_orderkey % 5000 IN (SELECT k FROM k)"""


def extent_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.premises(spark, sf_dir).groupBy("town").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    far = F.when(F.col("town") % 2 == 0, 5400000.0).otherwise(0.0)
    return p.select("town", projection.guessed(F.col("x0") + 250000, F.col("x1") + 250000, F.col("y0") + far, F.col("y1") + far).alias("crs"))


GUESS_SQL = f"WITH {V.PREMISES_SQL} SELECT town, CASE WHEN town % 2 = 0 THEN CASE WHEN min(x) + 250000 >= 556600 AND max(x) + 250000 <= 2226400 AND min(y) + 5400000 >= 4974300 THEN 'EPSG:3857' WHEN max(x) + 250000 <= 700000 THEN 'EPSG:25832' WHEN max(x) + 250000 <= 900000 THEN 'EPSG:25833' END END AS crs FROM premises GROUP BY town"


def street_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = V.grid_lines(spark, sf_dir)
    return lines, graph.edges_of(lines, 100.0, 1.0, ["town"])


def grid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest way from the south-west corner of each town to all crossings."""
    _, e = street_graph(spark, sf_dir)
    n = e.select("town", F.col("u").alias("node")).union(e.select("town", "v")).distinct()
    at = lambda i: F.split("node", ":")[i].cast("long")
    corner = (at(0) == F.col("town") * V.TOWN) & (at(1) == 0)
    r = routing.routes(e, n.select("town", F.col("node").alias("id"), "node", corner.alias("source")), "town", span=300.0)
    return r.select("town", F.col("id").alias("node"), F.round("dist", 3).alias("dist"), F.size("path").alias("hops"))


GRID_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS town, CAST(n_nationkey * 20000 + i * 100 AS VARCHAR) || ':' || CAST(j * 100 AS VARCHAR) AS node, CAST((i + j) * 100 AS DOUBLE) AS dist, CAST(i + j + 1 AS INTEGER) AS hops FROM nation, range(11) a(i), range(11) b(j) WHERE i + j > 0"


def nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crossing with its nearest of two central nodes in town (ties to the first)."""
    _, e = street_graph(spark, sf_dir)
    n = e.select("town", F.col("u").alias("node")).union(e.select("town", "v")).distinct()
    at = lambda i: F.split("node", ":")[i].cast("long")
    first, second = (at(0) == F.col("town") * V.TOWN) & (at(1) == 0), (at(0) == F.col("town") * V.TOWN + 1000) & (at(1) == 800)
    t = n.select("town", F.when(first, "A").when(second, "B").otherwise(F.col("node")).alias("id"), "node", (first | second).alias("source"))
    return routing.routes(e, t, "town", span=300.0).select("town", F.col("id").alias("node"), "source", F.round("dist", 3).alias("dist"))


SOURCE_SQL = """WITH g AS (SELECT CAST(n_nationkey AS BIGINT) AS town, n_nationkey * 20000 + i * 100 AS x, i, j FROM nation, range(11) a(i), range(11) b(j)), d AS (SELECT *, i + j AS da, (10 - i) + abs(8 - j) AS db FROM g)
SELECT town, CAST(x AS VARCHAR) || ':' || CAST(j * 100 AS VARCHAR) AS node, CASE WHEN da <= db THEN 'A' ELSE 'B' END AS source, CAST(least(da, db) * 100 AS DOUBLE) AS dist FROM d WHERE da > 0 AND db > 0"""


def healed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises and the crossing they are nearest to: edges to crossings within 40 m exist, other gaps of up to 40 m are closed."""
    p = V.premises(spark, sf_dir).select("town", F.concat(F.lit("p"), F.col("fid").cast("string")).alias("node"), "x", "y")
    # the corner of the hundred metres that is nearest, streets end at 1000 m
    grid = lambda c: F.least(F.floor((c + 50) / 100) * 100, F.lit(1000)).cast("long")
    cx, cy = grid(F.col("x") - F.col("town") * V.TOWN), grid(F.col("y"))
    crossing = F.concat_ws("_", F.concat(F.lit("c"), F.col("town").cast("string")), cx.cast("string"), cy.cast("string"))
    to = p.select("town", "node", crossing.alias("c"), (F.col("town") * V.TOWN + cx).cast("double").alias("cx"), cy.cast("double").alias("cy"), F.hypot(F.col("x") - F.col("town") * V.TOWN - cx, F.col("y") - cy).alias("w"))
    have = to.where("w > 1e-6 AND w <= 40").select(F.col("c").alias("u"), F.col("node").alias("v"), "w")
    nodes = p.select("node", "x", "y").union(to.select("c", "cx", "cy").distinct())
    return graph.healed(have, nodes, 40.0).select("u", "v", F.round("w", 3).alias("w"))


HEAL_SQL = f"""WITH {V.PREMISES_SQL}, k AS (SELECT fid, town, x, y, CAST(least(floor((x - town * 20000 + 50) / 100) * 100, 1000) AS BIGINT) AS cx, CAST(least(floor((y + 50) / 100) * 100, 1000) AS BIGINT) AS cy FROM premises),
n AS (SELECT 'p' || fid AS node, town, x, y FROM premises UNION ALL SELECT DISTINCT 'c' || town || '_' || cx || '_' || cy, town, CAST(town * 20000 + cx AS DOUBLE), CAST(cy AS DOUBLE) FROM k)
SELECT a.node AS u, b.node AS v, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 3) AS w FROM n a JOIN n b ON a.town = b.town AND a.node < b.node
AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > 1e-6"""


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of the crossings within 150 m of the middle of each quarter: least summed distance to its premises."""
    p = V.premises(spark, sf_dir)
    hit = spatial.last_polygon(spatial.point_in_polygon(p, V.quarters(spark, sf_dir), 250.0)).select("fid", F.col("poly").alias("area"))
    cross = intersection_centres(spark, sf_dir).select(F.format_string("%d_%d", F.col("x").cast("long"), F.col("y").cast("long")).alias("cand"), "x", "y")
    s = network.scores(p, hit, cross)
    return s.groupBy("area").agg(F.min(F.struct("total", "cand")).alias("b")).select("area", "b.cand", F.round("b.total", 3).alias("total"))


SCORES_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, {V.ROADS_SQL}, h AS (SELECT fid, x, y, max_by(poly, seq) AS area FROM premises JOIN quarters ON x BETWEEN x0 AND x0 + 500 AND y BETWEEN y0 AND y0 + 500 GROUP BY 1, 2, 3),
c AS (SELECT area, avg(x) AS cx, avg(y) AS cy FROM h GROUP BY 1), k AS (SELECT DISTINCT v.ax AS x, h.ay AS y FROM roads h JOIN roads v ON h.town = v.town AND h.v = 0 AND v.v = 1),
s AS (SELECT c.area, CAST(CAST(k.x AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(k.y AS BIGINT) AS VARCHAR) AS cand, sum(CAST(round(sqrt(power(h.x - k.x, 2) + power(h.y - k.y, 2)), 6) AS DECIMAL(20, 6))) AS total
FROM c JOIN k ON sqrt(power(cx - k.x, 2) + power(cy - k.y, 2)) <= 150 JOIN h ON h.area = c.area GROUP BY 1, 2)
SELECT area, arg_min(cand, (total, cand)) AS cand, round(CAST(min(total) AS DOUBLE), 3) AS total FROM s GROUP BY area"""


def garden_trenches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises to the nearest sidewalk: every road moved 3 m to either side; left wins ties."""
    r = V.roads(spark, sf_dir)
    s = network.sidewalks(r)
    side = lambda k: spatial.segments(s.where(F.col("side") == k).select("fid", "line"), "fid")
    g = network.gardens(V.premises(spark, sf_dir).select("fid", "x", "y"), side("L"), side("R"), 60.0)
    return g.select("fid", "side", F.round("d", 3).alias("d"))


GARDEN_SQL = f"""WITH {V.PREMISES_SQL}, w AS (SELECT p.fid, side, sqrt(power(greatest(x - town * 20000 - 1000, 0), 2) + power(y - (i * 100 + off), 2)) AS d FROM premises p, range(11) a(i), (VALUES ('L', 3), ('R', -3)) b(side, off)
UNION ALL SELECT p.fid, side, sqrt(power(greatest(y - 1000, 0), 2) + power(x - (town * 20000 + i * 100 + off), 2)) FROM premises p, range(11) a(i), (VALUES ('L', -3), ('R', 3)) b(side, off)),
k AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY round(d, 9), side) AS rn FROM w WHERE d <= 60) SELECT fid, side, round(d, 3) AS d FROM k WHERE rn = 1"""


def distribution_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines between premises and the corner of their town, dissolved per town."""
    p = V.premises(spark, sf_dir)
    lines = p.select("fid", F.col("town").cast("string").alias("PDP_ID"), geometry.line(geometry.point(F.col("x"), F.col("y")), geometry.point(F.col("town") * V.TOWN, F.col("y"))).alias("line"))
    lines = lines.withColumn("length_m", F.round(geometry.length(F.col("line")), 2))
    return trenches.dissolved(lines, "PDP_ID")


ROLLUP_SQL = f"""WITH {V.PREMISES_SQL}, l AS (SELECT town, x, y, x - town * 20000 AS len FROM premises), o AS (SELECT DISTINCT town, x, y, len FROM l),
s AS (SELECT town, count(*) AS obj_cnt, round(sum(len), 2) AS total_m FROM l GROUP BY 1), d AS (SELECT town, count(*) AS segments, sum(len) AS once_m FROM o GROUP BY 1)
SELECT CAST(town AS VARCHAR) AS "PDP_ID", obj_cnt, total_m, segments, once_m FROM s JOIN d USING (town)"""


def distribution_cables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.premises(spark, sf_dir)
    mk = lambda half: p.where(F.col("fid") % 2 == half).select(F.concat(F.lit("PDP"), F.lpad(F.col("town").cast("string"), 5, "0")).alias("PDP_ID"), "fid", geometry.line(geometry.point(F.col("x"), F.col("y")), geometry.point(F.col("x"), F.lit(0)), geometry.point(F.col("town") * V.TOWN, F.lit(0))).alias("line"))
    return trenches.distribution_cable(mk(0), mk(1))


CABLE_SQL = f"""WITH {V.PREMISES_SQL}, p AS (SELECT * FROM premises), s AS (SELECT DISTINCT town, x, y, 0 AS k, y AS len FROM p WHERE y <> 0 UNION SELECT DISTINCT town, x, 0, 1, x - town * 20000 FROM p WHERE x <> town * 20000)
SELECT 'pdp' || lpad(CAST(town AS VARCHAR), 5, '0') AS pdp_id, 'PDP' || lpad(CAST(town AS VARCHAR), 5, '0') AS point_id, count(*) AS segments, round(sum(len), 2) AS length_m FROM s GROUP BY town"""


def central_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.central_node(V.roads(spark, sf_dir), "town")


CENTRAL_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS town, CAST(n_nationkey * 20000 + 500 AS DOUBLE) AS x, CAST(500 AS DOUBLE) AS y FROM nation"


def clear_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.candidates(V.roads(spark, sf_dir)).groupBy((F.floor(F.col("x") / V.TOWN)).cast("long").alias("town")).agg(F.count("*").alias("candidates"))


CLEAR_SQL = """WITH p AS (SELECT n_nationkey AS town, i, k * 30 AS place FROM nation, range(11) a(i), range(34) b(k)), ok AS (SELECT * FROM p WHERE least(place % 100, 100 - place % 100) >= 20)
SELECT CAST(town AS BIGINT) AS town, 2 * count(*) AS candidates FROM ok GROUP BY town"""


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("P"), (F.col("c_custkey") % 500).cast("string")).alias("poly_id"))
    return relational.suffixed(o, "poly_id", [F.col("c_custkey")])


DUPLICATE_SQL = """WITH r AS (SELECT c_custkey, 'P' || c_custkey % 500 AS poly_id, row_number() OVER (PARTITION BY c_custkey % 500 ORDER BY c_custkey) AS n FROM customer)
SELECT c_custkey, CASE WHEN n > 1 THEN poly_id || '__' || n ELSE poly_id END AS poly_id FROM r"""


def nearest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the order of theirs whose total is nearest to the balance."""
    c, o = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_custkey", "c_acctbal"), V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    r = relational.nearest_match(c, o, "k", "c_custkey", "o_orderkey", F.abs(F.col("o_totalprice") - F.col("c_acctbal")))
    return r.select("c_custkey", "o_orderkey", F.round("d", 2).alias("d"))


NEAREST_ORDER_SQL = """WITH j AS (SELECT c_custkey, o_orderkey, abs(o_totalprice - c_acctbal) AS d FROM customer JOIN orders ON c_custkey = o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, o_orderkey) AS n FROM j) SELECT c_custkey, o_orderkey, round(d, 2) AS d FROM r WHERE n = 1"""


def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers, suppliers and the nation table, and which of them hold each."""
    return relational.all_keys({n: V.table(spark, sf_dir, n).select(F.col(f"{n[0]}_nationkey").cast("long").alias("nation")) for n in ("customer", "supplier", "nation")}, "nation")


KEY_UNION_SQL = """WITH a AS (SELECT c_nationkey AS k, 1 AS t FROM customer UNION ALL SELECT s_nationkey, 2 FROM supplier UNION ALL SELECT n_nationkey, 3 FROM nation)
SELECT CAST(k AS BIGINT) AS nation, bool_or(t = 1) AS in_customer, bool_or(t = 2) AS in_supplier, bool_or(t = 3) AS in_nation FROM a WHERE k IS NOT NULL GROUP BY k"""


def premise_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median distance to the twelve nearest others within 150 m, by town."""
    s = spatial.typical_spacing(V.premises(spark, sf_dir).select("fid", "town", "x", "y"), 150.0, 12, "town")
    return s.select(F.col("town").cast("long").alias("town"), F.round("spacing", 6).alias("spacing"), F.round(numeric.snap_reach(F.col("spacing")), 6).alias("reach"), F.round(numeric.node_step(F.col("spacing") / 1000), 6).alias("step"))


SPACING_SQL = f"""WITH {V.PREMISES_SQL}, d AS (SELECT a.fid, b.fid AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM premises a JOIN premises b ON a.town = b.town AND a.fid <> b.fid),
k AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d2, other) AS n FROM d WHERE d2 > 0 AND d2 <= 22500), m AS (SELECT town, coalesce(median(sqrt(d2)), 1.0) AS s FROM premises p LEFT JOIN k ON k.fid = p.fid AND n <= 12 GROUP BY town)
SELECT CAST(town AS BIGINT) AS town, round(s, 6) AS spacing, round(greatest(s + 50, 75), 6) AS reach, round(least(0.05, greatest(0.001, s / 5000)), 6) AS step FROM m"""


def layer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and length of all roads, and of the residential and the missing class."""
    r = V.roads(spark, sf_dir)
    parts = [relational.total_length(r, geometry.length(F.col("line")), *a).select(F.lit(n).alias("layer"), "rows", "length_m") for n, a in (("all", ()), ("residential", ("fclass", "residential")), ("none", ("fclass", None)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LENGTHS_SQL = f"""WITH {V.ROADS_SQL}, l AS (SELECT fclass, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS m FROM roads) SELECT 'all' AS layer, count(*) AS rows, round(sum(m), 2) AS length_m FROM l
UNION ALL SELECT 'residential', count(*), round(sum(m), 2) FROM l WHERE fclass = 'residential' UNION ALL SELECT 'none', count(*), CAST(0 AS DOUBLE) FROM l WHERE fclass IS NULL"""


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets of segments as clusters: numbered in each town by homes, then by name."""
    c = V.premises(spark, sf_dir).groupBy("town", "segment").agg(F.sum("hh").cast("long").alias("homes"))
    return relational.by_homes(c, "town", "homes", "segment").select(F.col("town").cast("long").alias("town"), "segment", "homes", "rank")


CLUSTER_SQL = f"""WITH {V.PREMISES_SQL}, c AS (SELECT town, segment, CAST(sum(hh) AS BIGINT) AS homes FROM premises GROUP BY 1, 2)
SELECT CAST(town AS BIGINT) AS town, segment, homes, CAST(row_number() OVER (PARTITION BY town ORDER BY homes DESC, segment) AS INTEGER) AS rank FROM c"""


def stray_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises that lie in no other quarter than the one their number stands for."""
    p = V.premises(spark, sf_dir).select("fid", "x", "y", F.concat(F.lit("POLY"), F.lpad((F.col("town") * 4 + F.col("fid") % 4).cast("string"), 5, "0")).alias("own"))
    return spatial.inside_others(p, V.quarters(spark, sf_dir), "own", 250.0).select("fid", "own")


STRAY_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, p AS (SELECT *, 'POLY' || lpad(CAST(town * 4 + fid % 4 AS VARCHAR), 5, '0') AS own FROM premises)
SELECT fid, own FROM p WHERE NOT EXISTS (SELECT 1 FROM quarters WHERE poly <> own AND x BETWEEN x0 AND x0 + 500 AND y BETWEEN y0 AND y0 + 500)"""


def tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines of 7 m to the east of premises that cross a left and a right sidewalk."""
    p = V.premises(spark, sf_dir)
    lines = p.select("fid", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.lit(7.0)).alias("bx"), F.col("y").alias("by"))
    s = network.sidewalks(V.roads(spark, sf_dir))
    side = lambda k: spatial.segments(s.where(F.col("side") == k).select("fid", "line"), "fid")
    return spatial.crossed_by_both(lines, side("L"), side("R"), 100.0).select("fid")


TANGENT_SQL = f"""WITH {V.PREMISES_SQL}, w AS (SELECT p.fid, bool_or((y <= 1000 AND x <= town * 20000 + i * 100 - 3 AND x + 7 >= town * 20000 + i * 100 - 3) OR (y = i * 100 + 3 AND x <= town * 20000 + 1000)) AS l,
  bool_or((y <= 1000 AND x <= town * 20000 + i * 100 + 3 AND x + 7 >= town * 20000 + i * 100 + 3) OR (y = i * 100 - 3 AND x <= town * 20000 + 1000)) AS r
FROM premises p, range(11) a(i) GROUP BY p.fid) SELECT fid FROM w WHERE l AND r"""


def used_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines of 12 m to the north of premises that meet a diggable road."""
    p = V.premises(spark, sf_dir)
    lines = p.select("fid", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), (F.col("y") + 12).alias("by"))
    return spatial.meeting(lines, spatial.segments(relational.diggable(V.roads(spark, sf_dir)).select("fid", "line"), "fid"), 100.0).select("fid")


USED_SQL = f"""WITH {V.PREMISES_SQL}, {V.ROADS_SQL} SELECT fid FROM premises p WHERE EXISTS (SELECT 1 FROM roads r WHERE r.town = p.town AND fclass <> 'motorway_link'
AND p.x BETWEEN r.ax AND r.bx AND p.y <= r.by_ AND p.y + 12 >= r.ay)"""


def polygon_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points of the quarters, and of one lot without premises in every town."""
    q = V.quarters(spark, sf_dir).select("poly", "rings")
    corner = lambda x, y: geometry.point(F.col("n_nationkey") * V.TOWN + x, F.lit(y))
    lot = geometry.line(corner(5000, 5000), corner(5100, 5000), corner(5100, 5040), corner(5000, 5040), corner(5000, 5000))
    lots = V.table(spark, sf_dir, "nation").select(F.concat(F.lit("LOT"), F.col("n_nationkey").cast("string")).alias("poly"), F.array(lot).alias("rings"))
    r = spatial.reference_points(q.unionByName(lots), V.premises(spark, sf_dir), 250.0)
    return r.groupBy("poly").agg(F.count("*").alias("points"), F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y"))


REFERENCES_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, h AS (SELECT poly, x, y FROM quarters JOIN premises ON power(greatest(x0 - x, x - x0 - 500, 0), 2) + power(greatest(y0 - y, y - y0 - 500, 0), 2) <= 25)
SELECT poly, count(*) AS points, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM h GROUP BY poly UNION ALL SELECT poly, 6, CAST(x0 + 250 AS DOUBLE), CAST(y0 + 250 AS DOUBLE) FROM quarters WHERE poly NOT IN (SELECT poly FROM h)
UNION ALL SELECT 'LOT' || n_nationkey, 6, CAST(n_nationkey * 20000 + 5050 AS DOUBLE), CAST(5020 AS DOUBLE) FROM nation"""


def candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the quarters (inside), of thin lots around a premise (by centroid), wider ones beside it (by box) and far ones (the nearest)."""
    p = V.premises(spark, sf_dir)
    box = lambda x, y, w, h: F.array(geometry.line(*[geometry.point(x + i * w, y + j * h) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]))
    name = lambda prefix: F.concat(F.lit(prefix), F.col("fid").cast("string")).alias("poly")
    thin = p.select(name("thin"), box(F.col("x") - 2, F.col("y") - 2, 4, 4).alias("rings"))
    strip = p.select(name("strip"), box(F.col("x") - 1, F.col("y") - 1, 100, 4).alias("rings"))
    away = p.groupBy("town").agg(F.min("fid").alias("fid")).select(name("away"), box(F.col("town") * V.TOWN - 3000.0, F.lit(-3000.0), 10, 10).alias("rings"))
    polys = V.quarters(spark, sf_dir).select("poly", "rings").unionByName(thin).unionByName(strip).unionByName(away)
    c = spatial.candidate_pool(polys, p.select(F.col("fid").alias("cand"), "x", "y"), 125.0)
    return c.groupBy("poly").agg(F.count("*").alias("n"), F.min("tier").alias("tier"), F.min("cand").alias("least"), F.sum("cand").cast("long").alias("total"))


POOLS_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, b AS (SELECT poly, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, 500 AS w, 500 AS h FROM quarters UNION ALL SELECT 'thin' || fid, x - 2, y - 2, 4, 4 FROM premises UNION ALL SELECT 'strip' || fid, x - 1, y - 1, 100, 4 FROM premises
UNION ALL SELECT 'away' || min(fid), town * 20000 - 3000.0, -3000.0, 10, 10 FROM premises GROUP BY town),
t AS (SELECT poly, fid, CASE WHEN x >= x0 + 3 AND x <= x0 + w - 3 AND y >= y0 + 3 AND y <= y0 + h - 3 THEN 0 WHEN sqrt(power(x - x0 - w / 2.0, 2) + power(y - y0 - h / 2.0, 2)) <= 10 THEN 1 WHEN x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + h THEN 2 END AS tier
FROM b JOIN premises p ON x BETWEEN x0 - 10 AND x0 + w + 10 AND y BETWEEN y0 - 10 AND y0 + h + 10), m AS (SELECT poly, fid, tier FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY poly)),
far AS (SELECT poly, fid, 3 AS tier FROM b CROSS JOIN premises WHERE poly NOT IN (SELECT poly FROM m) QUALIFY row_number() OVER (PARTITION BY poly ORDER BY sqrt(power(x - x0 - w / 2.0, 2) + power(y - y0 - h / 2.0, 2)), fid) = 1)
SELECT poly, count(*) AS n, CAST(min(tier) AS INTEGER) AS tier, min(fid) AS least, CAST(sum(fid) AS BIGINT) AS total FROM (SELECT * FROM m UNION ALL SELECT * FROM far) GROUP BY poly"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, town, x, y: one distribution device per supplier."""
    k = F.col("s_suppkey")
    return V.table(spark, sf_dir, "supplier").select(k.alias("fid"), F.col("s_nationkey").alias("town"), (F.col("s_nationkey") * V.TOWN + k * 7919 % 1009).cast("double").alias("x"), (k * 6151 % 1013).cast("double").alias("y"))


DEVICES_SQL = f"""devices AS (SELECT s_suppkey AS fid, s_nationkey AS town, CAST(s_nationkey * {V.TOWN} + s_suppkey * 7919 % 1009 AS DOUBLE) AS x, CAST(s_suppkey * 6151 % 1013 AS DOUBLE) AS y FROM supplier)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Left and right sidewalks (fid, line) of all roads."""
    s = network.sidewalks(V.roads(spark, sf_dir))
    return tuple(s.where(F.col("side") == k).select("fid", "line") for k in "LR")


def supply_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junctions.supply_point(devices(spark, sf_dir)).select("fid", "x", "y", "MFG_ID")


SUPPLY_SQL = f"WITH {DEVICES_SQL} SELECT fid, x, y, 'MFG00001' AS MFG_ID FROM devices ORDER BY fid LIMIT 1"


def pdp_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices and their pseudo points on sidewalks within 30 m; those in the middle of a block have none."""
    left, right = sides(spark, sf_dir)
    p = junctions.projections(devices(spark, sf_dir), spatial.segments(left, "fid"), spatial.segments(right, "fid"), 30.0)
    return p.select("fid", "sidewalk", "method", "dist_m", F.size("line").alias("vertices"))


PROJECTIONS_SQL = f"""WITH {DEVICES_SQL}, w AS (SELECT p.fid, side, sqrt(power(greatest(x - town * 20000 - 1000, 0), 2) + power(y - (i * 100 + off), 2)) AS d FROM devices p, range(11) a(i), (VALUES ('left', 3), ('right', -3)) b(side, off)
UNION ALL SELECT p.fid, side, sqrt(power(greatest(y - 1000, 0), 2) + power(x - (town * 20000 + i * 100 + off), 2)) FROM devices p, range(11) a(i), (VALUES ('left', -3), ('right', 3)) b(side, off)),
m AS (SELECT fid, side, min(d) AS d FROM w WHERE d <= 30 GROUP BY fid, side), r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY d, side) AS n FROM m)
SELECT fid, side AS sidewalk, 'nearest' AS method, round(d, 3) AS dist_m, 2 AS vertices FROM r WHERE n = 1"""


def pseudo_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises with a slanted line of 8 m each way against all sidewalks: crossing, passing or far away."""
    left, right = sides(spark, sf_dir)
    at = lambda d: geometry.point(F.col("x") + d, F.col("y") + d)
    h = junctions.pseudo_homes(V.premises(spark, sf_dir).select("fid", geometry.line(at(0), at(8)).alias("line")), left, right)
    return h.select("fid", "sidewalk", "method", "dist_m", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


HOMES_SQL = f"""WITH {V.PREMISES_SQL}, s AS (SELECT fid, town * 20000 AS x0, v, CASE v WHEN 1 THEN x - town * 20000 ELSE y END AS p, CASE v WHEN 1 THEN y ELSE x - town * 20000 END AS q, i, side, i * 100 + off AS sx
  FROM premises, range(11) a(i), (VALUES (1, 'left', -3), (1, 'right', 3), (0, 'left', 3), (0, 'right', -3)) b(v, side, off)),
t AS (SELECT *, sx BETWEEN p AND p + 8 AND q <= 1000 AS boxed, q + sx - p AS cq, least(1, greatest(0, (sx - p + 1000 - q) / 16)) AS u FROM s),
g AS (SELECT *, boxed AND cq <= 1000 AS crossed, CASE WHEN boxed AND cq <= 1000 THEN 0 ELSE least(sqrt(power(sx - p, 2) + power(greatest(q - 1000, 0), 2)), sqrt(power(sx - p - 8, 2) + power(greatest(q - 992, 0), 2)), sqrt(power(sx - p - 8 * u, 2) + power(1000 - q - 8 * u, 2))) END AS d,
  sqrt(power(sx - p - 8, 2) + power(greatest(q - 992, 0), 2)) AS far FROM t),
k AS (SELECT *, CASE WHEN crossed THEN 0 WHEN boxed THEN 1 ELSE 2 END AS tier FROM g WHERE boxed OR side = 'left'),
r AS (SELECT *, CASE WHEN tier = 0 THEN cq ELSE least(1000, CASE WHEN tier = 1 THEN 1000 WHEN sx < p THEN q ELSE q + 8 END) END AS along, row_number() OVER (PARTITION BY fid ORDER BY tier, CASE tier WHEN 2 THEN round(far, 9) ELSE round(d, 9) END, side, v, i) AS n FROM k)
SELECT fid, side AS sidewalk, CASE WHEN tier = 0 THEN 'intersection' ELSE 'nearest' END AS method, round(d, 3) AS dist_m, round(CAST(x0 + CASE v WHEN 1 THEN sx ELSE along END AS DOUBLE), 3) AS x, round(CAST(CASE v WHEN 1 THEN along ELSE sx END AS DOUBLE), 3) AS y FROM r WHERE n = 1"""


def sidewalk_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = sides(spark, sf_dir)
    return junctions.bridges(left, right).select("node", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


BRIDGES_SQL = """WITH p AS (SELECT n_nationkey * 20000 + j * 100 + 3 AS x, i * 100 + 3 AS y FROM nation, range(10) a(i), range(10) b(j)
UNION ALL SELECT n_nationkey * 20000 + j * 100 - 3, i * 100 - 3 FROM nation, range(1, 11) a(i), range(1, 11) b(j)) SELECT CAST(x * 20 AS VARCHAR) || ':' || CAST(y * 20 AS VARCHAR) AS node, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM p"""


def bridge_spokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of the crossings of left and right sidewalks to the nodes of both, cut every 5 m."""
    left, right = sides(spark, sf_dir)
    return junctions.spokes(left, right, 5.0)


SPOKES_SQL = """WITH p AS (SELECT n_nationkey * 20000 + j * 100 + 3 AS x, i * 100 + 3 AS y, 2 AS d, 'L' AS flat FROM nation, range(10) a(i), range(10) b(j)
  UNION ALL SELECT n_nationkey * 20000 + j * 100 - 3, i * 100 - 3, -2, 'R' FROM nation, range(1, 11) a(i), range(1, 11) b(j)), s AS (SELECT *, unnest(['L', 'R']) AS side FROM p)
SELECT (x * 20) || ':' || (y * 20) AS node, side, ((x + CASE WHEN side = flat THEN d ELSE 0 END) * 20) || ':' || ((y + CASE WHEN side = flat THEN 0 ELSE d END) * 20) AS other, 2.0::DOUBLE AS w FROM s"""


def virtual_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises within 9 m of a road on their graph nodes."""
    v = junctions.virtual_nodes(V.premises(spark, sf_dir), V.roads(spark, sf_dir).select("fid", "line"))
    return v.select("fid", "road", "node", F.round("along", 3).alias("along"), "broken")


VIRTUAL_SQL = f"""WITH {V.PREMISES_SQL}, {V.ROADS_SQL}, n AS (SELECT p.fid, r.fid AS road, least(greatest(p.x, r.ax), r.bx) AS fx, least(greatest(p.y, r.ay), r.by_) AS fy, r.ax, r.ay, p.x, p.y FROM premises p JOIN roads r ON p.town = r.town
WHERE p.x BETWEEN r.ax - 9 AND r.bx + 9 AND p.y BETWEEN r.ay - 9 AND r.by_ + 9), r AS (SELECT *, fx - ax + fy - ay AS along, row_number() OVER (PARTITION BY fid ORDER BY sqrt(power(x - fx, 2) + power(y - fy, 2)), road) AS k FROM n)
SELECT fid, road, CAST(CAST(fx * 2 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(fy * 2 AS BIGINT) AS VARCHAR) AS node, along, along > 0.25 AND along < 999.75 AS broken FROM r WHERE k = 1"""


def merged_feeders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line from the west edge of town to every customer, and the nearest of the short lines of their orders."""
    p = V.premises(spark, sf_dir).withColumn("PDP_ID", F.col("fid").cast("string"))
    west = F.col("town").cast("double") * V.TOWN
    feeders = p.select("fid", "PDP_ID", geometry.line(geometry.point(west, F.col("y")), geometry.point(F.col("x"), F.col("y"))).alias("line"), F.lit(None).cast("double").alias("dist_m"))
    k = F.col("o_orderkey")
    o = V.table(spark, sf_dir, "orders").join(p.select(F.col("fid").alias("o_custkey"), "town"), "o_custkey")
    at = lambda d: geometry.point(west + k * 7919 % 1009, k * 6151 % 1013 + d)
    connectors = o.select(k.alias("connector"), F.col("o_custkey").alias("PDP_ID"), geometry.line(at(0), at(5)).alias("line"))
    known = p.select(F.col("fid").alias("point"), F.concat(F.lit("POLY"), F.col("town").cast("string")).alias("POLYGON_ID"), F.lit(None).cast("string").alias("PDP_ID"))
    return junctions.merged_feeders(feeders, connectors, known).select("id", "fid", "dist_m", "POLYGON_ID", "PDP_ID", "connector", F.size("parts").alias("parts"))


MERGED_SQL = f"""WITH {V.PREMISES_SQL}, o AS (SELECT p.fid, o_orderkey AS k, sqrt(power(greatest(o_orderkey * 7919 % 1009 - (x - town * 20000), 0), 2) + power(greatest(o_orderkey * 6151 % 1013 - y, y - o_orderkey * 6151 % 1013 - 5, 0), 2)) AS d
FROM premises p JOIN orders ON o_custkey = p.fid), b AS (SELECT fid, arg_min(k, (round(d, 9), k)) AS connector FROM o GROUP BY fid)
SELECT row_number() OVER (ORDER BY p.fid) AS id, p.fid, x - town * 20000 AS dist_m, 'POLY' || town AS POLYGON_ID, CAST(p.fid AS VARCHAR) AS PDP_ID, connector, CAST(CASE WHEN connector IS NULL THEN 1 ELSE 2 END AS INTEGER) AS parts FROM premises p LEFT JOIN b USING (fid)"""


def clear_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines of 12 m to the north of premises that keep 0.3 m from the buildings of 40 m around devices."""
    p = V.premises(spark, sf_dir)
    lines = p.select("fid", geometry.line(geometry.point(F.col("x"), F.col("y")), geometry.point(F.col("x"), F.col("y") + 12)).alias("line"))
    ring = geometry.line(*[geometry.point(F.col("x") + i, F.col("y") + j) for i, j in ((0, 0), (40, 0), (40, 40), (0, 40), (0, 0))])
    return junctions.clear_of(lines, devices(spark, sf_dir).select(F.col("fid").alias("poly"), F.array(ring).alias("rings"))).select("fid")


CLEAR_OF_SQL = f"""WITH {V.PREMISES_SQL}, {DEVICES_SQL} SELECT fid FROM premises p WHERE NOT EXISTS (SELECT 1 FROM devices d WHERE d.town = p.town
AND power(greatest(d.x - p.x, p.x - d.x - 40, 0), 2) + power(greatest(d.y - p.y - 12, p.y - d.y - 40, 0), 2) <= 0.09)"""


def growth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises in the quarter that their number stands for, of which most lie elsewhere."""
    own = F.concat(F.lit("POLY"), F.lpad((F.col("town") * 4 + F.col("fid") % 4).cast("string"), 5, "0"))
    return checks.growth_report(V.premises(spark, sf_dir).withColumns({"area": own, "addr_id": F.concat("segment", F.col("hh").cast("string"))}), V.quarters(spark, sf_dir), 20, 100)


REPORT_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, p AS (SELECT *, 'POLY' || lpad(CAST(town * 4 + fid % 4 AS VARCHAR), 5, '0') AS area FROM premises), a AS (SELECT area, count(*) AS n, sum(hh) AS hh FROM p GROUP BY 1),
m AS (SELECT count(*) AS multi FROM (SELECT segment, hh FROM p GROUP BY 1, 2 HAVING count(DISTINCT area) > 1)), o AS (SELECT count(*) AS outside FROM p JOIN quarters ON area = poly WHERE NOT (x BETWEEN x0 AND x0 + 500 AND y BETWEEN y0 AND y0 + 500))
SELECT count(*) AS areas, CAST(sum(n) AS BIGINT) AS buildings, CAST(sum(hh) AS BIGINT) AS homes, count(*) FILTER (hh BETWEEN 20 AND 100 AND n >= 3) AS in_band, count(*) - count(*) FILTER (hh BETWEEN 20 AND 100 AND n >= 3) AS review,
CAST(ceil(sum(hh) / 100.0) AS BIGINT) AS floor, any_value(multi) AS multi, any_value(outside) AS outside FROM a, m, o"""


def network_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as polygons, their devices as points and their premises as addresses."""
    poly = F.concat(F.lit("N"), F.col("town").cast("string")).alias("poly")
    towns = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("town")).select(poly)
    return checks.networks(towns, devices(spark, sf_dir).select(poly, F.col("fid").alias("PDP_ID")), V.premises(spark, sf_dir).select(poly, "addr_id"))


REGISTRY_SQL = f"""WITH {V.PREMISES_SQL}, {DEVICES_SQL} SELECT 'N' || n_nationkey AS poly, (SELECT min(fid) FROM devices WHERE town = n_nationkey) AS PDP_ID, (SELECT count(*) FROM premises WHERE town = n_nationkey) AS address_count FROM nation"""


def trench_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trenches of their customer's point, some with an area of their own or a null-like one; devices know the areas of their ids."""
    o = V.table(spark, sf_dir, "orders")
    area = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" P"), F.col("o_custkey").cast("string"))).when(F.col("o_orderstatus") == "O", " Null ")
    lines = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("pdp_id"), area.alias("Polygon_Id"))
    known = devices(spark, sf_dir).select(F.col("fid").alias("point"), F.concat(F.lit("POLY"), F.col("town").cast("string")).alias("POLYGON_ID"), F.concat(F.lit("PDP"), F.col("fid").cast("string")).alias("PDP_ID"))
    return trenches.owned(lines, known)


TRENCH_IDS_SQL = f"""WITH {DEVICES_SQL}, o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'P' || o_custkey END AS area FROM orders)
SELECT o_orderkey, CASE WHEN area IS NULL AND fid IS NOT NULL THEN 'POLY' || town ELSE area END AS POLYGON_ID, CASE WHEN area IS NULL AND fid IS NOT NULL THEN 'PDP' || fid ELSE CAST(o_custkey AS VARCHAR) END AS PDP_ID FROM o LEFT JOIN devices ON fid = o_custkey"""


# ---- results that plain SQL does not express ----


def region_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.premises(spark, sf_dir).select("fid", "x", "y", "hh")
    walls = spatial.segments(V.roads(spark, sf_dir).where(relational.restricted(F.col("fclass"))).select("fid", "line"), "fid")
    areas = regions.service_areas(p, walls)
    t = regions.area_table(p, areas, regions.hulls(p, areas).select("area", "area_m2"))
    return t.select("area", "hh", "buildings", "review", "density", F.col("plan.label").alias("label"))


def enclosed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces that the roads of every town and a slanted road across it enclose, by area."""
    r = V.roads(spark, sf_dir).select("fid", "town", "line")
    at = lambda d: geometry.point(F.col("town") * V.TOWN + d, F.lit(d))
    across = r.select("town").distinct().select((-1 - F.col("town")).alias("fid"), "town", geometry.line(at(-50), at(1050)).alias("line"))
    f = faces.polygonised(r.unionByName(across), 100.0)
    west = F.array_min(F.transform(F.col("rings")[0], lambda p: p["x"]))
    return f.groupBy(F.floor((west + 1) / V.TOWN).alias("town"), F.round("area_m2", 2).alias("area_m2")).agg(F.count("*").alias("n"), F.sum(F.size("rings")).alias("rings"))


FACES_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS town, area_m2, n, n AS rings FROM nation, (VALUES (10000.0::DOUBLE, 90::BIGINT), (5000.0::DOUBLE, 20::BIGINT)) a(area_m2, n)"


def covered_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters as areas of their premises: polygons from cells, hulls and the roads between, grown until they cover all; buildings and homes in
    all, members outside their polygon, and square metres that two polygons share."""
    p = V.premises(spark, sf_dir)
    hit = spatial.last_polygon(spatial.point_in_polygon(p, V.quarters(spark, sf_dir), 250.0)).select("fid", F.substring("poly", 5, 9).cast("long").alias("area"))
    members = p.select("fid", "x", "y", "hh").join(hit, "fid")
    walls = spatial.segments(V.roads(spark, sf_dir).where(relational.restricted(F.col("fclass"))).select("fid", "line"), "fid")
    after, shapes = territories.covering(members, territories.area_polygons(members, walls))
    outside = territories.uncovered(after, shapes, 100.0).agg(F.count("*").alias("outside"))
    sums = after.agg(F.count("*").alias("buildings"), F.sum("hh").cast("long").alias("homes")).join(outside)
    line = F.flatten("rings")
    met = spatial.box_pairs(shapes.select(F.col("area").alias("fid"), "rings", line.alias("line")), shapes.select(F.col("area").alias("other"), F.col("rings").alias("theirs"), line.alias("other_line")), 250.0).where("fid < other")
    both = met.select(F.concat_ws(":", "fid", "other").alias("grp"), F.explode(F.array(F.struct(F.lit("a").alias("role"), "rings"), F.struct(F.lit("b").alias("role"), F.col("theirs").alias("rings")))).alias("s")).select("grp", "s.role", "s.rings")
    shared = overlay.overlay(both, "intersection", 250.0).agg(F.round(F.coalesce(F.sum("area_m2"), F.lit(0.0)), 2).alias("shared_m2"))
    return sums.join(shared)


COVERED_SQL = f"""WITH {V.PREMISES_SQL}, {V.QUARTERS_SQL}, m AS (SELECT DISTINCT fid, hh FROM premises JOIN quarters ON x BETWEEN x0 AND x0 + 500 AND y BETWEEN y0 AND y0 + 500)
SELECT count(*) AS buildings, CAST(sum(hh) AS BIGINT) AS homes, 0::BIGINT AS outside, 0.0::DOUBLE AS shared_m2 FROM m"""


def pdp_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.premises(spark, sf_dir)
    hit = spatial.last_polygon(spatial.point_in_polygon(p, V.quarters(spark, sf_dir), 250.0)).select("fid", F.substring("poly", 5, 9).cast("long").alias("area"))
    s = network.scores(p, hit, network.candidates(V.roads(spark, sf_dir))).withColumn("town", F.floor(F.col("area") / 4).cast("long"))
    centres = p.join(hit, "fid").groupBy("area").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("hh").alias("hh")).withColumn("town", F.floor(F.col("area") / 4).cast("long"))
    points = network.assigned(s, hit, centres, "town")
    return network.distribution_points(points, centres).select("area", "PDP_ID", "cand", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "hh", F.col("plan.label").alias("label"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways from each town's centre to all crossings."""
    _, e = street_graph(spark, sf_dir)
    n = e.select("town", F.col("u").alias("node")).union(e.select("town", "v")).distinct()
    at = lambda i: F.split("node", ":")[i].cast("long")
    centre = (at(0) == F.col("town") * V.TOWN + 500) & (at(1) == 500)
    t = n.select("town", F.col("node").alias("id"), "node", centre.alias("source"))
    return routing.routes(e, t, "town")


ASSIGNMENT_SQL = f"""WITH RECURSIVE {V.PREMISES_SQL}, {V.QUARTERS_SQL}, h AS (SELECT fid, x, y, hh, max(seq) AS area FROM premises JOIN quarters ON x BETWEEN x0 AND x0 + 500 AND y BETWEEN y0 AND y0 + 500 GROUP BY 1, 2, 3, 4),
c AS (SELECT area, area // 4 AS town, avg(x) AS cx, avg(y) AS cy, CAST(sum(hh) AS INTEGER) AS hh FROM h GROUP BY 1), k AS (SELECT (n_nationkey * 22 + v * 11 + i) || '_' || n AS cand, CAST(n_nationkey * 20000 + CASE v WHEN 0 THEN n * 30 ELSE i * 100 END AS DOUBLE) AS x, CAST(CASE v WHEN 0 THEN i * 100 ELSE n * 30 END AS DOUBLE) AS y
  FROM nation, range(11) a(i), range(2) b(v), range(34) d(n) WHERE least(n * 30 % 100, 100 - n * 30 % 100) >= 20),
s AS (SELECT c.area, cand, k.x, k.y, sum(CAST(round(sqrt(power(h.x - k.x, 2) + power(h.y - k.y, 2)), 6) AS DECIMAL(20, 6))) AS total
FROM c JOIN k ON sqrt(power(cx - k.x, 2) + power(cy - k.y, 2)) <= 150 JOIN h ON h.area = c.area GROUP BY 1, 2, 3, 4), o AS (SELECT town, area, row_number() OVER (PARTITION BY town ORDER BY area) AS n FROM c),
w AS (SELECT area, list({{'cand': cand, 'x': x, 'y': y}} ORDER BY total, cand) AS wishes FROM s GROUP BY area),
r AS (SELECT DISTINCT town, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS area, CAST(NULL AS STRUCT(cand VARCHAR, x DOUBLE, y DOUBLE)) AS pick FROM o
  UNION ALL SELECT q.town, q.n, list_append(q.used, q.pick.cand), q.area, q.pick FROM (SELECT o.town, o.n, r.used, o.area, list_filter(wishes, lambda z: NOT list_contains(r.used, z.cand))[1] AS pick FROM r JOIN o ON o.town = r.town AND o.n = r.n + 1 LEFT JOIN w ON w.area = o.area) q),
hhs AS (SELECT DISTINCT hh FROM c), {PLAN_SQL}
SELECT r.area, 'PDP' || lpad(CAST(row_number() OVER (ORDER BY r.area) AS VARCHAR), 5, '0') AS "PDP_ID", pick.cand AS cand, round(coalesce(pick.x, cx), 3) AS x, round(coalesce(pick.y, cy), 3) AS y, CAST(c.hh AS BIGINT) AS hh, label
FROM r JOIN c ON c.area = r.area LEFT JOIN plan ON plan.hh = c.hh"""



def feeder_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routed(spark, sf_dir)
    paths = r.select(F.col("town").cast("string").alias("mfg_id"), "id", F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.concat_ws(">", a, b)).alias("path")).withColumn("lengths", F.transform("path", lambda _: F.lit(100.0)))
    return ducts.feeder_ducts(paths)


def distribution_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = routed(spark, sf_dir)
    return ducts.distribution_ducts(r.select(F.col("town").cast("string").alias("pdp_id"), F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "L").otherwise("R").alias("side"), "id", "path", "dist"))


def plan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and metres of every layer of the whole plan over all premises."""
    layers = plan(V.premises(spark, sf_dir).select("fid", "x", "y", "hh", "town"), V.roads(spark, sf_dir))
    out = None
    for name, df in layers.items():
        metres = next((c for c in ("length_m", "dist_m", "distance_m") if c in df.columns), None)
        row = df.agg(F.lit(name).alias("layer"), F.count("*").alias("rows"), F.round(F.sum(metres) if metres else F.lit(None).cast("double"), 1).alias("metres"))
        out = row if out is None else out.unionByName(row)
    return out



def crossed_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted lines cut wherever they meet: pieces in order and their lengths."""
    cut = overlay.planarised(V.lanes(spark, sf_dir), 60.0, 0.021)
    return cut.select("fid", "piece", F.round("length", 4).alias("length"))


CROSSED_SQL = f"""WITH {V.LANES_SQL}, p AS (SELECT s.fid, s.ax, s.ay, s.bx, s.by_, o.ax AS ox, o.ay AS oy, o.bx AS px, o.by_ AS py FROM lanes s JOIN lanes o ON s.town = o.town AND s.fid <> o.fid AND abs(s.ax - o.ax) < 330 AND abs(s.ay - o.ay) < 330),
d AS (SELECT *, (bx - ax) * (py - oy) - (by_ - ay) * (px - ox) AS den, power(bx - ax, 2) + power(by_ - ay, 2) AS n FROM p),
c AS (SELECT *, ((ox - ax) * (py - oy) - (oy - ay) * (px - ox)) / nullif(den, 0) AS t, ((ox - ax) * (by_ - ay) - (oy - ay) * (bx - ax)) / nullif(den, 0) AS u FROM d),
x AS (SELECT fid, ax, ay, bx, by_, n, ax + t * (bx - ax) AS x, ay + t * (by_ - ay) AS y, ox, oy, px, py FROM c WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
e AS (SELECT fid, ax, ay, bx, by_, n, x, y FROM x WHERE least(sqrt(power(x - ax, 2) + power(y - ay, 2)), sqrt(power(x - bx, 2) + power(y - by_, 2)), sqrt(power(x - ox, 2) + power(y - oy, 2)), sqrt(power(x - px, 2) + power(y - py, 2))) > 0.021
  UNION SELECT fid, ax, ay, bx, by_, n, q.x, q.y FROM d, unnest([{{'x': ox, 'y': oy}}, {{'x': px, 'y': py}}]) z(q) WHERE sqrt(power(q.x - ax, 2) + power(q.y - ay, 2)) > 0.021 AND sqrt(power(q.x - bx, 2) + power(q.y - by_, 2)) > 0.021
    AND sqrt(power(q.x - ax - greatest(0, least(1, ((q.x - ax) * (bx - ax) + (q.y - ay) * (by_ - ay)) / n)) * (bx - ax), 2) + power(q.y - ay - greatest(0, least(1, ((q.x - ax) * (bx - ax) + (q.y - ay) * (by_ - ay)) / n)) * (by_ - ay), 2)) <= 0.021),
t AS (SELECT fid, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / n AS t, x, y, sqrt(n) AS size FROM e), k AS (SELECT *, lag(t) OVER (PARTITION BY fid ORDER BY t, x, y) AS before FROM t WHERE t > 0 AND t < 1),
m AS (SELECT fid, t, x, y FROM k WHERE before IS NULL OR (t - before) * size > 0.021 UNION ALL SELECT fid, 0, ax, ay FROM lanes UNION ALL SELECT fid, 1, bx, by_ FROM lanes),
w AS (SELECT fid, t, x, y, lead(x) OVER o AS nx, lead(y) OVER o AS ny, row_number() OVER o AS piece FROM m WINDOW o AS (PARTITION BY fid ORDER BY t))
SELECT fid, CAST(piece AS INTEGER) AS piece, round(sqrt(power(nx - x, 2) + power(ny - y, 2)), 4) AS length FROM w WHERE nx IS NOT NULL"""


def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains, forks and rings of lines, merged where exactly two ends meet."""
    m = chains.merged_lines(V.links(spark, sf_dir))
    return m.select("chain", "n", "closed", F.round("length", 4).alias("length"), F.array_join(F.array_sort("fids"), ",").alias("fids"))


CHAINS_SQL = f"""WITH RECURSIVE {V.LINKS_SQL}, e AS (SELECT fid, 0 AS e, ax AS x, ay AS y FROM links UNION ALL SELECT fid, 1, bx, by_ FROM links),
n AS (SELECT x, y, min({{'f': fid, 'e': e}}) AS p, max({{'f': fid, 'e': e}}) AS q FROM e GROUP BY 1, 2 HAVING count(*) = 2), l AS (SELECT p.f AS a, q.f AS b FROM n UNION ALL SELECT q.f, p.f FROM n),
r AS (SELECT fid AS a, fid AS b FROM links UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a AS fid, min(b) AS chain FROM r GROUP BY a), k AS (SELECT a, count(*) AS ends FROM l GROUP BY a)
SELECT chain, count(*) AS n, sum(coalesce(ends, 0)) = 2 * count(*) AS closed, round(sum(sqrt(power(bx - ax, 2) + power(by_ - ay, 2))), 4) AS length, string_agg(CAST(links.fid AS VARCHAR), ',' ORDER BY links.fid) AS fids
FROM links JOIN c ON c.fid = links.fid LEFT JOIN k ON k.a = links.fid GROUP BY chain"""


def shared_area(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    found = overlay.against(V.lots(spark, sf_dir), V.buildings(spark, sf_dir), rule, 60.0)
    return found.select("fid", F.round("area_m2", 2).alias("area_m2"))


def carved_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilted lots, some with holes, without the tilted buildings on them."""
    return shared_area(spark, sf_dir, "difference")


def built_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all buildings together cover of each lot."""
    return shared_area(spark, sf_dir, "intersection")


def lots_sql(wanted: str) -> str:
    """Along the axes u = x + y and v = x - y tilted squares are upright: a lot is cut into cells at every edge in it, and a cell
    (of half its area in u and v) is in it or not, built on or not."""
    return f"""WITH {V.LOTS_SQL}, s AS (SELECT fid, town, x + y AS u, x - y AS v, reach, hole FROM lots), o AS (SELECT town, x + y AS u, x - y AS v, reach FROM buildings),
    n AS (SELECT fid, s.u - s.reach AS u0, s.u + s.reach AS u1, s.v - s.reach AS v0, s.v + s.reach AS v1, o.u - o.reach AS a0, o.u + o.reach AS a1, o.v - o.reach AS b0, o.v + o.reach AS b1 FROM s JOIN o ON s.town = o.town AND abs(s.u - o.u) < s.reach + o.reach AND abs(s.v - o.v) < s.reach + o.reach),
    cu AS (SELECT fid, u - reach AS c FROM s UNION SELECT fid, u + reach FROM s UNION SELECT fid, u - hole FROM s UNION SELECT fid, u + hole FROM s UNION SELECT fid, greatest(u0, a0) FROM n UNION SELECT fid, least(u1, a1) FROM n),
    cv AS (SELECT fid, v - reach AS c FROM s UNION SELECT fid, v + reach FROM s UNION SELECT fid, v - hole FROM s UNION SELECT fid, v + hole FROM s UNION SELECT fid, greatest(v0, b0) FROM n UNION SELECT fid, least(v1, b1) FROM n),
    iu AS (SELECT fid, c, lead(c) OVER (PARTITION BY fid ORDER BY c) AS d FROM cu), iv AS (SELECT fid, c, lead(c) OVER (PARTITION BY fid ORDER BY c) AS d FROM cv),
    cell AS (SELECT s.fid, iu.c AS u0, iu.d AS u1, iv.c AS v0, iv.d AS v1 FROM s JOIN iu ON iu.fid = s.fid AND iu.d IS NOT NULL JOIN iv ON iv.fid = s.fid AND iv.d IS NOT NULL
      WHERE NOT (iu.c >= s.u - hole AND iu.d <= s.u + hole AND iv.c >= s.v - hole AND iv.d <= s.v + hole)),
    j AS (SELECT cell.*, EXISTS (SELECT 1 FROM n WHERE n.fid = cell.fid AND a0 <= cell.u0 AND a1 >= cell.u1 AND b0 <= cell.v0 AND b1 >= cell.v1) AS built FROM cell)
    SELECT fid, round(sum((u1 - u0) * (v1 - v0)) / 2.0, 2) AS area_m2 FROM j WHERE {wanted} GROUP BY fid"""


def lanes_past_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted lines without what lies within 20 m of a premise: how much is left, in how many pieces."""
    left = overlay.outside_discs(V.lanes(spark, sf_dir), V.premises(spark, sf_dir), 20.0)
    return left.groupBy("fid").agg(F.count("*").alias("pieces"), F.round(F.sum("length"), 4).alias("length"))


PAST_SQL = f"""WITH {V.LANES_SQL}, c AS (SELECT DISTINCT town, x, y FROM premises), d AS (SELECT fid, bx - ax AS dx, by_ - ay AS dy, ax - x AS ex, ay - y AS ey FROM lanes JOIN c USING (town)),
q AS (SELECT fid, (dx * ex + dy * ey) / (dx * dx + dy * dy) AS h, (ex * ex + ey * ey - 400) / (dx * dx + dy * dy) AS f FROM d),
i AS (SELECT fid, greatest(-h - sqrt(h * h - f), 0) AS lo, least(-h + sqrt(h * h - f), 1) AS hi FROM q WHERE h * h > f), k AS (SELECT fid, lo, hi FROM i WHERE lo < hi UNION ALL SELECT fid, 1, 1 FROM lanes),
w AS (SELECT fid, lo, greatest(0, coalesce(max(hi) OVER (PARTITION BY fid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reached FROM k)
SELECT fid, count(*) AS pieces, round(sum((lo - reached) * sqrt(power(bx - ax, 2) + power(by_ - ay, 2))), 4) AS length FROM w JOIN lanes USING (fid) WHERE lo > reached GROUP BY fid"""


def trimmed_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted lines without what lies on a building."""
    left = overlay.split_by_polygons(V.lanes(spark, sf_dir), V.buildings(spark, sf_dir), 60.0, False)
    return left.groupBy("fid").agg(F.round(F.sum("length"), 3).alias("length"))


TRIMMED_SQL = f"""WITH {V.LANES_SQL}, b AS (SELECT town, x + y AS u, x - y AS v, fid % 20 + 12 AS r FROM premises),
d AS (SELECT fid, ax + ay - u AS u, ax - ay - v AS v, bx - ax + by_ - ay AS du, bx - ax - by_ + ay AS dv, r FROM lanes JOIN b USING (town)),
t AS (SELECT fid, CASE WHEN du = 0 THEN CASE WHEN abs(u) <= r THEN 0 ELSE 2 END ELSE least((-r - u) / du, (r - u) / du) END AS u0, CASE WHEN du = 0 THEN CASE WHEN abs(u) <= r THEN 1 ELSE -1 END ELSE greatest((-r - u) / du, (r - u) / du) END AS u1,
  CASE WHEN dv = 0 THEN CASE WHEN abs(v) <= r THEN 0 ELSE 2 END ELSE least((-r - v) / dv, (r - v) / dv) END AS v0, CASE WHEN dv = 0 THEN CASE WHEN abs(v) <= r THEN 1 ELSE -1 END ELSE greatest((-r - v) / dv, (r - v) / dv) END AS v1 FROM d),
k AS (SELECT fid, greatest(0, u0, v0) AS lo, least(1, u1, v1) AS hi FROM t WHERE greatest(0, u0, v0) < least(1, u1, v1) UNION ALL SELECT fid, 1, 1 FROM lanes),
w AS (SELECT fid, lo, greatest(0, coalesce(max(hi) OVER (PARTITION BY fid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reached FROM k)
SELECT fid, round(sum((lo - reached) * sqrt(power(bx - ax, 2) + power(by_ - ay, 2))), 3) AS length FROM w JOIN lanes USING (fid) WHERE lo > reached + 1e-9 GROUP BY fid"""


SQL = {
    crossed_lanes: CROSSED_SQL, merged_links: CHAINS_SQL, carved_lots: lots_sql("NOT built"), built_lots: lots_sql("built"), lanes_past_crossings: PAST_SQL, trimmed_lanes: TRIMMED_SQL, covered_quarters: COVERED_SQL, enclosed_faces: FACES_SQL,
    service_summary: SERVICE_SQL, splitter_plan: SPLITTER_SQL, address_ids: ADDRESS_SQL, neighbour_counts: NEIGHBOUR_SQL, road_access: ACCESS_SQL, nearest_road: NEAREST_SQL, points_in_areas: AREAS_SQL,
    object_links: LINKS_SQL, intersection_centres: CENTRES_SQL, barrier_free: BARRIER_SQL, majority_segment: MAJORITY_SQL, group_aggregates: AGGREGATES_SQL, road_filters: FILTER_SQL, price_cells: PRICE_SQL,
    price_match: MATCH_SQL, bill_totals: TOTALS_SQL, stage_pivot: PIVOT_SQL, run_summary: SUMMARY_SQL, cache_keys: CACHE_SQL, geocode_cascade: GEOCODE_SQL, text_normalizers: TEXT_SQL, number_columns: NUMBER_SQL,
    link_overlap: OVERLAP_SQL, extent_guess: GUESS_SQL, grid_distances: GRID_SQL, nearest_source: SOURCE_SQL, healed_edges: HEAL_SQL, candidate_scores: SCORES_SQL, garden_trenches: GARDEN_SQL,
    distribution_rollup: ROLLUP_SQL, distribution_cables: CABLE_SQL, central_nodes: CENTRAL_SQL, clear_candidates: CLEAR_SQL, duplicate_ids: DUPLICATE_SQL,
    nearest_order: NEAREST_ORDER_SQL, key_union: KEY_UNION_SQL, premise_spacing: SPACING_SQL, layer_lengths: LENGTHS_SQL, cluster_order: CLUSTER_SQL, stray_premises: STRAY_SQL, tangents: TANGENT_SQL,
    used_crossings: USED_SQL, polygon_references: REFERENCES_SQL, candidate_pools: POOLS_SQL, supply_point: SUPPLY_SQL, pdp_projections: PROJECTIONS_SQL, pseudo_homes: HOMES_SQL, sidewalk_bridges: BRIDGES_SQL, bridge_spokes: SPOKES_SQL,
    virtual_nodes: VIRTUAL_SQL, merged_feeders: MERGED_SQL, clear_lines: CLEAR_OF_SQL, growth_report: REPORT_SQL, network_registry: REGISTRY_SQL, trench_ids: TRENCH_IDS_SQL,
    region_growth: None, pdp_assignment: ASSIGNMENT_SQL, feeder_bundles: None, distribution_bundles: None, plan_layers: None,
}
QUERIES = {f.__name__: f for f in SQL}
ORACLES = {f.__name__: s for f, s in SQL.items() if s}
