"""Planning views over the shared tables: one town of 1 km per nation, all places derived from keys by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import line, point

TOWN = 20000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, town, x, y, hh, addr_id, segment: one premise per customer."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return c.select(
        k.alias("fid"), F.col("c_nationkey").alias("town"), (F.col("c_nationkey") * TOWN + k * 7919 % 1009).cast("double").alias("x"), (k * 6151 % 1013).cast("double").alias("y"),
        (k % 12 + 1).cast("int").alias("hh"), F.concat(F.lit("ADDR"), F.lpad(k.cast("string"), 9, "0")).alias("addr_id"), F.col("c_mktsegment").alias("segment"),
    )


PREMISES_SQL = f"""premises AS (SELECT c_custkey AS fid, c_nationkey AS town, CAST(c_nationkey * {TOWN} + c_custkey * 7919 % 1009 AS DOUBLE) AS x,
  CAST(c_custkey * 6151 % 1013 AS DOUBLE) AS y, CAST(c_custkey % 12 + 1 AS INTEGER) AS hh, c_mktsegment AS segment FROM customer)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, town, fclass, area, bridge, tunnel, line: eleven roads each way in every town."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("town"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).select("town", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    x0, at = F.col("town") * TOWN, F.col("i") * 100
    flat, up = line(point(x0, at), point(x0 + 1000, at)), line(point(x0 + at, F.lit(0)), point(x0 + at, F.lit(1000)))
    kind = F.when(F.col("i") == 5, "primary").when(F.col("i") == 3, "footway").when(F.col("i") == 7, "service").when(F.col("i") == 9, "motorway_link").otherwise("residential")
    return n.select((F.col("town") * 22 + F.col("v") * 11 + F.col("i")).alias("fid"), "town", kind.alias("fclass"), F.when(F.col("i") == 3, "T").alias("area"), F.when(F.col("i") == 8, "T").alias("bridge"), F.lit(None).cast("string").alias("tunnel"), F.when(F.col("v") == 0, flat).otherwise(up).alias("line"))


ROADS_SQL = f"""roads AS (SELECT n_nationkey * 22 + v * 11 + i AS fid, n_nationkey AS town, i, v,
  CASE i WHEN 5 THEN 'primary' WHEN 3 THEN 'footway' WHEN 7 THEN 'service' WHEN 9 THEN 'motorway_link' ELSE 'residential' END AS fclass,
  CASE WHEN i = 3 THEN 'T' END AS area, CASE WHEN i = 8 THEN 'T' END AS bridge,
  CAST(n_nationkey * {TOWN} + CASE v WHEN 0 THEN 0 ELSE i * 100 END AS DOUBLE) AS ax, CAST(CASE v WHEN 0 THEN i * 100 ELSE 0 END AS DOUBLE) AS ay,
  CAST(n_nationkey * {TOWN} + CASE v WHEN 0 THEN 1000 ELSE i * 100 END AS DOUBLE) AS bx, CAST(CASE v WHEN 0 THEN i * 100 ELSE 1000 END AS DOUBLE) AS by_
  FROM nation, range(11) a(i), range(2) b(v))"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly, seq, rings: four squares of half a kilometre in every town, that share their edges."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("town"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    x, y = F.col("town") * TOWN + (F.col("q") % 2) * 500, F.floor(F.col("q") / 2) * 500
    ring = line(point(x, y), point(x + 500, y), point(x + 500, y + 500), point(x, y + 500), point(x, y))
    seq = F.col("town") * 4 + F.col("q")
    return n.select(F.concat(F.lit("POLY"), F.lpad(seq.cast("string"), 5, "0")).alias("poly"), seq.alias("seq"), F.array(ring).alias("rings"))


QUARTERS_SQL = f"""quarters AS (SELECT 'POLY' || lpad(CAST(n_nationkey * 4 + q AS VARCHAR), 5, '0') AS poly, n_nationkey * 4 + q AS seq,
  n_nationkey * {TOWN} + (q % 2) * 500 AS x0, (q // 2) * 500 AS y0 FROM nation, range(4) a(q))"""


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, town, line: the roads, for graphs."""
    return roads(spark, sf_dir).select("fid", "town", "line")


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a bill: item_id, item, unit, section, quantity, from line items and their parts."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    k = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    section = F.element_at(F.array(*map(F.lit, ["Trenches", "Ducts", "Cables", "Crossings", "Other"])), (F.col("l_orderkey") % 5 + 1).cast("int"))
    j = k.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.col("p_type").alias("item"), F.lower("l_returnflag").alias("unit"), section.alias("section"), F.col("l_quantity").alias("quantity"))


QUANTITIES_SQL = """quantities AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, p_type AS item, lower(l_returnflag) AS unit,
  (['Trenches', 'Ducts', 'Cables', 'Crossings', 'Other'])[CAST(l_orderkey % 5 + 1 AS INTEGER)] AS section, l_quantity AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, code, desc, unit, unit_price: one priced row per part."""
    unit = F.element_at(F.array(*map(F.lit, ["A", "N", "R", "x"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_partkey").cast("string").alias("code"), F.concat_ws(" ", "p_type", "p_brand").alias("desc"), unit.alias("unit"), F.col("p_retailprice").alias("unit_price"))


PRICES_SQL = "prices AS (SELECT p_partkey AS row_, CAST(p_partkey AS VARCHAR) AS code, p_type || ' ' || p_brand AS desc_, (['A', 'N', 'R', 'x'])[CAST(p_partkey % 4 + 1 AS INTEGER)] AS unit, p_retailprice AS unit_price FROM part)"


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log (user), line_no, line: every user's events as the lines of one log with a start marker before each tenth event."""
    from ..operators.logs import STAGES, START

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value").where("user_id IS NOT NULL AND value IS NOT NULL")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 6 + 1).cast("int"))
    secs = F.format_string("%.3f", F.floor(F.abs("value") * 1000) / 1000)
    text = F.concat(F.lit("  [timing] "), stage, F.lit(": "), (F.col("event_id") % 900 + 10).cast("string"), F.lit(" features, "), secs, F.lit("s"))
    rows = e.select(F.col("user_id").alias("log"), (F.col("event_id") * 2 + 1).alias("line_no"), text.alias("line"))
    starts = e.where("event_id % 10 = 0").select(F.col("user_id").alias("log"), (F.col("event_id") * 2).alias("line_no"), F.lit(START).alias("line"))
    totals = e.where("event_id % 10 = 7").select(F.col("user_id").alias("log"), (F.col("event_id") * 2).alias("line_no"), F.concat(F.lit("[timing] Total pipeline: "), secs, F.lit("s")).alias("line"))
    return rows.unionByName(starts).unionByName(totals)


LOG_SQL = """ev AS (SELECT event_id, user_id AS log, floor(abs(value) * 1000) / 1000 AS secs, event_id % 6 AS st FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
  numbered AS (SELECT *, sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY event_id) AS run FROM ev)"""


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, line: a slanted line of up to 113 m from the place of every premise; whole metres."""
    k = F.col("fid")
    dx, dy = k * 37 % 161 - 80, k * 53 % 161 - 80
    return premises(spark, sf_dir).select("fid", line(point(F.col("x"), F.col("y")), point(F.col("x") + dx, F.col("y") + dy)).alias("line"))


LANES_SQL = f"{PREMISES_SQL}, lanes AS (SELECT fid, town, x AS ax, y AS ay, x + fid * 37 % 161 - 80 AS bx, y + fid * 53 % 161 - 80 AS by_ FROM premises WHERE fid * 37 % 161 <> 80 OR fid * 53 % 161 <> 80)"


def diamond(x, y, reach):
    """Ring of the places whose distances along x and y from a place sum to at most reach: a square on its tip."""
    return line(point(x + reach, y), point(x, y + reach), point(x - reach, y), point(x, y - reach), point(x + reach, y))


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, town, rings: a tilted square of 90 to 180 m from middle to tip for every supplier, with a square hole in every third."""
    k = F.col("s_suppkey")
    x, y, reach = F.col("s_nationkey") * TOWN + k * 613 % 997, k * 419 % 991, k % 10 * 10 + 90
    rings = F.when(k % 3 == 0, F.array(diamond(x, y, reach), diamond(x, y, F.lit(40)))).otherwise(F.array(diamond(x, y, reach)))
    return table(spark, sf_dir, "supplier").select(k.alias("fid"), F.col("s_nationkey").alias("town"), rings.alias("rings"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly, rings: a tilted square of 12 to 31 m from middle to tip around every premise."""
    return premises(spark, sf_dir).select(F.col("fid").alias("poly"), F.array(diamond(F.col("x"), F.col("y"), F.col("fid") % 20 + 12)).alias("rings"))


LOTS_SQL = f"""{PREMISES_SQL}, lots AS (SELECT s_suppkey AS fid, s_nationkey AS town, s_nationkey * {TOWN} + s_suppkey * 613 % 997 AS x, s_suppkey * 419 % 991 AS y, s_suppkey % 10 * 10 + 90 AS reach, CASE WHEN s_suppkey % 3 = 0 THEN 40 ELSE 0 END AS hole FROM supplier),
  buildings AS (SELECT fid AS poly, town, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, fid % 20 + 12 AS reach FROM premises)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, line: three lines for every customer key at most: chains broken at every seventh key, forks at every eleventh, rings of three."""
    k = F.col("c_custkey")
    spot = lambda k, up: point(k * 7919 % 1009, k * 6151 % 1013 + up)
    chain = F.when(k % 7 != 0, line(spot(k, 0), spot(k + 1, 0)))
    fork = F.when(k % 11 == 0, line(spot(k + 4, 0), spot(k, 0)))
    ring = line(spot(k, 5000), spot(F.when(k % 3 == 0, k - 2).otherwise(k + 1), 5000))
    each = table(spark, sf_dir, "customer").select(k, F.posexplode(F.array(chain, fork, ring)).alias("i", "line"))
    return each.where("line IS NOT NULL").select((k * 3 + F.col("i")).alias("fid"), "line")


LINKS_SQL = """spots AS (SELECT c_custkey AS k, c_custkey * 3 AS fid, c_custkey AS a, c_custkey + 1 AS b, 0 AS up FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, c_custkey * 3 + 1, c_custkey + 4, c_custkey, 0 FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT c_custkey, c_custkey * 3 + 2, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 2 ELSE c_custkey + 1 END, 5000 FROM customer),
  links AS (SELECT fid, a * 7919 % 1009 AS ax, a * 6151 % 1013 + up AS ay, b * 7919 % 1009 AS bx, b * 6151 % 1013 + up AS by_ FROM spots)"""
