"""Sources: address sheets, layers by name or path, road tables, geocode caches, logs, price and quantity tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Header words of address sheets by role, the first that exists counts.
HEADERS = {
    "address": ["Address", "Adresse", "Straße", "Strasse", "street", "Standort"],
    "house_number": ["Housenumber", "house number", "house numb", "Hausnummer", "hnr"],
    "city": ["City", "Ort", "Stadt"],
    "postcode": ["Postcode", "PLZ", "postal code", "Zip", "postal cod"],
    "country": ["Country", "Land"],
    "district": ["District", "Ortsteil", "Bezirk", "borough"],
    "household": ["HH", "HHS", "HOUSEHOLDS", "HOUSEHOLD", "HOUSEHOLD_S", "WE", "WE_anzahl", "Wohneinheiten", "No. of HH", "Anzahl WE"],
    "addr_id": ["ADDR_ID", "Adress_ID", "Address ID", "Adress ID", "Address_ID"],
    "latitude": ["LATITUDE", "Lat", "Y", "Y_COORD", "YCOORD", "POINT_Y", "northing"],
    "longitude": ["LONGITUDE", "Lon", "Lng", "X", "X_COORD", "XCOORD", "POINT_X", "easting"],
}
# Words that tell a header row.
HEADER_ROW = "Address|Adresse|Straße|Strasse|City|Ort|PLZ|Postcode|Housenumber|Hausnummer|ADDR|Adress|Zip|postal"
DEFAULTS = {"default_country": "Germany", "nominatim_email": "", "nominatim_min_delay": 1.2, "object_include_all": True, "addr_prefix": "ADDR"}
CACHE = "key string, lon double, lat double, raw string, q struct<street:string,city:string,postalcode:string,country:string>"


def layer(spark: SparkSession, source: DataFrame | str) -> DataFrame | None:
    """A frame, a view or table by name, or a Parquet, CSV or JSON path; null if there is none."""
    if isinstance(source, DataFrame):
        return source
    if "/" not in source and spark.catalog.tableExists(source):
        return spark.table(source)
    kind = source.rsplit(".", 1)[-1].lower()
    try:
        if kind == "csv":
            return spark.read.csv(source, header=True)
        return spark.read.json(source) if kind in ("json", "jsonl") else spark.read.parquet(source)
    except AnalysisException:
        return None


def layer_like(spark: SparkSession, part: str) -> DataFrame | None:
    """The first table or view, by name, that holds the text."""
    names = sorted(t.name for t in spark.catalog.listTables() if part.lower() in t.name.lower())
    return spark.table(names[0]) if names else None


def filled_layer(candidates: list[DataFrame]) -> DataFrame | None:
    """The first non-empty point layer (it has x and y), else the first non-empty one."""
    full = [df for df in candidates if not df.isEmpty()]
    return next((df for df in full if {"x", "y"} <= {c.lower() for c in df.columns}), full[0] if full else None)


def empty_layer(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """An address sheet from CSV, all text, without empty rows; a header in the first data row is promoted."""
    df = spark.read.csv(path, header=True, nullValue="")
    return promoted(df).dropna(how="all")


def promoted(df: DataFrame) -> DataFrame:
    """If over half of the columns have no name and the first row looks like a header, it becomes the header."""
    unnamed = [c for c in df.columns if re.match(r"Unnamed|_c\d+$", c)]
    first = df.first() if len(unnamed) * 2 > len(df.columns) else None
    values = ["" if v is None else str(v).strip() for v in first] if first else []
    if not any(re.search(HEADER_ROW, v, re.IGNORECASE) for v in values):
        return df
    same = F.lit(True)
    for c, v in zip(df.columns, first, strict=True):
        same = same & F.col(f"`{c}`").eqNullSafe(F.lit(v))
    # of equal rows only the first is the header
    place = df.select("*", F.monotonically_increasing_id().alias("_place"))
    top = place.where(same).agg(F.min("_place")).first()[0]
    return place.where(F.col("_place") != F.lit(top)).drop("_place").toDF(*[v or f"col_{i}" for i, v in enumerate(values)])


def mapping(df: DataFrame) -> dict[str, str]:
    """Role -> column. Coordinates are the first names with a number anywhere; one pass over the table decides them."""
    have = {c.lower(): c for c in df.columns}
    found = {role: next((have[n.lower()] for n in names if n.lower() in have), None) for role, names in HEADERS.items()}
    names = [have[n.lower()] for role in ("latitude", "longitude") for n in HEADERS[role] if n.lower() in have]
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("string").try_cast("double"), F.lit(None).cast("double"))
    facts = df.agg(F.lit(0).alias("_"), *[F.count(number(c)).alias(c) for c in dict.fromkeys(names)]).first().asDict() if names else {}
    for role in ("latitude", "longitude"):
        found[role] = next((have[n.lower()] for n in HEADERS[role] if n.lower() in have and facts[have[n.lower()]]), found[role])
    lat, lon = found["latitude"], found["longitude"]
    if lat and lon:
        if df.where(number(lat).isNotNull() & number(lon).isNotNull()).isEmpty():
            found["latitude"] = found["longitude"] = None
    else:
        for role, most in (("latitude", 90), ("longitude", 180)):
            if found[role] and df.where(number(found[role]).between(-most, most)).isEmpty():
                found[role] = None
    return {r: c for r, c in found.items() if c}


def roads(spark: SparkSession, source: DataFrame | str, box: tuple[float, float, float, float] | None = None, grow: float = 0.003) -> DataFrame:
    """Rows of a lines table that have a highway class, and whose box meets a grown one; both conditions reach the scan."""
    df = layer(spark, source).where("highway IS NOT NULL")
    if box:
        x0, y0, x1, y1 = box
        df = df.where((F.col("xmax") >= x0 - grow) & (F.col("xmin") <= x1 + grow) & (F.col("ymax") >= y0 - grow) & (F.col("ymin") <= y1 + grow))
    return df


def buildings(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    return layer(spark, source).where("building IS NOT NULL")


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each key, in file and line order; corrupt lines and records without both coordinates do not count."""
    rows = spark.read.schema(CACHE + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n")))
    return latest(rows.where("_bad IS NULL"))


def latest(rows: DataFrame) -> DataFrame:
    """key, lon, lat of the last record (by column at) of each key, if it has a place."""
    last = rows.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("lon", "lat"), "at").alias("p"))
    return last.select("key", "p.lon", "p.lat").where("lon IS NOT NULL AND lat IS NOT NULL")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log, line_no, line: one log per file."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))
    return text


def quantities(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a bill of quantities; a missing file gives none."""
    df = layer(spark, path)
    return df if df is not None else empty_layer(spark, "section string, item_code string, item_name string, unit string, quantity string, unit_price string, amount string, notes string")


def profile(path: str | None = None, **over) -> dict:
    """Settings: defaults, then the file, then what is given and not null."""
    told = json.load(open(path)) if path else {}
    return DEFAULTS | told | {k: v for k, v in over.items() if v is not None}


def has_value(column: Column) -> Column:
    return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))
