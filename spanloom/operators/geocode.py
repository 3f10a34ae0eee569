"""Object layer: premises from sheet rows, by their own coordinates or a cascade over a geocode cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import from_utm, or_placeholder
from ..functions.text import cache_key


def attempts(q: Column, ascii_only: bool = False) -> list[tuple[str, Column]]:
    """Cache keys of the four tries: all parts, then without the postcode, without the city, without the street."""
    blank = F.lit("")
    of = lambda street, city, code: cache_key(street, city, code, q["country"], ascii_only)
    return [("full", of(q["street"], q["city"], q["postalcode"])), ("no_postcode", of(q["street"], q["city"], blank)), ("no_city", of(q["street"], blank, q["postalcode"])), ("no_street", of(blank, q["city"], q["postalcode"]))]


def objects(rows: DataFrame, cache: DataFrame, crs: str = "EPSG:25833", ascii_only: bool = False) -> DataFrame:
    """rows (fid, lon, lat, q struct) -> fid, lon, lat, x, y, status, source, tries.

    Rows with both numbers keep them: degrees if they are within their range, else coordinates of the output system. The
    others try the four keys; the first that the cache knows wins. One pass explodes the keys, so the cache is joined once and
    only for rows that need it. Unknown places get a placeholder far north.
    """
    num = lambda c: F.col(c).cast("string").try_cast("double")
    rows = rows.withColumns({"_x": num("lon"), "_y": num("lat")})
    own = rows.where("_x IS NOT NULL AND _y IS NOT NULL")
    degrees = F.col("_x").between(-180, 180) & F.col("_y").between(-90, 90)
    back = from_utm(F.col("_x"), F.col("_y"), crs)
    named = own.select("fid", F.when(degrees, F.col("_x")).otherwise(back["x"]).alias("lon"), F.when(degrees, F.col("_y")).otherwise(back["y"]).alias("lat"), "_x", "_y", F.lit("ok").alias("status"), F.when(degrees, "sheet_lonlat").otherwise("sheet_xy").alias("source"), F.lit("from_sheet").alias("tries"))
    named = named.select("fid", "lon", "lat", F.col("_x").alias("x"), F.col("_y").alias("y"), "status", "source", "tries")
    ask = rows.where("_x IS NULL OR _y IS NULL").select("fid", "q")
    keys = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(name).alias("try"), k.alias("key")) for i, (name, k) in enumerate(attempts(F.col("q"), ascii_only))])
    tried = ask.select("fid", F.explode(keys).alias("k")).select("fid", "k.n", "k.try", "k.key")
    hit = tried.join(cache.select("key", F.col("lon").alias("clon"), F.col("lat").alias("clat")), "key")
    first = hit.groupBy("fid").agg(F.min_by(F.struct("n", "clon", "clat"), "n").alias("h"))
    place = or_placeholder(F.col("h.clon"), F.col("h.clat"))
    n = F.coalesce(F.col("h.n") + 1, F.lit(4))
    log = F.to_json(F.transform(F.slice(F.array(*[F.lit(name) for name, _ in attempts(F.col("q"), True)]), 1, n), lambda t: F.struct(t.alias("try"), F.lit(True).alias("from_cache"))))
    found = ask.join(first, "fid", "left").select("fid", F.col("h.clon").alias("lon"), F.col("h.clat").alias("lat"), place["x"].alias("x"), place["y"].alias("y"), F.when(F.col("h").isNotNull(), "ok").otherwise("not_found").alias("status"), F.when(F.col("h").isNotNull(), "nominatim_cache").otherwise("nominatim").alias("source"), log.alias("tries"))
    return named.unionByName(found)


def counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("not_found"))
