"""Checks of results and gates before a stage: reports are one small row or table, gates raise with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import covers
from .relational import first_field

# Names under which the ids of points and premises are known.
POINT_IDS = ["PDP_ID", "pdp_id", "pdp_pol_id"]
HOME_IDS = ["ADDR_ID", "addr_id", "HH_ID", "hh_id", "id"]


def growth_report(members: DataFrame, polygons: DataFrame, least: int, most: int) -> DataFrame:
    """areas, buildings, homes, in_band, review, floor, multi, outside in one row.

    members: fid, addr_id, area, x, y, hh; polygons: poly, rings. In the band are areas of least..most homes with three buildings or
    more; floor is the fewest areas that hold all homes; multi counts addresses in more than one area, outside the buildings
    that their own polygon does not cover. Buildings without an area are left out.
    """
    own = members.where(F.col("area").isNotNull())
    sums = own.groupBy("area").agg(F.count("*").alias("n"), F.sum("hh").alias("hh"))
    good = F.count_if(F.col("hh").between(least, most) & (F.col("n") >= 3))
    floor = F.when(F.lit(most > 0), F.ceil(F.coalesce(F.sum("hh"), F.lit(0)) / most)).otherwise(F.lit(0)).cast("long")
    areas = sums.agg(F.count("*").alias("areas"), F.coalesce(F.sum("n"), F.lit(0)).alias("buildings"), F.coalesce(F.sum("hh"), F.lit(0)).alias("homes"), good.alias("in_band"), (F.count("*") - good).alias("review"), floor.alias("floor"))
    spread = own.groupBy("addr_id").agg((F.min("area") != F.max("area")).alias("many")).agg(F.count_if("many").alias("multi"))
    held = own.join(polygons.select(F.col("poly").alias("area"), "rings"), "area").agg(F.count_if(~covers(F.col("rings"), F.col("x"), F.col("y"))).alias("outside"))
    names = [*areas.columns, "multi", "outside"]
    return areas.unionByName(spread, True).unionByName(held, True).agg(*[F.max(n).alias(n) for n in names])


def networks(polygons: DataFrame, points: DataFrame, addresses: DataFrame) -> DataFrame:
    """poly, PDP_ID, address_count of every polygon (poly) with its point (poly, PDP_ID) and its addresses (poly, addr_id).

    A polygon that occurs twice raises; what names no known polygon is left out; of several points the least counts.
    """
    if not polygons.groupBy("poly").count().where("count > 1").isEmpty():
        raise ValueError("a polygon is registered twice")
    p = points.groupBy("poly").agg(F.min("PDP_ID").alias("PDP_ID"))
    n = addresses.groupBy("poly").agg(F.count("*").alias("n"))
    return polygons.select("poly").join(p, "poly", "left").join(n, "poly", "left").select("poly", "PDP_ID", F.coalesce("n", F.lit(0)).alias("address_count"))


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, rows of every named layer."""
    parts = [df.agg(F.lit(name).alias("layer"), F.count("*").alias("rows")) for name, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cable_gate(feeder: DataFrame | None, garden: DataFrame | None, distribution: DataFrame | None) -> list[str]:
    """Raises if cables cannot be built from the trenches; returns warnings."""
    given = {"feeder": feeder, "garden": garden, "distribution": distribution}
    missing = [n for n, df in given.items() if df is None]
    if missing:
        raise ValueError(f"cables need trenches that are missing: {', '.join(missing)}")
    empty = [n for n, df in given.items() if df.isEmpty()]
    if len(empty) == 3:
        raise ValueError("all trenches are empty: there is nothing to build cables from")
    bare = [n for n in ("garden", "distribution") if not first_field(given[n], POINT_IDS)]
    if bare:
        raise ValueError(f"trenches without a point id: {', '.join(bare)}")
    return ["no feeder trench was routed: there will be no feeder cable"] if "feeder" in empty else []


def duct_gate(trenches: DataFrame | None, supply: DataFrame | None, points: DataFrame | None, objects: DataFrame | None) -> None:
    """Raises if ducts cannot be routed."""
    if trenches is None or trenches.isEmpty():
        raise ValueError("ducts need trenches to follow, and there are none")
    if supply is None or points is None:
        raise ValueError("ducts need the supply point and the distribution points")
    lacking = [what for what, names in (("point id", POINT_IDS), ("household id", HOME_IDS)) if objects is None or not first_field(objects, names)]
    if lacking:
        raise ValueError(f"objects without a {' and a '.join(lacking)}")
