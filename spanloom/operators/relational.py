"""Attribute operators: schema picks, filters, aggregates, numbering, links between layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import key

# Road classes.
DIGGABLE = ["residential", "living_street", "unclassified", "tertiary", "secondary", "primary", "service"]
NO_DIG = ["motorway", "motorway_link", "trunk", "trunk_link", "primary_link", "raceway", "road", "parking_aisle", "busway", "rest_area", "services"]
TRENCH = ["residential", "unclassified", "living_street", "service", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "trunk", "trunk_link"]
TRENCH_NOT = ["motorway", "motorway_link", "track", "path", "footway", "steps"]
FOOT = ["footway", "path", "pedestrian", "cycleway", "steps", "bridleway", "sidewalk"]
RESTRICTED = ["motorway", "trunk", "primary", "secondary"]
CLASS_NAMES = ["fclass", "highway", "class"]


def first_field(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that is a column, whatever its case; of columns that differ by case the last."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def thin(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, as far as they exist, in the given order."""
    return df.select(*[c for n in names if (c := first_field(df, [n]))])


def with_missing(df: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Adds columns without touching existing ones."""
    return df.withColumns({n: c for n, c in extra.items() if first_field(df, [n]) is None})


def unique_names(names: list[str]) -> list[str]:
    """Names that differ only by case get _NEW, then _NEW_v2 and so on."""
    seen, out = set(), []
    for n in names:
        new, k = n, 1
        while new.lower() in seen:
            new = f"{n}_NEW" if k == 1 else f"{n}_NEW_v{k}"
            k += 1
        seen.add(new.lower())
        out.append(new)
    return out


def road_class(df: DataFrame) -> Column | None:
    name = first_field(df, CLASS_NAMES)
    return F.col(name) if name else None


def candidate_roads(df: DataFrame, classes: list[str] = DIGGABLE) -> DataFrame:
    """Roads of the classes; if there are none, those with any describing attribute; if none either, all."""
    c = road_class(df)
    if c is not None:
        some = df.where(c.isin(classes))
        if not some.isEmpty():
            return some
    told = [F.col(n) for n in ("name", "ref", "maxspeed", "layer", "bridge", "tunnel") if first_field(df, [n])]
    if told:
        some = df.where(F.coalesce(*[t.cast("string") for t in told]).isNotNull())
        if not some.isEmpty():
            return some
    return df


def diggable(df: DataFrame) -> DataFrame:
    """Without classes that no duct can follow, and without roads of no class; unchanged if that leaves nothing."""
    c = road_class(df)
    if c is None:
        return df
    some = df.where(~c.isin(NO_DIG))
    return df if some.isEmpty() else some


def not_area(df: DataFrame) -> Column:
    return F.lower(F.coalesce(F.col("area").cast("string"), F.lit("f"))) != "t" if first_field(df, ["area"]) else F.lit(True)


def trench_road(df: DataFrame) -> Column:
    """Predicate of roads that trenches may follow."""
    c = road_class(df)
    flag = lambda n: F.coalesce(F.col(n), F.lit("F")) != "T" if first_field(df, [n]) else F.lit(True)
    return (c.isin(TRENCH) | ((c == "pedestrian") & flag("area"))) & ~c.isin(TRENCH_NOT) & flag("bridge") & flag("tunnel")


def road_group(df: DataFrame) -> Column:
    """footway, service or vehicular, in one pass; without a class everything can be walked."""
    c = road_class(df)
    if c is None:
        return F.lit("footway")
    low = F.lower(c)
    return F.when(low.isin(FOOT) & not_area(df), "footway").when(low == "service", "service").otherwise("vehicular")


def restricted(c: Column, classes: list[str] = RESTRICTED) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("^(" + "|".join(classes) + ")(_.*)?$"), F.lit(False))


def subset(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(key(F.col(column)) == key(F.lit(value)))


def majority(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """The most frequent non-null value of each group, null when two share the first place."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("n"))
    top = counts.groupBy(*group).agg(F.max("n").alias("n"))
    best = counts.join(top, [*group, "n"]).groupBy(*group).agg(F.min(column).alias(column), F.count("*").alias("ties"))
    return best.select(*group, F.when(F.col("ties") == 1, F.col(column)).alias(column))


def group_aggregates(df: DataFrame, group: list[str], means: list[str] = ("x", "y", "X", "Y")) -> DataFrame:
    """Numeric columns summed, coordinates averaged, texts by majority; one row over everything without a group."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float") and f.name not in group]
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name not in group]
    df = df if group else df.withColumn("grp", F.lit("ALL"))
    group = group or ["grp"]
    out = df.groupBy(*group).agg(*[(F.avg(n) if n in means else F.sum(n)).alias(n) for n in numeric])
    for t in texts:
        out = out.join(majority(df, group, t), group, "left")
    return out


def padded(number: Column, width: int) -> Column:
    """A number as text, with zeros before it up to the width; longer ones stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def numbered(df: DataFrame, order: str, prefix: str, name: str, width: int = 5) -> DataFrame:
    """df with column name: prefix00001, ... by the order over the whole table, by global_rank(), so that no task sees all rows."""
    return global_rank(df, order, "_rank").withColumn(name, F.concat(F.lit(prefix), padded(F.col("_rank"), width))).drop("_rank")


def address_ids(df: DataFrame, prefix: str, street: Column, house: Column, postcode: Column, tie: Column, column: str = "addr_id") -> DataFrame:
    """Blank ids numbered after the highest existing one, by street, first number of the house, postcode.

    The order is found by a range-partitioned sort: partition sizes are summed to offsets, so no task sees all rows.
    """
    c = F.col(column)
    blank = c.isNull() | (F.trim(c) == "") | F.lower(c).isin("nan", "none")
    taken = df.where(~blank).agg(F.max(F.regexp_extract(c, f"^{prefix}(\\d+)$", 1).try_cast("long")).alias("m")).first()["m"] or 0
    number = F.coalesce(F.regexp_extract(house, r"\d+", 0).try_cast("long"), F.lit(10**9))
    open_rows = df.where(blank).select("*", F.struct(F.lower(F.trim(F.coalesce(street, F.lit("")))).alias("s"), number.alias("n"), F.coalesce(postcode, F.lit("")).alias("p"), tie.alias("t")).alias("_o"))
    ranked = global_rank(open_rows, "_o", "_r")
    named = ranked.withColumn(column, F.concat(F.lit(prefix), padded(F.col("_r") + taken, 5))).drop("_o", "_r")
    return df.where(~blank).unionByName(named.select(*df.columns))


def global_rank(df: DataFrame, order: str, name: str, groups: int = 256) -> DataFrame:
    """Ranks from 1 over the whole table, by ranges of the order whose bounds are taken from a sample (a fixed number of groups)."""
    bounds = [r[0] for r in df.select(order).orderBy(F.xxhash64(order)).limit(20 * groups).sort(order).collect()]
    cuts = bounds[:: max(1, len(bounds) // groups)][1:]
    part = F.lit(0)
    if cuts:
        lits = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in c.asDict().items()]) if isinstance(c, Row) else F.lit(c) for c in cuts])
        # bounds in two steps: every 16th first, then those between two of them
        passed = lambda cs: F.size(F.filter(cs, lambda b: b <= F.col(order)))
        part = passed(lits)
        if len(cuts) >= 16:
            jump = passed(F.array(*[F.element_at(lits, i) for i in range(16, len(cuts) + 1, 16)])) * 16
            part = jump + passed(F.slice(lits, jump + 1, F.lit(16)))
        # few files may hold many rows: they are dealt out before they are compared
        df = df.repartition(groups, F.xxhash64(order))
    df = df.withColumn("_part", part)
    sizes = df.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return df.withColumn("_inner", inner).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_inner") + F.col("_before")).drop("_part", "_inner", "_before")


def suffixed(df: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """Repeated ids get __2, __3 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return df.withColumn("_n", n).withColumn(column, F.when(F.col("_n") > 1, F.concat(column, F.lit("__"), F.col("_n").cast("string"))).otherwise(F.col(column))).drop("_n")


def linked(objects: DataFrame, assignments: DataFrame, object_key: str = "fid", mfg: str = "MFG00001") -> DataFrame:
    """Objects with POLYGON_ID and PDP_ID of their assignment (null if there is none) and the one MFG id."""
    look = assignments.select(F.col(object_key).cast("string").alias("_k"), "POLYGON_ID", "PDP_ID")
    return objects.join(look, objects[object_key].cast("string") == look["_k"], "left").drop("_k").withColumn("MFG_ID", F.lit(mfg))


def link_counts(linked_objects: DataFrame) -> DataFrame:
    return linked_objects.agg(F.count("*").alias("expected"), F.count("PDP_ID").alias("updated"), F.count_if(F.col("PDP_ID").isNull()).alias("unmatched"))


def known_only(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key exists, and the rest."""
    return rows.join(keys, column, "left_semi"), rows.join(keys, column, "left_anti")


def link_overlap(rows: DataFrame, columns: list[str], keys: DataFrame, key_column: str) -> DataFrame:
    """For each column, how many of its distinct values are keys: what decides which column is the link."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), key(F.col(c)).alias("value")) for c in columns])).alias("x")).select("x.name", "x.value").where("value != ''").distinct()
    return long.join(keys.select(key(F.col(key_column)).alias("value")).distinct(), "value", "left_semi").groupBy("name").agg(F.count("*").alias("overlap"))


def addresses_in_two(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("addr_id").agg(F.countDistinct("poly").alias("n")).where("n > 1")


def least_areas(hh: Column, most: int) -> Column:
    """The theoretical minimum of areas for a number of homes."""
    return F.ceil(F.sum(hh) / most).cast("long")


def nearest_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, distance: Column) -> DataFrame:
    """Every left row with the nearest of the right rows of its key (ties to the least right_id), as left_id, right_id, d."""
    j = left.join(right, key).withColumn("_d", distance)
    best = j.groupBy(left_id).agg(F.min_by(F.struct(right_id, "_d"), F.struct("_d", right_id)).alias("b"))
    return best.select(left_id, f"b.{right_id}", F.col("b._d").alias("d"))


def all_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Every non-null key of the tables once, with a boolean column for each table that says whether it holds the key."""
    both = None
    for name, df in tables.items():
        rows = df.select(key, F.lit(name).alias("_in"))
        both = rows if both is None else both.unionByName(rows)
    holds = [F.max((F.col("_in") == n).cast("int")).cast("boolean").alias(f"in_{n}") for n in tables]
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(*holds)


def total_length(df: DataFrame, length: Column, field: str | None = None, value: str | None = None) -> DataFrame:
    """rows, length_m: count and length of a layer, or of the rows whose field has that value as text."""
    some = df if field is None else df.where(F.coalesce(F.col(field).cast("string"), F.lit("")) == F.lit(value or ""))
    return some.agg(F.count("*").alias("rows"), F.round(F.coalesce(F.sum(length), F.lit(0.0)), 2).alias("length_m"))


def by_homes(clusters: DataFrame, by: str, homes: str, order: str, name: str = "rank") -> DataFrame:
    """Clusters of each `by` numbered from 1: most homes first, then in their own order."""
    return clusters.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(homes), order)))


def choice(value, options: dict[str, str], default: str) -> str:
    """An option from its position, its key or its label, whatever the case; anything else is the default."""
    keys, text = list(options), str(value).strip().lower()
    if text.lstrip("+").isdigit() and not isinstance(value, bool):
        return keys[int(text)] if int(text) < len(keys) else default
    return next((k for k, label in options.items() if text in (k.lower(), label.lower())), default)
