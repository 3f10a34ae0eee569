"""Price tables, price matching and totals of bills of quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import price
from ..sources.shared import stored

# What marks a header row, and what names a column role (the first that fits counts).
HEADER = ["einheit", "unit", "preis", "ep", "amount", "position", "pos", "bezeichnung", "beschreibung"]
ROLES = {"code": ["pos", "position", "code", "nr"], "desc": ["bezeich", "beschr", "item", "beschreibung", "desc"], "unit": ["einheit", "unit"], "unit_price": ["preis", "ep", "einheitspreis", "unit price"]}
SECTIONS = ["Trenches", "Ducts", "Cables", "Crossings", "Network Elements"]


def price_table(cells: DataFrame, roles: dict[str, list[str]] = ROLES, price_first: bool = False) -> DataFrame:
    """Sheets as (sheet, row, cells array<string>) -> code, desc, unit, unit_price of the sheet with most prices.

    The header is the first of the 50 first rows with two header words; of equal sheets the first by name wins. A header
    such as Unit price counts as a unit, unless price_first is set.
    """
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    score = F.size(F.filter(low, lambda c: F.exists(F.array(*map(F.lit, HEADER)), lambda h: F.contains(c, h))))
    heads = cells.where("row < 50").where(score >= 2).groupBy("sheet").agg(F.min_by(F.struct("row", low.alias("names")), "row").alias("head"))
    order = ["unit_price", *[r for r in roles if r != "unit_price"]] if price_first else list(roles)

    def role(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for r in reversed(order):
            out = F.when(F.exists(F.array(*map(F.lit, roles[r])), lambda w: F.contains(c, w)), r).otherwise(out)
        return out

    heads = heads.select("sheet", F.col("head.row").alias("head"), F.transform("head.names", role).alias("roles"))
    at = lambda r: F.try_element_at(F.col("cells"), F.array_position("roles", r).cast("int"))
    got = lambda r: F.when(F.array_contains("roles", r), at(r))
    rows = cells.join(heads, "sheet").where("row > head").where(F.size(F.filter(F.array(*[F.array_contains("roles", r) for r in roles]), lambda x: x)) >= 3)
    text = lambda r: F.trim(F.coalesce(got(r), F.lit(""))).alias(r)
    rows = rows.select("sheet", "row", text("code"), text("desc"), text("unit"), price(got("unit_price")).alias("unit_price"))
    best = rows.groupBy("sheet").agg(F.count("unit_price").alias("n")).agg(F.min_by("sheet", F.struct(-F.col("n"), F.col("sheet"))).alias("sheet"))
    return rows.join(F.broadcast(best), "sheet").where("desc != ''").select("row", "code", "desc", "unit", "unit_price")


def pieces(c: Column, n: int) -> Column:
    """All substrings of n characters; the whole text if it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))


def holding(names: DataFrame, prices: DataFrame) -> DataFrame:
    """names (name, needles) with every price row (row, d, ...) whose text d holds all needles.

    An equi-join: names meet the rows that hold the rarest trigram of their needles (a shorter needle stands for itself)
    and the needles themselves are tested on what meets.
    """
    d = F.col("d")
    index = prices.select("row", F.explode(F.array_distinct(F.concat(pieces(d, 1), pieces(d, 2), pieces(d, 3)))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    needle = F.col("needle")
    asked = names.select("name", F.explode("needles").alias("needle")).select("name", F.explode(F.when(F.length(needle) < 3, F.array(needle)).otherwise(pieces(needle, 3))).alias("gram"))
    rare = asked.join(often, "gram", "left").groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return names.join(rare, "name").join(index, "gram").join(prices, "row").where(F.forall("needles", lambda h: F.contains(d, h)))


def matched(items: DataFrame, prices: DataFrame, code_map: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """Items (item_id, item, unit, quantity) with code, unit_price, amount from prices (row, code, desc, unit, unit_price).

    A mapped code with an empty or equal unit wins. Else all rows that hold every hint (item, hint) are candidates; if no row
    does, those that hold the first two words of four letters or more. Of candidates the first with the item's unit, or
    else the first. Items without hints, or with nothing to look for, have every row as candidate, so they are answered
    from the first row of each unit. Texts are looked up once per distinct item, by the rarest of their trigrams, in the distinct
    texts of the prices; what an item and a unit get is stored before the items are joined with it.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    p = prices.select("row", "code", F.lower("desc").alias("d"), low("unit").alias("u"), "unit_price")
    names = items.select(F.trim("item").alias("name")).distinct()
    told = hints.groupBy(F.trim("item").alias("name")).agg(F.collect_set(low("hint")).alias("hints")) if hints is not None else None
    names = names.join(told, "name", "left") if told is not None else names.withColumn("hints", F.lit(None).cast("array<string>"))
    words = F.slice(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) >= 4), 1, 2)
    names = names.withColumn("hints", F.array_remove("hints", "")).withColumn("hints", F.when(F.size("hints") > 0, F.col("hints")))
    hinted = names.where("hints IS NOT NULL")
    firsts = stored(p.groupBy("d", "u").agg(F.min_by(F.struct("row", "code", "unit_price"), "row").alias("first")))
    texts = firsts.groupBy("d").agg(F.min("first.row").alias("row"))
    by_hint = holding(hinted.withColumn("needles", F.col("hints")), texts)
    pick = lambda held: stored(held.select("name", "d").join(firsts, "d").groupBy("name", "u").agg(F.min_by("first", F.col("first.row")).alias("first")))
    found = pick(by_hint)
    rest = hinted.join(found.select("name").distinct(), "name", "left_anti").withColumn("needles", words)
    by_word = pick(holding(rest.where(F.size("needles") > 0), texts))
    names = names.join(rest.where(F.size("needles") == 0).select("name", F.lit(True).alias("any")), "name", "left")  # nothing to look for: any row does
    special = found.unionByName(by_word)
    anyone = firsts.groupBy("u").agg(F.min_by("first", F.col("first.row")).alias("first"))
    it = items.withColumn("_name", F.trim("item")).withColumn("_unit", low("unit"))
    asked = it.select("_name", "_unit").distinct().join(names.select(F.col("name").alias("_name"), (F.col("hints").isNotNull() & F.col("any").isNull()).alias("_hinted")), "_name")
    first_any = anyone.agg(F.min_by("first", F.col("first.row")).alias("any_first"))
    first_special = special.groupBy(F.col("name").alias("_name")).agg(F.min_by("first", F.col("first.row")).alias("name_first"))
    out = asked.join(anyone.select(F.col("u").alias("_unit"), F.col("first").alias("unit_first")), "_unit", "left").join(F.broadcast(first_any))  # one row
    out = out.join(special.select(F.col("name").alias("_name"), F.col("u").alias("_unit"), F.col("first").alias("both_first")), ["_name", "_unit"], "left").join(first_special, "_name", "left")
    same = F.col("_unit") != ""
    hit = F.when(F.col("_hinted"), F.coalesce(F.when(same, F.col("both_first")), F.col("name_first"))).otherwise(F.coalesce(F.when(same, F.col("unit_first")), F.col("any_first")))
    if code_map is not None:
        mapped = code_map.select(F.trim("item").alias("_name"), F.trim("code").alias("_code"))
        by_code = prices.where(F.trim("code") != "").groupBy(F.trim("code").alias("_code")).agg(F.max_by(F.struct("row", "code", "unit_price", low("unit").alias("u")), "row").alias("coded"))
        out = out.join(mapped, "_name", "left").join(by_code, "_code", "left")
        hit = F.when((F.col("coded.u") == "") | (F.col("coded.u") == F.col("_unit")), F.struct(F.col("coded.row").alias("row"), F.col("coded.code").alias("code"), F.col("coded.unit_price").alias("unit_price"))).otherwise(hit)
    told = stored(out.select("_name", "_unit", hit.alias("_hit")))
    return it.join(told, ["_name", "_unit"]).select(*items.columns, F.col("_hit.code").alias("code"), F.col("_hit.unit_price").alias("unit_price"), F.round(F.col("quantity") * F.col("_hit.unit_price"), 2).alias("amount"))


def section_order(c: Column) -> Column:
    out = F.lit(99)
    for i, s in enumerate(SECTIONS):
        out = F.when(c == s, i).otherwise(out)
    return out


def totals(rows: DataFrame) -> DataFrame:
    """section, total per section and over all (null section); unparsable amounts count 0."""
    amount = F.coalesce(F.col("amount").cast("string").try_cast("double"), F.lit(0.0))
    return rows.rollup("section").agg(F.round(F.sum(amount), 2).alias("total"))


def sheet(rows: DataFrame) -> DataFrame:
    """Rows in section order with a running number, and a subtotal after the last of each section."""
    w = Window.partitionBy("section").orderBy("item_name")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(w) == F.count("*").over(full)
    return rows.withColumns({"rank": section_order(F.col("section")), "subtotal": F.when(last, F.round(F.sum("amount").over(full), 2))}).orderBy("rank", "section", "item_name")


def jobpack(layers: dict[str, DataFrame]) -> str:
    """Markdown table of layers and their row counts."""
    lines = ["| layer | rows | status |", "|-|-|-|"]
    for name, df in layers.items():
        n = df.count()
        lines.append(f"| {name} | {n} | {'ok' if n else 'empty'} |")
    return "\n".join(lines)
