"""Number functions on columns: homes, splitter plans, grids, colours, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Splitter sizes and the band of utilisation in percent.
SIZES = (64, 32, 16, 8)
LOW, HIGH = 60, 90
# Colours.
TRUNK = "#808080"
BRANCHES = ["#d81b60", "#1e88e5", "#43a047", "#8e24aa", "#fb8c00", "#00897b", "#5e35b1"]
LEFT, RIGHT = ["#e53935", "#43a047"], ["#1e88e5", "#fdd835"]



def households(c: Column) -> Column:
    """Unparsable and missing become 0."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0).otherwise(n.cast("int"))


def homes(c: Column | None) -> Column:
    """No column, null and unparsable count as one home, negative as none."""
    if c is None:
        return F.lit(1)
    return F.greatest(F.lit(0), F.coalesce(F.trim(c.cast("string")).try_cast("double").try_cast("int"), F.lit(1)))


def splitter_plan(hh: Column) -> Column:
    """Struct n64, n32, n16, n8, total, ports, util, ok, label for a number of homes.

    Port totals are the multiples of 8 between hh / 0.9 and hh / 0.6 and 64 more. As every size divides the next, the
    fewest splitters for a total are unique: as many of 64 as fit, then the binary digits of the rest. The best total is
    in the band, then of fewest splitters, then the least. Everything stays in generated code.
    """
    hh = F.coalesce(hh.try_cast("int"), F.lit(0))
    low = F.greatest(hh, ((hh * 10 + 8) / 9).cast("int"), F.lit(8))
    high = F.greatest(low + 64, (hh * 5 / 3).cast("int") + 64)
    totals = F.sequence(((low + 7) / 8).cast("int"), (high / 8).cast("int"))

    def ranked(eighths: Column) -> Column:
        ports = eighths * 8
        count = (ports / 64).cast("int") + F.bit_count(F.pmod(eighths, F.lit(8)))
        inside = (hh * 100 >= ports * LOW) & (hh * 100 <= ports * HIGH)
        return F.struct(F.when(inside, 0).otherwise(1).alias("miss"), count.alias("count"), ports.alias("ports"))

    best = F.array_min(F.transform(totals, ranked))
    return F.element_at(F.transform(F.array(F.when(hh > 0, best)), lambda b: plan_of(hh, b)), 1)


def plan_of(hh: Column, best: Column) -> Column:
    ports = F.coalesce(best["ports"], F.lit(0))
    rest = F.pmod(ports, F.lit(64))
    n = {64: (ports / 64).cast("int")} | {s: F.pmod((rest / s).cast("int"), F.lit(2)) for s in SIZES[1:]}
    label = F.array_join(F.array_compact(F.array(*[F.when(n[s] > 0, F.concat(n[s].cast("string"), F.lit(f"x1:{s}"))) for s in SIZES])), " + ")
    return F.struct(
        *[n[s].alias(f"n{s}") for s in SIZES], F.coalesce(best["count"], F.lit(0)).alias("total"), ports.alias("ports"),
        F.when(ports > 0, F.bround(hh * 100.0 / ports, 1)).otherwise(F.lit(0.0)).alias("util"), F.when(best["miss"] == 0, 1).otherwise(0).alias("ok"),
        F.when(ports > 0, label).otherwise(F.lit("-")).alias("label"),
    )


def splitter_table(spark: SparkSession, most: int = 4096) -> DataFrame:
    """hh, plan for 0..most: of a fixed size, so it may be broadcast; joins beyond it use splitter_plan() itself."""
    return spark.range(most + 1).select(F.col("id").cast("int").alias("hh"), splitter_plan(F.col("id").cast("int")).alias("plan"))


def quantized(c: Column, step: float) -> Column:
    """To the nearest multiple, halves to even."""
    return F.rint(c / step) * step


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def density(hh: Column, area: Column) -> Column:
    """Homes per hectare."""
    return F.when(area > 0, F.bround(hh / (area / 10000.0), 2)).otherwise(F.lit(0.0))


def branch_colour(i: Column) -> Column:
    """Palette first, then a hue of 137 degrees a step at fixed saturation and value."""
    hue = F.pmod(i * 137, F.lit(360))
    s, v = 160 / 255.0, 230 / 255.0
    part = lambda n: F.pmod(n + hue / 60.0, F.lit(6.0))
    level = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(part(n), 4 - part(n), F.lit(1.0)))
    hexed = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.round(level(n) * 255).cast("int")), 2, "0")) for n in (5, 3, 1)])
    return F.when(i < len(BRANCHES), F.element_at(F.array(*map(F.lit, BRANCHES)), F.least(i, F.lit(len(BRANCHES) - 1)).cast("int") + 1)).otherwise(hexed)


def side_colour(side: Column, i: Column) -> Column:
    pick = lambda palette: F.element_at(F.array(*map(F.lit, palette)), F.pmod(i, F.lit(len(palette))).cast("int") + 1)
    return F.when(F.upper(F.coalesce(side, F.lit(""))).startswith("L"), pick(LEFT)).otherwise(pick(RIGHT))


def homes_bucket(c: Column) -> Column:
    n = c.cast("string").try_cast("int")
    return F.when(n.isNull(), "Unknown/NULL HH").when(n == 0, "0 HH").when(n == 1, "1 HH").when(n == 2, "2 HH").when((n >= 3) & (n <= 31), "3 ≤ HH ≤ 31").when(n >= 32, "HH ≥ 32")


def margin(distance: Column) -> dict[str, Column]:
    """Margin, gap and footprint radius that follow from a typical neighbour distance."""
    m = F.least(F.lit(25.0), F.greatest(F.lit(8.0), distance * 0.15))
    return {"margin": m, "gap": F.greatest(F.lit(2.0), m * 0.4), "footprint": F.least(F.lit(6.0), F.greatest(F.lit(3.0), m * 0.3))}


def price(c: Column) -> Column:
    """The last number of a price cell, null if there is none.

    The cell is split at whatever is neither digit nor separator, and the last part with a digit counts. With both kinds
    of separators the rightmost is the decimal one and the others go; a comma alone is a decimal comma. A minus right before
    the number, or parentheses around anything in the cell, make it negative.
    """
    s = F.trim(c)
    parts = F.filter(F.split(s, "[^0-9.,]+"), lambda x: x.rlike("[0-9]"))
    raw = F.regexp_replace(F.get(parts, F.size(parts) - 1), "^[.,]+|[.,]+$", "")
    dot, comma = F.instr(F.reverse(raw), "."), F.instr(F.reverse(raw), ",")  # the smaller is farther right; 0: none
    spare = F.when((dot > 0) & (comma > 0), F.when(comma < dot, ".").otherwise(",")).otherwise("")
    value = F.translate(F.when(spare == "", raw).otherwise(F.replace(raw, spare, F.lit(""))), ",", ".").try_cast("double")
    before = F.rtrim(F.regexp_extract(s, "^(.*[^0-9.,])?[0-9.,]*[0-9][^0-9]*$", 1))
    return F.when(before.endswith("-") | (F.contains(s, F.lit("(")) & F.contains(s, F.lit(")"))), -value).otherwise(value)


def snap_reach(tolerance: Column | float = 25.0, room: float = 50.0, least: float = 75.0) -> Column:
    """How far a snap may look: the tolerance and some room, but never less than `least`."""
    return F.greatest(F.lit(tolerance) + room, F.lit(least))


def node_step(spacing: Column) -> Column:
    """Quantising step of graph nodes: a fifth of the spacing of dense points, within 0.001 and 0.05."""
    return F.least(F.lit(0.05), F.greatest(F.lit(0.001), spacing / 5))
