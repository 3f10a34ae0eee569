"""Lines merged into chains: places where exactly two ends meet are passed through, by list ranking in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import length
from .graph import checkpoints, components
from .overlay import clean


def ranked(halves: DataFrame, rounds: int = 60) -> DataFrame:
    """h, last, dist for h, next (null at an end): the end that each leads to and the steps to it, by doubling the reach of every pointer."""
    cut = checkpoints(halves)
    now = cut(halves.select("h", F.coalesce("next", "h").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("dist")))
    total = -1
    for _ in range(rounds):
        steps = now.agg(F.sum("dist")).first()[0]
        if steps == total:
            return now
        total = steps
        ahead = now.select(F.col("h").alias("last"), F.col("last").alias("further"), F.col("dist").alias("more"))
        now = cut(now.join(ahead, "last").select("h", F.col("further").alias("last"), (F.col("dist") + F.col("more")).alias("dist")))
    raise RuntimeError("chains did not settle; a ring was not cut")


def merged_lines(lines: DataFrame, grain: float = 0.05) -> DataFrame:
    """chain, n, closed, line, length, fids: lines (fid, line) joined wherever exactly two line ends, and no third, meet.

    Ends meet if they round to the same multiple of grain. A chain is named by its least fid; it starts at the end whose line
    has the lesser fid, a ring at the start of its least line. Lines without extent are left out. What meets at a place is
    counted by partial aggregates, so hubs gather nowhere; chains are told apart by components, their order is found by list
    ranking (as many rounds as the logarithm of the longest chain), and only a chain, one row of the result, is gathered.
    """
    cut = checkpoints(lines)
    node = lambda p: F.concat_ws(":", *[F.rint(p[c] / grain).cast("long").cast("string") for c in "xy"])
    tidy = cut(lines.select(F.col("fid").cast("long").alias("fid"), clean(F.col("line")).alias("line")).where("size(line) > 1"))
    ends = tidy.select("fid", F.posexplode(F.array(node(F.col("line")[0]), node(F.element_at("line", -1)))).alias("end", "node"))
    pair = ends.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("fid", "end")).alias("p"), F.max(F.struct("fid", "end")).alias("q")).where("n = 2")
    link = lambda a, b: pair.select(F.col(f"{a}.fid").alias("fid"), F.col(f"{a}.end").alias("end"), F.col(f"{b}.fid").alias("other"), F.col(f"{b}.end").alias("other_end"))
    links = cut(link("p", "q").unionByName(link("q", "p")))
    named = components(links.select("fid", "other"), "fid", "other").select(F.col("node").alias("fid"), F.col("component").alias("chain"))
    named = cut(tidy.select("fid").join(named, "fid", "left").select("fid", F.coalesce("chain", "fid").alias("chain")))
    sizes = named.groupBy("chain").agg(F.count("*").alias("n"))
    rings = links.join(named, "fid").groupBy("chain").agg(F.count("*").alias("ends")).join(sizes, "chain").where("ends = 2 * n").select("chain")
    gap = links.join(rings.select(F.col("chain").alias("fid")), "fid", "left_semi").where("end = 0")
    gaps = gap.select("fid", "end").unionByName(gap.select(F.col("other").alias("fid"), F.col("other_end").alias("end")))
    open_links = cut(links.join(gaps.distinct(), ["fid", "end"], "left_anti"))
    both = named.select("fid", "chain", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
    ahead = open_links.select("fid", (1 - F.col("end")).alias("way"), (F.col("other") * 2 + F.col("other_end")).alias("next"))
    halves = cut(both.join(ahead, ["fid", "way"], "left").withColumn("h", F.col("fid") * 2 + F.col("way")))
    placed = halves.select("h", "fid", "way", "chain").join(ranked(halves), "h")
    entered = open_links.select("fid", F.col("end").alias("way"))
    start = placed.join(entered, ["fid", "way"], "left_anti").groupBy("chain").agg(F.min_by("last", "h").alias("last"))
    own = placed.join(start, ["chain", "last"]).join(tidy, "fid").withColumn("path", F.when(F.col("way") == 0, F.col("line")).otherwise(F.reverse("line")))
    whole = own.groupBy("chain").agg(F.reverse(F.array_sort(F.collect_list(F.struct("dist", "fid", "path")))).alias("s"))
    path = F.flatten(F.transform("s", lambda s, i: F.when(i == 0, s["path"]).otherwise(F.slice(s["path"], F.lit(2), F.size(s["path"])))))
    out = whole.select("chain", F.size("s").cast("long").alias("n"), path.alias("line"), F.transform("s", lambda s: s["fid"]).alias("fids"))
    closed = node(F.col("line")[0]) == node(F.element_at("line", -1))
    return out.join(rings.withColumn("ring", F.lit(True)), "chain", "left").select("chain", "n", (F.coalesce("ring", F.lit(False)) & closed).alias("closed"), "line", length(F.col("line")).alias("length"), "fids")
