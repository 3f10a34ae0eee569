"""Street graphs: nodes are quantised points, edges undirected with the shorter of parallels kept."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import densified
from ..sources.shared import stored
from .spatial import neighbour_pairs, segments


def edges_of(lines: DataFrame, step: float = 2.0, eps: float = 0.05, carry: list[str] = ()) -> DataFrame:
    """u, v (texts of quantised places), w: lines (fid, line) cut every `step`; no loops, no empty edges."""
    s = segments(lines.select("fid", *carry, densified(F.col("line"), step).alias("line")), "fid")
    q = lambda c: F.rint(F.col(c) / eps).cast("long")
    node = lambda p: F.concat_ws(":", q(p + "x"), q(p + "y"))
    e = s.select(*carry, node("a").alias("p"), node("b").alias("q"), F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("w"))
    e = e.where("p != q AND w > 1e-6")
    return e.groupBy(*carry, F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.min("w").alias("w"))


def nodes_of(edges: DataFrame, eps: float = 0.05) -> DataFrame:
    """node, x, y."""
    n = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    part = lambda i: F.split("node", ":")[i].cast("double") * eps
    return n.select("node", part(0).alias("x"), part(1).alias("y"))


def healed(edges: DataFrame, nodes: DataFrame, reach: float = 3.0) -> DataFrame:
    """Edges and an edge for every pair of nodes within reach that has none."""
    near = neighbour_pairs(nodes, reach, "node").where("node < other").select(F.col("node").alias("u"), F.col("other").alias("v"), F.sqrt("d2").alias("w"))
    return edges.select("u", "v", "w").unionByName(near.where("w > 1e-6").join(edges.select("u", "v"), ["u", "v"], "left_anti"))


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """node, component (the least node): large-star and small-star steps over the edge list, cut by checkpoints."""
    cut = checkpoints(edges)
    e = edges.select(F.greatest(u, v).alias("p"), F.least(u, v).alias("q")).distinct()
    last = None
    for _ in range(rounds):
        both = e.union(e.select("q", "p"))
        low = both.groupBy("p").agg(F.least(F.min("q"), F.col("p")).alias("m"))
        e = both.where("q >= p").join(low, "p").select(F.col("q").alias("p"), F.col("m").alias("q")).distinct()
        low = e.groupBy("p").agg(F.min("q").alias("m"))
        j = e.join(low, "p")
        e = cut(j.select("q", "m").union(j.select("p", "m")).select(F.greatest("q", "m").alias("p"), F.least("q", "m").alias("q")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("p", "q").cast("decimal(38,0)"))).first()
        if now == last:
            return e.groupBy(F.col("p").alias("node")).agg(F.min("q").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def checkpoints(df: DataFrame):
    """What cuts a plan: a table in the shared folder."""
    return stored


def shortest(near: dict[str, list[tuple[str, float]]], starts: list[tuple[str, str]], wanted: set[str] | None = None) -> dict[str, tuple[float, str, str | None]]:
    """node -> distance, label of its nearest start (label, node), node before; ends early once all wanted nodes are known."""
    best: dict[str, tuple[float, str, str | None]] = {}
    heap = [(0.0, label, node, None) for label, node in starts]
    heapq.heapify(heap)
    left = None if wanted is None else set(wanted)
    while heap and (left is None or left):
        d, label, node, back = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (d, label, back)
        if left is not None:
            left.discard(node)
        for other, w in near.get(node, []):
            if other not in best:
                heapq.heappush(heap, (d + w, label, other, node))
    return best


def relaxed(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """node, dist, label by rounds of relaxation as joins, for graphs of few hops: edges (u, v, w), sources (node, label)."""
    cut = checkpoints(edges)
    both = edges.select("u", "v", "w").union(edges.select("v", "u", "w"))
    best = sources.select("node", F.lit(0.0).alias("dist"), "label")
    for _ in range(rounds):
        step = best.join(both, best["node"] == both["u"]).select(F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "label")
        new = cut(best.union(step).groupBy("node").agg(F.min(F.struct("dist", "label")).alias("b")).select("node", "b.dist", "b.label"))
        same = new.join(best.withColumnsRenamed({"dist": "d0", "label": "l0"}), "node", "left").where("d0 IS NULL OR d0 != dist OR l0 != label").isEmpty()
        best = new
        if same:
            return best
    raise RuntimeError(f"distances did not settle in {rounds} rounds")


def common_prefix(paths: DataFrame, group: str, path: str = "path") -> DataFrame:
    """group, k: how many first steps all paths of a group share; aggregated step by step, not path by path."""
    n = paths.groupBy(group).agg(F.count("*").alias("n"))
    s = paths.select(group, F.posexplode(path).alias("i", "seg")).groupBy(group, "i").agg(F.count("*").alias("have"), F.countDistinct("seg").alias("kinds")).join(n, group)
    good = s.withColumn("ok", (F.col("have") == F.col("n")) & (F.col("kinds") == 1))
    first_bad = good.groupBy(group).agg(F.min(F.when(~F.col("ok"), F.col("i"))).alias("bad"), F.max("i").alias("last"))
    return n.join(first_bad, group, "left").select(group, F.coalesce("bad", F.col("last") + 1, F.lit(0)).cast("int").alias("k"))
