"""Sharding by k-d tree: weighted medians along the widest metadata dimension. Native operators only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize

#: Every dimension and the tie-breaking hash are integers below these, so a histogram of a node has as many rows at most.
SCALE, TIES = 1024, 4096
#: Share of a shard's bytes that a cut may miss before more neighbours are dealt by hash.
CLOSE = 0.002


def dimensions(df: DataFrame) -> list[Column]:
    """Metadata dimensions on one scale: log size, language, source (by hash) and position of the id. Ids are told apart as
    doubles, so the widest of them neither overflow nor fail."""
    place = F.col("lead").cast("double")
    low, high = df.agg(F.min(place), F.max(place)).first()
    span = max(1.0, (high or 0.0) - (low or 0.0))
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(SCALE)).cast("int")
    return [F.least(F.lit(SCALE - 1), (F.log2("size") * 24).cast("int")), code("lang"), code("source"), F.coalesce(((place - (low or 0.0)) / span * (SCALE - 1)).cast("int"), F.lit(0))]


def grouped(base: DataFrame, most: float) -> DataFrame:
    """base with the metadata of the least row of its text (lead: its id), if all rows of the text have `most` bytes at most; other rows keep their own."""
    same = ["text_hash", "text_crc32", "size"]
    groups = base.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lang", "source")).alias("least")).where((F.col("n") > 1) & (F.col("n") * F.col("size") <= most))
    joined = base.join(groups, same, "left")
    own = lambda c: F.when(F.col("n").isNull(), F.col(c)).otherwise(F.col(f"least.{c}"))
    return joined.select("doc_id", "size", "text_crc32", own("doc_id").alias("lead"), own("lang").alias("lang"), own("source").alias("source"))


def boundary(hist: list[tuple[int, int]], goal: float, room: float) -> tuple[int, int, float]:
    """The keys (first, last) around the weighted median that are dealt by hash, and the weight before them.

    They begin as the one key at which the weights reach the goal and grow on the lighter side until they weigh `room`.
    """
    before, at = 0.0, len(hist) - 1
    for i, (_, weight) in enumerate(hist):
        if before + weight >= goal or i == at:
            at = i
            break
        before += weight
    first, last, held = at, at, hist[at][1]
    while held < room and (first > 0 or last < len(hist) - 1):
        if first > 0 and (last == len(hist) - 1 or goal - before <= before + held - goal):
            first -= 1
            before -= hist[first][1]
            held += hist[first][1]
        else:
            last += 1
            held += hist[last][1]
    return hist[first][0], hist[last][0], before


def filled(weights: dict[int, int], goal: float, tries: int = 16) -> set[int]:
    """Keys whose weights come near the goal: heavy ones first, each if it fits, then one more if that is nearer; of several runs,
    of which each leaves out one more of the heaviest, the nearest. It misses by half of the heaviest weight at most."""
    order, best, least = sorted(weights, key=lambda k: (-weights[k], k)), set(), abs(goal)
    for skipped in range(min(tries, len(order))):
        taken, rest = set(), goal
        for key in order[skipped:]:
            if weights[key] <= rest:
                taken.add(key)
                rest -= weights[key]
        nearest = min((k for k in order if k not in taken), key=lambda k: abs(rest - weights[k]), default=None)
        for more in (set(), {nearest} - {None}):
            off = abs(rest - sum(weights[k] for k in more))
            if off < least:
                best, least = taken | more, off
    return best


def kd_shards(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), node depth: near equal bytes in every shard.

    A node of k shards is cut where its bytes reach the share of floor(k/2) shards, along the dimension that spreads widest
    in it; rows about the cut (those that tie with it, and neighbours up to half a shard's bytes, more where few large rows
    cannot come within CLOSE) are dealt to the two sides by buckets of a hash, chosen so that the bytes come out equal. Each
    level is two histograms of bounded size per node; rows never move until they are numbered. Leaves are the shards: the
    target bytes of a leaf are total / n_shards. Equal texts fall into one shard, since they take the metadata of the first of
    them, unless together they have over half a shard's bytes: then near equal bytes come first.
    A null text has no bytes (size 16), null metadata hash like a value of their own, an empty table gives no rows.
    Missing lang or source columns count as null.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = {c.lower() for c in df.columns}
    meta = [(F.col(c).cast("string") if c in names else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *meta)
    base = materialize(base)
    total = base.agg(F.sum("size")).first()[0] or 0
    base = materialize(grouped(base, total / n_shards / 2))
    at = base.select("doc_id", "size", "text_crc32", F.array(*dimensions(base)).alias("at"), F.pmod(F.xxhash64("lead", "text_crc32"), F.lit(TIES)).cast("int").alias("tie"))
    at = materialize(at.withColumn("node", F.lit(0)))
    shares, leaf = {0: n_shards}, {0: 0}
    n_dims = 4
    while any(k > 1 for k in shares.values()):
        wide = at.groupBy("node").agg(*[f(F.col("at")[i]).alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        dim = {r["node"]: max(range(n_dims), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i)) for r in wide}
        nodes = sorted(shares)
        pick = F.array(*[F.lit(dim.get(n, 0)) for n in nodes])
        keyed = at.withColumn("key", F.element_at("at", F.element_at(pick, F.col("node") + 1) + 1))
        hist: dict[int, list] = {n: [] for n in nodes}
        for r in keyed.groupBy("node", "key").agg(F.sum("size").alias("w")).collect():
            hist[r["node"]].append((r["key"], r["w"]))
        low, high, dealt = {}, {}, {}
        lit = lambda values: F.array(*[F.lit(v) for v in values])
        room = {n: sum(w for _, w in hist[n]) / shares[n] / 2 for n in nodes if shares[n] > 1 and hist[n]}
        while room:  # a second turn only for nodes of few rows, whose boundary has too few buckets to meet the goal
            goal, ties = {}, {n: {} for n in room}
            for n in room:
                weight = sum(w for _, w in hist[n]) * (shares[n] // 2) / shares[n]
                low[n], high[n], before = boundary(sorted(hist[n]), weight, room[n])
                goal[n] = weight - before
            lows, highs = (lit([ends[n] if n in room else SCALE for n in nodes]) for ends in (low, high))
            zone = F.col("key").between(F.element_at(lows, F.col("node") + 1), F.element_at(highs, F.col("node") + 1))
            for r in keyed.where(zone).groupBy("node", "tie").agg(F.sum("size").alias("w")).collect():
                ties[r["node"]][r["tie"]] = r["w"]
            again = {}
            for n in room:
                taken = filled(ties[n], goal[n])
                dealt[n] = "".join("L" if t in taken else "R" for t in range(TIES))
                share, missed = sum(w for _, w in hist[n]) / shares[n], abs(sum(ties[n][t] for t in taken) - goal[n])
                if missed > share * CLOSE and len([k for k, _ in hist[n] if low[n] <= k <= high[n]]) < len(hist[n]):
                    again[n] = 2 * room[n]
            room = again
        lows, highs = (lit([ends.get(n, SCALE) for n in nodes]) for ends in (low, high))
        grown, first, to_left, to_right = {}, {}, [], []
        for n in nodes:  # children are numbered anew, left before right
            for half, out in ((shares[n] // 2 or 1, to_left), (shares[n] - shares[n] // 2 if shares[n] > 1 else 0, to_right)):
                if half:
                    grown[len(grown)] = half
                    first[len(first)] = leaf[n] + (shares[n] // 2 if out is to_right else 0)
                out.append(len(grown) - 1)
        split = F.arrays_zip(pick.alias("dim"), lows.alias("low"), highs.alias("high"), lit([dealt.get(n, "") for n in nodes]).alias("dealt"), lit(to_left).alias("left"), lit(to_right).alias("right"))

        def child(s: Column) -> Column:
            key = F.element_at("at", s["dim"] + 1)
            over = (key > s["high"]) | ((key >= s["low"]) & (F.substr(s["dealt"], F.col("tie") + 1, F.lit(1)) == "R"))
            return F.when(over, s["right"]).otherwise(s["left"])

        # the lambda binds the split once, so a plan of several levels grows by one term a level
        at = at.withColumn("node", F.element_at(F.transform(F.array(F.element_at(split, F.col("node") + 1)), child), 1))
        shares, leaf = grown, first
    shards = F.array(*[F.lit(leaf[n]) for n in sorted(leaf)])
    done = at.select("doc_id", "size", "text_crc32", F.element_at(shards, F.col("node") + 1).cast("int").alias("shard"))
    return numbered(done, n_shards)


def numbered(df: DataFrame, n_shards: int, rows_per_group: int = 50_000) -> DataFrame:
    """Gapless slots from 0 in each shard: rows are ranked within hashed groups of a shard, then shifted by the groups before.

    The groups' counts are n_shards * 4096 rows at most, which bounds the broadcast.
    """
    df = materialize(df)
    groups = max(8, min(4096, df.count() // (n_shards * rows_per_group)))
    df = df.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)).cast("int"))
    counts = df.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = W.Window.partitionBy("shard").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    out = df.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
