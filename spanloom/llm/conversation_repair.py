"""Conversation structure repair: one signature per conversation, one solution per distinct signature, edits replayed on the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: White space that makes no content, and the ends of a complete text.
WHITE, ENDS = " \t\n\v\f\r", (".", "!", "?")
#: A row is one character: its role's initial (o: any other), as it is, or in the row of its first fault.
SOUND, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "wxyz", "WXYZ"
#: What edits cost; a truncated row that stays costs more.
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
#: States of the role sequence `(s?(ua)+)?`: nothing yet, after a system, user or assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Least number of inserted rows that lead from one state to another.
INSERTS = {(x, x): 0 for x in range(4)} | {(START, USER): 1, (SYSTEM, USER): 1, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1, (START, ASSISTANT): 2, (SYSTEM, ASSISTANT): 2}
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
INITIALS = str.maketrans(TRUNCATED + BLANK + DUPLICATE, SOUND * 3)

Table = dict[tuple[int, int], tuple[int, str]]


def one_row(c: str) -> Table:
    """(state before, state after) -> (cost, audit) of one row, with the rows inserted before it."""
    out: Table = {}

    def offer(x: int, y: int, cost: int, audit: str) -> None:
        if (x, y) not in out or (cost, audit) < out[x, y]:
            out[x, y] = (cost, audit)

    for (x, y), n in INSERTS.items():
        offer(x, y, INSERT * n + DELETE, "I" * n + "D")
        if c in SOUND + TRUNCATED:
            cut, initial = (CUT if c in TRUNCATED else 0), c.lower()
            if (y, initial) in STEPS:
                offer(x, STEPS[y, initial], INSERT * n + cut, "I" * n + "K")
            for new in NAMES:
                if (y, new) in STEPS:
                    offer(x, STEPS[y, new], INSERT * n + cut + REROLE, "I" * n + "R")
    return out


def joined(a: Table, b: Table) -> Table:
    """One table after the other. Every audit ends in the letter of its last row, so none is the beginning of another of equal
    cost, and the least of the joined audits is made of least audits."""
    out: Table = {}
    for (x, y), (cost, audit) in a.items():
        for (y2, z), (more, rest) in b.items():
            if y == y2 and ((x, z) not in out or cost + more <= out[x, z][0]):
                found = (cost + more, audit + rest)
                if (x, z) not in out or found < out[x, z]:
                    out[x, z] = found
    return out


def solved(signature: str) -> Table:
    """Tables of halves, joined; those of up to 16 rows are remembered, so that alike conversations share them."""
    if len(signature) <= 16:
        return remembered(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1
    return joined(solved(signature[:half]), solved(signature[half:]))


@lru_cache(maxsize=50_000)
def remembered(signature: str) -> Table:
    if len(signature) == 1:
        return one_row(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1
    return joined(remembered(signature[:half]), remembered(signature[half:]))


def cheapest(signature: str) -> tuple[int, str]:
    """Cost and audit: the initials of the cheapest edits, the least in ASCII of those."""
    if not signature:
        return 0, ""
    found = solved(signature)
    ends = [(cost + INSERT * n, audit + "I" * n) for (x, y), (cost, audit) in found.items() if x == START for goal in (START, ASSISTANT) if (n := INSERTS.get((y, goal))) is not None]
    return min(ends)


def replayed(signature: str, audit: str) -> tuple[list[int], list[str]]:
    """For each row of the result, the place of its source row (-1: inserted) and its new role ("": the row's own)."""
    places, roles, state, row = [], [], START, 0
    for edit in audit:
        if edit != "D":
            initial = signature[row].translate(INITIALS) if edit == "K" else "a" if state == USER else "u"
            state = STEPS[state, initial]
            places.append(-1 if edit == "I" else row)
            roles.append("" if edit == "K" else NAMES[initial])
        row += edit != "I"
    return places, roles


def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for sig in f["sig"]:
            cost, audit = cheapest(sig)
            plain = sig.translate(INITIALS)
            count = lambda kind, sig=sig: sum(map(sig.count, kind))
            illegal = sum(plain[i : i + 2] not in LEGAL for i in range(len(plain) - 1))
            rows.append((sig, count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, cost, audit, *replayed(sig, audit)))
        yield pd.DataFrame(rows, columns=["sig", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "places", "roles"])


def entries(df: DataFrame) -> DataFrame:
    """Rows that are alike, once: rid, conv (the id as text, empty for none), conv_id, turn, role, text, n; nulls in role and text are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    return materialize(alike.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "*"))


def signed(entries: DataFrame) -> DataFrame:
    """Entries without their texts, with the characters of their rows: rid, conv, turn, role, sha, n, sig."""
    body, head = F.rtrim("text", F.lit(WHITE)), F.substring("role", 1, 1)
    when = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("turn"))
    e = entries.select(
        "rid", "conv", "turn", "role", "n", F.sha2("text", 256).alias("sha"), F.when(head.isin(*"sua"), head).otherwise("o").alias("initial"),
        (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(*ENDS)).alias("cut"), when.alias("when"),
    )
    first = e.groupBy("conv", "role", "sha").agg(F.min("when").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    e = e.join(first, ["conv", "role", "sha"], "left")
    kind = lambda letters: F.translate("initial", SOUND, letters)
    again = F.when(F.col("blank"), kind(BLANK)).otherwise(kind(DUPLICATE))
    own = F.when(F.col("blank") | F.coalesce(F.col("when") > F.col("first"), F.lit(False)), again).when(F.col("cut"), kind(TRUNCATED)).otherwise(F.col("initial"))
    return e.withColumn("again", again).select("rid", "conv", "turn", "role", "sha", "n", F.concat(own, F.expr("repeat(again, cast(n - 1 AS int))")).alias("sig"))


def in_order(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their place in the conversation (rid, conv, place, role), and signatures (conv, sig).

    Ranges of the whole order cut long conversations into parts, so that no task sees more of one than a range; parts are strings
    of one character a row.
    """
    order = ["turn", "role", "sha"]
    ranged = signed.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(ranged.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).select("rid", "conv", "part", "at", "role", "n", "sig"))
    chained = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "sig"))), lambda x: x["sig"]), "").alias("sig")
    parts = materialize(placed.groupBy("conv", "part").agg(chained("at"), F.sum("n").alias("size")))
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("conv", "part", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    places = placed.join(offsets, ["conv", "part"]).select("rid", "conv", (F.col("ahead") + F.col("at")).alias("place"), "role")
    return places, parts.groupBy("conv").agg(chained("part"))


def repair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, rows) for a table of conv_id, turn, role, text.

    report: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per conversation.
    rows: conv_id, place (from 0), role, text, source_turn, edit (K, R or I): the conversations after their cheapest edits.

    Rows are ordered by turn (nulls first), then role, then SHA-256 of the text; rows alike in all of these are interchangeable and
    gathered before any shuffle by conversation. A null id is a conversation of its own, null roles and texts are one space,
    a role without the initial s, u or a is never kept, an empty table gives empty results; other columns are ignored.
    Each distinct signature is solved once, by halves, with remembered tables for short ones. A signature and an audit are one
    character a row, which is what the report holds of a conversation in one row; texts never come together.
    """
    e = entries(df)
    places, signatures = in_order(signed(e))
    signatures = materialize(signatures)
    solutions = signatures.select("sig").distinct().mapInPandas(
        solve, "sig string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, places array<int>, roles array<string>"
    )
    solutions = materialize(solutions)
    turns = e.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_rows"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    )
    report = turns.join(signatures.join(solutions.drop("places", "roles"), "sig"), "conv").select("conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = solutions.select("sig", F.posexplode(F.arrays_zip("places", "roles")).alias("out", "x")).select("sig", "out", F.col("x.places").cast("long").alias("place"), F.col("x.roles").alias("new"))
    edits = materialize(signatures.join(edits, "sig").drop("sig"))
    kept = edits.join(places, ["conv", "place"]).select("rid", "out", "new").join(e.select("rid", "conv_id", "turn", "role", "text"), "rid")
    kept = kept.select("conv_id", F.col("out").alias("place"), F.when(F.col("new") == "", F.col("role")).otherwise(F.col("new")).alias("role"), "text", F.col("turn").alias("source_turn"), F.when(F.col("new") == "", "K").otherwise("R").alias("edit"))
    added = edits.where("place < 0").select(F.expr("try_cast(conv AS long)").alias("conv_id"), F.col("out").alias("place"), F.col("new").alias("role"), F.lit("").alias("text"), F.lit(None).cast("long").alias("source_turn"), F.lit("I").alias("edit"))
    return report, kept.unionByName(added)


def text_hashes(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` lines: rows stream through the hash in order, so a long conversation is never held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = digest = None
        for f in frames:
            done = []
            for conv, role, text in zip(f["conv"], f["role"], f["text"], strict=True):
                data = f"{role}:{text}".encode("utf-8", "replace")
                if digest is None or conv != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256(data)
                else:
                    digest.update(b"\n" + data)
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if digest is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    keyed = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "place", "role", "text")
    hashed = keyed.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "role", "text").mapInPandas(run, "conv string, repaired_sha256 string")
    return hashed.select(F.expr("try_cast(conv AS long)").alias("conv_id"), "repaired_sha256")


def damaged(df: DataFrame) -> DataFrame:
    """The faults that the query's contract plants, by crc32 of `conv_id:turn`: dropped, emptied, unended, repeated, user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("fault")
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time")


def repaired_digest(df: DataFrame) -> DataFrame:
    """The report on the damaged rows for every conv_id of df, with the hash of the repaired text."""
    report, rows = repair(damaged(df))
    hashes = text_hashes(rows).withColumnRenamed("conv_id", "h")
    found = report.withColumnRenamed("conv_id", "r")
    ids = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["r"]), "left").join(hashes, ids["conv_id"].eqNullSafe(hashes["h"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
