"""Exact substring dedup: every byte covered by a long string that also starts earlier is removed.

Scale comes from anchors. Of the hashes of all 32-byte grams in each window of `least` bytes the smallest is an anchor, so
equal strings of that length hold equal anchors at equal places. Only anchors that occur more than once matter, and with
them the bytes around them that a string of `least` bytes through the anchor can reach: its context. Equal contexts are
collapsed to the first; distinct contexts of one anchor meet in a task of bounded size. There, a Burrows-Wheeler
transform of the contexts is expanded breadth first, one character further back a level, so that common prefixes come out
by increasing length; at `least` the expansion stops and what is still together is a set of equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, place_order, text_rows

GRAM = 32
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(parts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts: hash, text number and place of every gram that is the least of some window of `least` bytes."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    data = b"".join(parts)
    n, wide = len(data) - GRAM + 1, least - GRAM + 1
    if n < wide:
        return np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int)
    # eight bytes at every place as one number; a gram is a few of these, each times its own odd factor
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()
    h = eight[:n] * P
    for k in range(8, GRAM, 8):
        h += eight[k : n + k] * (Q << np.uint64(k) | P)
    h ^= h >> np.uint64(32)
    h *= P
    h ^= h >> np.uint64(29)

    def window(x: np.ndarray, f) -> np.ndarray:
        """f over every `wide` consecutive values."""
        step = 1
        while step * 2 <= wide:
            x = f(x[:-step], x[step:])
            step *= 2
        return f(x[: len(x) - (wide - step)], x[wide - step :]) if wide > step else x

    low = window(h, np.minimum)
    inside = np.zeros(len(low) + 1, np.int32)  # windows that lie in one text
    full = sizes >= least
    np.add.at(inside, (ends - sizes)[full], 1)
    np.add.at(inside, (ends - least + 1)[full], -1)
    low[np.cumsum(inside)[:-1] == 0] = 0
    pad = np.zeros(wide - 1, np.uint64)
    high = window(np.concatenate((pad, low, pad)), np.maximum)
    at = np.flatnonzero((high == h) & (high > 0))
    text = np.searchsorted(ends, at, side="right")
    return h[at], text, at - (ends - sizes)[text]


def batches(frame: pd.DataFrame, size: int = 100_000) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """The rows and their UTF-8 bytes, about `size` bytes at a time, which keeps the arrays over all places small."""
    data = [(t or "").encode("utf-8", "replace") for t in frame["text"]]
    lo = held = 0
    for i, d in enumerate(data):
        held += len(d)
        if held >= size or i == len(data) - 1:
            yield frame.iloc[lo : i + 1], data[lo : i + 1]
            lo, held = i + 1, 0


def anchor_rows(least: int):
    """Hash of every anchor, 128-bit hash of its context (and of the anchor's place in it), and where the context lies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach, digest = least - GRAM, xxhash.xxh3_128_digest
        for frame in frames:
            for f, data in batches(frame):
                h, text, pos = anchors(data, least)
                left = np.minimum(pos, reach)
                size = np.minimum(pos + GRAM + reach, np.fromiter(map(len, data), np.int64, len(data))[text]) - pos + left
                start = pos - left
                c = b"".join([digest(data[t][s : s + n], r) for t, s, n, r in zip(text.tolist(), start.tolist(), size.tolist(), left.tolist(), strict=True)])
                c = np.frombuffer(c, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"h": h.view(np.int64), "c": c[:, 0], "d": c[:, 1], "doc_id": f["doc_id"].astype("Int64").array[text], "dkey": f["dkey"].to_numpy()[text], "start": start.astype(np.int32), "size": size.astype(np.int32)})

    return run


def cut_contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the contexts listed in column heads of each text."""
    for frame in frames:
        for lo in range(0, len(frame), 200):
            rows = []
            for doc, dkey, text, heads in zip(*(frame[c].iloc[lo : lo + 200] for c in ("doc_id", "dkey", "text", "heads")), strict=True):
                data, doc = text.encode("utf-8", "replace"), None if pd.isna(doc) else int(doc)
                rows += [(x["h"], x["m"], doc, dkey, x["start"], data[x["start"] : x["start"] + x["size"]]) for x in heads]
            yield pd.DataFrame(rows, columns=["h", "m", "doc_id", "dkey", "start", "context"]).astype({"doc_id": "Int64"})


def sorted_suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All suffixes in the order of their first `least` codes at least, where in that order prefixes of the returned length
    begin to differ, and that length: the greatest up to `least` that the doubling of the compared length has met."""
    n, base = len(codes), int(codes.max()) + 1
    width = max(k for k in range(1, least + 1) if k == 1 or base**k < 2**62)
    padded, key = np.concatenate((codes, np.zeros(width, np.int64))), np.zeros(n, np.int64)
    for i in range(width):
        key = key * base + padded[i : n + i]
    edge, known = np.ones(n + 1, bool), 0
    while True:
        order = np.argsort(key)
        new = np.diff(key[order]) != 0
        if width <= least:
            edge[1:n], known = new, width
        if width >= least:
            return order, edge, known
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(new)
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


def equal_strings(contexts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal strings of `least` bytes: group, context and offset of every member of a group of two or more."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    codes[begin + sizes] = 0  # a separator; strings that hold one are left out at the end
    codes = (np.cumsum(np.bincount(codes, minlength=257) > 0) - 1)[codes]
    order, edge, level = sorted_suffixes(codes, least)
    n = len(codes)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    live = np.flatnonzero(~edge[:n])
    after = row[(order + 1) % n]  # in the transform's terms, the row that a backward step leads here from
    a, b = after[live - 1], after[live]
    for _ in range(least - level):
        if not len(live):
            break
        seen = np.cumsum(edge[:n], dtype=np.int32)
        # a string's interval, put one character further back, splits where the interval it comes from is split
        split = seen[a] != seen[b]
        edge[live[split]] = True
        live, a, b = live[~split], a[~split], b[~split]
    keep = ~edge[:n]
    keep[:-1] |= keep[1:]
    rows = np.flatnonzero(keep)
    group, at = np.cumsum(edge[:n])[rows], order[rows]
    owner = np.searchsorted(begin, at, side="right") - 1
    whole = at - begin[owner] + least <= sizes[owner]  # equal strings hold a separator all or none
    return group[whole], owner[whole], (at - begin[owner])[whole]


def covered(least: int, batch: int = 48_000):
    """dkey, start, stop: starts (stop exclusive) of strings that also start earlier; anchors are expanded a few at a time."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("h", kind="stable").reset_index(drop=True)
        h, held = frame["h"].to_numpy(), np.cumsum(frame["context"].map(len).to_numpy())
        ends = np.flatnonzero(np.concatenate((h[1:] != h[:-1], [True]))) + 1
        lo, keys, starts = 0, [], []
        for end in ends.tolist():
            if held[end - 1] - (held[lo - 1] if lo else 0) >= batch or end == len(frame):
                key, w = late_starts(frame.iloc[lo:end], least)
                keys.append(key)
                starts.append(w)
                lo = end
        key, w = np.concatenate(keys), np.concatenate(starts)
        order = np.lexsort((w, key))
        key, w = key[order], w[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (w[1:] > w[:-1] + 1))) if len(w) else np.empty(0, bool)
        at = np.flatnonzero(new)
        last = np.concatenate((at[1:], [len(w)])).astype(int) - 1 if len(w) else at
        return pd.DataFrame({"dkey": key[at], "start": w[at].astype(np.int32), "stop": (w[last] + 1).astype(np.int32)})

    return run


def late_starts(frame: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of every string of these contexts that another of them holds earlier."""
    group, owner, offset = equal_strings(frame["context"].to_list(), least)
    known = frame["doc_id"].notna().to_numpy()
    doc, dkey = frame["doc_id"].fillna(0).to_numpy(np.int64), frame["dkey"].to_numpy(np.int64)
    where = frame["start"].to_numpy(np.int64)[owner] + offset
    ids, has = doc[owner], known[owner]
    order = np.lexsort((where, ids, has, group))  # a null id comes first
    g, w, d, k, key = group[order], where[order], ids[order], has[order], dkey[owner][order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, int)
    lead = np.repeat(head, np.diff([*head, len(g)]))
    late = (w != w[lead]) | (d != d[lead]) | (k != k[lead])
    return key[late], w[late]


def repeat_starts(docs: DataFrame, least: int, hot: int = 20_000, task_bytes: int = 2_000_000) -> DataFrame:
    """(dkey, start, stop) ranges of starts whose strings of `least` bytes start earlier too; ranges may overlap."""
    found = materialize(docs.mapInPandas(anchor_rows(least), "h long, c long, d long, doc_id long, dkey long, start int, size int"))
    shared = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    held = materialize(found.join(shared, "h", "left_semi"))
    discard(found)
    contexts = held.withColumn("order", place_order())
    first = contexts.groupBy("h", "c", "d").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    several = first.groupBy("h").agg(F.count("*").alias("m"))
    first = materialize(first.join(several, "h").where("n > 1 OR m > 1").select("h", "c", "d", "first", "m"))
    met = contexts.join(first, ["h", "c", "d"]).withColumn("again", F.col("order") > F.col("first")).where("again OR m > 1")
    met = materialize(met.select("h", "m", "dkey", "start", "size", "again"))
    discard(held, first)
    whole = met.where("again").select("dkey", "start", (F.col("start") + F.col("size") - (least - 1)).cast("int").alias("stop")).where("stop > start")
    heads = met.where("NOT again").groupBy("dkey").agg(F.collect_set(F.struct("h", "m", "start", "size")).alias("heads"))
    total = met.where(f"NOT again AND m <= {hot}").agg(F.sum("size")).first()[0] or 0
    heads = materialize(docs.join(heads, "dkey").mapInPandas(cut_contexts, "h long, m long, doc_id long, dkey long, start int, context binary"))
    buckets = max(1, total // task_bytes)
    bwt = heads.where(F.col("m") <= hot).select(F.pmod("h", F.lit(buckets)).alias("bucket"), "h", "doc_id", "dkey", "start", "context").groupBy("bucket").applyInPandas(covered(least), "dkey long, start int, stop int")
    # anchors with very many contexts: the strings themselves are keys of a partially aggregated minimum
    crowded = heads.where(F.col("m") > hot)
    if crowded.isEmpty():
        return whole.union(bwt)
    spread = crowded.select("dkey", "start", place_order().alias("order"), "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - least)).alias("at"))
    spread = spread.select("dkey", (F.col("start") + F.col("at")).alias("start"), (F.col("order") + F.col("at")).cast("decimal(38,0)").alias("order"), F.expr(f"substring(context, at + 1, {least})").alias("string"))
    least_of = materialize(spread.groupBy("string").agg(F.min("order").alias("first")))
    far = spread.join(least_of, "string").where("order > first").select("dkey", "start", (F.col("start") + 1).cast("int").alias("stop"))
    return whole.union(bwt).union(far)


def repeated_bytes(df: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, ranges: array of (start, stop) starts of repeated strings, null if there are none.

    Texts are UTF-8 bytes; matches never leave a document. Earlier means a smaller doc_id (null first), or an earlier start
    in the same one; rows that share an id are one document for this order. Null and empty texts, and texts of fewer than
    `least` bytes, keep everything; copies of a row (id and text) get the same result; other columns are ignored.
    """
    docs = text_rows(df, id_col, text_col).withColumn("dkey", F.xxhash64("doc_id", "text"))
    ranges = repeat_starts(docs, least).groupBy("dkey").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    return docs.join(materialize(ranges), "dkey", "left").select("doc_id", "text", "ranges")


def runs(ranges, size: int, least: int) -> np.ndarray:
    """Removed runs as rows (begin, end) of bytes, apart from one another."""
    if ranges is None or not len(ranges):
        return np.empty((0, 2), np.int64)
    pairs = sorted((r["start"], r["stop"] - 1 + least) for r in ranges)
    out = [list(pairs[0])]
    for a, b in pairs[1:]:
        if a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.minimum(np.array(out), size)


def without_repeats(found: DataFrame, least: int = 100) -> DataFrame:
    """repeated_bytes() output as doc_id, n_bytes, n_removed, n_spans, kept (bytes: a removed run may cut a character)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text, ranges in zip(f["text"], f["ranges"], strict=True):
                data = (text or "").encode("utf-8", "replace")
                gone = runs(ranges, len(data), least)
                at, kept = 0, []
                for a, b in gone.tolist():
                    kept.append(data[at:a])
                    at = b
                rows.append((len(data), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), b"".join([*kept, data[at:]])))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").array)
            yield out

    return found.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame, least: int = 100) -> DataFrame:
    return without_repeats(found, least).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
