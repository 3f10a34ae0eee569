"""Substring dedup by paragraph MinHash banding: near-equal paragraphs are clustered and all but the first of a cluster removed.

Lines are the paragraphs that are compared for similarity. A passage that is repeated inside longer, different lines, or
over several short ones, is found by windows of words that start at content-defined places: equal windows are one
paragraph, whatever surrounds them, and all but the first are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, WordHashes, connected_components, gram_hashes, materialize, place_order, text_rows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
REACH = 4  # words on either side that decide on a window's start


def tuned(similarity: float, recall: float = 0.999, rows: int = 2) -> int:
    """The least number of bands of `rows` hashes that finds a pair of that similarity with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def paragraphs(text: str | None, least: int) -> Iterator[tuple[int, list[bytes]]]:
    """Line number and lower-cased words of every line of at least `least` words."""
    for i, line in enumerate((text or "").encode("utf-8", "replace").lower().split(b"\n")):
        words = line.split()
        if len(words) >= max(1, least):
            yield i, words


def window_starts(h: np.ndarray, window: int) -> np.ndarray:
    """Content-defined places: where the hash of three words is less than the REACH hashes before it and no more than the REACH after.

    They depend on the words within REACH of them only, so a passage has them at the same places in every document.
    """
    grams = gram_hashes(h, 3)
    n = len(grams)
    if n < 3 or len(h) < window:
        return np.empty(0, np.int64)
    top = np.full(REACH, np.uint64(2**64 - 1))
    padded, least = np.concatenate((top, grams, top)), np.ones(n, bool)
    for k in range(1, REACH + 1):
        least &= (grams < padded[REACH - k : REACH - k + n]) & (grams <= padded[REACH + k : REACH + k + n])
    at = np.flatnonzero(least)
    return at[at + window <= len(h)]


def window_keys(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """128 bits over the words of each window, as two columns of longs."""
    factors = np.random.default_rng(13).integers(1, 2**63, (window, 2), np.uint64) | np.uint64(1)
    words = h[starts[:, None] + np.arange(window)]
    return np.stack([(words * factors[:, k]).sum(axis=1, dtype=np.uint64) for k in range(2)], axis=1).view(np.int64)


def signer(least: int, size: int, window: int, bands: int, rows: int):
    """One row per line of at least `least` words, with its band hashes, and one per window of words, with none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, memo = np.random.default_rng(11), WordHashes()
        mult = rng.integers(1, 2**63, bands * rows, np.uint64) | np.uint64(1)
        xor = rng.integers(0, 2**63, bands * rows, np.uint64)
        for f in frames:
            for lo in range(0, len(f), 100):
                part = f.iloc[lo : lo + 100]
                held, grams, places, keys = [], [], [], []
                for i, text in enumerate(part["text"]):
                    lines = [line.split() for line in text.encode("utf-8", "replace").lower().split(b"\n")]
                    counts = list(map(len, lines))
                    h, ends = memo.of([w for line in lines for w in line]), np.cumsum(counts).tolist()
                    for pos, (n, end) in enumerate(zip(counts, ends, strict=True)):
                        if n >= max(1, least):
                            grams.append(gram_hashes(h[end - n : end], size))
                            held.append((i, pos, xxhash.xxh64_intdigest(b" ".join(lines[pos]))))
                    starts = window_starts(h, window)
                    if len(starts):
                        places.append(np.stack((np.full(len(starts), i), starts), axis=1))
                        keys.append(window_keys(h, starts, window))
                docs, dkeys = part["doc_id"].astype("Int64").array, part["dkey"].to_numpy()
                if held:
                    at, pos, pid = (np.array(x, t) for x, t in zip(zip(*held, strict=True), (np.int64, np.int32, np.uint64), strict=True))
                    begin = np.cumsum([0, *map(len, grams[:-1])])
                    h = np.concatenate(grams)
                    low = np.stack([np.minimum.reduceat((h ^ x) * m, begin) for m, x in zip(mult, xor, strict=True)])
                    band = np.zeros((len(held), bands), np.uint64)
                    for b in range(bands):
                        mixed = np.full(len(held), b + 1, np.uint64)
                        for r in range(rows):
                            mixed = (mixed ^ low[b * rows + r]) * MIX
                            mixed ^= mixed >> np.uint64(31)
                        band[:, b] = mixed
                    yield pd.DataFrame({"doc_id": docs[at], "dkey": dkeys[at], "pos": pos, "pid": pid.view(np.int64), "more": np.zeros(len(held), np.int64), "bands": list(band.view(np.int64))})
                if places:
                    place, key = np.concatenate(places), np.concatenate(keys)
                    yield pd.DataFrame({"doc_id": docs[place[:, 0]], "dkey": dkeys[place[:, 0]], "pos": place[:, 1].astype(np.int32), "pid": key[:, 0], "more": key[:, 1], "bands": pd.Series([None] * len(key), dtype=object)})

    return run


def shingler(least: int, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for f in frames:
            pids, sets = [], []
            for text, wanted in zip(f["text"], f["wanted"], strict=True):
                wanted = set(wanted.tolist())
                for pos, words in paragraphs(text, least):
                    if pos in wanted:
                        pids.append(xxhash.xxh64_intdigest(b" ".join(words)))
                        sets.append(np.unique(gram_hashes(memo.of(words), size)).view(np.int64))
            yield pd.DataFrame({"pid": np.array(pids, np.uint64).view(np.int64), "grams": pd.Series(sets, dtype=object)})

    return run


def cross_links(similarity: float):
    """Links of members that are not like their group's centre to any member of the group: exact Jaccard, local components."""

    def band_links(ask: pd.DataFrame, data: pd.DataFrame) -> dict[int, int]:
        label: dict[int, int] = {}

        def root(i: int) -> int:
            label.setdefault(i, i)
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        sizes = np.array([len(g) for g in data["grams"]])
        grams, owner = np.concatenate(data["grams"].to_list()), np.repeat(np.arange(len(data)), sizes)
        order = np.argsort(grams, kind="stable")
        grams, owner, ids = grams[order], owner[order], data["pid"].to_numpy()
        for pid, own in zip(ask["pid"].tolist(), ask["grams"], strict=True):
            lo, hi = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
            width = hi - lo
            at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
            common = np.bincount(owner[at], minlength=len(ids))
            for other in ids[common >= similarity * (sizes + len(own) - common)].tolist():
                a, b = root(pid), root(other)
                label[max(a, b)] = min(a, b)
        return {i: root(i) for i in label}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, f in frame.groupby("band"):
            ask, data = f[f["ask"]].drop_duplicates("pid"), f[f["data"]].drop_duplicates("pid")
            if len(ask) and len(data):
                out += [(a, b) for a, b in band_links(ask, data).items() if a != b]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def paragraph_links(distinct: DataFrame, docs: DataFrame, bands: int, least: int, size: int, similarity: float, block: int = 2000) -> DataFrame:
    """(a, b): links between distinct paragraphs that collide in a band and are verified by exact Jaccard.

    Every member of a band group is compared with the group's centre, its most frequent paragraph: a join that adaptive
    execution splits when a group is large. Members unlike the centre are then compared with the whole group, in blocks
    of bounded size, without emitting pairs.
    """
    sent = distinct.select("pid", "n", F.explode(F.array(*[f"b{i}" for i in range(bands)])).alias("band"))
    groups = sent.groupBy("band").agg(F.count("*").alias("members"), F.max(F.struct("n", "pid"))["pid"].alias("centre")).where("members > 1")
    met = materialize(sent.join(groups, "band").select("band", "pid", "centre", "members"))
    pairs = met.where("pid != centre").select("pid", "centre").distinct()
    wanted = pairs.select("pid").union(pairs.select("centre")).distinct().join(distinct, "pid").groupBy(F.col("first.dkey").alias("dkey")).agg(F.collect_set("first.pos").alias("wanted"))
    sets = docs.dropDuplicates(["dkey"]).join(wanted, "dkey").select("text", "wanted").mapInPandas(shingler(least, size), "pid long, grams array<long>")
    sets = materialize(sets.dropDuplicates(["pid"]))
    centre_sets = sets.select(F.col("pid").alias("centre"), F.col("grams").alias("theirs"))
    common = F.size(F.array_intersect("grams", "theirs"))
    judged = pairs.join(sets, "pid").join(centre_sets, "centre")
    judged = materialize(judged.select("pid", "centre", (common >= similarity * (F.size("grams") + F.size("theirs") - common)).alias("alike")))
    near = judged.where("alike").select(F.col("pid").alias("a"), F.col("centre").alias("b"))
    odd = met.where("members > 2").join(judged.where("NOT alike").select("pid", "centre"), ["pid", "centre"]).select("band", "pid")
    loose = odd.groupBy("band").agg(F.count("*").alias("odd"))
    work = met.where("members > 2").select("band", "pid", "members").join(loose, "band").join(odd.withColumn("ask", F.lit(True)), ["band", "pid"], "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    work = materialize(work)
    rows = work.count()
    if not rows:
        return near
    buckets = max(1, rows // 5000)
    blocks = F.ceil(F.col("members") / block).cast("int")
    work = work.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    small = work.where("blocks = 1").select("band", "pid", "ask", F.lit(True).alias("data"), F.pmod("band", F.lit(buckets)).alias("place"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    data = work.where("blocks > 1").select("band", "pid", F.lit(False).alias("ask"), F.lit(True).alias("data"), F.col("band").alias("place"), F.col("own").alias("x"), every.alias("y"))
    ask = work.where("blocks > 1 AND ask").select("band", "pid", F.lit(True).alias("ask"), F.lit(False).alias("data"), F.col("band").alias("place"), every.alias("x"), F.col("own").alias("y"))
    far = small.unionByName(data).unionByName(ask).join(sets, "pid").groupBy("place", "x", "y").applyInPandas(cross_links(similarity), "a long, b long")
    return near.union(far)


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, dkey, pos, pid, more) -> dkey, windows (starts of those that also stand earlier), seen_in (documents of the first ones)."""
    placed = windows.withColumn("order", place_order(start="pos"))
    first = placed.groupBy("pid", "more").agg(F.min("order").alias("first"), F.min("doc_id").alias("seen"), F.count("*").alias("n")).where("n > 1").select("pid", "more", "first", "seen")
    again = placed.join(first, ["pid", "more"]).where("order > first")
    return again.groupBy("dkey").agg(F.array_sort(F.collect_set("pos")).alias("windows"), F.array_sort(F.collect_set("seen")).alias("seen_in"))


def repeated_paragraphs(df: DataFrame, similarity: float = 0.8, size: int = 5, least: int = 20, window: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, gone (sorted numbers of the lines removed), windows (first words of the windows
    removed, counted from 0 over the text), kept_in (documents that keep what was removed).

    A paragraph is a line of at least `least` words. Paragraphs of equal words count as one (by a 64-bit hash of them);
    distinct ones whose word-shingle sets have a Jaccard similarity of at least `similarity` are linked, and of each
    connected group only the first in (doc_id, line) order stays, wherever it repeats, also in its own document.
    Windows are `window` words, starting about every 2 * REACH + 1 words at places that their content defines; one whose
    words stand at an earlier (doc_id, word) as a window is removed. Of a passage of over 50 words the ends, some 12 words
    at most as a rule, may stay. Null and empty texts have no paragraphs; a null id comes before all others; copies
    of a row (id and text) are one document, and rows that share an id keep equal windows at equal places.
    """
    bands, rows = tuned(similarity), 2
    docs = text_rows(df, id_col, text_col).withColumn("dkey", F.xxhash64("doc_id", "text"))
    signed = materialize(docs.mapInPandas(signer(least, size, window, bands, rows), "doc_id long, dkey long, pos int, pid long, more long, bands array<long>"))
    lines = signed.where("bands IS NOT NULL").select("doc_id", "dkey", "pos", "pid", *[F.col("bands")[i].alias(f"b{i}") for i in range(bands)])
    place = F.struct("doc_id", "pos", "dkey")
    distinct = materialize(lines.groupBy("pid").agg(F.min(place).alias("first"), F.count("*").alias("n"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(bands)]))
    comps = connected_components(paragraph_links(distinct, docs, bands, least, size, similarity))
    named = distinct.join(comps, distinct["pid"] == comps["node"], "left").select("pid", "first", "n", F.coalesce("component", "pid").alias("component"))
    first = named.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1").select("component", "keep")
    keep = materialize(named.select("pid", "component").join(first, "component").select("pid", "keep"))
    gone = lines.select("dkey", "doc_id", "pos", "pid").join(keep, "pid").where(~place.eqNullSafe(F.col("keep")))
    by_doc = gone.groupBy("dkey").agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.array_sort(F.collect_set("keep.doc_id")).alias("kept_in"))
    by_window = repeated_windows(signed.where("bands IS NULL").select("doc_id", "dkey", "pos", "pid", "more"))
    found = materialize(by_doc.join(by_window, "dkey", "full"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    kept_in = F.array_sort(F.array_union(F.coalesce("kept_in", none("long")), F.coalesce("seen_in", none("long"))))
    return docs.join(found, "dkey", "left").select("doc_id", "text", F.coalesce("gone", none("int")).alias("gone"), F.coalesce("windows", none("int")).alias("windows"), kept_in.alias("kept_in"))


def remainder(text: bytes, gone: list[int], windows: list[int], window: int) -> bytes:
    """The lines that are not gone, without the words of the windows and what follows them up to the next word; lines that lose all their words go."""
    if not gone and not windows:
        return text
    cut, out, n = set(gone), [], 0
    dropped = np.zeros(max(windows, default=0) + window, bool)
    for w in windows:
        dropped[w : w + window] = True
    for i, line in enumerate(text.split(b"\n")):
        words = len(line.split())
        lost = dropped[n : n + words]
        n += words
        if i in cut or (words and lost.sum() == words):
            continue
        if lost.any():
            starts = [m.start() for m in WORD.finditer(line)]
            edges = [0, *starts[1:], len(line)]
            line = b"".join(line[a:b] for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if k >= len(lost) or not lost[k])
        out.append(line)
    return b"\n".join(out)


def without_repeats(found: DataFrame, window: int = 25) -> DataFrame:
    """repeated_paragraphs() output with column kept: the text without the removed lines and windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kept = [remainder(t.encode("utf-8", "replace"), g.tolist(), w.tolist(), window).decode("utf-8", "replace") for t, g, w in zip(f["text"], f["gone"], f["windows"], strict=True)]
            yield f.assign(doc_id=f["doc_id"].astype("Int64"), kept=kept)

    schema = "doc_id long, text string, gone array<int>, windows array<int>, kept_in array<long>, kept string"
    return found.select("doc_id", "text", "gone", "windows", "kept_in").mapInPandas(run, schema)


def digest(found: DataFrame) -> DataFrame:
    out = without_repeats(found)
    n, kept = F.octet_length("text").cast("long"), F.octet_length("kept").cast("long")
    return out.select("doc_id", kept.alias("kept_bytes"), (n - kept).alias("n_removed"), F.size("gone").cast("long").alias("n_lines_removed"), F.size("windows").cast("long").alias("n_windows_removed"), F.sha2("kept", 256).alias("kept_sha256"), "kept_in")
