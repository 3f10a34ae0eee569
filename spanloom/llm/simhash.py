"""SimHash near-dedup with meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, WordHashes, connected_components, discard, gram_hashes, local_components, materialize, text_rows


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of 64-bit numbers; 255 rows at a time fit a byte."""
    bits = np.zeros(h.shape[1] * 64, np.int64)
    for lo in range(0, len(h), 255):
        bits += np.add.reduce(np.unpackbits(h[lo : lo + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return bits


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' hashes. No words: 0."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    line, stops = b" ".join(words), (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    last = min(shingle, len(words)) - 1
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n], stops[last:], strict=True)), np.uint64, n)
    bits = bit_counts(h.reshape(n, 1))
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.fromiter((fingerprint(t, shingle) for t in f["text"]), np.uint64, len(f))
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    return text_rows(df, id_col, text_col).mapInPandas(run, "doc_id long, fp long")


def ball_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly those within 2 bits of one another.

    Each fingerprint emits itself and its 64 one-bit variants, half the radius. Two fingerprints share a variant if
    and only if they differ in 2 bits at most. What meets at a variant is known by the flipped bit, so a group is kept as
    a 64-bit mask and a flag, whatever its size, and summed before the shuffle. All members of a group lie within one bit of
    the variant, hence within 2 of each other: linking them to the least member verifies every pair.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("v"), i.alias("bit")))
    sent = F.concat(flips, F.array(F.struct(F.col("fp").alias("v"), F.lit(64).alias("bit"))))
    variants = fps.select(F.explode(sent).alias("x")).select("x.v", F.when(F.col("x.bit") < 64, F.expr("shiftleft(1L, x.bit)")).otherwise(F.lit(0).cast("long")).alias("mask"), (F.col("x.bit") == 64).cast("int").alias("self"))
    met = variants.groupBy("v").agg(F.bit_or("mask").alias("mask"), F.max("self").alias("self")).where(F.bit_count("mask") + F.col("self") >= 2)
    members = F.concat(
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0), lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
        F.when(F.col("self") == 1, F.array("v")).otherwise(F.array().cast("array<long>")),
    )
    pairs = met.select(members.alias("m")).select(F.explode("m").alias("a"), F.array_min("m").alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct()


def simhash_groups(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other; repeated rows each keep a row; rows with a null
    id get their group's id; other columns are ignored.
    """
    docs = materialize(fingerprints(df, shingle, id_col, text_col))
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("low"))
    fps = materialize(fps)
    dealt = fps.repartition(max(8, fps.count() // 16_384), "fp")  # each becomes 65 rows
    comps = connected_components(ball_links(dealt))
    named = fps.join(comps, fps["fp"] == comps["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = materialize(named.join(least, "component").select("fp", "component_id"))
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


TABLES_AT_ONCE, STAR_TABLES = 13, 3  # what near_copies() shuffles at once; tables that find the dense groups first
SMALL, LEAF = 64, 50_000  # members of a ball that are compared along with other balls; rows of a bucket that are expanded at once
BUCKET = 400_000  # rows of a bucket that one task takes; larger ones are split


def tuned(width: int, similarity: float, recall: float) -> int:
    """The least number of tables of `width` bits that brings a pair of that Jaccard similarity within 2 bits in one of them with that probability."""
    p = differing(similarity)
    met = sum(comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(3))
    return int(np.ceil(np.log(1 - recall) / np.log(1 - met)))


def differing(similarity: float) -> float:
    """Probability that a bit differs in a pair of that Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def tolerance(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of a pair of that Jaccard similarity may differ: the mean and four deviations."""
    p = differing(similarity)
    return int(np.ceil(bits * p + 4 * np.sqrt(bits * p * (1 - p))))


def shingle_set(text: str | None, shingle: int, memo: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's word shingles; of the whole sequence if it is shorter."""
    return np.unique(gram_hashes(memo.of(text.encode("utf-8", "replace").lower().split() if text else []), shingle))


def long_fingerprint(grams: np.ndarray, count: int) -> np.ndarray:
    """count * 64 bits over the set of word shingles, as longs; zeros without words."""
    lanes = np.arange(1, count + 1, dtype=np.uint64) * MIX
    bits = np.zeros(count * 64, np.int64)
    for lo in range(0, len(grams), 4080):
        h = (grams[lo : lo + 4080, None] ^ lanes) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(32))) * MIX
        bits += bit_counts(h ^ (h >> np.uint64(29)))
    return np.packbits(bits * 2 > len(grams), bitorder="little").view(np.int64)


def near_copies(df: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep: for every document in a group of near copies, the smallest doc_id of the group.

    A pair of that similarity differs in more bits than a ball of a 64-bit fingerprint can hold, so a long fingerprint is cut
    into tables of short ones; in each table the ball hashing runs on the short fingerprints. All that meet in a ball are
    compared, first by all bits of the long fingerprints, then by the exact Jaccard similarity of the sets of word shingles;
    only pairs that are known to be in one group are passed over. So that dense groups are known early, each document is first
    compared with the least one that it meets in a few tables, twice. The bits of a table are log2 of the number of documents and 14 more, so chance
    collisions stay below one a document and table at any size; the number of tables follows, so that a pair of just that
    similarity meets with probability `recall` (for independent bits). Documents of equal long fingerprints are
    compared like any others. Null and empty texts are left alone, as are null ids; repeated ids are one document; other
    columns are ignored.
    """
    docs = text_rows(df, id_col, text_col).where("text != '' AND doc_id IS NOT NULL")
    rows = max(2, docs.count())
    width = min(60, max(26, int(np.ceil(np.log2(rows))) + 14))
    tables = tuned(width, similarity, recall)
    lanes = -(-tables * width // 64) + 2
    prefix = min(16, max(4, int(np.ceil(np.log2(rows / 65_536)))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for f in frames:
            fps = np.stack([long_fingerprint(shingle_set(t, shingle, memo), lanes) for t in f["text"]]) if len(f) else np.zeros((0, lanes), np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"]} | {f"f{k}": fps[:, k] for k in range(lanes)})

    names = [f"f{k}" for k in range(lanes)]
    marked = materialize(docs.mapInPandas(run, "doc_id long, " + ", ".join(f"{n} long" for n in names)))
    # equal fingerprints: one stands for all, each of the others is a candidate with it
    lead = materialize(marked.groupBy(*names).agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")))
    same = materialize(marked.join(lead.where("n > 1"), names).where("doc_id != lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")))
    discard(marked)
    most = tolerance(similarity, lanes * 64)
    known = verified(docs, same, shingle, similarity)
    for lo in (0, STAR_TABLES):
        star = met_pairs(labelled(lead, known), names, range(lo, min(lo + STAR_TABLES, tables)), width, prefix, most, True)
        known = known.union(verified(docs, star, shingle, similarity))
    lead, clusters = materialize(labelled(lead, known)), None
    for lo in range(0, tables, TABLES_AT_ONCE):
        some = materialize(met_pairs(lead, names, range(lo, min(tables, lo + TABLES_AT_ONCE)), width, prefix, tolerance(similarity, 128), False))
        clusters = some if clusters is None else clusters.union(some)
    near = compared(docs, lead, connected_components(clusters), names, shingle, similarity)
    return connected_components(known.union(near)).select(F.col("node").alias("doc_id"), F.col("component").alias("keep"))


def compared(docs: DataFrame, lead: DataFrame, clusters: DataFrame, names: list[str], shingle: int, similarity: float, block: int = 1000) -> DataFrame:
    """(a, b) that join up what is alike in the clusters (node, component): all members of different labels are compared, block
    by block, by their long fingerprints and then by exact Jaccard similarity; pairs never leave a task."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = clusters.withColumnRenamed("node", "lead").join(sizes, "component").join(lead, "lead").withColumn("own", F.pmod(F.xxhash64("lead"), F.col("blocks")).cast("int"))
    wanted = members.select(F.col("lead").alias("doc_id"))
    members = materialize(members.select("lead", "label", "component", "blocks", "own", *names))
    grams = materialize(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), shingle))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("own", i).alias("x"), F.greatest("own", i).alias("y")))
    batches = max(1, members.count() // block)  # clusters of one block share tasks
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(batches))).otherwise(F.col("component"))
    work = members.select("lead", "label", "component", "own", *names, task.alias("task"), F.explode(places).alias("at")).join(grams.withColumnRenamed("doc_id", "lead"), "lead")
    return materialize(work.select("task", "at.x", "at.y", "component", "own", "lead", "label", "grams", *names).groupBy("task", "x", "y").applyInPandas(block_links(names, tolerance(similarity, 64 * len(names)), similarity), "a long, b long"))


def labelled(lead: DataFrame, known: DataFrame) -> DataFrame:
    """lead with the least document of the group that the known pairs put it in."""
    labels = connected_components(known).withColumnsRenamed({"node": "lead", "component": "label"})
    return lead.join(labels, "lead", "left").withColumn("label", F.coalesce("label", "lead"))


def verified(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets of word shingles have at least that Jaccard similarity."""

    pairs = materialize(pairs.distinct())
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    grams = materialize(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), shingle))
    both = pairs.join(grams.withColumnsRenamed({"doc_id": "a", "grams": "ga"}), "a").join(grams.withColumnsRenamed({"doc_id": "b", "grams": "gb"}), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    near = materialize(both.where(common >= similarity * (F.size("ga") + F.size("gb") - common)).select("a", "b"))
    discard(pairs, grams)
    return near


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, grams: the sorted hashes of a document's word shingles, once for each id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "grams": pd.Series([shingle_set(t, shingle, memo).view(np.int64) for t in f["text"]], dtype=object)})

    return docs.mapInPandas(run, "doc_id long, grams array<long>").dropDuplicates(["doc_id"])


def met_pairs(lead: DataFrame, names: list[str], tables: range, width: int, prefix: int, most: int, star: bool) -> DataFrame:
    """(a, b) documents of different labels that meet in a ball of these tables.

    A fingerprint goes to the buckets of its one-bit variants, by their first `prefix` bits; the variants themselves are made
    in the bucket; large buckets are split by dealt(). With star, a document is paired with the least one of its balls only, and the pairs' long fingerprints
    differ in `most` bits at most. Else all members of a ball are compared in the bucket by a sketch of 128 other bits that may
    differ in `most`, and what comes out are not the pairs, but links that join up the same documents.
    """
    sketch = [F.col(n).alias(f"s{i}") for i, n in enumerate(names[-2:])]
    cut = lead.select("lead", "label", *(() if star else sketch), F.posexplode(F.array(*[short(names, t * width, width) for t in tables])).alias("table", "fp"))
    met = dealt(cut, width, prefix, star).groupBy("table", "bucket", "bits", "x", "y").applyInPandas(ball_members(width, most, star), "a long, b long").distinct()
    if not star:
        return met
    left, right = (lead.select(F.col("lead").alias(c), F.struct(*names).alias(f"f{c}")) for c in "ab")
    apart = sum((F.bit_count(F.col(f"fa.{n}").bitwiseXOR(F.col(f"fb.{n}"))) for n in names), F.lit(0))
    return met.join(left, "a").join(right, "b").where(apart <= most).select("a", "b")


def deeper(rows: DataFrame, width: int, bits: int, more: int) -> DataFrame:
    """Rows (table, bucket, fp, ...) of buckets of `bits` bits in those of `more` bits more: in the one of their next bits and, if their
    first bits are the bucket's, in the ones of the one-bit variants of these."""
    one = F.lit(1).cast("long")
    own = F.shiftrightunsigned("fp", width - bits) == F.col("bucket")
    first = F.shiftleft("bucket", more).bitwiseOR(F.shiftrightunsigned("fp", width - bits - more).bitwiseAND(F.lit((1 << more) - 1).cast("long")))
    flips = F.transform(F.sequence(F.lit(0), F.lit(more - 1)), lambda i: first.bitwiseXOR(F.call_function("shiftleft", one, i)))
    rest = [c for c in rows.columns if c != "bucket"]
    return rows.select(*rest, F.explode(F.concat(F.array(first), F.when(own, flips).otherwise(F.array().cast("array<long>")))).alias("bucket"))


def dealt(cut: DataFrame, width: int, prefix: int, star: bool, step: int = 8, broadcast_rows: int = 100_000) -> DataFrame:
    """The fingerprints (table, fp, ...) in the groups (table, bucket, bits, x, y) that a task compares.

    A bucket is a prefix of `bits` bits. Buckets are counted, and those of over BUCKET rows go on with longer prefixes. What is
    too large as a ball of the whole width, such as a template's, is dealt to parts by the hash of the document, and each two
    parts (x, y) are a group, so all members still meet; with star each part is a group of its own.
    """
    done, bits, more, rows = [], 0, prefix, cut.withColumn("bucket", F.lit(0).cast("long"))
    while True:
        top = F.shiftleft(F.shiftrightunsigned("fp", width - bits - more), width - bits - more).alias("fp")
        heads = rows.groupBy("table", "bucket", top).agg(F.count("*").alias("n"))
        sizes = deeper(heads, width, bits, more).groupBy("table", "bucket").agg(F.sum("n").alias("n"))
        large = materialize(sizes.where(F.col("n") > BUCKET))
        sent, bits = deeper(rows, width, bits, more), bits + more
        group = (F.lit(bits).alias("bits"), F.lit(0).alias("x"), F.lit(0).alias("y"))
        if not (hot := large.count()):
            return reduce(DataFrame.unionByName, done, sent.select("*", *group))
        large = F.broadcast(large) if hot <= broadcast_rows else large
        done.append(sent.join(large, ["table", "bucket"], "left_anti").select("*", *group))
        rows, more = sent.join(large, ["table", "bucket"]).select(*sent.columns, "n"), min(step, width - bits)
        if bits == width:
            break
        rows = rows.drop("n")
    parts = F.ceil(F.col("n") * 2 / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("lead"), parts).cast("int")
    pairs = F.array(F.struct(own.alias("x"), own.alias("y"))) if star else F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(own, i).alias("x"), F.greatest(own, i).alias("y")))
    split = rows.withColumn("at", F.explode(pairs)).select(*[c for c in rows.columns if c != "n"], F.lit(bits).alias("bits"), "at.x", "at.y")
    return reduce(DataFrame.unionByName, done, split)


def alike(sketch: np.ndarray, labels: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of x and y, all with all, of different labels and with sketches (rows of longs) that differ in `most` bits at most."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, 200_000 // max(1, len(y)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        apart = sum((np.bitwise_count(sketch[part, None, k] ^ sketch[None, y, k]).astype(np.int16) for k in range(sketch.shape[1])), np.zeros(1, np.int16))
        i, j = np.nonzero((apart <= most) & (labels[part, None] != labels[None, y]))
        a.append(part[i])
        b.append(y[j])
    return np.concatenate(a), np.concatenate(b)


def ball_members(width: int, most: int, star: bool):
    """Pairs (a, b) for met_pairs(), from one group of dealt()."""

    def leaf(fp, who, value, low):
        """Variants below a prefix of the fingerprints that have it, and of those that differ from it in one bit."""
        own = fp >> low == value
        mine, near = fp[own], fp[~own]
        made = [mine, *(mine ^ (1 << i) for i in range(low)), (value << low) | (near & ((1 << low) - 1))]
        return np.concatenate(made), np.concatenate([*[who[own]] * (low + 1), who[~own]]), np.arange(len(mine) * (low + 1) + len(near)) < len(mine) * (low + 1)

    def leaves(fp, who, value, low):
        if len(fp) <= LEAF or low == 0:
            yield leaf(fp, who, value, low)
            return
        own, bit = fp >> low == value, fp >> (low - 1) & 1
        for b in (0, 1):
            keep = own | (bit == b)
            yield from leaves(fp[keep], who[keep], value * 2 + b, low - 1)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, labels = frame["lead"].to_numpy(), frame["label"].to_numpy()
        order = np.argsort(ids)
        ids, labels = ids[order], labels[order]
        sketch = None if star else frame[["s0", "s1"]].to_numpy()[order].view(np.uint64)
        pairs = [np.empty((0, 2), np.int64)]
        for v, who, own in leaves(frame["fp"].to_numpy()[order], np.arange(len(ids)), int(frame["bucket"].iloc[0]), width - int(frame["bits"].iloc[0])):
            at = np.argsort(v, kind="stable")
            v, who, own = v[at], who[at], own[at]
            edge = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.empty(0, np.int64)
            size = np.diff([*edge, len(v)])
            if not len(edge):
                continue
            mixed = np.minimum.reduceat(labels[who], edge) != np.maximum.reduceat(labels[who], edge)
            first = np.minimum.reduceat(who, edge)
            if star:
                hit = np.repeat(mixed, size) & own
                a, b = who[hit], np.repeat(first, size)[hit]
                apart, least = labels[a] != labels[b], np.full(len(ids), len(ids))
                np.minimum.at(least, a[apart], b[apart])
                a = np.flatnonzero(least < len(ids))
                pairs.append(np.stack((least[a], a), axis=1))
                continue
            few = np.repeat(mixed & (size <= SMALL), size)
            w, ball = who[few], np.repeat(np.arange(len(size)), size)[few]
            for k in range(1, int(size[mixed & (size <= SMALL)].max(initial=1))):
                a, b = w[:-k][ball[k:] == ball[:-k]], w[k:][ball[k:] == ball[:-k]]
                near = (labels[a] != labels[b]) & (np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= most)
                pairs.append(np.stack((a[near], b[near]), axis=1))
            for at in np.flatnonzero(mixed & (size > SMALL)).tolist():
                members = np.unique(who[edge[at] : edge[at] + size[at]])
                pairs.append(np.stack(alike(sketch, labels, members, members, most), axis=1))
            pairs = [forest(len(ids), np.concatenate(pairs))]
        p = np.concatenate(pairs)
        return pd.DataFrame({"a": ids[p[:, 1]], "b": ids[p[:, 0]]})

    return run


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """At most n pairs that join up what these pairs do."""
    least = local_components(n, pairs[:, 0], pairs[:, 1])
    own = np.flatnonzero(least != np.arange(n))
    return np.stack((least[own], own), axis=1)


def block_links(names: list[str], most: int, similarity: float):
    """Links (a, b) that join up the like documents of different labels in two blocks of a cluster, or in whole clusters."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, labels, fps, grams = frame["lead"].to_numpy(), frame["label"].to_numpy(), frame[names].to_numpy().view(np.uint64), frame["grams"].tolist()
        pairs = [np.empty((0, 2), np.int64)]
        for _, own in frame.reset_index(drop=True).groupby("component"):
            x, y = (own.index[own["own"] == own[c]].to_numpy() for c in "xy")
            a, b = alike(fps, labels, x, y, most)
            a, b = a[a != b], b[a != b]
            same = np.fromiter((np.intersect1d(grams[i], grams[j], assume_unique=True).size for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
            sizes = np.fromiter((len(grams[i]) + len(grams[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
            near = same >= similarity * (sizes - same)
            pairs.append(np.stack((a[near], b[near]), axis=1))
        p = forest(len(ids), np.concatenate(pairs))
        return pd.DataFrame({"a": ids[p[:, 1]], "b": ids[p[:, 0]]})

    return run


def short(names: list[str], first: int, width: int):
    """width bits of the long fingerprint from bit `first` on."""
    lane, shift = first // 64, first % 64
    low = F.shiftrightunsigned(names[lane], shift) if shift else F.col(names[lane])
    if shift + width > 64:
        low = low.bitwiseOR(F.shiftleft(names[lane + 1], 64 - shift))
    return low.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
