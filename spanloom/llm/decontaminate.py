"""Benchmark decontamination by winnowing.

Words are lower-cased runs of letters, digits and non-ASCII characters. Of every `window` consecutive k-grams the one with
the least hash is a fingerprint, so two texts that share window + k - 1 words share a fingerprint there. Fingerprints
of documents and benchmark items are joined on the hash, and hits are extended to whole windows of words, compared word
by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, materialize, text_rows

K = 5
#: Everything below 0x80 but digits and letters parts words; A-Z become a-z.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def kgram_hashes(h: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : i + n]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: whatever is the least hash of some window of k-grams (of all, if there are fewer)."""
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    window = min(window, n)
    least = grams[: n - window + 1].copy()  # of the window that starts there
    for i in range(1, window):
        np.minimum(least, grams[i : n - window + 1 + i], out=least)
    most = np.zeros(n, np.uint64)  # the greatest of the leasts of the windows around a place
    for i in range(window):
        np.maximum(most[i : n - window + 1 + i], least, out=most[i : n - window + 1 + i])
    return np.flatnonzero(most == grams)


def spans(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` words from each start."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(length):
        out = (out ^ h[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


class Benchmark:
    """Fingerprints and windows of the items; what a task needs to match and extend."""

    def __init__(self, items: list[tuple[int | None, str | None]], length: int):
        self.length, self.words, self.short = length, [], defaultdict(lambda: defaultdict(set))
        self.known: dict[bytes, int] = {}
        prints, keys, numbers, places = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [], []
        for item, text in items:
            words = words_of(text)
            if 0 < len(words) < length:
                self.short[len(words)][tuple(words)].add(item)
            elif words:
                self.known |= {w: xxhash.xxh64_intdigest(w) for w in words}
                h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
                grams = kgram_hashes(h)
                prints.append(grams[winnow(grams, length - K + 1)])
                own, at = np.unique(spans(h, np.arange(len(words) - length + 1), length), return_index=True)  # a window that repeats counts once
                keys.append(own)
                numbers += [len(self.words)] * len(own)
                places += at.tolist()
                self.words.append((item, words))
        self.hashes, key = np.unique(np.concatenate(prints)), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.keys, self.numbers, self.places = key[order], np.array(numbers, np.int64)[order], np.array(places, np.int64)[order]
        self.firsts = {n: {w[0] for w in group} for n, group in self.short.items()}

    def match(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray | None, set[int | None]]]:
        """For each text, which words are hit (None: none) and the items with an occurring window."""
        out: list[tuple[np.ndarray | None, set[int | None]]] = [(None, set()) for _ in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if len(self.hashes) and ends[-1] >= self.length:
            # a word of no item can be in no shared span: all such words have one hash
            h = np.fromiter(map(self.known.get, chain.from_iterable(texts), repeat(0)), np.uint64, ends[-1])
            grams = kgram_hashes(h)
            for back in range(1, K):  # a k-gram that runs over the end of its text is none
                across = ends - back
                grams[across[(across >= 0) & (across < len(grams))]] = np.uint64(2**64 - 1)
            at = winnow(grams, self.length - K + 1)
            self.extend(texts, h, at[np.isin(grams[at], self.hashes)], ends, sizes, out)
        for size, group in self.short.items():
            first = self.firsts[size]
            for k, words in enumerate(texts):
                for i in [i for i, w in enumerate(words) if w in first]:
                    if found := group.get(tuple(words[i : i + size])):
                        self.add(out, k, words, i, size, found)
        return out

    def extend(self, texts: list[list[bytes]], h: np.ndarray, at: np.ndarray, ends: np.ndarray, sizes: np.ndarray, out: list) -> None:
        """Extends hits to the windows around them. A window that a text shares with an item holds a fingerprint of both, so
        these are all; each is looked up by its hash and compared word by word, however often the text or an item repeats."""
        owner = np.searchsorted(ends, at, side="right")
        starts = (at[:, None] - np.arange(self.length - K + 1)).ravel()
        owner = np.repeat(owner, self.length - K + 1)
        inside = (starts >= (ends - sizes)[owner]) & (starts + self.length <= ends[owner])
        starts, first = np.unique(starts[inside], return_index=True)
        owner = owner[inside][first]
        key = spans(h, starts, self.length)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        some = np.flatnonzero(hi > lo)
        for i, s, a, b in zip(owner[some].tolist(), starts[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
            place = s - int(ends[i] - sizes[i])
            ours = texts[i][place : place + self.length]
            found = set()
            for number, q in zip(self.numbers[a:b].tolist(), self.places[a:b].tolist(), strict=True):
                item, theirs = self.words[number]
                if item not in found and theirs[q : q + self.length] == ours:
                    found.add(item)
            if found:
                self.add(out, i, texts[i], place, self.length, found)

    @staticmethod
    def add(out: list, k: int, words: list[bytes], at: int, size: int, found: set[int | None]) -> None:
        hit, items = out[k]
        hit = np.zeros(len(words), bool) if hit is None else hit
        hit[at : at + size] = True
        out[k] = hit, items | found


def contaminated(df: DataFrame, benchmark: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    The benchmark goes to every task only if its text is counted to be at most broadcast_bytes; with a larger one the
    fingerprints of documents and items are joined, and each pair of a document and an item that share one is extended.
    Null or empty texts have no words; items of null text have no windows; an item of null id counts in n_hit and n_items
    but has no id to list; repeated rows each keep a row; other columns are ignored. length must be at least K + 1.
    """
    docs = text_rows(df, id_col, text_col)
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("words")).where("words IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if total <= broadcast_bytes:
        return docs.mapInPandas(matcher([tuple(r) for r in items.collect()], length), "doc_id long, n_words long, n_hit long, n_items long, item_ids string, contaminated boolean")
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    items = items.withColumn("number", F.xxhash64("item", "words"))
    sizes = items.mapInPandas(short_sizes(length), "size int").distinct()  # `length` rows at most
    own = materialize(items.select("number", F.col("words").alias("text")).mapInPandas(printer(length, "number", None), "key long, h long").distinct())
    met = keyed.select("key", "text").mapInPandas(printer(length, "key", [r["size"] for r in sizes.collect()]), "key long, h long")
    pairs = materialize(met.join(own.select("h", F.col("key").alias("number")), "h").select("key", "number").distinct())
    together = keyed.dropDuplicates(["key"]).join(pairs, "key").join(items, "number").select("key", "text", "item", "words")
    hits = together.mapInPandas(pair_matcher(length), "key long, item long, hits array<int>")
    hits = hits.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.collect_set("item").alias("ids"), F.max(F.col("item").isNull().cast("long")).alias("unnamed"))
    counted = keyed.mapInPandas(counter, "doc_id long, key long, n_words long").join(materialize(hits), "key", "left")
    n_hit, ids, unnamed = F.coalesce(F.size("hits"), F.lit(0)), F.coalesce("ids", F.array().cast("array<long>")), F.coalesce("unnamed", F.lit(0).cast("long"))
    listed = F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",")
    return counted.select("doc_id", "n_words", F.greatest(n_hit, F.lit(0)).cast("long").alias("n_hit"), (F.size(ids) + unnamed).alias("n_items"), listed.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def short_sizes(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"size": sorted({n for t in f["words"] if 0 < (n := len(words_of(t))) < length})}, dtype="int32")

    return run


def printer(length: int, key: str, sizes: list[int] | None):
    """Hashes that a text shares with another if they share a window: its winnowed k-grams, and for windows shorter than
    `length` all runs of these sizes; a text of fewer words is one window itself where sizes is None."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for f in frames:
            for k, text in zip(f[key].tolist(), f["text"], strict=True):
                words = words_of(text)
                h, found = memo.of(words), []
                if len(words) >= length:
                    grams = kgram_hashes(h)
                    found.append(grams[winnow(grams, length - K + 1)])
                elif words and sizes is None:
                    found.append(spans(h, np.zeros(1, np.int64), len(words)))
                for n in sizes or ():
                    found.append(spans(h, np.arange(max(0, len(words) - n + 1)), n))
                if found:
                    yield pd.DataFrame({"h": np.unique(np.concatenate(found)).view(np.int64)}).assign(key=k)[["key", "h"]]

    return run


def pair_matcher(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, text, item, words in zip(f["key"].tolist(), f["text"], f["item"].astype("Int64"), f["words"], strict=True):
                hit, _ = Benchmark([(0, words)], length).match([words_of(text)])[0]
                if hit is not None:
                    rows.append((key, item, np.flatnonzero(hit).astype("int32")))
            yield pd.DataFrame(rows, columns=["key", "item", "hits"]).astype({"key": "int64", "item": "Int64"})

    return run


def counter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "key": f["key"], "n_words": [len(words_of(t)) for t in f["text"]]})


def matcher(items: list[tuple[int | None, str]], length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bench = Benchmark(items, length)
        for f in frames:
            texts = f["text"].tolist()
            sizes, rows = [], []
            for lo in range(0, len(texts), 200):
                part = [words_of(t) for t in texts[lo : lo + 200]]
                sizes += map(len, part)
                rows += bench.match(part)
            yield pd.DataFrame({
                "doc_id": f["doc_id"].astype("Int64"), "n_words": sizes, "n_hit": [0 if h is None else int(h.sum()) for h, _ in rows],
                "n_items": [len(i) for _, i in rows], "item_ids": [",".join(sorted(str(x) for x in i if x is not None)) for _, i in rows], "contaminated": [bool(i) for _, i in rows],
            })

    return run
