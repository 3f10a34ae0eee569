"""Helpers shared by the corpus operators: shared-folder materialisation, ASCII folding, graph components."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` words; of the whole sequence if there are fewer, none without words."""
    size = min(size, len(h))
    n = len(h) - size + 1 if size else 0
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * MIX
        out ^= out >> np.uint64(31)
    return out


WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialize() that nothing will read again, from whatever file system holds them."""
    for df in tables:
        if path := WRITTEN.pop(df, None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later steps do not recompute it and survive lost executors.

    What was shuffled on the way is not needed any more once the table is written, so Spark removes those files at once.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/spanloom/{uuid.uuid4().hex}", spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    WRITTEN[out] = path
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; a null text is an empty one. Other columns, whatever their names, do not matter."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def place_order(doc_id: str = "doc_id", start: str = "start") -> Column:
    """(doc_id, start) as one number that orders like the pair; a null id comes first."""
    doc = F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit("-9300000000000000000").cast("decimal(20,0)"))
    return (doc * F.lit(10_000_000_000).cast("decimal(11,0)") + F.col(start)).cast("decimal(38,0)")


def without(df: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """df without the rows whose key is in ids(key); the ids are broadcast only if they are counted to be few. Null keys stay."""
    ids = materialize(ids.select(key).distinct())
    few = ids.count() <= broadcast_rows
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' component, for the edges (a, b) of one task."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) longs -> (node, component), the component being its smallest node.

    Alternates large-star and small-star steps. Each step is one partially aggregated minimum per node and one join that
    adaptive execution can split when a node is a hub; nothing is gathered per component. Self-loops are allowed;
    nodes without an edge do not appear. Raises RuntimeError when max_rounds do not suffice (2**max_rounds long paths).
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select("v", "m").union(hung.select(F.col("u").alias("v"), "m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        before, e = e, materialize(small)
        discard(before)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        last = now
    raise RuntimeError("components did not settle")
