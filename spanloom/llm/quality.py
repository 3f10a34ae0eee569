"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_rows

#: Words fall into BUCKETS by a hash, so the table of word vectors has one size at any scale (BUCKETS * DIM numbers).
BUCKETS, DIM, NONZERO, REACH = 8192, 32, 2, 2
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = b = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return b


def token_buckets(text: str | None, memo: Buckets) -> np.ndarray:
    words = TOKEN.findall(text or "")
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def index_vectors(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few nonzero components of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM: each word's sum of its neighbours' index vectors over all documents, scaled to length 1.

    A task adds up its own rows and emits one row per bucket it has met, so what is shuffled is bounded by tasks, not words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, signs = index_vectors()
        total, memo = np.zeros(BUCKETS * DIM), Buckets()
        for f in frames:
            held, size = [], 0
            for t in [*f["text"], None]:
                held += [token_buckets(t, memo), np.full(REACH, -1)]
                size += len(held[-2])
                if t is None or size > 300_000:
                    ids, held, size = np.concatenate(held), [], 0
                    for gap in range(1, REACH + 1):
                        a, b = ids[:-gap], ids[gap:]
                        ok = (a >= 0) & (b >= 0)
                        a, b = a[ok], b[ok]
                        for k in range(NONZERO):
                            total += np.bincount(a * DIM + places[b, k], signs[b, k], BUCKETS * DIM)
                            total += np.bincount(b * DIM + places[a, k], signs[a, k], BUCKETS * DIM)
        v = total.reshape(BUCKETS, DIM).astype(np.int64)
        met = np.flatnonzero(v.any(axis=1))
        yield pd.DataFrame(v[met], columns=[f"v{i}" for i in range(DIM)]).assign(bucket=met)

    names = [f"v{i}" for i in range(DIM)]
    parts = docs.mapInPandas(run, ", ".join(f"{n} long" for n in names) + ", bucket long")
    rows = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # BUCKETS rows at most
    v = np.zeros((BUCKETS, DIM))
    v[rows["bucket"].to_numpy(np.int64)] = rows[names].to_numpy(np.float64)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, how alike neighbours are, how many words there are and how few differ."""
    x = np.zeros(2 * DIM + 5, np.float32)
    if n := len(ids):
        v = vectors[ids]
        x[:DIM] = mean = v.mean(axis=0)
        x[DIM : 2 * DIM] = np.sqrt(np.maximum((v * v).mean(axis=0) - mean * mean, 0))
        near = [float(np.einsum("ij,ij->", v[:-g], v[g:])) / (n - g) if n > g else 0.0 for g in (1, 2)]
        x[2 * DIM :] = [*near, float(np.linalg.norm(mean)), np.log1p(n), len(np.unique(ids)) / n]
    return x


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x: pool() of a document's words; zeros for a text without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Buckets()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64").array, "x": [pool(token_buckets(t, memo), vectors) for t in f["text"]]})

    return docs.mapInPandas(run, "doc_id long, x array<float>")


class Network:
    """Inputs scaled to mean 0 and deviation 1, one hidden layer of rectified units, a logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.heat = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        d = x.shape[1]
        self.w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        fit, y_fit = (x[~calibrate] - self.mean) / self.scale, y[~calibrate].astype(float)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(fit))
            for s in range(0, len(fit), 128):
                b = order[s : s + 128]
                h = np.maximum(fit[b] @ self.w[0] + self.w[1], 0)
                err = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y_fit[b]) / len(b)
                back = np.outer(err, self.w[2]) * (h > 0)
                grads = [fit[b].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ err + 1e-4 * self.w[2], np.array([err.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if calibrate.any():
            z, t = self.logits(x[calibrate]), y[calibrate].astype(float)
            loss = lambda heat: np.mean(np.logaddexp(0, z / heat) - t * z / heat)
            self.heat = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.heat, -50, 50)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; an id of null counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0))


def quality_scores(df: DataFrame, labels: DataFrame, sample: int = 20_000, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= cut).

    Word vectors come from all documents. The network learns from labelled rows outside fold 0, of which a share by a
    hash of the id is taken so that about `sample` are expected to be broadcast and to reach the driver; fold 1 sets the
    temperature.
    Unlabelled rows and null labels teach nothing. Empty and null texts are scored from zero features; without both
    classes the score is the share of label 1 among the learning rows (0.5 without any). Repeated rows each keep a row.
    """
    docs = text_rows(df, id_col, text_col)
    vectors = word_vectors(docs)
    features = materialize(pooled(docs, vectors))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    share = min(1.0, sample / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = features.join(F.broadcast(marks), "doc_id").select("doc_id", "quality", fold(F.col("doc_id")).alias("fold"), "x").orderBy("doc_id", "quality").toPandas()
    y = rows["quality"].to_numpy() if len(rows) else np.empty(0)
    net = None
    if len(set(y.tolist())) == 2:
        net = Network(np.stack(rows["x"].to_list()).astype(np.float64), y, (rows["fold"] == 1).to_numpy())
    prior = float(y.mean()) if len(y) else 0.5

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            score = net.scores(np.stack(f["x"].to_list()).astype(np.float64)) if net and len(f) else np.full(len(f), prior)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "score": score})

    scored = features.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
