"""Hard-negative mining by partial inner products in a PCA rotation, with bounds that never discard a true answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Components are this times the value, rounded down; squared norms stay below LIMIT, so that 100 products fit a long.
SCALE, LIMIT = 256, 2.0**55
#: Rows the rotation is fitted on (and bytes of them), and bytes of all rotations that go to the tasks.
SAMPLE_ROWS, SAMPLE_BYTES, ROTATION_BYTES = 4096, 32 << 20, 64 << 20
#: Bytes of the rows, and of the anchors, that meet in one task.
CELL = 32 << 20
#: Anchors and rows whose products are held at a time; the first blocks are small, since they have no thresholds yet.
ANCHORS, ROWS, FIRST = 512, 2048, 128
NONE = np.iinfo(np.int64).min


def vectors(df: DataFrame) -> DataFrame:
    """rid, vec_id, label, dim, ints of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    size = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(F.abs(v * SCALE) + 1, F.lit(2.0)))
    ints = F.transform(x, lambda v: F.when(F.col("ok"), F.floor(v * SCALE)).cast("long"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.withColumn("ok", fine).withColumn("ok", F.col("ok") & (F.when(F.col("ok"), size).otherwise(LIMIT) < LIMIT)).where("ok")
    return materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.size("embedding").alias("dim"), ints.alias("ints")))


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Eigenvectors of the second moments of a bounded sample, strongest first, for each number of components.

    Rows come by a hash of their id. Whatever the rotation, it is orthogonal and results are exact; lengths that the sample
    misses, or beyond ROTATION_BYTES, keep their own axes.
    """
    widest = rows.agg(F.max("dim")).first()[0] or 0
    most = max(16, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(widest, 1))))
    by_dim: dict[int, list] = {}
    for r in rows.select("dim", "ints", F.xxhash64("vec_id", F.lit(13)).alias("h")).orderBy("h").limit(most).collect():
        by_dim.setdefault(r["dim"], []).append(r["ints"])
    out, held = {}, 0
    for dim, sample in sorted(by_dim.items(), key=lambda x: -len(x[1])):
        held += 8 * dim * dim
        if 1 < dim and held <= ROTATION_BYTES:
            x = np.array(sample, float)
            out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


class Turned:
    """Integer vectors, their rotated form and the norms of what each stage leaves out."""

    def __init__(self, ints: np.ndarray, rotation: np.ndarray | None, stages: list[int]):
        self.ints = ints
        self.turned = ints.astype(float) if rotation is None else ints.astype(float) @ rotation
        square = self.turned**2
        self.norm = np.sqrt(square.sum(axis=1))
        self.rest = [np.sqrt(square[:, k:].sum(axis=1)) for k in stages]

    def part(self, at: slice | np.ndarray) -> Turned:
        new = object.__new__(Turned)
        new.ints, new.turned, new.norm, new.rest = self.ints[at], self.turned[at], self.norm[at], [r[at] for r in self.rest]
        return new


def stages_of(dim: int) -> list[int]:
    """Leading components after which pairs are discarded: an eighth, a quarter, a half, all."""
    return sorted({max(1, dim // 8), max(1, dim // 4), max(1, dim // 2), dim}) if dim else [0]


def rounding(dim: int, rotation: np.ndarray | None) -> float:
    """Times both norms, what a rotated product may differ from the integer one by: rounding in rotation and sums, and by how
    much the computed rotation is not orthogonal."""
    turn = 0.0 if rotation is None else float(np.linalg.norm(rotation @ rotation.T - np.eye(dim)))
    return 2 * turn + 16 * (dim + 2) ** 1.5 * 2.0**-53


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the pairs (i, j), some megabytes at a time."""
    step = max(1, (4 << 20) // (8 * max(1, a.shape[1])))
    return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, np.int64)])


def survivors(q: Turned, x: Turned, able: np.ndarray, low: np.ndarray, high: np.ndarray, stages: list[int], slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose product may lie from low to high (for each row of q): partial products are carried on stage by stage, for the
    whole block while many pairs are left, then pair by pair."""
    done, i, j, p = 0, None, None, np.zeros(able.shape)
    for k, stage in enumerate(stages):
        if i is None:
            p += q.turned[:, done:stage] @ x.turned[:, done:stage].T
            off = np.multiply.outer(q.rest[k], x.rest[k]) + slack * np.multiply.outer(q.norm, x.norm) + 1e-6
            able = able & (p + off >= low[:, None]) & (p - off <= high[:, None])
            if np.count_nonzero(able) < able.size / 32:
                i, j = np.nonzero(able)
                p = p[i, j]
        else:
            p = p + np.einsum("ij,ij->i", q.turned[i, done:stage], x.turned[j, done:stage])
            off = q.rest[k][i] * x.rest[k][j] + slack * q.norm[i] * x.norm[j] + 1e-6
            left = (p + off >= low[i]) & (p - off <= high[i])
            i, j, p = i[left], j[left], p[left]
        done = stage
    return (i, j) if i is not None else np.nonzero(able)


class Best:
    """The k best (score, id, row) of every anchor in every of its windows of scores."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score, self.id, self.row = (np.full((*low.shape, k), NONE, np.int64) for _ in range(3))

    def floor(self) -> np.ndarray:
        """What a score must reach in each window; ties may still win by their id."""
        return np.maximum(self.low, self.score[:, :, -1])

    def add(self, i: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        floor = self.floor()
        for w in range(self.low.shape[1]):
            fit = (score >= floor[i, w]) & (score <= self.high[i, w])
            if not fit.any():
                continue
            held = np.nonzero(self.score[:, w] != NONE)
            every = [np.concatenate((i[fit], held[0]))] + [np.concatenate((new[fit], old[:, w][held])) for new, old in ((score, self.score), (vec_id, self.id), (row, self.row))]
            order = np.lexsort((every[3], every[2], -every[1], every[0]))
            a, s, v, r = (e[order] for e in every)
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            top = rank < self.k
            self.score[:, w] = NONE
            self.score[a[top], w, rank[top]], self.id[a[top], w, rank[top]], self.row[a[top], w, rank[top]] = s[top], v[top], r[top]


def matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("ints").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)


def numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def mined(anchors: pa.Table, rows: pa.Table, dim: int, rotation: np.ndarray | None, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The best rows of one label with the anchor (same) or of others, for the anchors and rows of one task."""
    stages, slack = stages_of(dim), rounding(dim, rotation)
    q_all, x_all = (Turned(matrix(t, dim), rotation, stages) for t in (anchors, rows))
    q_rid, q_label, x_rid, x_label, x_id = numbers(anchors, "rid"), numbers(anchors, "label"), numbers(rows, "rid"), numbers(rows, "label"), numbers(rows, "vec_id")
    whole = Best(low, high, k)
    for a in range(0, len(q_rid), ANCHORS):
        block = slice(a, a + ANCHORS)
        q, best = q_all.part(block), Best(low[block], high[block], k)
        b, step = 0, FIRST
        while b < len(x_rid):
            at = slice(b, b + step)
            x = x_all.part(at)
            able = (q_label[block, None] == x_label[None, at]) == same
            if same:
                able &= q_rid[block, None] != x_rid[None, at]
            i, j = survivors(q, x, able, best.floor().min(axis=1).astype(float), best.high.max(axis=1).astype(float), stages, slack)
            best.add(i, exact(q.ints, x.ints, i, j), x_id[at][j], x_rid[at][j])
            b, step = b + step, min(ROWS, 2 * step)
        whole.score[block], whole.id[block], whole.row[block] = best.score, best.id, best.row
    return whole


def cells(anchors: DataFrame, rows: DataFrame, by: list[str], cell: int):
    """Anchors and rows dealt to blocks of at most about `cell` bytes, every block of the one meeting every block of the other."""
    size = lambda t, n: t.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * (8 * F.max("dim") + 64) / F.lit(cell))).cast("int").alias(n))
    blocks = size(rows, "n_x").join(size(anchors, "n_q"), by)
    own = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = anchors.join(blocks, by).withColumn("q_block", own("n_q", 1)).withColumn("x_block", each("n_x")).drop("n_q", "n_x")
    x = rows.join(blocks, by).withColumn("x_block", own("n_x", 2)).withColumn("q_block", each("n_q")).drop("n_q", "n_x")
    key = [*by, "q_block", "x_block"]
    return q.groupBy(*key).cogroup(x.groupBy(*key))


def hard_negatives(
    df: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, cell: int | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for a table of vec_id, label, embedding.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part, nor those whose squared
    integer norm exceeds 2**55 (their scores times 100 would not fit a long). Vectors meet vectors of their length only. Scores
    are integer products; ties go to the smaller id; repeated rows are rows of their own. `anchor` picks the query rows.
    Anchors meet all rows in blocks of `cell` bytes at most (by default 32 MB, less where that leaves cores idle): first those
    of their label for the positives, then, with the windows that those set (percentages `least` to `most`), those of others.
    In a block, products grow by leading components of the rotation; a pair is dropped once its partial product, with the product
    of the residual norms and the rounding slack, can neither enter nor stay in any window's list; what is left is scored in
    integers. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors(df)
    told = rows.agg(F.count("*"), F.sum(F.col("dim") * 8 + 64)).first()
    cell = cell or int(min(CELL, max(CELL / 64, (told[1] or 0) / (4 * df.sparkSession.sparkContext.defaultParallelism))))
    turn = rotations(rows)
    q = materialize(rows.where(anchor))

    def positives(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("rid", "positive_row", "positive_id", "positive_score")})
        dim, ends = q.column("dim")[0].as_py(), np.zeros((q.num_rows, 1), np.int64)
        best = mined(q, x, dim, turn.get(dim), True, ends - 2**61, ends + 2**61, n_positives)
        i, w, k = np.nonzero(best.score != NONE)
        return pa.table({"rid": numbers(q, "rid")[i], "positive_row": best.row[i, w, k], "positive_id": best.id[i, w, k], "positive_score": best.score[i, w, k]})

    def negatives(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("rid", "positive_row", "negative_id", "negative_row", "negative_score")})
        dim = q.column("dim")[0].as_py()
        scores, chosen = np.full((2, q.num_rows, n_positives), NONE, np.int64)
        for i, p in enumerate(q.column("positives").to_pylist()):
            scores[i, : len(p)], chosen[i, : len(p)] = [z["positive_score"] for z in p], [z["positive_row"] for z in p]
        real = scores != NONE
        low, high = np.where(real, -((-least * np.where(real, scores, 0)) // 100), 2**61), np.where(real, most * np.where(real, scores, 0) // 100, -(2**61))
        best = mined(q, x, dim, turn.get(dim), False, low, high, n_negatives)
        i, w, k = np.nonzero(best.score != NONE)
        return pa.table({"rid": numbers(q, "rid")[i], "positive_row": chosen[i, w], "negative_id": best.id[i, w, k], "negative_row": best.row[i, w, k], "negative_score": best.score[i, w, k]})

    longs = lambda *names: ", ".join(f"{n} long" for n in names)
    found = cells(q, rows, ["dim", "label"], cell).applyInArrow(positives, longs("rid", "positive_row", "positive_id", "positive_score"))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id", "positive_row"))
    found = materialize(found.withColumn("rank", rank).where(F.col("rank") <= n_positives).drop("rank"))
    q2 = materialize(q.join(found.groupBy("rid").agg(F.collect_list(F.struct("positive_row", "positive_score")).alias("positives")), "rid"))
    hard = cells(q2, rows, ["dim"], cell).applyInArrow(negatives, longs("rid", "positive_row", "negative_id", "negative_row", "negative_score"))
    rank = F.row_number().over(Window.partitionBy("rid", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row"))
    hard = hard.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n_negatives)
    named = found.join(q.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return hard.join(named, ["rid", "positive_row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
