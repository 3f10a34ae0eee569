"""Near-duplicate embeddings with a robust-pruned flat graph.

Distinct vectors are dealt to overlapping cluster shards. Each shard builds a robust-pruned graph; the adjacency lists of
a vector from all its shards are united; then each shard searches for all of its vectors from the medoid, greedily until a
beam settles, and expands every result in range along the graph. Similarities are verified in double precision, and
recall is audited against brute force on a bounded set of queries, over all links and as the mean of the queries' own
recalls; too low a recall repeats the search with more overlap. If that does not help, as in a dense group that is cut over
many shards, vectors are compared without a graph: each with every shard that can hold a link of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: Rows a shard aims at and rows of a block; vectors that train centres; centres on one level and on two (a larger table has larger shards, searched block by block).
SHARD_ROWS, BLOCK_ROWS, SAMPLE_ROWS, FLAT, MAX_CENTRES = 400, 2000, 20_000, 4096, 65_536


def kind_of(vectors: DataFrame) -> str:
    return vectors.schema["v"].dataType.simpleString()


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # before squaring, so that extreme values neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means on a sample that is already in random order."""
    c = sample[:k].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T, axis=1) for part in np.array_split(sample.astype(np.float32), max(1, len(sample) // 2000))])
        for j in np.unique(near):
            m = sample[near == j].mean(axis=0)
            c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def prune(x: np.ndarray, most: int = 24, pool: int = 48, alpha: float = 1.2) -> np.ndarray:
    """Robust pruning of each row's nearest `pool` rows: keep the closest, drop those that it covers, repeat. -1 pads."""
    n = len(x)
    pool, out = min(pool, n - 1), np.full((n, most), -1)
    if n < 2:
        return out
    f = x.astype(np.float32)
    for lo in range(0, n, 256):
        sims = f[lo : lo + 256] @ f.T
        rows = np.arange(len(sims))
        sims[rows, lo + rows] = -2
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        dist = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, 1), 0))
        alive = np.ones_like(near, bool)
        for step in range(most):
            first = np.argmax(alive, axis=1)
            ok = alive[rows, first]
            if not ok.any():
                break
            pick = near[rows, first]
            out[lo + rows[ok], step] = pick[ok]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", f[near], f[pick]), 0))
            alive &= alpha * between > dist
            alive[rows, first] = False
    return out


def graph_of(ids: np.ndarray, lists: list, width: int = 64) -> np.ndarray:
    """Neighbours of each row (-1 pads): its own list, then the rows that list it, `width` at most. Ids of other shards drop out."""
    n = len(ids)
    own = np.concatenate([np.full(0 if x is None else len(x), i) for i, x in enumerate(lists)])
    other = np.concatenate([np.asarray([] if x is None else x, np.int64) for x in lists])
    order = np.argsort(ids, kind="stable")
    at = order[np.minimum(np.searchsorted(ids[order], other), n - 1)]
    own, at = own[ids[at] == other], at[ids[at] == other]
    a, b, back = np.concatenate((own, at)), np.concatenate((at, own)), np.repeat((0, 1), len(own))
    _, first = np.unique(a * n + b, return_index=True)  # of two the outgoing one, which comes first
    a, b, back = a[first], b[first], back[first]
    order = np.lexsort((b, back, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, max(1, min(width, int(place.max(initial=0)) + 1))), -1)
    fits = place < width
    out[a[fits], place[fits]] = b[fits]
    return out


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, floor: float, beam: int = 32) -> np.ndarray:
    """Boolean queries x rows: found pairs with similarity >= floor."""
    n = len(x)
    f, q = x.astype(np.float32), queries.astype(np.float32)
    medoid = int(np.argmax(f @ f.mean(axis=0)))
    found = np.zeros((len(q), n), bool)
    slack = floor - 1e-5
    reachable = np.zeros((n, n), np.float32)
    reachable[np.nonzero(graph >= 0)[0], graph[graph >= 0]] = 1
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        m = len(part)
        rows = np.arange(m)
        seen, near = np.zeros((m, n), bool), np.zeros((m, n), bool)
        ids, sims, done = np.full((m, beam), -1), np.full((m, beam), -9.0, np.float32), np.ones((m, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = medoid, part @ f[medoid], False
        seen[:, medoid] = True
        near[:, medoid] = sims[:, 0] >= slack
        while True:
            score = np.where(done, -9.0, sims)
            best = np.argmax(score, axis=1)
            live = np.flatnonzero(~done[rows, best])
            if not len(live):
                break
            at = best[live]
            done[live, at] = True
            step = graph[ids[live, at]]
            ok = (step >= 0) & ~seen[live[:, None], step]
            s = np.where(ok, np.einsum("ijk,ik->ij", f[step], part[live]), -9.0).astype(np.float32)
            r, c = np.nonzero(ok)
            seen[live[r], step[r, c]] = True
            hit = s[r, c] >= slack
            near[live[r[hit]], step[r[hit], c[hit]]] = True
            all_ids, all_sims = np.concatenate((ids[live], step), 1), np.concatenate((sims[live], s), 1)
            all_done = np.concatenate((done[live], ~ok), 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
        front = near
        while front.any():  # expand what is in range until nothing new is
            new = (front.astype(np.float32) @ reachable > 0) & ~seen
            seen |= new
            front = similar(part, f, new, slack)
            near = near | front
        found[lo : lo + m] = similar(queries[lo : lo + m], x, near, floor)  # verified in double precision
    return found


def similar(queries: np.ndarray, x: np.ndarray, pairs: np.ndarray, floor: float, at_once: int = 50_000) -> np.ndarray:
    """Those of the marked pairs whose similarity is at least floor."""
    out = np.zeros_like(pairs)
    a, b = np.nonzero(pairs)
    for lo in range(0, len(a), at_once):
        r, c = a[lo : lo + at_once], b[lo : lo + at_once]
        ok = np.einsum("ij,ij->i", queries[r], x[c]) >= floor
        out[r[ok], c[ok]] = True
    return out


class Centres:
    """Cluster centres; of many, one looks only among those below the nearest of a level above, so that dealing a vector costs
    about the square root of their number."""

    def __init__(self, sample: np.ndarray, k: int):
        self.top = self.below = None
        if k <= FLAT or len(sample) <= FLAT:
            self.all = centres(sample, max(1, min(k, len(sample))))
            return
        self.top = centres(sample[:SAMPLE_ROWS], int(np.sqrt(k)))
        home = np.concatenate([np.argmax(part @ self.top.T, axis=1) for part in np.array_split(sample.astype(np.float32), max(1, len(sample) // 2000))])
        parts = [centres(own, max(1, min(len(own), round(k * len(own) / len(sample))))) for j in range(len(self.top)) if len(own := sample[home == j])]
        self.top = self.top[np.unique(home)]
        self.all = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        self.below = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    def nearest(self, x: np.ndarray, overlap: int, tops: int = 4) -> np.ndarray:
        """The `overlap` nearest centres of each row, nearest first; -1 pads."""
        if self.top is None:
            return np.argsort(-(x @ self.all.T), axis=1, kind="stable")[:, :overlap].astype("int32")
        near, out = np.argsort(-(x @ self.top.T), axis=1, kind="stable")[:, :tops], np.full((len(x), overlap), -1, np.int32)
        best = np.full((len(x), overlap), -9.0, np.float32)
        for t in np.unique(near).tolist():
            rows, (lo, hi) = np.flatnonzero((near == t).any(axis=1)), self.below[t]
            sims = np.concatenate((best[rows], x[rows] @ self.all[lo:hi].T), axis=1)
            ids = np.concatenate((out[rows], np.broadcast_to(np.arange(lo, hi, dtype=np.int32), (len(rows), hi - lo))), axis=1)
            pick = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
            out[rows], best[rows] = np.take_along_axis(ids, pick, 1), np.take_along_axis(sims, pick, 1)
        return out


def dealt(vectors: DataFrame, c: Centres, overlap: int) -> DataFrame:
    """vectors plus their `overlap` nearest shards, nearest first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 1000):
                part = f.iloc[lo : lo + 1000]
                yield part.assign(shards=[r[r >= 0] for r in c.nearest(unit(part["v"]).astype(np.float32), overlap)])

    return vectors.mapInPandas(run, f"id long, copies long, v {kind_of(vectors)}, shards array<int>")


def shard_graph(frame: pd.DataFrame) -> pd.DataFrame:
    ids = frame["id"].to_numpy()
    g = prune(unit(frame["v"]))
    return pd.DataFrame({"id": ids, "near": [ids[row[row >= 0]] for row in g]})


def labelled(found: np.ndarray, asked: np.ndarray, ids: np.ndarray, links: np.ndarray) -> pd.DataFrame:
    """id, links, least: for each query its links and the least id of its local component; for data that are no queries the latter."""
    both = np.unique(np.concatenate((asked, ids)))
    least, a, b = np.arange(len(both), dtype=np.int32), np.searchsorted(both, asked), np.searchsorted(both, ids)
    while True:
        new = least.copy()
        np.minimum.at(new, a, np.where(found, least[b], len(both)).min(axis=1).astype(np.int32))
        np.minimum.at(new, b, np.where(found, least[a][:, None], len(both)).min(axis=0).astype(np.int32))
        if (new == least).all():
            break
        least = new
    out = pd.DataFrame({"id": asked, "links": links, "least": both[least[a]]})
    more = ~np.isin(ids, asked) & (both[least[b]] != ids)
    return pd.concat([out, pd.DataFrame({"id": ids[more], "links": 0, "least": both[least[b[more]]]})], ignore_index=True)


def links_of(floor: float, beam: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """One row per query of the task: links that belong to this shard (the first that both ends share), least id of its local component."""
        frame = frame.sort_values(["id", "role"]).reset_index(drop=True)
        data, ask = frame[frame["role"] != 1].reset_index(drop=True), frame[frame["role"] != 0].reset_index(drop=True)
        ids, asked = data["id"].to_numpy(), ask["id"].to_numpy()
        if not len(data) or not len(ask):
            return pd.DataFrame({"id": asked, "links": 0, "least": asked})
        found = search(unit(data["v"]), graph_of(ids, data["near"].to_list()), unit(ask["v"]), floor, beam)
        if len(ids) == len(asked) and (ids == asked).all():
            found |= found.T
        found &= asked[:, None] != ids[None, :]
        here, copies, links = int(frame["shard"].iloc[0]), data["copies"].to_numpy(), np.zeros(len(ask), np.int64)
        wide = max(map(len, frame["shards"]))
        padded = lambda side, empty: np.stack([np.pad(r, (0, wide - len(r)), constant_values=empty) for r in side["shards"]])
        ours, theirs = padded(ask, -1), padded(data, -2)
        a, b = np.nonzero(found)
        for lo in range(0, len(a), 100_000):
            r, c = a[lo : lo + 100_000], b[lo : lo + 100_000]
            first = np.full(len(r), np.iinfo(np.int32).max)
            for j in range(wide):
                for k in range(wide):
                    same = ours[r, j] == theirs[c, k]
                    first[same] = np.minimum(first[same], ours[r[same], j])
            own = first == here
            links += np.bincount(r[own], copies[c[own]], len(asked)).astype(np.int64)
        return labelled(found, asked, ids, links)

    return run


def audit(vectors: DataFrame, found: DataFrame, floor: float, queries: int = 1000) -> float:
    """Recall against brute force, a bounded set of query vectors against all vectors, in blocks: the lesser of the share of
    all their links and the mean share of each query's own links, so that neither dense groups nor single pairs hide the other."""
    ask = vectors.orderBy(F.xxhash64("id")).limit(queries).join(found, "id", "left").select("id", "v", F.coalesce("links", F.lit(0)).alias("links")).toPandas()
    if not len(ask):
        return 1.0
    q, own = unit(ask["v"]), ask["id"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(q), np.int64)
        for f in frames:
            if len(f):
                total += ((q @ unit(f["v"]).T >= floor) & (own[:, None] != f["id"].to_numpy()[None, :])) @ f["copies"].to_numpy()
        yield pd.DataFrame({"id": own, "true": total})

    true = vectors.mapInPandas(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true")).toPandas()
    both = ask.merge(true, on="id").query("true > 0")
    if (both["links"] > both["true"]).any():
        raise RuntimeError("a link was counted twice")
    hit = both["links"]
    return float(min(hit.sum() / both["true"].sum(), (hit / both["true"]).mean())) if len(both) else 1.0


def sampled_centres(vectors: DataFrame, rows: int, most: int) -> Centres:
    """One centre for SHARD_ROWS vectors, `most` in all, from a sample of SAMPLE_ROWS vectors or four a centre."""
    k = max(1, min(most, rows // SHARD_ROWS))
    size = max(SAMPLE_ROWS, 4 * k)
    share = min(1.0, size / max(1, rows))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("id", F.lit(1))).select("v").limit(size).toPandas()
    return Centres(unit(sample["v"]) if len(sample) else np.zeros((1, 1)), k)


def compared(floor: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """links_of() for one block of queries against one block of data, by all similarities in double precision."""
        data, ask = frame[~frame["ask"]], frame[frame["ask"]]
        asked, ids, copies = ask["id"].to_numpy(), data["id"].to_numpy(), data["copies"].to_numpy()
        if not len(data) or not len(ask):
            return pd.DataFrame({"id": asked, "links": 0, "least": asked})
        x, q = unit(data["v"]), unit(ask["v"])
        found = np.concatenate([q[lo : lo + 256] @ x.T >= floor for lo in range(0, len(q), 256)]) & (asked[:, None] != ids[None, :])
        return labelled(found, asked, ids, found @ copies)

    return run


def compare_all(cells: DataFrame, floor: float) -> DataFrame:
    """(cell, ask, id, copies, v) -> id, links, least: the queries (ask) of a cell with all data of the cell, block against block."""
    blocks = cells.groupBy("cell").agg(*[F.greatest(F.ceil(F.count_if(c) / BLOCK_ROWS), F.lit(1)).cast("int").alias(n) for n, c in (("asks", F.col("ask")), ("datas", ~F.col("ask")))])
    placed = cells.join(F.broadcast(blocks), "cell")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = placed.withColumn("x", F.explode(F.when(F.col("ask"), F.array(own("asks"))).otherwise(every("asks")))).withColumn("y", F.explode(F.when(F.col("ask"), every("datas")).otherwise(F.array(own("datas")))))
    return placed.select("cell", "x", "y", "ask", "id", "copies", "v").groupBy("cell", "x", "y").applyInPandas(compared(floor), "id long, links long, least long")


def reached(vectors: DataFrame, rows: int, floor: float, reach: float) -> DataFrame:
    """search_all() without a graph: each vector is data of the shard of its nearest centre c and asks every shard that can
    hold a link of it. Its partner is nearer to that shard's centre d, so it lies beyond the plane between c and d; at an angle of
    arccos(floor) that is at most sin(arccos(floor)) away. reach is the share of this distance; at 1 no link is left out."""
    c = sampled_centres(vectors, rows, FLAT).all
    apart = np.sqrt(np.maximum((c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * c @ c.T, 0))
    most = reach * np.sqrt(1 - floor**2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                sims = unit(f["v"]).astype(np.float32) @ c.T
                home = np.argmax(sims, axis=1)
                near = sims[np.arange(len(f)), home][:, None] - sims <= most * apart[home] + 1e-4
                yield f.assign(home=home.astype("int32"), shards=[np.flatnonzero(r).astype("int32") for r in near])

    placed = materialize(vectors.mapInPandas(run, f"id long, copies long, v {kind_of(vectors)}, home int, shards array<int>"))
    data = placed.select(F.col("home").alias("cell"), F.lit(False).alias("ask"), "id", "copies", "v")
    return compare_all(data.union(placed.select(F.explode("shards"), F.lit(True), "id", "copies", "v")), floor)


def search_all(vectors: DataFrame, rows: int, floor: float, overlap: int, beam: int) -> DataFrame:
    """id, links, least for every distinct vector (id, copies, v); several rows per id, to be summed and united."""
    placed = materialize(dealt(vectors, sampled_centres(vectors, rows, MAX_CENTRES), overlap))
    spread = placed.select("id", "copies", "v", "shards", F.explode("shards").alias("shard"))
    blocks = spread.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))  # MAX_CENTRES rows at most, 8 bytes each
    spread = spread.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    built = spread.groupBy("shard", "block").applyInPandas(lambda f: shard_graph(f), "id long, near array<long>")
    graph = materialize(built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    # a shard of several blocks is searched block against block; in a shard of one block a row is both data and query
    whole = spread.where("blocks = 1").select("*", F.lit(0).alias("other"), F.lit(2).alias("role"))
    split = spread.where("blocks > 1").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    data = split.select(*spread.columns, F.col("x").alias("other"), F.lit(0).alias("role"))
    ask = split.select(*[F.col("x").alias("block") if n == "block" else F.col(n) for n in spread.columns], F.col("block").alias("other"), F.lit(1).alias("role"))
    work = whole.unionByName(data).unionByName(ask).join(graph, "id", "left")
    return work.select("shard", "block", "other", "role", "id", "copies", "v", "shards", "near").groupBy("shard", "block", "other").applyInPandas(links_of(floor, beam), "id long, links long, least long")


def searched(vectors: DataFrame, rows: int, floor: float, recall: float) -> DataFrame:
    """The first search over vectors of one length whose audited recall suffices; the last one is exact."""
    for overlap, beam in ((2, 32), (3, 64), (4, 128)):
        hits = materialize(search_all(vectors, rows, floor, overlap, beam))
        if audit(vectors, hits.groupBy("id").agg(F.sum("links").alias("links")), floor) >= recall:
            return hits
    hits = materialize(reached(vectors, rows, floor, 0.5))
    if audit(vectors, hits.groupBy("id").agg(F.sum("links").alias("links")), floor) >= recall:
        return hits
    return materialize(reached(vectors, rows, floor, 1.0))


def near_vectors(df: DataFrame, floor: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.98) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors are searched for once and counted as often as they occur. Null, empty, zero and non-finite vectors link
    with nothing; vectors of each length are compared among themselves. Lengths of at most SAMPLE_ROWS vectors, but for the
    most frequent one, are compared without a graph.
    Repeated rows count as vectors of their own. A row without an id links with nothing, whatever its vector, has no component and is
    kept. Other columns are ignored.
    """
    given = df.select(F.col(f"`{vector_col}`").alias("v"))
    v = F.col(f"`{vector_col}`").cast("array<float>" if kind_of(given) == "array<float>" else "array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    fit = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("v", F.when(fit, F.col("v"))))
    distinct = rows.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    distinct = materialize(distinct.select("id", "copies", "v"))
    lengths = distinct.groupBy(F.size("v").alias("n")).count()
    large = lengths.where(F.col("count") > SAMPLE_ROWS).union(lengths.orderBy(F.desc("count"), "n").limit(1)).distinct().collect()
    rest = distinct.where(~F.size("v").isin([r["n"] for r in large])).withColumn("cell", F.size("v"))
    hits = materialize(compare_all(rest.withColumn("ask", F.explode(F.array(F.lit(False), F.lit(True)))), floor))
    for r in large:
        hits = hits.union(searched(distinct.where(F.size("v") == r["n"]), r["count"], floor, recall))
    found = hits.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(hits.where("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    named = distinct.join(found, "id", "left").join(comps, distinct["id"] == comps["node"], "left")
    named = materialize(named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = rows.join(named, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
