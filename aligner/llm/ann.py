"""Nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small network learns to tell from a vector which parts its neighbours
lie in. Every row is indexed under its most probable part, a query goes to as many of its most probable parts as a held-out share
of the sample needs for the wanted recall, and is ranked there by exact distances.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aligner.session import stage

_HASH_SEED = 29


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer from vectors to part probabilities; ``probes`` parts are searched per query."""

    centre: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` nearest other rows of every row."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        d = square[None, :] - 2 * x[i:i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i:i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _halves(x: np.ndarray, members: np.ndarray, graph: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few graph edges between them: a median split, then swaps with the largest gains."""
    own = x[members] - x[members].mean(axis=0)
    axis = np.linalg.svd(own[:2000], full_matrices=False)[2][0]
    side = np.zeros(len(members), bool)
    side[np.argsort(own @ axis, kind="stable")[len(members) // 2:]] = True
    place = np.full(len(x), -1)
    place[members] = np.arange(len(members))
    ends = place[graph[members]]
    source = np.repeat(np.arange(len(members)), graph.shape[1])[ends.ravel() >= 0]
    target = ends.ravel()[ends.ravel() >= 0]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    for _ in range(rounds):
        across = np.bincount(a, weights=side[a] != side[b], minlength=len(members))
        gain = 2 * across - np.bincount(a, minlength=len(members))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        worth = np.flatnonzero(gain[left[:n]] + gain[right[:n]] > 0)
        if not len(worth):
            break
        moved = max(1, (worth[-1] + 1) // 2)  # all at once would undo each other
        side[left[:moved]], side[right[:moved]] = True, False
    return members[~side], members[side]


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of every row: repeated halving, ``parts`` being a power of two."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _halves(x, g, graph)]
    out = np.empty(len(x), np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


def train(x: np.ndarray, parts: int, k: int, recall: float, width: int = 128, epochs: int = 25, rate: float = 0.05,
          seed: int = 3) -> Router:
    """Graph, parts and network; the number of probes is the least that reaches ``recall`` for rows that weren't learned from."""
    dim = x.shape[1]
    centre = x.mean(axis=0) if len(x) else np.zeros(dim)
    parts = 1 << int(np.log2(max(1, min(parts, len(x) // (4 * k)))))
    if parts == 1:
        return Router(centre, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, parts)
    near = np.zeros((len(x), parts))
    np.add.at(near, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1 / k)
    wanted = 0.7 * near + 0.3 * np.eye(parts)[part]
    rng = np.random.default_rng(seed)
    held = rng.random(len(x)) < 0.2
    learn = np.flatnonzero(~held)
    scale = 1 / (x.std(axis=0).mean() + 1e-12)
    w1, b1 = rng.normal(0, scale * np.sqrt(2 / dim), (dim, width)), np.zeros(width)
    w2, b2 = rng.normal(0, np.sqrt(1 / width), (width, parts)), np.zeros(parts)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            v = x[batch] - centre
            h = np.maximum(v @ w1 + b1, 0)
            z = h @ w2 + b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            back = (p / p.sum(axis=1, keepdims=True) - wanted[batch]) / len(batch)
            hidden = (back @ w2.T) * (h > 0)
            w2 -= step * 4 * h.T @ back
            b2 -= step * 4 * back.sum(axis=0)
            w1 -= step * 4 * scale * scale * v.T @ hidden
            b1 -= step * 4 * hidden.sum(axis=0)
    router = Router(centre, w1, b1, w2, b2, parts)
    own = router.best(x, 1)[:, 0]
    ranks = np.argsort(router.best(x[held], parts), axis=1)  # of each part, for each held-out row
    found = np.take_along_axis(ranks, own[graph[held]], axis=1)
    shares = [(found < t).mean() for t in range(1, parts + 1)]
    probes = next((t for t, share in enumerate(shares, 1) if share >= recall), parts)
    return Router(centre, w1, b1, w2, b2, probes)


def usable(vector: Column, dim: int | None = None) -> Column:
    """Neither null nor zero, without null or non-finite components; of ``dim`` components if given."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)
    return fine if dim is None else fine & (F.size(vector) == dim)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_PLACED = "vec_id long, vector array<double>, part int"
_NEAR = "query_id long, vec_id long, score double"


def _nearest(queries: pa.Table, rows: pa.Table, k: int, dim: int) -> pa.Table:
    """The ``k`` nearest rows of every query in one block, by distance and id."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not rows.num_rows:
        return kind.empty_table()
    x, ids = _matrix(rows.column("vector"), dim), rows.column("vec_id").to_numpy()
    q, own = _matrix(queries.column("vector"), dim), queries.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    repeated, ids = len(first) < len(ids), ids[first]
    out = []
    for vector, query in zip(q, own, strict=True):
        score = np.sqrt(((x - vector) ** 2).sum(axis=1))
        if repeated:  # an id counts once
            score = np.minimum.reduceat(score, first)
        score[ids == query] = np.inf
        most = np.partition(score, k - 1)[k - 1] if k < len(score) else np.inf
        at = np.flatnonzero((score <= most) & (score < np.inf))
        at = at[np.lexsort((ids[at], score[at]))][:k]
        out.append((np.full(len(at), query), ids[at], score[at]))
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=kind)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, parts: int = 32,
           sample_rows: int = 8000, recall: float = 0.97, block_rows: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest rows found for every query row, nearest first, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. The network learns from at most ``sample_rows`` rows (smallest hash of the id); every
    usable row is indexed. Vectors that are null, zero, not finite, hold nulls or differ from the most common dimension take no part, nor do
    null ids. An id is no neighbour of itself; a row repeated under one id counts once, a query id with several vectors is asked with its
    smallest. Parts are cut into blocks of about ``block_rows`` rows, so a vector that a third of the rows share is spread. Parts are
    added to a query's until they hold ``k`` other ids, so only fewer candidates than ``k`` give fewer results. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    rows = rows.where(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64(F.col("vec_id"), F.lit(_HASH_SEED)), "vec_id").limit(sample_rows).collect()
    router = train(np.array([r["vector"] for r in sample]).reshape(-1, dim), parts, k, recall)

    def place(n: int, held_ids: np.ndarray | None = None):
        """The ``n`` most probable parts; with ``held_ids`` (ids of each part) as many more as it takes to hold ``k`` + 1 ids."""
        def of(batches):
            for batch in batches:
                best = router.best(_matrix(batch.column("vector"), dim), parts if held_ids is not None else n)
                wanted = np.zeros(best.shape, bool)
                wanted[:, :n] = True
                if held_ids is not None:
                    wanted[:, 1:] |= np.cumsum(held_ids[best], axis=1)[:, :-1] <= k
                at = pa.array(np.nonzero(wanted)[0])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("vector").take(at),
                                                  pa.array(best[wanted].astype(np.int32))], ["vec_id", "vector", "part"])
        return of

    placed = rows.mapInArrow(place(1), _PLACED)
    ids = stage(placed.groupBy("vec_id", "part").agg(F.count(F.lit(1)).alias("n")), "placed")
    blocks = ids.groupBy("part").agg(F.ceil(F.sum("n") / F.lit(float(block_rows))).cast("int").alias("blocks"))
    blocks = {r["part"]: r["blocks"] for r in blocks.collect()}  # one row per part
    held_ids = np.zeros(max(1, parts), np.int64)  # an id with vectors in several parts counts in one
    for r in ids.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").count().collect():
        held_ids[r["part"]] = r["count"]
    counts = F.coalesce(F.get(F.array(*[F.lit(blocks.get(p, 1)) for p in range(max(1, parts))]), F.col("part")), F.lit(1))
    held = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), counts).cast("int"))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).mapInArrow(place(router.probes, held_ids), _PLACED)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), counts - 1)))
    near = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(
        lambda q, r: _nearest(q, r, k, dim), _NEAR)
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
