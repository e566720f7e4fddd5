"""Hard negatives by inner product, searched in STR-packed R-trees.

Rows are packed by sort-tile-recursive splits: a bounded sample gives the splits of the tiles, every row goes to its tile, tiles are cut into
blocks, and a block is packed into leaves and nodes with minimum bounding boxes. A box gives an interval for each coordinate's product
with a query's, their sum an interval for the score. A best-first queue opens boxes by falling upper bound and leaves out those outside
all wanted score windows or strictly below the k-th score found. Tiles are searched in two rounds: the most promising ones of each query
first, then those that its k-th scores don't exclude. All of it is exact; scores are integers.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aligner.session import stage

_HASH_SEED = 41
_SAMPLE_ROWS = 16_384
_MOST_TILES = 1024
_BLOCK_ROWS = 8192
#: Queries of a group; more are dealt out over several copies of the block.
_QUERY_ROWS = 1 << 16
_LEAF_ROWS, _NODE_LEAVES = 64, 16
#: Tiles that a query visits before its k-th scores are known.
_FIRST_TILES = 2
#: Leaves that are scored together at most.
_TOGETHER = 16
_LOW, _HIGH = -(1 << 62), 1 << 62

_SLOTS = "array<struct<slot:int,low:long,high:long,kth:long>>"
_ASKED = f"query_id long, label long, vector array<double>, slots {_SLOTS}"
_FOUND = "query_id long, slot int, vec_id long, score long"


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def exact_kind(*arrays: np.ndarray) -> type:
    """Doubles where all sums of products stay exact in them, else Python's integers."""
    largest = [float(np.abs(a).max()) if a.size else 0.0 for a in arrays]
    return np.float64 if largest[0] * largest[-1] * max(1, arrays[0].shape[1]) < 2 ** 53 else object


def as_kind(x: np.ndarray, kind: type) -> np.ndarray:
    return x if kind is np.float64 else x.astype(np.int64).astype(object)


@dataclass(frozen=True)
class Tiles:
    """Splits of sort-tile-recursive packing: level i cuts every piece by coordinate ``axes[i]`` at ``cuts[i]`` (pieces x cuts)."""

    axes: tuple[int, ...]
    cuts: tuple[np.ndarray, ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for axis, cuts in zip(self.axes, self.cuts, strict=True):
            at = at * (cuts.shape[1] + 1) + (x[:, axis, None] > cuts[at]).sum(axis=1)
        return at


def plan_tiles(sample: np.ndarray, tiles: int) -> Tiles:
    """Tiles (a power of two) of near-equal size over the sample, four slabs a level, by the coordinates that vary most."""
    order = np.argsort(-sample.var(axis=0), kind="stable") if len(sample) else np.zeros(0, np.int64)
    axes, cuts, pieces = [], [], [sample]
    while len(pieces) < tiles and len(order):
        slabs = min(4, tiles // len(pieces))
        axis = int(order[len(axes) % len(order)])
        level = [np.quantile(p[:, axis], np.arange(1, slabs) / slabs, method="lower") if len(p) else np.zeros(slabs - 1) for p in pieces]
        own = [(p[:, axis, None] > c).sum(axis=1) for p, c in zip(pieces, level, strict=True)]
        pieces = [p[o == s] for p, o in zip(pieces, own, strict=True) for s in range(slabs)]
        axes.append(axis)
        cuts.append(np.array(level))
    return Tiles(tuple(axes), tuple(cuts))


def pack(x: np.ndarray, leaf_rows: int = _LEAF_ROWS, axes: int = 4) -> list[np.ndarray]:
    """Rows of each leaf: sorted into slabs by one coordinate after the other, at the last into leaves."""
    order = np.argsort(-x.var(axis=0), kind="stable")[:max(1, min(axes, x.shape[1]))]
    groups = [np.arange(len(x))]
    for k, axis in enumerate(order):
        out = []
        for g in groups:
            leaves = -(-len(g) // leaf_rows)
            slabs = leaves if k == len(order) - 1 else int(np.ceil(leaves ** (1 / (len(order) - k))))
            g = g[np.argsort(x[g, axis], kind="stable")]
            step = leaf_rows * -(-leaves // max(1, slabs))
            out += [g[a:a + step] for a in range(0, len(g), step)]
        groups = out
    return groups


@dataclass(frozen=True)
class Tree:
    """A packed block: rows in the order of the leaves, boxes of leaves and nodes."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    leaf_low: np.ndarray
    leaf_high: np.ndarray
    node_low: np.ndarray
    node_high: np.ndarray


def build(x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tree:
    leaves = pack(x)
    order = np.concatenate(leaves)
    starts = np.cumsum([0, *map(len, leaves)])
    x = x[order]
    low, high = np.minimum.reduceat(x, starts[:-1]), np.maximum.reduceat(x, starts[:-1])
    nodes = np.arange(0, len(leaves), _NODE_LEAVES)
    return Tree(x, ids[order], labels[order], starts, low, high, np.minimum.reduceat(low, nodes), np.maximum.reduceat(high, nodes))


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every query with a vector in every box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def wanted_boxes(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Boxes that can hold a score in some window from ``low`` (or the k-th score, if that is higher) to ``high``."""
    return ((most[:, None] >= low) & (least[:, None] <= high)).any(axis=1)


def search_tree(tree: Tree, vector: np.ndarray, fits: np.ndarray, bounds: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray,
                k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every window the ``k`` best (scores, ids) of the rows that fit, or those that the given ``low`` leaves."""
    leaf_least, leaf_most, node_least, node_most = bounds
    found = [(np.zeros(0, tree.x.dtype), np.zeros(0, np.int64)) for _ in low]
    low = low.copy()
    queue = [(-node_most[n], 0, n) for n in np.flatnonzero(wanted_boxes(node_least, node_most, low, high)).tolist()]
    heapq.heapify(queue)
    together, held = 1, []
    while queue or held:
        if queue and -queue[0][0] >= low.min() and len(held) < together:
            _, is_leaf, at = heapq.heappop(queue)
            if is_leaf:
                held.append(at)
            else:
                span = slice(at * _NODE_LEAVES, (at + 1) * _NODE_LEAVES)
                for i in np.flatnonzero(wanted_boxes(leaf_least[span], leaf_most[span], low, high)).tolist():
                    heapq.heappush(queue, (-leaf_most[span.start + i], 1, span.start + i))
            continue
        if not held:  # all that is left lies below
            break
        rows = np.concatenate([np.arange(tree.starts[i], tree.starts[i + 1]) for i in held])
        rows = rows[fits[rows]]
        scores, ids = tree.x[rows] @ vector, tree.ids[rows]
        for s in range(len(low)):
            inside = (scores >= low[s]) & (scores <= high[s])
            if inside.any():
                own, own_ids = np.concatenate([found[s][0], scores[inside]]), np.concatenate([found[s][1], ids[inside]])
                best = np.lexsort((own_ids, -own))[:k]
                found[s] = own[best], own_ids[best]
                if len(best) == k:
                    low[s] = max(low[s], own[best[-1]])
        held, together = [], min(_TOGETHER, 2 * together)
    return found


def _slots(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each query's slots begin, and ``slot, low, high`` of all; a known k-th score raises ``low``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    slot, low, high, kth = (pc.fill_null(c, _LOW if c.type == pa.int64() else 0).to_numpy() for c in column.flatten().flatten())
    return np.concatenate([[0], np.cumsum(counts)]), [slot, np.maximum(low, kth), high]


def _search_block(asked: pa.Table, rows: pa.Table, k: int, dim: int, same: bool) -> pa.Table:
    kind = pa.schema([("query_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not asked.num_rows or not rows.num_rows:
        return kind.empty_table()
    x, q = matrix(rows.column("vector"), dim), matrix(asked.column("vector"), dim)
    exact = exact_kind(x, q)
    tree = build(as_kind(x, exact), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy())
    q, ids, labels = as_kind(q, exact), asked.column("query_id").to_numpy(), asked.column("label").to_numpy()
    starts, (slot, low, high) = _slots(asked.column("slots"))
    of_label = {int(c): (tree.labels == c) == same for c in np.unique(labels)}
    out = []
    for a in range(0, len(q), 512):
        leaves, nodes = intervals(q[a:a + 512], tree.leaf_low, tree.leaf_high), intervals(q[a:a + 512], tree.node_low, tree.node_high)
        for i in range(a, min(a + 512, len(q))):
            fits = of_label[int(labels[i])] & (tree.ids != ids[i])
            own = slice(starts[i], starts[i + 1])
            bounds = (leaves[0][i - a], leaves[1][i - a], nodes[0][i - a], nodes[1][i - a])
            for s, (scores, near) in zip(slot[own], search_tree(tree, q[i], fits, bounds, low[own], high[own], k), strict=True):
                out.append((np.full(len(near), ids[i]), np.full(len(near), s, np.int32), near, scores.astype(np.int64)))
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=kind)


class Index:
    """Packed rows ``vec_id, label, vector`` (integers as doubles), written once, and the boxes of their tiles."""

    def __init__(self, rows: DataFrame, dim: int, tile_rows: int, block_rows: int) -> None:
        self.dim = dim
        sample = rows.orderBy(F.xxhash64(F.col("vec_id"), F.lit(_HASH_SEED)), "vec_id").limit(_SAMPLE_ROWS).select("vector").collect()
        total = rows.count()
        tiles = plan_tiles(np.array([r["vector"] for r in sample]).reshape(-1, dim),
                           min(_MOST_TILES, 1 << max(0, -(-total // tile_rows) - 1).bit_length()))

        def place(batches):
            for batch in batches:
                at = tiles.of(matrix(batch.column("vector"), dim)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "tile"])

        def boxes(batches):
            low, high = {}, {}
            for batch in batches:
                x, at = matrix(batch.column("vector"), dim), batch.column("tile").to_numpy()
                for t in np.unique(at).tolist():
                    own = x[at == t]
                    low[t] = np.minimum(low.get(t, np.inf), own.min(axis=0))
                    high[t] = np.maximum(high.get(t, -np.inf), own.max(axis=0))
            for t in low:  # one row per tile
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([low[t].tolist()], pa.list_(pa.float64())),
                     pa.array([high[t].tolist()], pa.list_(pa.float64()))], ["tile", "low", "high"])

        self.rows = stage(rows.select("vec_id", "label", "vector").mapInArrow(
            place, "vec_id long, label long, vector array<double>, tile int"), "packed")
        sizes = {r["tile"]: r["count"] for r in self.rows.groupBy("tile").count().collect()}  # one row per tile
        self.tiles = sorted(sizes)
        self.blocks = {t: -(-n // block_rows) for t, n in sizes.items()}
        each = self.rows.select("tile", "vector").mapInArrow(boxes, "tile int, low array<double>, high array<double>")
        each = each.select("tile", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "c")).groupBy("tile", "axis").agg(
            F.min("c.low").alias("low"), F.max("c.high").alias("high"))
        self.low, self.high = np.zeros((len(self.tiles), dim)), np.zeros((len(self.tiles), dim))
        place_of = {t: i for i, t in enumerate(self.tiles)}
        for r in each.collect():  # one row per tile and coordinate
            self.low[place_of[r["tile"]], r["axis"]], self.high[place_of[r["tile"]], r["axis"]] = r["low"], r["high"]

    def _routed(self, asked: DataFrame, first: bool) -> DataFrame:
        """``asked`` once for each tile to visit: the best ones, or the others that may still hold something."""
        tiles, low, high, dim = np.array(self.tiles, np.int32), self.low, self.high, self.dim

        def route(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column("vector"), dim)
                exact = exact_kind(q, np.maximum(np.abs(low), np.abs(high)))
                least, most = intervals(as_kind(q, exact), as_kind(low, exact), as_kind(high, exact))
                starts, (_, slot_low, slot_high) = _slots(batch.column("slots"))
                row, to = [], []
                for i in range(len(q)):
                    best = np.argsort(-most[i], kind="stable")
                    best = best[:_FIRST_TILES] if first else best[_FIRST_TILES:]
                    own = slice(starts[i], starts[i + 1])
                    best = best[wanted_boxes(least[i][best], most[i][best], slot_low[own], slot_high[own])]
                    row.append(np.full(len(best), i))
                    to.append(tiles[best])
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(np.concatenate(row))) for c in batch.columns), pa.array(np.concatenate(to))],
                    [*batch.schema.names, "tile"])

        return asked.mapInArrow(route, f"{_ASKED}, tile int")

    def _found(self, asked: DataFrame, queries: int, first: bool, k: int, same: bool) -> DataFrame:
        """``query_id, slot, vec_id, score`` of the blocks that are visited."""
        dim, shares = self.dim, max(1, -(-queries // _QUERY_ROWS))
        counts = F.get(F.array(*[F.lit(self.blocks.get(t, 1)) for t in range(max(self.tiles, default=0) + 1)]), F.col("tile"))
        held = self.rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), counts).cast("int"))
        held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        routed = self._routed(asked, first).withColumn("block", F.explode(F.sequence(F.lit(0), counts - 1)))
        routed = routed.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
        return routed.groupBy("tile", "block", "share").cogroup(held.groupBy("tile", "block", "share")).applyInArrow(
            lambda q, r: _search_block(q, r, k, dim, same), _FOUND)

    def best(self, asked: DataFrame, queries: int, k: int, same: bool) -> DataFrame:
        """``query_id, slot, rank, vec_id, score``: the first ``k`` rows of the same label (or of others) in every slot's window."""
        order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")

        def top(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        one = stage(top(self._found(asked, queries, True, k, same)), "first_tiles")
        kth = one.where(F.col("rank") == k).groupBy("query_id").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        known = asked.join(kth, "query_id", "left").withColumn("slots", F.transform("slots", lambda s: F.struct(
            s["slot"].alias("slot"), s["low"].alias("low"), s["high"].alias("high"), F.try_element_at("kth", s["slot"]).alias("kth"))))
        two = self._found(known.select("query_id", "label", "vector", F.col("slots").cast(_SLOTS).alias("slots")), queries, False, k, same)
        return stage(top(one.drop("rank").unionByName(two)), "found")


def _floor(x: Column) -> Column:
    """The next lower whole number as a double, however large."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _hundredths(x: Column) -> Column:
    """Whole hundredths of a number that isn't negative."""
    return F.call_function("div", x, F.lit(100).cast("long"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
                   positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: int = 256,
                   tile_rows: int = _BLOCK_ROWS, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as floor(scale * x); a score is the integer inner product with the anchor, higher ones first, ties by smaller id.
    For every anchor (``is_anchor``, a condition on ``vec_id``) and each of its first ``positives`` other rows of the same label, the
    first ``negatives`` rows of other labels with low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.
    An anchor without positives and a positive without negatives give no row; a negative positive score leaves no window.

    Rows with a null id, label or vector, with a null or non-finite component, without components, or of another dimension than the most
    common one take no part, nor do those with a component so large that scores times 100 wouldn't fit into a long
    (dimension * component^2 >= 2^56). An id that occurs several times counts once, with its smallest label and vector. A vector that very many rows share
    is spread over blocks. Extra columns are ignored; an empty table gives an empty result.
    """
    own_label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), own_label.cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and size(vector) > 0").where(~F.coalesce(odd, F.lit(True)))
    rows = rows.withColumn("vector", F.transform("vector", lambda v: _floor(v * F.lit(float(scale)))))
    rows = rows.where(~F.exists("vector", lambda v: v * v * F.size("vector") >= float(1 << 56)))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")
    rows = stage(rows, "vectors")
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    index = Index(rows.where(F.size("vector") == dim), dim, tile_rows, block_rows)
    anchors = stage(rows.where(is_anchor & (F.size("vector") == dim)).select(F.col("vec_id").alias("query_id"), "label", "vector"), "anchors")
    queries = anchors.count()
    every = F.array(F.struct(F.lit(0).alias("slot"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"), F.lit(None).cast("long").alias("kth")))
    near = index.best(anchors.withColumn("slots", every.cast(_SLOTS)), queries, positives, True)
    lowest, highest = F.col("score") * low_percent, F.col("score") * high_percent
    window = F.struct(F.col("rank").cast("int").alias("slot"), _hundredths(lowest + 99).alias("low"), _hundredths(highest).alias("high"),
                      F.lit(None).cast("long").alias("kth"))
    slots = near.where("score >= 0").groupBy("query_id").agg(F.collect_list(window).cast(_SLOTS).alias("slots"))
    hard = index.best(anchors.join(slots, "query_id"), queries, negatives, False)
    pairs = near.select("query_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["query_id", "slot"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
