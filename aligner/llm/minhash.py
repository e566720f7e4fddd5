"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and min-hash bands propose pairs, the shingles decide.

Texts with the same shingles are one node. Nodes whose fingerprints differ in few bits are linked first (``simhash.links``). What these links
leave apart meets under the keys of its bands, with signatures of 200 bytes that estimate the similarity of a pair. Each node proposes links to its
most similar nodes of a bucket, in rounds: one at first, then sixteen times as many, only to nodes that aren't connected to it yet, and
a pair only in the first bucket that it shares. All proposals are verified on the shingle hashes, so no bucket ever sends all of its pairs, and
the rounds end when no node has a partner left that the signatures allow. A pair of similarity 0.8 meets with probability
1 - (1 - 0.8^5)^20 = 0.9996 (0.99999999 at 0.9) and passes the signatures, which allow three standard deviations, with 0.9987.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import byte_slices, mixed, split_words
from aligner.llm.graph import components
from aligner.llm.simhash import fingerprint_of, links, rows_of
from aligner.session import release, stage

_SLICE_BYTES = 2 << 20
_BANDS, _WIDTH, _SIGNATURE = 20, 5, 200
#: Nodes of a bucket that are compared in one task; larger buckets are cut into blocks.
_BLOCK = 1 << 12
#: Proposals of a node in a bucket, and their growth from round to round.
_FIRST, _GROWTH = 1, 16
#: Estimated similarity to the smallest node of a bucket that makes it a node's first proposal.
_SURE = 0.86
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 63, (_SIGNATURE, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, (_SIGNATURE, 1), dtype=np.uint64)
_PLACES = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct lower-cased word shingles (A-Z only); a shorter text is one shingle."""
    words, codes, starts = split_words(texts)
    hashes = np.array([xxhash.xxh64_intdigest(w.encode().lower(), 42) for w in words.to_pylist()] or [0], np.uint64)[codes]
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = hashes[a:b]
        wide = min(shingle, b - a)
        total = np.zeros(b - a - wide + 1 if wide else 0, np.uint64)
        for k in range(wide):
            total += own[k:k + len(total)] * _PLACES[k]
        out.append(np.unique(mixed(total + np.uint64(wide))))
    return out


def least_hashes(own: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each of the permutations, mixed."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        least = np.minimum(least, ((own[i:i + 1024] ^ _MASKS) * _FACTORS).min(axis=1))
    return mixed(least)


def bands(least: np.ndarray) -> np.ndarray:
    """The keys of a text, one for each band, from its smallest hashes."""
    total = (least[:_BANDS * _WIDTH].reshape(_BANDS, _WIDTH) * _PLACES[:_WIDTH]).sum(axis=1, dtype=np.uint64)
    return mixed(total + np.arange(_BANDS, dtype=np.uint64) * _PLACES[_WIDTH])


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, hash, node, fp, size, bands, signature, shingles`` of every row: a hash of its text, one of its shingles, their fingerprint
    and number, the keys, a byte of each smallest hash, and 32 bits of each shingle's hash."""

    def of(batches):
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            sets = shingle_sets(part.column("text"), shingle)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            fps = np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            least = [least_hashes(s) for s in sets]
            keys = np.concatenate([bands(x) for x in least]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * _BANDS), pa.array(keys))
            short = [np.unique(s.astype(np.uint32)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("hash"), pa.array(nodes), pa.array(fps), pa.array([len(s) for s in short], pa.int64()), lists,
                 pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary()), pa.array([s.tobytes() for s in short], pa.binary())],
                ["doc_id", "hash", "node", "fp", "size", "bands", "signature", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(of, "doc_id long, hash long, node long, fp long, size long, bands array<long>, signature binary, shingles binary")


def _near_fingerprints(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs ``u, v`` that connect all nodes whose fingerprints are connected by steps of at most ``distance`` bits."""
    own = nodes.select("node", "fp")
    fps = stage(own.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = own.join(fps, "fp").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    apart = links(fps.select("fp"), distance).distinct()
    for c in ("u", "v"):
        apart = apart.join(fps.select(F.col("fp").alias(c), "first"), c).withColumn(c, F.col("first")).drop("first")
    return same.unionByName(apart)


def _members(nodes: DataFrame) -> DataFrame:
    """``key, node, band, head, blocks`` of all buckets with several nodes; ``blocks`` is the number of blocks that the bucket is cut into."""
    keyed = nodes.select(F.posexplode("bands").alias("band", "key"), "node")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1")
    buckets = buckets.select("key", "head", F.ceil(F.col("n") / F.lit(float(_BLOCK))).cast("int").alias("blocks"))
    return stage(keyed.join(buckets, "key"), "members")


def _first_blocks(members: DataFrame) -> DataFrame:
    """Every node in one block of its bucket, the bucket's smallest node in all."""
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    everywhere = F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return members.select("key", "node", "band", "root", F.explode(everywhere).alias("block"), F.lit(0).alias("other"))


def _pairs_of_blocks(members: DataFrame) -> DataFrame:
    """Every node in all pairs of blocks that its own block takes part in."""
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    row = members.select("key", "node", "band", "root", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_to"))
    return row.select("key", "node", "band", "root", F.least("_own", "_to").alias("block"), F.greatest("_own", "_to").alias("other"))


def proposals(nodes: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, roots: np.ndarray, similarity: float, begin: int, end: int,
              first: bool = False, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Links (u, v) of a bucket: every node's partners at places ``begin`` to ``end`` of those that the signatures allow, most similar first,
    unless they are connected already or share a key of ``before`` (their keys of earlier bands), whose bucket proposes them; and whether a node has
    such partners beyond.

    In the ``first`` round a node that is surely alike to the smallest node has no other proposal.
    """
    least = similarity * _SIGNATURE - 3 * np.sqrt(_SIGNATURE * similarity * (1 - similarity))
    order = np.argsort(nodes)
    nodes, sizes, signatures, roots = nodes[order], sizes[order], signatures[order], roots[order]
    before = np.zeros((len(nodes), 0), np.int64) if before is None else before[order]
    close = lambda i: np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i])
    u, v, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False

    def open_(i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are left to this bucket."""
        others = others[roots[others] != roots[i]]
        return others[~(before[others] == before[i]).any(axis=1)]

    todo = np.arange(len(nodes))
    if first:
        alike = (signatures == signatures[0]).sum(axis=1)
        sure = np.flatnonzero((alike >= _SURE * _SIGNATURE) & close(0))[1:]
        chosen = open_(0, sure)
        u.append(np.full(len(chosen), nodes[0]))
        v.append(nodes[chosen])
        more = len(sure) > 0
        todo = np.setdiff1d(todo, [0, *sure])
    for i in todo.tolist():
        alike = (signatures == signatures[i]).sum(axis=1)
        fits = np.flatnonzero((alike >= least) & close(i))
        fits = fits[fits != i]
        if len(fits) <= begin:
            continue
        fits = fits[np.lexsort((fits, -alike[fits]))]
        chosen = open_(i, fits[begin:end])
        more = more or len(open_(i, fits[end:])) > 0
        u.append(np.full(len(chosen), nodes[i]))
        v.append(nodes[chosen])
    return np.concatenate(u), np.concatenate(v), more


def _proposed(met: DataFrame, similarity: float, begin: int, end: int, first: bool) -> DataFrame:
    """``u, v`` of all buckets, as ``key`` a bucket that has more to propose (once for each of its groups)."""

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(held)
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, _SIGNATURE)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, _BANDS)
        nodes, sizes, roots = (group.column(c).to_numpy() for c in ("node", "size", "root"))
        u, v, more = proposals(nodes, sizes, signatures, roots, similarity, begin, end, first, bands[:, :group.column("band")[0].as_py()])
        u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)  # two nodes may propose each other
        more = int(more)
        key = np.full(len(u) + more, group.column("key")[0].as_py(), np.int64)
        one = pa.array([True] * len(u) + [False] * more, pa.bool_())
        u, v = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(key), one], ["u", "v", "key", "link"])

    def search(batches: Iterator[pa.RecordBatch]):
        held, current = [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "block", "other")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                group = tuple(int(c[a]) for c in columns)
                if group != current and held:
                    yield of(held)
                    held = []
                current = group
                held.append(batch.slice(a, b - a))
        if held:
            yield of(held)

    dealt = met.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
    return dealt.mapInArrow(search, "u long, v long, key long, link boolean")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose shingles have at least the similarity."""

    def verify(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long")


def _unfinished(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with roots, of the buckets whose nodes aren't all connected."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("key").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("key")
    return stage(rooted.join(apart, "key", "left_semi"), "unfinished")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links, which only connect the roots of their ends."""
    if links.isEmpty():
        return roots
    for c in ("u", "v"):
        own = roots.select(F.col("node").alias(c), "root")
        links = links.join(own, c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    merged = components(links)
    above = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stage(roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(merged), "roots")


def _connected(nodes: DataFrame, similarity: float, distance: int) -> DataFrame:
    """``node, root`` of the nodes that pairs of at least the similarity connect to a smaller node."""
    near, members = stage(_near_fingerprints(nodes, distance), "near"), _members(nodes)
    needed = members.select("node").unionByName(near.select(F.col("u").alias("node"))).unionByName(near.select(F.col("v").alias("node"))).distinct()
    own = stage(nodes.join(needed, "node", "left_semi").select("node", "size", "signature", "bands"), "signatures")
    sets = stage(nodes.join(needed, "node", "left_semi").select("node", "shingles"), "shingles")
    roots = components(_alike(near, sets, similarity))
    left, begin, end, first = _unfinished(members, roots), 0, _FIRST, True
    while not left.isEmpty():
        blocks = _first_blocks(left) if first else _pairs_of_blocks(left)
        found = stage(_proposed(blocks.join(own, "node"), similarity, begin, end, first), "proposed")
        fresh = stage(_alike(found.where("link").select("u", "v").distinct(), sets, similarity), "alike")
        roots = _joined(roots, fresh)
        more = found.where("not link").select("key")
        if first:  # blocks haven't met
            more = more.unionByName(members.where("blocks > 1").select("key"))
        rest = _unfinished(members.join(more.distinct(), "key", "left_semi"), roots)
        release(left, found, fresh)
        left, begin, end, first = rest, 0 if first else end, end * _GROWTH, False
    release(near, members, own, sets, left)
    return roots


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3) -> DataFrame:
    """One row of every group that is connected by pairs of at least ``similarity``, all columns.

    It is the row with the smallest id (nulls last), then the smallest hash of its text. Texts without words (null, empty, white
    space) are one group. An empty table gives an empty result. Pairs are those of fingerprints within ``distance`` bits, others are found with the
    recall of the bands (see above); none is linked below ``similarity``.
    """
    signatures = stage(_signatures(docs, shingle), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("hash").alias("h"))
    nodes = stage(signatures.groupBy("node").agg(
        F.min(order).alias("o"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"),
        F.first("signature").alias("signature"), F.first("shingles").alias("shingles")), "nodes")
    release(signatures)
    roots = _connected(nodes, similarity, distance)
    groups = stage(nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("o").alias("o")), "groups")
    release(nodes)
    return rows_of(docs, groups)
