"""SimHash fingerprints and near-duplicates within a Hamming distance, by the generalised pigeonhole principle.

The bits are put into partitions, correlated ones together, and partition i gets a threshold t_i with sum(t_i) = distance - partitions + 1:
two fingerprints within the distance agree up to t_i bits in some partition i. Thresholds may differ and may be -1 (the partition is
not probed); a dynamic programme picks those with the least estimated work, over all partition counts. Fingerprints meet
under (partition, key), are verified there, and a spanning set of links per group goes on to the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import byte_slices, mixed, split_words
from aligner.llm.graph import components
from aligner.session import stage

_SLICE_BYTES = 2 << 20
BITS = 64
#: Fingerprints of one (partition, key) that are compared in a task; larger groups are dealt out by further bits.
_GROUP = 1 << 14
#: Relative cost of a row that is shuffled and of a pair that is compared in memory.
_ROW_COST, _PAIR_COST = 1.0, 0.01


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit b is set if more than half of the hashes have it."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """Signed 64-bit fingerprints of lower-cased word shingles (A-Z only), repeats included; no word: zero."""
    words, codes, starts = split_words(texts)
    lowered = [w.encode().lower() for w in words.to_pylist()]  # bytes.lower changes A-Z only
    sizes = np.array([len(w) + 1 for w in lowered] or [1], dtype=np.int64)[codes]
    ends = np.cumsum(sizes)
    raw = b" ".join([lowered[c] for c in codes.tolist()])
    ends, begins = ends - 1, ends - sizes
    out = np.zeros(len(starts) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        if b > a:
            last = max(a + 1, b - shingle + 1)
            spans = zip(begins[a:last].tolist(), ends[min(a + shingle, b) - 1:b].tolist(), strict=True)
            out[i] = fingerprint_of(np.array([digest(raw[s:e], 42) for s, e in spans], dtype=np.uint64))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, hash, fp`` of every row: a hash of its text and the fingerprint as a signed long, zero without words."""

    def of(batches):
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            fps = fingerprints_of(part.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(fps)], ["doc_id", "hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "doc_id long, hash long, fp long")


@dataclass(frozen=True)
class Plan:
    """Bits of each partition and its threshold (-1: not probed)."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over all rows of ``fp``."""

    def count(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = np.ascontiguousarray(batch.column("fp").to_numpy()).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.indices((BITS, BITS)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(count, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def group_bits(together: np.ndarray, rows: int, parts: int) -> tuple[tuple[int, ...], ...]:
    """Partitions of near-equal width; each is grown from a free bit by the bits most correlated with it."""
    share = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    correlation = np.abs((together / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread))
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (len(free) + parts - k - 1) // (parts - k)
        own = [min(free, key=lambda b: (-correlation[b, sorted(free)].sum(), b))]
        free.discard(own[0])
        while len(own) < width:
            best = min(free, key=lambda b: (-correlation[b, own].sum(), b))
            own.append(best)
            free.discard(best)
        out.append(tuple(sorted(own)))
    return tuple(out)


def _within(differ: np.ndarray) -> np.ndarray:
    """Probability that at most t of independent bits differ, for t = 0..len."""
    p = np.ones(1)
    for d in differ:
        p = np.append(p, 0) * (1 - d) + np.append(0, p) * d
    return np.cumsum(p)


def choose_plan(together: np.ndarray, rows: int, distance: int) -> Plan:
    """The partition count and thresholds with the least estimated work for ``rows`` fingerprints.

    A partition of threshold t costs its shuffled rows (one, or all keys within t bits besides) and the pairs that meet
    under a key. Thresholds are allocated by dynamic programming over the partitions.
    """
    share = np.diag(together) / max(rows, 1)
    differ = 2 * share * (1 - share)
    best: tuple[float, Plan] | None = None
    for m in range(1, distance + 2):
        parts = group_bits(together, rows, m)
        total = distance - m + 1
        reach: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for own in parts:
            near = _within(differ[list(own)])
            costs = {-1: 0.0}
            keys = 0
            for t in range(total + m):
                if t > min(distance, len(own)):
                    break
                keys += len(list(combinations(range(len(own)), t)))
                pairs = rows * rows / 2 * near[t]
                costs[t] = _ROW_COST * rows * keys + _PAIR_COST * pairs
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in reach.items():
                for t, extra in costs.items():
                    found = (cost + extra, (*chosen, t))
                    if used + t not in step or found < step[used + t]:
                        step[used + t] = found
            reach = step
        cost, thresholds = reach[total]
        if best is None or cost < best[0]:
            best = (cost, Plan(parts, thresholds))
    return best[1]


def _key(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def _split(bits: list[int], parts: int) -> list[tuple[int, ...]]:
    return [tuple(bits[k::parts]) for k in range(parts)]


def _keys(fps: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(partition, keys, fingerprints) under which fingerprints meet."""
    for i, (bits, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if t < 0:
            continue
        key = _key(fps, bits)
        for n in range(t + 1):
            for flips in combinations(range(len(bits)), n):
                yield i, key ^ np.uint64(sum(1 << f for f in flips)), fps


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the fingerprints that are connected by steps of at most ``distance`` bits, one less than members.

    Breadth first: each reached fingerprint is compared with those not reached yet, so a dense group is left after few steps.
    """
    left, froms, tos = fps.copy(), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                froms.append(np.full(len(found), at, np.uint64))
                tos.append(found)
                frontier += list(found)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *froms]), np.concatenate([empty, *tos])


_MET = "part long, key long, fp long"
_FOUND = "u long, v long, part long, key long"


def _found(u: np.ndarray, v: np.ndarray | None, part: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
    columns = [pa.nulls(len(u), pa.int64()) if c is None else pa.array(c.view(np.int64)) for c in (u, v, part, key)]
    return pa.RecordBatch.from_arrays(columns, ["u", "v", "part", "key"])


def _verify(met: DataFrame, plan: Plan, distance: int, depth: int, group_rows: int) -> DataFrame:
    """Links (u, v) within groups; members of groups over the limit come back as rows (fp, null, sub-partition, sub-key).

    A member is dealt out under its remaining bits, cut into ``distance`` + 1 shares: two members within the distance agree in one of
    the shares. At the last depth, where no bits are left to deal by, groups of any size are compared as they are.
    """
    last = depth == 2

    def deal(part: int, key: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        rest = [b for b in range(BITS) if b not in plan.parts[part % 16]]
        if depth:
            used = _split(rest, distance + 1)[part // 16 - 1]
            rest = [b for b in rest if b not in used]
        above = mixed(np.array([key], np.int64).view(np.uint64))
        for j, bits in enumerate(_split(rest, distance + 1)):
            sub = mixed(_key(members, bits) + above)  # two keys that collide only cause more comparisons
            yield _found(members, None, np.full(len(members), part + (j + 1) * 16 ** (depth + 1)), sub)

    def links(members: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = spanning_links(np.unique(members), distance)
        if len(u):
            yield _found(u, v, None, None)

    def verify(batches):
        held: list[np.ndarray] = []
        size, current, dealt = 0, None, False
        for batch in batches:
            part, key = batch.column("part").to_numpy(), batch.column("key").to_numpy()
            fps = np.ascontiguousarray(batch.column("fp").to_numpy()).view(np.uint64)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                if a == b:
                    continue
                group = (int(part[a]), int(key[a]))
                if group != current:
                    if size > 1 and not dealt:
                        yield from links(np.concatenate(held))
                    held, size, current, dealt = [], 0, group, False
                held.append(fps[a:b])
                size += b - a
                if size > group_rows and not last:
                    yield from deal(*current, np.concatenate(held))
                    held, size, dealt = [], group_rows, True  # what follows of this group is dealt out as well
        if size > 1 and not dealt:
            yield from links(np.concatenate(held))

    dealt_out = met.repartition("part", "key").sortWithinPartitions("part", "key")
    return dealt_out.mapInArrow(verify, _FOUND)


def links(fps: DataFrame, distance: int = 3, group_rows: int = _GROUP) -> DataFrame:
    """Links ``u, v`` between different values of ``fp`` that connect all values within ``distance`` bits of each other."""
    together = bit_counts(fps)
    rows = fps.count()
    plan = choose_plan(together, rows, distance)

    def meet(batches):
        for batch in batches:
            own = np.ascontiguousarray(batch.column("fp").to_numpy()).view(np.uint64)
            for i, key, fp in _keys(own, plan):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), i)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["part", "key", "fp"])

    met = fps.select("fp").mapInArrow(meet, _MET)
    found = []
    for depth in range(3):
        out = stage(_verify(met, plan, distance, depth, group_rows), "links")
        found.append(out.where("v is not null").select("u", "v"))
        met = out.where("v is null").select("part", "key", F.col("u").alias("fp"))
        if depth == 2 or met.isEmpty():
            break
    links_found = found[0]
    for more in found[1:]:
        links_found = links_found.unionByName(more)
    return links_found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id reachable over links of at most ``distance`` bits.
    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. Repeated rows
    stay; a null id stays null and takes the component of its fingerprint; a component of null ids only has a null id. Extra
    columns are ignored; an empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return with_components(fps, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(fps: DataFrame, distance: int, group_rows: int) -> DataFrame:
    """``fp, root, component_id`` for every distinct fingerprint of ``doc_id, fp``."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, distance, group_rows))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return stage(rooted.join(smallest, "root").select("fp", "root", "component_id"), "components")


def with_components(fps: DataFrame, distance: int, group_rows: int = _GROUP) -> DataFrame:
    """``doc_id, fp, component_id`` for rows ``doc_id, fp``."""
    return fps.join(_members(fps, distance, group_rows), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of every component, all columns: the row with the smallest id (nulls last), then the smallest hash of its text.

    Texts without words (null, empty, white space) are one component; of repeated rows one stays; whole texts count, however long. Columns of any
    name are kept, an empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, "doc_id", "text", shingle), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("hash").alias("h"))
    kept = fps.join(_members(fps, distance, _GROUP), "fp").groupBy("root").agg(F.min(order).alias("o"))
    return rows_of(docs, kept)


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for every ``o`` of ``kept``: a struct with the id ``i`` (may be null) and the hash ``h`` of the text."""
    kept = kept.select(F.coalesce("o.i", F.lit(0)).alias("id"), F.col("o.i").isNull().alias("null"), F.col("o.h").alias("hash")).distinct()
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                      F.col("doc_id").isNull().alias("null"), F.xxhash64("text").alias("hash"))
    found = own.join(kept, ["id", "null", "hash"]).dropDuplicates(["id", "null", "hash"])  # one shuffle serves both
    return found.select("row.*")
