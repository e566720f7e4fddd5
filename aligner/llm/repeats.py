"""Removal of passages that occur in an earlier document, found by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window; a window that occurs elsewhere holds at least one whole
reference block of the other document. All rolling block-sized windows probe the blocks, dealt out by hash. Around each hit the windows
are extended to full length by their own hashes, dealt out likewise, and the smallest document of each decides. Documents travel in
packs (a hash of their id), probes and answers as packed arrays with one row per pack and hash range, so that a passage shared by a
third of all documents is still spread evenly, and no pair of documents is ever formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import mixed, shuffle_partitions, split_words

_PACK_BYTES = 2 << 20
#: An odd multiplier of 64 bits for rolling hashes and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST_ID = np.iinfo(np.int64).max

_PROBES = "bucket int, pack long, first long, gaps binary, hashes binary"
_HITS = "pack long, positions binary"
_WINDOWS = "bucket int, pack long, doc_ids binary, counts binary, positions binary, hashes binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * step])
            step = step * step
    return out[:n]


class Pack:
    """The words of a pack's documents, in the order of (id, text): their hashes, and where each document begins."""

    def __init__(self, docs: pa.Table) -> None:
        self.docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = self.docs.column("text").combine_chunks()
        self.words, self.codes, self.starts = split_words(texts)
        distinct = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        self.hashes = distinct[self.codes]
        ids = self.docs.column("doc_id").to_numpy()
        self.ids = ids

    def rolling(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each position on, and whether they all belong to one document."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(_BASE, n), dtype=np.uint64)])
            sums = (total[size:] - total[:-size]) * _powers(_BASE_INVERSE, n - size + 1)
            hashes = mixed(sums + np.uint64(size))
        ends = np.repeat(self.starts[1:], np.diff(self.starts))  # where the document of each position ends
        at = np.arange(n - size + 1)
        return hashes, at + size <= ends[:n - size + 1]

    def in_doc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(buckets: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indexes in ascending order) for the buckets that occur."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.searchsorted(buckets[order], np.arange(n + 1))
    return [(b, order[cuts[b]:cuts[b + 1]]) for b in range(n) if cuts[b + 1] > cuts[b]]


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the spans [start, end)."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_PROBE_FIELDS = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("first", pa.int64()), ("gaps", pa.binary()),
                           ("hashes", pa.binary())])
_HIT_FIELDS = pa.schema([("pack", pa.int64()), ("positions", pa.binary())])
_WINDOW_FIELDS = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("doc_ids", pa.binary()), ("counts", pa.binary()),
                            ("positions", pa.binary()), ("hashes", pa.binary())])


def _probes(key: tuple, docs: pa.Table, block: int, buckets: int) -> pa.Table:
    """All rolling windows of one block's length: low hash bits and gaps of position, one row per bucket.

    The low bit of a hash says whether the window is a reference block.
    """
    pack = Pack(docs)
    hashes, whole = pack.rolling(block)
    at = np.flatnonzero(whole)
    hashes = hashes[at]
    reference = (at - pack.starts[pack.in_doc(at)]) % block == 0
    low = (hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | reference.astype(np.uint32)
    rows = []
    for bucket, index in _by_bucket(_bucket(hashes, buckets), buckets):
        gaps = np.diff(at[index], prepend=at[index[0]])
        wide = np.flatnonzero(gaps > 65535)
        for part in np.split(np.arange(len(index)), wide):
            if len(part):
                own = gaps[part]
                own[0] = 0
                planes = own.astype("<u2").view(np.uint8).reshape(-1, 2).T  # low bytes, then the high ones, which are mostly zero
                rows.append((bucket, key[0].as_py(), int(at[index[part[0]]]), planes.tobytes(), low[index[part]].tobytes()))
    return _rows(rows, _PROBE_FIELDS)


def _lengths(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.array([len(x) // width for x in column.to_pylist()], dtype=np.int64)


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _hits(key: tuple, probes: pa.Table) -> pa.Table:
    """Positions whose window occurs at least twice, once of them as a reference block."""
    hashes = _joined(probes.column("hashes"), np.uint32)
    counts = _lengths(probes.column("hashes"), 4)
    words = hashes >> np.uint32(1)
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(ordered)))
    references = np.add.reduceat((hashes & np.uint32(1))[order].astype(np.int64), first)
    good = np.repeat((size > 1) & (references > 0), size)
    hit = np.zeros(len(hashes), bool)
    hit[order[good]] = True
    planes = [np.frombuffer(x, np.uint8).reshape(2, -1) for x in probes.column("gaps").to_pylist()]
    gaps = np.concatenate([p[0] + p[1].astype(np.int64) * 256 for p in planes])
    begins = np.cumsum(counts) - counts
    total = np.cumsum(gaps)
    positions = total - np.repeat(total[begins], counts) + np.repeat(probes.column("first").to_numpy(), counts)
    packs = np.repeat(probes.column("pack").to_numpy(), counts)[hit]
    positions = positions[hit].astype(np.uint32)
    rows = []
    order = np.argsort(packs, kind="stable")
    packs, positions = packs[order], positions[order]
    for part in np.split(np.arange(len(packs)), np.flatnonzero(np.diff(packs)) + 1):
        if len(part):
            rows.append((int(packs[part[0]]), positions[part].tobytes()))
    return _rows(rows, _HIT_FIELDS)


def _windows(key: tuple, docs: pa.Table, hits: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """The full windows around the hits of a pack: hashes and positions, and which documents they belong to."""
    if not docs.num_rows or not hits.num_rows:
        return _rows([], _WINDOW_FIELDS)
    pack = Pack(docs)
    hashes, whole = pack.rolling(window)
    positions = _joined(hits.column("positions"), np.uint32).astype(np.int64)
    near = _covered(np.maximum(positions - (window - block), 0), positions + 1, len(pack.hashes))
    at = np.flatnonzero(near[:len(hashes)] & whole)
    hashes = hashes[at]
    doc = pack.in_doc(at)
    rows = []
    for bucket, index in _by_bucket(_bucket(hashes, buckets), buckets):
        own, counts = np.unique(doc[index], return_counts=True)
        rows.append((bucket, key[0].as_py(), pack.ids[own].astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes(),
                     at[index].astype(np.uint32).tobytes(), hashes[index].tobytes()))
    return _rows(rows, _WINDOW_FIELDS)


def _later(key: tuple, windows: pa.Table) -> pa.Table:
    """Positions of the windows that also occur in a document with a smaller id."""
    hashes = _joined(windows.column("hashes"), np.uint64)
    counts = _lengths(windows.column("hashes"), 8)
    ids = np.repeat(_joined(windows.column("doc_ids"), np.int64), _joined(windows.column("counts"), np.uint32))
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(ordered))))
    later = np.zeros(len(hashes), bool)
    later[order] = ids[order] > smallest
    positions = _joined(windows.column("positions"), np.uint32)
    rows, at = [], 0
    for pack, n in zip(windows.column("pack").to_pylist(), counts.tolist(), strict=True):
        own = positions[at:at + n][later[at:at + n]]
        at += n
        if len(own):
            rows.append((pack, own.tobytes()))
    return _rows(rows, _HIT_FIELDS)


def _kept(key: tuple, docs: pa.Table, later: pa.Table, window: int, layout: bool, schema: pa.Schema) -> pa.Table:
    """Documents without the words that ``later`` windows cover; ``layout``: texts that lose none stay as they are."""
    if not docs.num_rows:
        return schema.empty_table()
    pack = Pack(docs)
    positions = _joined(later.column("positions"), np.uint32).astype(np.int64)
    keep = ~_covered(positions, positions + window, len(pack.codes))
    done = np.concatenate([[0], np.cumsum(keep)])
    words = pa.DictionaryArray.from_arrays(pa.array(pack.codes[keep], pa.int32()), pack.words).dictionary_decode()
    offsets = done[pack.starts]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")
    n_words = np.diff(pack.starts)
    if layout:
        texts = pc.if_else(pa.array(n_words == np.diff(offsets)), pack.docs.column("text").combine_chunks(), texts)
    return pa.table([pack.docs.column("carried"), pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(offsets), pa.int64()),
                     texts], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                   pack_bytes: int = _PACK_BYTES, layout: bool = False) -> DataFrame:
    """All columns but the text of every row, with ``n_words``, ``n_removed`` and ``kept_text`` (kept words, one space between; with
    ``layout`` a text that loses nothing is kept as it is).

    A word goes if it is covered by a window of ``window`` words of its document whose words also start in a document with a smaller
    id. Null texts have no words. A null id counts as larger than all others; rows with equal ids are one position in the
    order and never remove each other's words; repeated rows stay. An empty table gives an empty result. Input columns of the
    names ``n_words``, ``n_removed`` or ``kept_text`` are replaced.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    block = window // 2
    total = docs.select(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    packs = max(buckets, total // pack_bytes + 1)
    own = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept_text")]
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST_ID))).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(*[F.col(c) for c in own]).alias("carried"),
    ).withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs)))

    probes = rows.groupBy("pack").applyInArrow(lambda k, t: _probes(k, t, block, buckets), _PROBES)
    hits = probes.groupBy("bucket").applyInArrow(_hits, _HITS)
    windows = rows.groupBy("pack").cogroup(hits.groupBy("pack")).applyInArrow(
        lambda k, t, h: _windows(k, t, h, window, block, buckets), _WINDOWS)
    later = windows.groupBy("bucket").applyInArrow(_later, _HITS)
    out = f"carried {rows.schema['carried'].dataType.simpleString()}, n_words long, n_removed long, kept_text string"

    def keep(key: tuple, docs: pa.Table, later: pa.Table) -> pa.Table:
        fields = [docs.schema.field("carried"), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()),
                  pa.field("kept_text", pa.string())]
        return _kept(key, docs, later, window, layout, pa.schema(fields))

    kept = rows.groupBy("pack").cogroup(later.groupBy("pack")).applyInArrow(keep, out)
    return kept.select("carried.*", "n_words", "n_removed", "kept_text")
