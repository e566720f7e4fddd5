"""Exact duplicates by a tree-merge of sorted digest runs.

Every task sorts what it has read into a run of entries (digest, how many rows, the row that stays) and combines equal digests. Runs
then meet in rounds: in a round each partition exchanges with seven others, three steps of a binomial tree at once, and keeps the entries
whose digests carry its own three bits. The up to eight runs that reach a partition are merged into one, so a text that a third of all
rows share is a handful of entries from the first round on. After the last round every digest lies in one partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import byte_slices, shuffle_partitions
from aligner.session import stage

_SLICE_BYTES = 4 << 20
#: Entries that a task sorts at a time.
_RUN_ROWS = 1 << 17
#: Bits of the digest that a round deals by.
_ROUND_BITS = 3
#: Groups with more than this share of all rows are sent to every task; there are fewer than one over the share of them.
_HOT_SHARE = 1e-4
_NO_ID = np.iinfo(np.int64).min

_ROW = "doc_id long, tag long, key long, sha binary"
_ENTRY = "part int, key long, sha binary, keep_id long, keep_tag long, n long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, key, sha`` of every row: a number of its own, SHA-256 of its normalised text and the first 64 bits of that."""

    def of(batches):
        from pyspark import TaskContext

        tag = TaskContext.get().partitionId() << 36
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            texts = pc.ascii_lower(pc.fill_null(part.column("text"), ""))  # A-Z only
            sha = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
            keys = np.frombuffer(b"".join(sha), ">i8").reshape(-1, 4)[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.arange(tag, tag + len(sha))), pa.array(keys), pa.array(sha, pa.binary())],
                ["doc_id", "tag", "key", "sha"])
            tag += len(sha)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, _ROW)


def merged(part: np.ndarray, key: np.ndarray, sha: np.ndarray, keep_id: np.ndarray, keep_tag: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """One sorted run of the entries of several: equal digests become one entry. Those with equal ``key`` count as equal only if
    all 256 bits are. The row with the largest id stays, of equal ids the one with the smallest tag."""
    words = np.frombuffer(sha.tobytes(), ">u8").reshape(-1, 4)
    order = np.lexsort((keep_tag, ~keep_id, words[:, 3], words[:, 2], words[:, 1], words[:, 0], part))
    part, words = part[order], words[order]
    first = np.ones(len(order), bool)
    first[1:] = (part[1:] != part[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    return [part[starts], key[order][starts], sha[order][starts], keep_id[order][starts], keep_tag[order][starts],
            np.add.reduceat(n[order], starts) if len(starts) else n[:0]]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    part, key, sha, keep_id, keep_tag, n = batch.columns
    raw = np.frombuffer(b"".join(sha.to_pylist()), "V32")
    return [part.to_numpy(), key.to_numpy(), raw, keep_id.to_numpy(), keep_tag.to_numpy(), n.to_numpy()]


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    part, key, sha, keep_id, keep_tag, n = columns
    binary = pa.Array.from_buffers(pa.binary(), len(sha), [
        None, pa.py_buffer(np.arange(len(sha) + 1, dtype=np.int32) * 32), pa.py_buffer(np.ascontiguousarray(sha).tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array(part.astype(np.int32)), pa.array(key), binary, pa.array(keep_id), pa.array(keep_tag), pa.array(n)],
        ["part", "key", "sha", "keep_id", "keep_tag", "n"])


def _first_runs(parts: int):
    """Rows as sorted runs of the task that read them."""

    def of(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        own, held, rows = TaskContext.get().partitionId() % parts, [], 0
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy()
            sha = np.frombuffer(b"".join(batch.column("sha").to_pylist()), "V32")
            held.append([np.full(len(ids), own), batch.column("key").to_numpy(), sha, ids, batch.column("tag").to_numpy(),
                         np.ones(len(ids), np.int64)])
            rows += len(ids)
            if rows >= _RUN_ROWS:
                yield _batch(merged(*(np.concatenate(c) for c in zip(*held, strict=True))))
                held, rows = [], 0
        if rows:
            yield _batch(merged(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return of


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that Spark has merged by (part, key) become one without repeats; what could go on in the next batch is carried over."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_columns(batch))
        part, key = held[-1][0], held[-1][1]
        last = np.flatnonzero((part != part[-1]) | (key != key[-1]))
        if not len(last):  # one key so far: combine what is held, which leaves one entry per digest
            held = [merged(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            continue
        cut = last[-1] + 1
        closed = [*held[:-1], [c[:cut] for c in held[-1]]]
        held = [[c[cut:] for c in held[-1]]]
        yield _batch(merged(*(np.concatenate(c) for c in zip(*closed, strict=True))))
    if held:
        yield _batch(merged(*(np.concatenate(c) for c in zip(*held, strict=True))))


def tree_merged(rows: DataFrame, parts: int) -> DataFrame:
    """``key, sha, keep_id, keep_tag, n`` of every digest of ``rows``, in binomial rounds over ``parts`` (a power of two) partitions."""
    runs = rows.mapInArrow(_first_runs(parts), _ENTRY)
    bits = parts.bit_length() - 1
    for low in range(0, max(1, bits), _ROUND_BITS):  # a single partition merges its runs as well
        mask = ((1 << min(_ROUND_BITS, bits - low)) - 1) << low
        partner = F.col("part").bitwiseAND(F.lit(parts - 1 - mask)).bitwiseOR(F.col("key").bitwiseAND(F.lit(mask)).cast("int"))
        met = runs.withColumn("part", partner).repartitionById(parts, "part").sortWithinPartitions("part", "key")
        runs = met.mapInArrow(_merge_sorted, _ENTRY)
    return runs.drop("part")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Texts are equal if they are identical after lower-casing A-Z; a null text counts as empty, and all empty texts are one group. Of a
    group the row with the largest id stays; null ids stay only in a group without others (``keep_id`` is null then). Exactly one
    row of a group has ``kept``, also where rows repeat. ``group_size`` counts rows. Whole texts are hashed, however long. Other
    columns are ignored; an empty table gives an empty result. ``parts`` partitions exchange runs (default: the shuffle partitions,
    rounded up to a power of two).
    """
    spark = docs.sparkSession
    parts = 1 << ((parts or shuffle_partitions(spark)) - 1).bit_length()
    rows = stage(digests(docs, id_col, text_col), "digests")
    groups = stage(tree_merged(rows, parts), "groups")
    counted = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(max(1.0, counted * _HOT_SHARE))
    verdict = groups.select(F.col("sha").alias("_sha"), "keep_id", "keep_tag", F.col("n").alias("group_size"), hot.alias("_hot"))
    same = F.col("sha") == F.col("_sha")
    few = F.broadcast(verdict.where("_hot"))  # fewer than 1 / _HOT_SHARE rows
    alone = verdict.where("not _hot").drop("_hot")
    judged = rows.join(few, same, "inner").drop("_hot").unionByName(rows.join(few, same, "left_anti").join(alone, same))
    return judged.select(
        "doc_id", F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")).alias("keep_id"), "group_size",
        (F.col("tag") == F.col("keep_tag")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
