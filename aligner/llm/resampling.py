"""Importance resampling towards a target distribution over hashed word features.

Features of the source and of the target are counted per bucket; a bucket's gain is an integer logarithm of how much more often the target
has it. The gains are one array of fixed length that every task scores its texts by. Adding Gumbel noise and keeping the highest scores
draws without replacement in proportion to the weights. The cutoff isn't found by sorting the table: a quantile sketch brackets it, exact
counts outside the bracket prove that it lies inside (or widen the bracket), and only the bracket's rows are sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import byte_slices, shuffle_partitions, split_words
from aligner.session import stage

_SLICE_BYTES = 4 << 20
#: Bytes of words stay, A-Z as a-z; all others part words (fixed by the contract: ASCII letters and digits, and whatever isn't ASCII).
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Share of the rows on either side of the wanted place that the first bracket takes in, and its growth.
_BRACKET, _WIDEN = 0.002, 8.0
_SKETCH_ACCURACY = 10_000


def words_only(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and every byte outside words as a space."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    clean = (data.to_pybytes() if data is not None else b"").translate(_WORD_BYTES)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(clean)], offset=texts.offset)


def features_of(texts: pa.Array, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, where each text's begin, words of each text): features are the runs of 1 to ``most`` words."""
    words, codes, starts = split_words(words_only(texts))
    raw = [w.encode() for w in words.to_pylist()]
    counts = np.diff(starts)
    own = np.repeat(np.arange(len(counts)), counts)
    text, bucket = [own], [np.array([zlib.crc32(w) % buckets for w in raw] or [0], np.int64)[codes]]
    for k in range(2, most + 1):
        at = np.flatnonzero(own[k - 1:] == own[:len(own) - k + 1]) if len(own) >= k else np.zeros(0, np.int64)
        runs, place = np.unique(np.stack([codes[at + i] for i in range(k)], axis=1).reshape(-1, k), axis=0, return_inverse=True)
        of_run = np.array([zlib.crc32(b" ".join(raw[c] for c in run)) % buckets for run in runs] or [0], np.int64)
        text.append(own[at])
        bucket.append(of_run[place.ravel()])
    text, bucket = np.concatenate(text), np.concatenate(bucket)
    order = np.argsort(text, kind="stable")
    return bucket[order], np.searchsorted(text[order], np.arange(len(counts) + 1)), counts


def bucket_counts(docs: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """Features of all texts per bucket; every task sends at most one row per bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            total += np.bincount(features_of(part.column("text"), most, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    buckets = len(source)
    above = (target + 1).astype(float) * float(source.sum() + buckets)
    below = (source + 1).astype(float) * float(target.sum() + buckets)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def noise(doc_ids: list[int | None], seed: int) -> np.ndarray:
    """Integer Gumbel noise of an id; a null id reads as an empty text."""
    h = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in doc_ids]
    return np.floor(-1000 * np.log(-np.log((np.array(h, float) + 0.5) / 4294967296))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, most: int, seed: int) -> DataFrame:
    """``doc_id, tag, n_words, n_features, weight, score`` of every row; ``tag`` is a number of its own."""

    def of(batches):
        from pyspark import TaskContext

        tag = TaskContext.get().partitionId() << 36
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            bucket, starts, words = features_of(part.column("text"), most, len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            weight = sums[starts[1:]] - sums[starts[:-1]]
            score = weight + noise(part.column("doc_id").to_pylist(), seed)
            columns = [part.column("doc_id"), np.arange(tag, tag + len(words)), words, np.diff(starts), weight, score]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns],
                                             ["doc_id", "tag", "n_words", "n_features", "weight", "score"])
            tag += len(words)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "doc_id long, tag long, n_words long, n_features long, weight long, score long")


_ORDER = [F.desc, F.asc_nulls_last, F.asc]
_ORDER_COLUMNS = ["score", "doc_id", "tag"]


def _ordered() -> list[Column]:
    return [how(c) for how, c in zip(_ORDER, _ORDER_COLUMNS, strict=True)]


def places(rows: DataFrame) -> DataFrame:
    """``rows`` with their 1-based ``place`` by falling score, then id (nulls last), then tag.

    Rows are dealt out by range and sorted per task; one number per task is all that is added up across them.
    """
    spark = rows.sparkSession

    def number(batches):
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = np.arange(done + 1, done + 1 + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), task, np.int32)), pa.array(at)],
                                             [*batch.schema.names, "_task", "_at"])
            done += batch.num_rows

    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *_ordered()).sortWithinPartitions(*_ordered())
    numbered = stage(dealt.mapInArrow(number, f"{kinds}, _task int, _at long"), "places")
    before, total = {}, 0
    for r in sorted(numbered.groupBy("_task").count().collect()):  # one row per task
        before[r["_task"]] = total
        total += r["count"]
    offsets = spark.createDataFrame(list(before.items()), "_task int, _before long")
    return numbered.join(F.broadcast(offsets), "_task").withColumn("place", F.col("_at") + F.col("_before")).drop("_task", "_at", "_before")


@dataclass(frozen=True)
class Cutoff:
    """The last row that is drawn, and how many rows the bracket held that was sorted for it."""

    score: int
    doc_id: int | None
    tag: int
    sorted_rows: int


def find_cutoff(rows: DataFrame, wanted: int, total: int, bracket: float = _BRACKET) -> Cutoff:
    """The row at place ``wanted`` (1 to ``total``, the number of ``rows``)."""
    spread = bracket
    while True:
        shares = [max(0.0, 1 - wanted / total - spread), min(1.0, 1 - wanted / total + spread)]
        low, high = rows.agg(F.percentile_approx("score", shares, _SKETCH_ACCURACY)).first()[0]
        if shares[0] == 0:
            low = None
        if shares[1] == 1:
            high = None
        above = F.col("score") > F.lit(high) if high is not None else F.lit(False)
        inside = ~above & (F.col("score") >= F.lit(low) if low is not None else F.lit(True))
        n_above, n_inside = rows.agg(F.count_if(above), F.count_if(inside)).first()
        if n_above < wanted <= n_above + n_inside:
            break
        spread = max(spread * _WIDEN, 1e-4)  # in the end the bracket is the whole table
    found = places(rows.where(inside).select(*_ORDER_COLUMNS)).where(F.col("place") == wanted - n_above).first()
    return Cutoff(found["score"], found["doc_id"], found["tag"], n_inside)


def _drawn(cut: Cutoff) -> Column:
    same = F.col("score") == cut.score
    smaller = F.lit(False) if cut.doc_id is None else F.col("doc_id") < F.lit(cut.doc_id)
    if cut.doc_id is None:
        smaller = F.col("doc_id").isNotNull()
    tied = F.col("doc_id").eqNullSafe(F.lit(cut.doc_id).cast("long")) & (F.col("tag") <= cut.tag)
    return (F.col("score") > cut.score) | (same & F.coalesce(smaller | tied, F.lit(False)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             percent: int = 10, least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024,
             bracket: float = _BRACKET) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` (1, 2, ...) for those drawn, null for the others.

    Drawn are the highest scores among the rows with at least ``least_words`` words, ``percent`` of their number (rounded down), ties to
    smaller ids; null ids come last, and of repeated rows, which count one by one, any may come first. A null or empty text has no
    feature and weight 0. Whole texts are counted and scored. An empty target leaves the smoothed source shares. Extra columns are
    ignored; an empty table gives an empty result.
    """
    source = bucket_counts(docs, text_col, most, buckets)
    gain = gains(source, bucket_counts(target, target_text_col, most, buckets))
    rows = stage(scored(docs, gain, id_col, text_col, most, seed), "scored")
    enough = F.col("n_words") >= least_words
    total = rows.where(enough).count()
    wanted = percent * total // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = enough & _drawn(find_cutoff(rows.where(enough), wanted, total, bracket))
    ranked = places(rows.where(drawn)).select(*out, F.col("place").alias("rank"))
    return ranked.unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
