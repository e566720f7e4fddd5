"""Quality scores from compression: how much better text compresses with a dictionary of good text than with one of bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import doc_remainder

_HASH_SEED = 17


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and a logistic calibration of what they say. ``weights`` is empty if nothing could be learned."""

    good: bytes
    bad: bytes
    chunk: int
    level: int
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_content_size=False))
        return made[0], made[1]


def features(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, chunk: int) -> tuple[float, ...]:
    """What the two dictionaries make of a whole text, cut into chunks that are compressed on their own.

    The normalised size difference of the whole and of its most bad-like chunk, the compressed share of the whole and of
    its most repetitive chunk, and the length.
    """
    raw = text.encode()
    parts = [raw[i:i + chunk] for i in range(0, len(raw), chunk)] or [b""]
    size = np.array([len(p) for p in parts], dtype=float)
    g = np.array([len(good.compress(p)) for p in parts], dtype=float)
    b = np.array([len(bad.compress(p)) for p in parts], dtype=float)
    full = size >= min(64, size.max())  # a short last chunk says little
    difference = (b - g) / (b + g)
    share = np.minimum(g, b) / (size + 16)
    return ((b.sum() - g.sum()) / (b.sum() + g.sum()), difference[full].min(), g.sum() / (size.sum() + 16), share[full].min(),
            float(np.log1p(len(raw))))


def _standardised(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -8, 8)
    return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _dictionary(texts: list[str], size: int, chunk: int) -> bytes:
    parts = [raw[i:i + chunk] for raw in (t.encode() for t in texts) for i in range(0, len(raw), chunk)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return (b"".join(parts)[-size:]).ljust(8, b" ")


def _train(rows: list[tuple[str, int]], counts: dict[int, int], dictionary_bytes: int, chunk: int, level: int) -> CompressionModel:
    """Dictionaries from two thirds of the rows, the calibration from the others, weighted to the labels' true shares."""
    by = {c: [t for t, label in rows if label == c] for c in (0, 1)}
    if min(len(by[0]), len(by[1])) < 3:
        return CompressionModel(b"", b"", chunk, level)
    own = {c: [t for i, t in enumerate(by[c]) if i % 3] for c in by}
    rest = [(t, c) for c in by for i, t in enumerate(by[c]) if i % 3 == 0]
    model = CompressionModel(_dictionary(own[1], dictionary_bytes, chunk), _dictionary(own[0], dictionary_bytes, chunk), chunk, level)
    good, bad = model.compressors()
    x = np.array([features(t, good, bad, chunk) for t, _ in rest])
    y = np.array([c for _, c in rest], dtype=float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _standardised(x, centre, scale)
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1e-3)
    ridge[-1] = 1e-9
    for _ in range(50):  # Newton steps of the weighted logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) / len(y) + ridge * w
        curvature = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z / len(y) + np.diag(ridge)
        step = np.linalg.solve(curvature, gradient)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return CompressionModel(model.good, model.bad, chunk, level, tuple(centre), tuple(scale), tuple(w))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, rows_per_class: int = 1200, max_chars: int = 20_000,
        dictionary_bytes: int = 65_536, chunk: int = 1024, level: int = 3) -> CompressionModel:
    """Learns from at most ``rows_per_class`` rows of each label, those with the smallest hash of their id.

    ``learnable`` is a condition on ``doc_id`` of ``labels``. Rows whose text is null or longer than ``max_chars`` aren't learned from, so what
    reaches the driver is bounded. Null ids and labels other than 0 and 1 are skipped.
    """
    known = labels.where(learnable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).distinct()
    counts = {0: 0, 1: 0} | {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = [known.where(F.col("_label") == c).orderBy(F.xxhash64(F.col("_id"), F.lit(_HASH_SEED)), "_id").limit(rows_per_class)
              for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id").groupBy("_id", "_label").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).collect()  # one text of each id, however often it is repeated
    rows.sort(key=lambda r: (r["_id"], r["text"]))
    return _train([(r["text"], r["_label"]) for r in rows], counts, dictionary_bytes, chunk, level)


def score_of(model: CompressionModel):
    """A column function: the score of a text (null counts as empty), 0.5 if nothing could be learned."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not model.weights:
            return pd.Series(np.full(len(texts), 0.5))
        good, bad = model.compressors()
        x = np.array([features(t or "", good, bad, model.chunk) for t in texts]).reshape(-1, len(model.centre))
        z = _standardised(x, np.array(model.centre), np.array(model.scale)) @ np.array(model.weights)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def with_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 4, held_out: int = 2) -> DataFrame:
    """All columns of every row, with ``held_out``, ``score`` and ``predicted`` (replaced if the input has such columns).

    Labels are learned only from rows whose id's remainder is not ``held_out``; a score depends on nothing but the text. Null and
    empty texts are scored as the empty text, null ids are never learned from and not held out. Repeated rows get equal
    scores. Without learnable labels of both kinds every score is 0.5. An empty table gives an empty result.
    """
    model = fit(docs, labels, doc_remainder(F.col("doc_id"), mod) != held_out)
    scored = docs.withColumn("score", score_of(model)(F.col("text")))
    return scored.withColumns({
        "held_out": F.coalesce(doc_remainder(F.col("doc_id"), mod) == held_out, F.lit(False)),
        "predicted": (F.col("score") >= threshold).cast("int"),
    })


def not_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, mod: int = 4, held_out: int = 2) -> DataFrame:
    """The rows whose score reaches the threshold; all rows if nothing could be learned, since such a classifier rejects nothing.

    Null and empty texts are scored like any other text and stay or go by that; repeated rows stay together, null ids are never learned from. Extra columns
    are kept, an empty table gives an empty result.
    """
    model = fit(docs, labels, doc_remainder(F.col("doc_id"), mod) != held_out)
    return docs.where(score_of(model)(F.col("text")) >= threshold) if model.weights else docs
