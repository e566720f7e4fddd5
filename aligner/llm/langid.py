"""Language of a text: averaged embeddings of hashed subwords and a linear softmax, trained by gradient descent, with rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aligner.llm.common import doc_remainder

_HASH_SEED = 23
_ORDERS = (2, 3, 4)
_SLICE = 1 << 18
#: Letters A-Z and a-z in lower case, other ASCII as a blank, bytes of other characters as they are.
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], dtype=np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """``logits`` holds, per hashed subword, its embedding already multiplied by the softmax weights."""

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float


def subwords(text: str, bits: int) -> np.ndarray:
    """Hashed ids of all byte 2-, 3- and 4-grams of a whole text that hold a letter."""
    raw = text.lower().encode()
    b = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    out = []
    for n in _ORDERS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        letters = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ b[k:k + m]) * np.uint32(0x9E3779B1)
            letters |= b[k:k + m] != 32
        out.append((h >> np.uint32(32 - bits))[letters])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _mean_logits(text: str, table: np.ndarray, bits: int) -> np.ndarray:
    """The mean over all subwords of the text, which is cut into slices only to bound the memory."""
    total, n = np.zeros(table.shape[1]), 0
    for i in range(0, max(1, len(text)), _SLICE):
        ids = subwords(text[i:i + _SLICE], bits)
        total += np.bincount(ids, minlength=len(table)) @ table if len(ids) > len(table) else table[ids].sum(axis=0)
        n += len(ids)
    return total / max(n, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], bits: int = 14, width: int = 16, epochs: int = 6, rate: float = 0.5, piece: int = 400,
          pieces: int = 6, precision: float = 0.99, seed: int = 5) -> LanguageModel:
    """Gradient descent on pieces of the texts; every fifth text calibrates the temperature and the level of acceptance."""
    languages = tuple(sorted({lang for _, lang in rows}))
    rng = np.random.default_rng(seed)
    examples: list[tuple[np.ndarray, int, bool]] = []
    for i, (text, lang) in enumerate(rows):
        places = max(1, len(text) - piece)
        starts = rng.choice(places, size=min(places, pieces, 1 + len(text) // piece), replace=False)
        for s in starts:
            ids = subwords(text[s:s + int(rng.integers(20, piece + 1))], bits)
            if len(ids):
                examples.append((ids, languages.index(lang), i % 5 == 0))
    embedding = rng.normal(0, 0.1, (1 << bits, width))
    weights, bias = np.zeros((width, len(languages))), np.zeros(len(languages))
    learned = [e for e in examples if not e[2]]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(learned)):
            ids, label, _ = learned[k]
            hidden = embedding[ids].mean(axis=0)
            wrong = _softmax(hidden @ weights + bias)
            wrong[label] -= 1
            back = weights @ wrong
            weights -= step * np.outer(hidden, wrong)
            bias -= 0.01 * step * wrong
            np.subtract.at(embedding, ids, (step * 8 / len(ids)) * back)
    logits = embedding @ weights
    held = [e for e in examples if e[2]] or learned
    z = np.array([logits[ids].mean(axis=0) + bias for ids, _, _ in held]).reshape(len(held), len(languages))
    y = np.array([label for _, label, _ in held], dtype=int)
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() if len(y) else 0 for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    best = _softmax(z / temperature).max(axis=1) if len(y) else np.zeros(0)
    right = (z.argmax(axis=1) == y) if len(y) else np.zeros(0, bool)
    order = np.argsort(-best)
    kept = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    accept = float(best[order][np.flatnonzero(kept)[-1]]) if kept.any() else 1.0
    return LanguageModel(languages, logits.astype(np.float32), bias, temperature, accept)


def fit(docs: DataFrame, learnable: Column, rows_per_language: int = 300, max_chars: int = 20_000) -> LanguageModel | None:
    """Learns from at most ``rows_per_language`` ids per language, those with the smallest hash, and one text of each.

    Rows without language, letters or id, and texts longer than ``max_chars``, aren't learned from. None if nothing is left.
    """
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                       & (F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("_lang").orderBy("_hash", "_id")
    ids = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").alias("_lang")).distinct().withColumn(
        "_hash", F.xxhash64(F.col("_id"), F.lit(_HASH_SEED)))
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows_per_language).select("_id", "_lang")
    rows = known.select(F.col("doc_id").cast("long").alias("_id"), "text", F.col("lang").alias("_lang")).join(F.broadcast(chosen), ["_id", "_lang"])
    rows = rows.groupBy("_id", "_lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows = sorted((r["_id"], r["text"], r["_lang"]) for r in rows)
    return train([(text, lang) for _, text, lang in rows]) if rows else None


def with_language(docs: DataFrame, mod: int = 5, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every row.

    Learned only from text and language of rows whose id's remainder isn't ``held_out``; a prediction depends on nothing but the whole text.
    ``accepted`` says whether the calibrated ``score`` reaches the level above which at most one in a hundred was wrong. A null text
    or one without a letter is ``und`` with score 0 and not accepted, as is everything if nothing can be learned.
    Repeated rows and null ids stay; extra columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, doc_remainder(F.col("doc_id"), mod) != held_out)

    @F.pandas_udf("struct<lang_pred string, score double, accepted boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        bits = len(model.logits).bit_length() - 1
        table = model.logits.astype(np.float64)
        z = np.array([_mean_logits(t or "", table, bits) for t in texts]).reshape(-1, len(model.languages)) + model.bias
        p = _softmax(z / model.temperature)
        top = p.max(axis=1) if len(p) else np.zeros(0)
        return pd.DataFrame({"lang_pred": [model.languages[k] for k in p.argmax(axis=1)], "score": top, "accepted": top >= model.accept})

    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    text = F.col("text")
    found = nothing if model is None else F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predict(text)).otherwise(nothing)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(doc_remainder(F.col("doc_id"), mod) == held_out, F.lit(False)).alias("held_out"), found.alias("_found"))
    return rows.select("doc_id", "held_out", "_found.lang_pred", "_found.score", "_found.accepted")
