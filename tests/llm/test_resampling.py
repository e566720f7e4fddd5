"""Resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aligner.llm import catalog, resampling

SCHEMA = "doc_id long, text string, rank string, score string, tag int, place string"


def features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k:k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target, most=1):
    own = [features(t, most) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x, most)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    out = []
    for (i, _), (words, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[:10 * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def texts():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)] + ["Straße", "日本語", "ÉCLAIR", "x"]
    out = [rng.choice([" ", ", ", "  ", "\x00"]).join(rng.choice(words) for _ in range(rng.choice([0, 3, 19, 20, 21, 120]))) for _ in range(600)]
    return [*out, None, "", "...", "a-b c_d", "one " * 300_000]


@pytest.mark.parametrize("most", [1, 3])
def test_rows_equal_a_plain_computation(spark, most):
    rows = [(i - 50, t) for i, t in enumerate(texts())]
    rows += [rows[7]] * 40 + [(None, rows[9][1]), (None, rows[9][1])]  # repeated rows have equal scores
    target = [t for _, t in rows[:30]] + [None, "", "other words"]
    docs = spark.createDataFrame([(i, t, "r", "s", 1, "p") for i, t in rows], SCHEMA).repartition(5)
    aims = spark.createDataFrame([(t, 1.0) for t in target], "text string, score double")
    assert rows_of(resampling.resample(docs, aims, most=most)) == brute(rows, target, most)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(catalog.QUERIES["op13_resampling"](spark, sf))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == brute(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])


def test_only_the_bracket_is_sorted_and_it_widens(spark):
    rng = random.Random(0)
    scores = [rng.gauss(0, 1000) for _ in range(20_000)]
    df = spark.createDataFrame([(k, k, int(s)) for k, s in enumerate(scores)], "doc_id long, tag long, score long")
    ordered = sorted(((-int(s), k) for k, s in enumerate(scores)))
    for bracket in (0.002, 0.0):  # none at all has to widen, or hits the score itself
        cut = resampling.find_cutoff(df, 2000, len(scores), bracket)
        assert (-cut.score, cut.doc_id) == ordered[1999]
        assert cut.sorted_rows < 0.02 * len(scores)
    for place in (1, len(scores)):
        cut = resampling.find_cutoff(df, place, len(scores))
        assert (-cut.score, cut.doc_id) == ordered[place - 1]
    same = df.withColumn("score", F.lit(5).cast("long"))
    assert resampling.find_cutoff(same, 700, len(scores)).doc_id == 699


def test_a_wrong_sketch_is_widened(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").alias("tag"), F.col("id").alias("score"))
    calls, real = [], F.percentile_approx

    def wrong(column, shares, accuracy):
        calls.append(shares)
        return F.array(F.lit(4990), F.lit(4995)) if len(calls) == 1 else real(column, shares, accuracy)

    monkeypatch.setattr(resampling.F, "percentile_approx", wrong)
    assert resampling.find_cutoff(df, 1000, 5000).doc_id == 4000 and len(calls) == 2


def test_no_rows_and_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    aims = spark.createDataFrame([], "text string")
    assert resampling.resample(none, aims).collect() == []
    few = [(k, "word " * (30 if k < 9 else 5)) for k in range(12)]
    docs = spark.createDataFrame([(i, t, "", "", 0, "") for i, t in few], SCHEMA)
    got = rows_of(resampling.resample(docs, aims))
    assert got == brute(few, []) and all(r[4] is None for r in got)
