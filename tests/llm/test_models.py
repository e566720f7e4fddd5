"""Quality and language classifiers: held-out accuracy, what may be learned from, odd rows."""

import binascii
import random

import pytest
from pyspark.sql import functions as F

from aligner.llm import catalog, langid, quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, held_out string, _id int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    words = {"en": ["the", "and", "thing", "with"], "de": ["und", "über", "nicht", "schön"], "fr": ["où", "être", "les", "ça"]}
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 80)))
        if i % 4 == 0:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, lang))
    rows += [(300, None, "en"), (301, "", "en"), (302, " \n", None), (303, "12 34 %", "de"), (None, "the and thing", "fr"),
             (304, "über und " * 60000, None), (1, rows[1][1], rows[1][2])]
    return spark.createDataFrame([(i, t, lang, -1.0, "clash", 1) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return corpus.where("doc_id < 240").selectExpr("doc_id", "if(doc_id % 4 = 0, 0, 1) quality", "0 toxic", "'x' _label").unionByName(
        spark.createDataFrame([(5, None, 0, "x"), (None, 1, 0, "x"), (7, 3, 0, "x"), (9999, 1, 0, "x")], "doc_id long, quality int, toxic int, _label string"))


def remainder(i, mod):
    return binascii.crc32(str(i).encode()) % mod


def test_quality_of_odd_rows(spark, corpus, labels):
    got = quality.with_quality(corpus, labels).collect()
    assert len(got) == corpus.count()
    by = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and remainder(r.doc_id, 4) == 2)
        by.setdefault(r.text or "", set()).add(round(r.score, 12))
    assert all(len(v) == 1 for v in by.values())  # a score depends on the text only
    wrong = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.predicted != int(r.doc_id % 4 != 0)]
    assert len(wrong) < 12


def test_quality_never_learns_held_out_labels(spark, corpus, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    learnable = quality.doc_remainder(F.col("doc_id"), 4) != 2
    assert quality.fit(corpus, labels, learnable) == quality.fit(corpus, flipped, learnable)


def test_quality_without_labels_or_rows(spark, corpus, labels):
    assert {r.score for r in quality.with_quality(corpus, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.with_quality(corpus, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.with_quality(corpus.limit(0), labels).collect() == []


def test_quality_held_out_accuracy(spark):
    scored = catalog.QUERIES["op7_quality"](spark, SF)
    known = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")
    rows = scored.where("held_out").join(known, "doc_id").select("quality", "predicted").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2


def test_language_of_odd_rows(spark, corpus):
    got = langid.with_language(corpus).collect()
    assert len(got) == corpus.count()
    by_id = {r.doc_id: r for r in got}
    for i in (300, 301, 302, 303):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].accepted) == ("und", 0.0, False)
    assert by_id[304].lang_pred == "de" and by_id[None].lang_pred == "en" and by_id[None].held_out is False
    assert all(r.held_out == (r.doc_id is not None and remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    wanted = {i: ["en", "de", "fr"][i % 3] for i in range(240)}
    assert sum(by_id[i].lang_pred != lang for i, lang in wanted.items()) < 5


def test_language_never_learns_held_out_rows(spark, corpus):
    flipped = corpus.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang")))
    learnable = langid.doc_remainder(F.col("doc_id"), 5) != 0
    a, b = langid.fit(corpus, learnable), langid.fit(flipped, learnable)
    assert a.languages == b.languages == ("de", "en", "fr") and (a.logits == b.logits).all()


def test_language_without_rows(spark, corpus):
    assert langid.with_language(corpus.limit(0)).collect() == []
    alone = langid.with_language(corpus.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    got = catalog.QUERIES["op10_language"](spark, SF).where("held_out")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = [r.lang == r.lang_pred for r in got.join(docs, "doc_id").collect()]
    assert sum(right) / len(right) > 0.97


def test_one_text_of_a_repeated_id_reaches_the_driver(spark, corpus, labels, monkeypatch):
    plain = corpus.where("doc_id < 240").dropDuplicates(["doc_id"])
    docs = plain.unionByName(plain.where("doc_id in (2, 3)").selectExpr(
        "doc_id", "explode(transform(sequence(1, 50), n -> concat(text, ' ', n))) text", "lang", "score", "held_out", "_id"))
    seen = []
    monkeypatch.setattr(quality, "_train", lambda rows, *_: seen.append(len(rows)))
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(len(rows)))
    known = labels.where("doc_id < 240 and quality in (0, 1)").dropDuplicates(["doc_id"])
    quality.fit(docs, known, F.lit(True))
    langid.fit(docs, F.lit(True))
    assert seen == [240, 240]
