"""The pipeline stage by stage, each against the brute force of its own input."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from aligner.llm import quality
from aligner.session import stage
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_near_duplicates import brute_repeats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in pipeline.STAGES:
        out.append((docs := stage(function(spark, docs, SF), name)))
    return [[r.asDict() for r in df.collect()] for df in out]


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def keyed(rows):
    return sorted(tuple(r[c] for c in pipeline.COLUMNS) for r in rows)


def test_order_and_columns(outputs):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "packing"]
    assert all(list(rows[0]) == pipeline.COLUMNS for rows in outputs[:-1])


def test_quality_rejects_what_it_scores_low(spark, documents, outputs):
    scored = quality.with_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in scored.where("predicted = 0").collect()}
    assert 0 < len(rejected) < len(documents) / 3
    assert keyed(outputs[0]) == keyed(r for r in documents if r["doc_id"] not in rejected)


def test_one_document_of_each_group(outputs):
    rows = outputs[0]
    first = set(brute_near([(r["doc_id"], r["text"]) for r in rows]))
    assert keyed(outputs[1]) == keyed(r for r in rows if r["doc_id"] in first)


def test_repeats_go_and_other_texts_stay(outputs):
    before = {r["doc_id"]: r["text"] for r in outputs[1]}
    for (i, _, gone, text), r in zip(brute_repeats(list(before.items()), 50), sorted(outputs[2], key=lambda r: r["doc_id"]), strict=True):
        assert i == r["doc_id"] and r["text"] == (text if gone else before[i]) and r["n_chars"] == len(r["text"])


def test_mix_copies_whole_documents(outputs):
    before = {r["doc_id"]: r for r in outputs[2]}
    copies = defaultdict(int)
    for r in outputs[3]:
        assert r == before[r["doc_id"]]
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in before.items()}
    total = sum(size[i] * n for i, n in copies.items()) / sum(size.values())
    assert total == pytest.approx(1.5, abs=0.1)


def test_packing_covers_every_copy(outputs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, wanted, got = {}, defaultdict(int), defaultdict(int)
    for r in outputs[3]:
        if r["doc_id"] not in ids:
            ids[r["doc_id"]] = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        wanted[r["doc_id"]] += len(ids[r["doc_id"]])
    for p in outputs[4]:
        own = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert zlib.crc32(own.tobytes()) == p["ids_crc32"] and len(own) == p["length"]
        got[p["doc_id"]] += p["length"]
    assert got == wanted
    assert sum(got.values()) / (4096 * len({p["sequence_id"] for p in outputs[4]})) > 0.9


def test_run_gives_the_pieces_of_the_last_stage(spark, outputs):
    assert pipeline.run(spark, SF).count() == len(outputs[4])


def test_empty_documents_pass_through(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("condition", ["false", "quality = 1"])
def test_quality_keeps_all_where_nothing_is_learned(spark, documents, tmp_path, condition):
    spark.read.parquet(f"{SF}/labels.parquet").where(condition).write.parquet(str(tmp_path / "labels.parquet"))
    kept = pipeline.quality_filter(spark, spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path))
    assert keyed(r.asDict() for r in kept.collect()) == keyed(documents)
