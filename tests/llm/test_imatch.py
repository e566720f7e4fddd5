"""I-Match fingerprints: edited texts exactly, entries against a plain computation, likeness."""

import hashlib

import pytest
from pyspark.sql import functions as F

from aligner.llm import catalog, imatch

SCHEMA = "doc_id long, text string, fingerprint string, lexicon string, near_next int"


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "x", 1) for i, t in rows], SCHEMA)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = catalog.QUERIES["op4_imatch"](spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == expected(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)
    prints = {r.doc_id: r.fingerprint for r in got}
    order = sorted(prints, reverse=True)
    for r in got:
        if prints[r.doc_id] == prints[order[(order.index(r.doc_id) + 1) % len(order)]]:
            assert r.near_next == 1.0


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n "), (2, "é😀x yz wörd and more"), (1, "a b c d e f g h"), (-7, "x"), (10**15, "far away id " * 50), (0, "Σ")]
    got = imatch.with_edits(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == expected(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].fingerprint == by_id[4].fingerprint == by_id[3].fingerprint == "-" * 256
    assert by_id[5].near_next == 1.0 and by_id[3].near_next == 0.0
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 256 for r in got)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "some text here " * 9)] * 3 + [(None, "null id text"), (2, "other words there " * 5)]
    got = imatch.with_edits(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    follows = [r for r in got if r.doc_id is None]
    text, after = "null id text", "other words there " * 5  # last by descending id; the first follows
    assert follows[0].edited_sha256 == hashlib.sha256((text[:6] + after[:6]).encode()).hexdigest()
    assert imatch.with_edits(frame(spark, rows).limit(0)).collect() == []
    alone = imatch.with_edits(frame(spark, [(1, "abcd")])).first()
    assert (alone.edited_sha256, alone.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (0.3, 0.7)])
def test_entries_equal_a_plain_computation(spark, low, high):
    rows = [(i, " ".join(f"W{(i * k) % 23}" for k in range(1, 2 + i % 9))) for i in range(60)]
    df = frame(spark, rows).select("doc_id", "text")
    words = imatch.lexicon(df.select("text"), low, high)
    got = {r.doc_id: r.e for r in imatch.fingerprinted(df, "text", words, 8, "e").collect()}
    terms = {i: set(t.lower().split()) for i, t in rows}
    held = {w: sum(w in t for t in terms.values()) for t in terms.values() for w in t}
    band = {w for w, n in held.items() if low * len(rows) <= n <= max(2, high * len(rows))}
    hashes = {r.w: (r.t, r.part, r.rare) for r in spark.createDataFrame([(w,) for w in held], "w string").select(
        "w", F.xxhash64("w").alias("t")).select("w", "t", F.pmod(F.xxhash64("t", F.lit(101)), F.lit(8)).alias("part"),
                                                F.xxhash64("t", F.lit(202)).alias("rare")).collect()}
    chains = {}
    for i, own in terms.items():
        used = (own & band) or own
        chains[i] = {}
        for part in range(8):
            here = [(hashes[w][0], (hashes[w][2] & -hashes[w][2]).bit_length()) for w in used if hashes[w][1] == part]
            if here:
                rarest = max(level for _, level in here)
                chains[i][part] = tuple(sorted(t for t, level in here if level == rarest))
    seen = {}
    for i, entries in got.items():
        assert [e >> 32 for e in entries] == sorted(chains[i])
        for e in entries:
            chain = chains[i][e >> 32]
            assert seen.setdefault((e >> 32, chain), e) == e  # the same terms give the same entry ...
    assert len(set(seen.values())) == len(seen)  # ... and others another
