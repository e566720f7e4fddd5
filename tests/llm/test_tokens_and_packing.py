import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aligner.llm import catalog, packing, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens int, length string"
ODD = [
    (1, "plain words, and more"), (1, "plain words, and more"), (2, None), (3, ""), (None, "null id"), (4, " \t\n\x0b "),
    (5, "<s> </s> <unk> <|endoftext|> it's İ ΣΑΣ é ☃ ␞ ␞␞ x␞y"), (6, "a" * 3000), (7, "日本語" * 400 + "\n" * 99), (8, "word " * 5000),
    (9, "́combining \U0001F600\U000E0100"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in ODD], SCHEMA)


def test_counts_equal_the_library(spark, odd):
    counter = tokens.SplicingCounter(PIECES)
    got = tokens.token_counts(odd, PIECES, chunk_chars=64, overlap_chars=4).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i or 0, len((t or "").encode()), n := len(counter.model.encode(t or "")), n > 4096) for i, t in ODD)


def test_counts_of_no_rows(spark, odd):
    assert tokens.token_counts(odd.limit(0), PIECES).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab cde\n▁.é日😀<>/s01 "), min_size=40, max_size=400), st.integers(8, 60), st.integers(1, 8))
def test_spliced_chunks_equal_one_encoding(text, chunk, overlap):
    counter = COUNTERS.setdefault((chunk, overlap), None) or tokens.SplicingCounter(PIECES, chunk, overlap)
    COUNTERS[chunk, overlap] = counter
    assert counter.spliced(text) == len(counter.model.encode(text))


COUNTERS: dict = {}


def test_query_counts_whole_texts(spark):
    counter = tokens.SplicingCounter(PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = catalog.QUERIES["op2_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert all(r.n_tokens == len(counter.model.encode(docs[r.doc_id] or "")) for r in got)


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def check_packing(pieces, ids_by_doc, capacity):
    """Every id in exactly one piece, windows gapless from 0 and within capacity, checksums of the library's ids."""
    windows, covered = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = [ids for ids in ids_by_doc[p.doc_id] if len(ids) == p.doc_tokens
               and zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
        assert own and p.length > 0
        windows[p.sequence_id].append((p.offset, p.length))
        covered[p.doc_id].append(p.length)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert {d: sum(v) for d, v in covered.items()} == {d: sum(map(len, v)) for d, v in ids_by_doc.items()}
    return windows


def test_packing_odd_rows(spark, odd):
    ids = defaultdict(list)
    for (i, _), own in zip(ODD, expected_ids([t for _, t in ODD]), strict=True):
        ids[i].append(own)
    got = packing.pack_texts(odd, WORDS, capacity=64).collect()
    check_packing(got, ids, 64)
    assert packing.pack_texts(odd.limit(0), WORDS).collect() == []
    assert [(p.start, p.length, p.doc_tokens) for p in got if p.doc_id in (2, 3, 4)] == [(0, 1, 1)] * 3


def test_packing_query_has_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [own] for r, own in zip(docs, expected_ids([r.text for r in docs]), strict=True)}
    got = catalog.QUERIES["op6_packing"](spark, "/root/testdata/sf0.01").collect()
    windows = check_packing(got, ids, 4096)
    total = sum(p.length for p in got)
    assert total / (4096 * len(windows)) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 120))
def test_windows_hold_every_item_once(sizes, capacity):
    parts = packing.balanced_windows(sizes, capacity)
    assert sorted(i for part in parts for i in part) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in part) <= capacity for part in parts)


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 500, 400).tolist()
    sums = [sum(sizes[i] for i in part) for part in packing.difference(sizes, 24)]
    assert max(sums) - min(sums) <= 5
    assert packing.difference([], 3) == [[], [], []]
    assert sorted(map(len, packing.difference([4, 4], 3))) == [0, 1, 1]


def test_words_and_their_punctuation_encode_like_whole_words():
    rng = random.Random(3)
    letters = ["a", "B", "é", "É", "ß", "ı", "İ", "H\u0331", "e\u0301", "ª", "»", "日", "'s", "'", "9", ".", ",", "!?", "\u00a0", "\u0300", "\u1e9e", "ǆ"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(4000)] + [".", "...", "a.", "É!", "H\u0331."]
    encoder = packing.WordEncoder(WORDS)
    ids, begins = encoder.encode(pa.array([*words, "", None, "  ", *words]), 2)
    for k, text in enumerate([*words, "", "", "  ", *words]):
        assert ids[begins[k]:begins[k + 1]].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_runs_are_looked_up_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    values, begin, length = np.arange(1000, dtype=np.uint32), rng.integers(0, 900, 200_000), rng.integers(0, 40, 200_000)
    tracemalloc.start()
    flat, _ = packing._spans(values, begin, length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(flat, np.concatenate([values[b:b + n] for b, n in zip(begin, length, strict=True)]))
    assert peak < 3 * flat.nbytes
