"""Near-duplicates by Jaccard similarity against the brute force over all pairs."""

import random
import re
from itertools import combinations
from pathlib import Path

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest

from aligner.llm import minhash
from aligner.session import release, shared_dir, stage

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each group that is connected by pairs of Jaccard similarity 0.8 or more."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if (not a and not b) or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted(i for i in root if find(i) == i)


def texts():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    out = ["", None, " \n", "one two", "One two", "one two three"]
    for n in (8, 60, 400):
        for _ in range(6):
            words = [rng.choice(vocabulary) for _ in range(n)]
            out.append(" ".join(words))
            for step in range(8):  # a chain: each copy changes words of the one before
                words[rng.randrange(n)] = rng.choice(vocabulary)
                if n == 400:
                    words[rng.randrange(n)] = rng.choice(vocabulary)
                out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [1 << 12, 3])
def test_one_of_each_group(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "_BLOCK", block)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows] + [(0, "", "en", "x", 0)], SCHEMA)
    assert sorted(r.doc_id for r in minhash.one_of_each(docs).collect()) == brute(rows)
    assert minhash.one_of_each(docs.limit(0)).collect() == []


def test_stage_keeps_one_of_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_that_hardly_differ_from_the_threshold(spark):
    """Copies of one text that are about 0.8 alike: some pairs are links, most are refuted."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.choice([2, 6, 7, 8])):
            own[rng.randrange(300)] = f"new{rng.random()}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], SCHEMA)
    wanted = brute(rows)
    assert 10 < len(wanted) < 150
    got = sorted(r.doc_id for r in minhash.one_of_each(docs).collect())
    assert abs(len(got) - len(wanted)) <= 1 and set(wanted) <= set(got)


def test_proposals_are_few_and_name_the_most_similar():
    rng = np.random.default_rng(0)
    signatures = rng.integers(0, 255, (500, 200), dtype=np.uint8)
    signatures[1:400] = signatures[0]
    signatures[1:400, :10] = rng.integers(0, 255, (399, 10))
    nodes, sizes = np.arange(500), np.full(500, 100)
    u, v, more = minhash.proposals(nodes, sizes, signatures, nodes, 0.8, 0, 1, True)
    assert len(u) == 399 and set(u.tolist()) == {0} and more
    u, v, more = minhash.proposals(nodes, sizes, signatures, np.where(nodes < 400, 0, nodes), 0.8, 0, 4)
    assert len(u) == 0 and not more


def test_null_ids_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{k % 5000}x{k}" for k in range(60_000))
    rows = [(None, "one two three four five six"), (3, "one two three four five six"), (None, "alone with a null id"), (4, long), (5, long + " end"), (5, long + " end")]
    docs = spark.createDataFrame([(i, t, "en", "x", 0, "h", 1, 2) for i, t in rows], SCHEMA + ", hash string, node int, id int")
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.hash, r.node, r.id) for r in got.collect()) == [(0, "h", 1, 2), (3, "h", 1, 2), (4, "h", 1, 2)]


def test_a_pair_is_proposed_in_the_first_bucket_it_shares():
    signatures = np.zeros((6, 200), np.uint8)
    nodes, sizes = np.arange(6), np.full(6, 100)
    before = np.arange(12).reshape(6, 2)
    before[[1, 2], 0] = 50
    before[[3, 4], 1] = 60
    u, v, more = minhash.proposals(nodes, sizes, signatures, nodes, 0.8, 0, 5, before=before)
    pairs = {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}
    assert pairs == set(combinations(range(6), 2)) - {(1, 2), (3, 4)} and not more
    assert len(minhash.proposals(nodes, sizes, signatures, nodes, 0.8, 0, 5, before=before * 0)[0]) == 0


def test_near_fingerprints_are_links_without_bands(spark, monkeypatch):
    words = [f"w{i}" for i in range(600)]
    copies = [[*words[:k], "changed", *words[k + 1:]] for k in range(0, 600, 10)]
    texts_of = [" ".join(w) for w in (words, *copies)]
    own = [minhash.fingerprint_of(s) for s in minhash.shingle_sets(pa.array(texts_of), 5)]
    near = [i for i, fp in enumerate(own) if i and (fp ^ own[0]).bit_count() <= 3]
    assert len(near) > 3
    rows = [(i, texts_of[i]) for i in [0, *near]] + [(100, " ".join(words[:300]))]  # half of a text is no near copy
    members = minhash._members
    monkeypatch.setattr(minhash, "_members", lambda nodes: members(nodes).limit(0))
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()) == [0, 100]


def test_little_stays_staged(spark):
    folder = Path(shared_dir(spark)) / "aligner"
    staged = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), staged()
    out = stage(pipeline.near_dedup(spark, docs, SF), "out")
    left = {name.rsplit("-", 1)[0] for name in staged() - before}
    assert "out" in left and not left & {"signatures", "nodes", "shingles", "members", "unfinished", "proposed", "alike", "near"}
    release(out)
    before = staged()
    assert pipeline.run(spark, SF).count() > 0
    left = {name.rsplit("-", 1)[0] for name in staged() - before}
    assert "mixing" in left and not left & {"quality", "near_dedup", "substring_dedup"}
