"""Exact duplicates against a plain grouping."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from aligner.llm import catalog, exact

SCHEMA = "doc_id long, text string, sha string, n int, tag string, keep_id long"


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        spared = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and not spared
            spared |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def texts(seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(300):
        base = " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 2, 40])))
        out += [rng.choice([base, base.upper(), base + " "])] * rng.choice([1, 1, 2, 5])
    return [*out, *["Hot TEXT"] * 400, None, "", None, "\n", "Ä", "ä", "É1", "É1", "long " * 400_000, "LONG " * 400_000]


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_groups_equal_a_plain_grouping(spark, parts):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    rows += [rows[0], rows[0], (None, "Hot text"), (None, "null id only"), (None, "NULL id only"), (-5, "minus"), (None, "minus")]
    df = spark.createDataFrame([(i, t, "x", 3, "y", 7) for i, t in rows], SCHEMA).repartition(7)
    assert rows_of(exact.exact_duplicates(df, parts=parts)) == brute(rows)


def test_empty_table(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(catalog.QUERIES["op12_exact_dedup"](spark, sf))
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_equal_keys_with_different_digests_stay_apart():
    sha = np.frombuffer(b"".join([b"a" * 8 + bytes([k]) * 24 for k in (2, 1, 2)]), "V32")
    one = np.ones(3, np.int64)
    part, key, found, ids, tags, n = exact.merged(one * 0, one, sha, np.array([4, 5, 6]), np.array([1, 2, 3]), one)
    assert [bytes(x)[-1] for x in found] == [1, 2] and ids.tolist() == [5, 6] and tags.tolist() == [2, 3] and n.tolist() == [1, 2]


def test_sorted_batches_are_merged_across_their_borders():
    sha = np.array([bytes([k]) * 32 for k in (1, 1, 1, 2, 2, 3)], "V32")
    key = np.array([1, 1, 1, 2, 2, 3])
    one = np.ones(6, np.int64)
    whole = [one * 0, key, sha, np.arange(6), np.arange(6), one]
    for cuts in ([1, 4], [2], [1, 2, 3, 4, 5], []):
        parts = np.split(np.arange(6), cuts)
        out = [r for b in exact._merge_sorted(iter([exact._batch([c[p] for c in whole]) for p in parts])) for r in b.to_pylist()]
        assert [(r["key"], r["keep_id"], r["n"]) for r in out] == [(1, 2, 3), (2, 4, 2), (3, 5, 1)]
