import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from aligner.llm import graph, repeats, simhash

SCHEMA = "doc_id long, text string, fp string, pack int, root string"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(fps, np.uint64)
    for k in range(len(array)):
        for m in np.flatnonzero(np.bitwise_count(array ^ array[k]) <= distance):
            a, b = find(k), find(int(m))
            parent[max(a, b)] = min(a, b)
    best = {}
    for k in range(len(fps)):
        best.setdefault(find(k), []).append(ids[k])
    return {k: min(best[find(k)], key=lambda i: (i is None, i)) for k in range(len(fps))}


def texts(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ä", "ÉA", "x y"]
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 50, 400]))]
        for _ in range(3):
            copy = list(base)
            if len(copy) > 100:
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t\n".join(copy))
    return [*out, None, "", " \x0b\n", "one", "ONE", "two words", "A B", "a b"]


def test_components_equal_brute_force(spark):
    rows = list(enumerate(texts(), 1))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, "only here with null id and these very words")]
    df = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    fps = [fingerprint(t) for _, t in rows]
    wanted = brute_components([i for i, _ in rows], fps)
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in got) == sorted(
        (i or 0, f"{fps[k]:016x}", wanted[k] or 0) for k, (i, _) in enumerate(rows))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []
    assert repeats.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("group_rows", [1 << 14, 20])
def test_dense_groups_are_dealt_out_without_loss(spark, group_rows):
    rng = random.Random(1)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.with_components(df, 3, group_rows).collect()}
    assert got == brute_components(list(range(len(fps))), fps)


@pytest.mark.parametrize("rows", [100, 10**9, 4 * 10**10])
def test_every_plan_is_lossless(rows):
    rng = np.random.default_rng(2)
    share = rng.uniform(0.2, 0.8, 64)
    together = np.outer(share, share) * rows
    np.fill_diagonal(together, share * rows)
    plan = simhash.choose_plan(together, rows, 3)
    assert sorted(b for p in plan.parts for b in p) == list(range(64))
    assert sum(plan.thresholds) == 3 - len(plan.parts) + 1
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 1).astype(np.uint64)
        b = a.copy()
        for bit in rng.choice(64, 3, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        met_a = {(i, int(k[0])) for i, k, _ in simhash._keys(a, plan)}
        assert met_a & {(i, int(k[0])) for i, k, _ in simhash._keys(b, plan)}


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    for k in range(1, 6):
        bits[:, 10 * k] = bits[:, 3]
    parts = simhash.group_bits((bits.T @ bits).astype(float), 4000, 4)
    assert any({3, 10, 20, 30, 40, 50} <= set(p) for p in parts)


def test_one_of_each_group_stays(spark):
    long = " ".join(f"word{i}" for i in range(600))
    rows = [(5, long), (3, long), (3, long), (7, long.upper().replace(" ", "\n")), (None, long), (8, "alone here"), (None, "null id only"),
            (9, None), (10, "")]
    df = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], SCHEMA)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(3, long), (8, "alone here"), (0, "null id only"), (9, "")])


def test_components_of_edges(spark):
    edges = [(1, 2), (2, 3), (9, 9), (20, 4), (4, 20), (5, 20), (None, 3)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 20: 4, 5: 4} | {101 + i: 100 for i in range(60)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [10**12 if i is None else i for i, _ in rows]
    first = {}
    for o, w in zip(order, words, strict=True):
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            first[key] = min(o, first.get(key, o))
    out = []
    for (i, _), o, w in zip(rows, order, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < o:
                gone[p:p + window] = [True] * window
        out.append((i or 0, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("window", [6, 7, 50])
def test_repeats_equal_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"p{k}.{i}" for i in range(window + rng.randint(-2, 30))] for k in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, 4)
            text += p[cut:] if rng.random() < 0.7 else [f"own{i}.{rng.randrange(50)}" for _ in range(rng.randint(1, 2 * window))]
        rows.append((rng.randrange(50), rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(None, " ".join(passages[0])), (None, " ".join(passages[0])), (70, None), (71, ""), (72, " \x0b"), (73, "same " * 400), (74, "same " * 300)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in rows], SCHEMA).repartition(5)
    got = repeats.remove_repeats(df, window=window, pack_bytes=400)
    assert set(got.columns) == {"doc_id", "fp", "pack", "root", "n_words", "n_removed", "kept_text"}
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == brute_repeats(rows, window)


def test_layout_of_untouched_texts_stays(spark):
    df = spark.createDataFrame([(1, "a  b\n c"), (2, "x " * 60), (3, "x  " * 60)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in repeats.remove_repeats(df, layout=True).collect()}
    assert got == {1: "a  b\n c", 2: "x " * 60, 3: ""}


def test_repeats_query_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = repeats.remove_repeats(docs.select("doc_id", "text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, 50)
