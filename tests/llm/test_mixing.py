"""Targets against plain water-filling, copies against their contract, rounding in expectation."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from aligner.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int, _units int"


def brute_targets(sizes, share=1.5, weights=(3, 1, 2), most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: most * sizes[s] for s in over}


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = None if i % 11 == 0 else "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", "zz", ""])
        n = rng.choice([0, 1, 2, 5, 40, 300])
        rows.append((i, rng.choice([" ", "\n\t"]).join(["w"] * n) if n else rng.choice([None, "", " \x0b "]), source))
    rows += [(5000, "same words here", "hot")] * 333 + [(None, "null id " * 20, "a"), (None, None, None), (6000, "x", "tiny")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return rows_of(1)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, s, "clash", 3, 9) for i, t, s in rows], SCHEMA).repartition(parts)


def test_mix_meets_its_contract(spark, rows):
    got = mixing.mix(frame(spark, rows), fan_in=16).collect()
    size_of = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size_of, strict=True):
        sizes[s] += n
    wanted = brute_targets(sizes)
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted(
        (i or -1 if i else (-1 if i is None else 0) or -1, s or "", n) for (i, _, s), n in zip(rows, size_of, strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= max(n for (_, _, x), n in zip(rows, size_of, strict=True) if x == s)


def test_mix_does_not_depend_on_the_order_of_rows(spark, rows):
    a, b = (sorted(map(repr, mixing.mix(frame(spark, r, p), fan_in=16).collect())) for r, p in ((rows, 3), (rows[::-1], 7)))
    assert a == b


def test_rounding_keeps_the_expectation(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 7), "hot" if i % 2 else "other") for i in range(40)])
    times = 4
    sums = defaultdict(int)
    for seed in range(times):
        for r in mixing.mix(docs, seed=seed, fan_in=8).collect():
            sums[r.source] += r.copies
            rate = r.target / r.source_size
            assert int(rate) <= r.copies <= int(rate) + 1
    assert sums["hot"] / times / 20 == pytest.approx(1.5, abs=0.6)


def test_empty_and_wordless_tables(spark, rows):
    assert mixing.mix(frame(spark, rows).limit(0)).collect() == []
    got = mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_rows_are_copied_as_mixed(spark, rows):
    docs = frame(spark, rows)
    wanted = defaultdict(int)
    for r in mixing.mix(docs).collect():
        wanted[r.doc_id, r.source, r.hash] += r.copies
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    counted = got.selectExpr("doc_id", "source", "xxhash64(text) h").groupBy("doc_id", "source", "h").count().collect()
    assert {(r.doc_id, r.source, r.h): r["count"] for r in counted} == {k: v for k, v in wanted.items() if v}


def test_position_in_any_order(spark):
    df = spark.range(1000).selectExpr("cast(pmod(id * 7919, 1000) as int) v")
    assert all(r.v == r.p for r in mixing.position(df, [F.asc("v")], "p").collect())


def test_rows_keep_columns_of_any_name(spark):
    rows = [(None, "one two three", None, "h", 7), (1, "one two three", "a", "h", 7), (1, "one two three", "a", "h", 7), (2, None, "a", "h", 7), (3, "", "b", "h", 7),
            (4, "word " * 50_000, "b", "h", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _hash string, _copies int")
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    found = [tuple(r) for r in got.collect()]
    assert found and set(found) <= set(rows) and all(r[3:] == ("h", 7) for r in found)
    assert mixing.mixed_rows(docs.limit(0)).collect() == []
