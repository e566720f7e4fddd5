"""Searches against brute force: recall, exact scores, order, rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aligner.llm import ann, catalog

SCHEMA = "vec_id long, embedding array<float>, label int, part int, score string"


def brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in sorted({int(i) for i in ids if i % 100 == 0}):
        own = x[np.flatnonzero(ids == q)[0]]
        best = {}
        for i, d in zip(ids.tolist(), np.sqrt(((x - own) ** 2).sum(axis=1)).tolist(), strict=True):
            if i != q:
                best[i] = min(d, best.get(i, d))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def ranked(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], SCHEMA)


def test_query_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, wanted = ranked(catalog.QUERIES["op5_neighbours"](spark, sf).collect()), brute(rows)
    assert set(got) == set(wanted)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        assert all(d == pytest.approx(np.sqrt(((vectors[q] - vectors[i]) ** 2).sum()), rel=1e-12) for d, i in found)


def test_clustered_vectors_use_few_parts(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (16, 12)) * 6
    x = (centres[rng.integers(0, 16, 3000)] + rng.normal(0, 1, (3000, 12))).astype(np.float32)
    router = ann.train(x.astype(float), 16, 10, 0.97)
    assert router.probes < 8
    sizes = np.bincount(router.best(x.astype(float), 1)[:, 0], minlength=16)
    assert sizes.max() < 4 * sizes.mean()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, wanted = ranked(ann.search(frame(spark, rows), F.col("vec_id") % 100 == 0, parts=16, block_rows=200).collect()), brute(rows)
    assert sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in wanted.items()) >= 0.9 * 10 * len(wanted)


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(0, 1, (1000, 8))
    parts = ann.balanced_parts(x, ann.neighbour_graph(x, 5), 8)
    assert np.bincount(parts).tolist() == [125] * 8


def test_odd_rows_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(100, same), (0, [1.0, 2.0, 4.0])] + [(i, same) for i in range(101, 160)] + [(130, same)] * 5
    odd = [(200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [nan, 1.0, 1.0]), (600, [inf, 0.0, 0.0]), (700, [1.0, 2.0]),
           (None, same), (800, [])]
    got = ranked(ann.search(frame(spark, rows + odd), F.col("vec_id") % 100 == 0, block_rows=7).collect())
    assert got == brute(rows)
    assert got[100] == [(0.0, i) for i in range(101, 111)]


def test_fewer_candidates_and_no_rows(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert ranked(ann.search(df, F.col("vec_id") % 100 == 0).collect()) == {0: [(pytest.approx(2 ** 0.5), 1)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert ann.search(frame(spark, [(0, None)]), F.col("vec_id") % 100 == 0).collect() == []


def test_parts_with_few_rows_are_filled_up(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0 if i < 6 else -1.0, *rng.normal(0, 0.1, 3).tolist()]) for i in range(60)]
    router = ann.Router(np.zeros(4), np.eye(4), np.zeros(4), np.array([[1.0, 0.0], [0, 0], [0, 0], [0, 0]]), np.array([0.0, 0.5]), 1)
    monkeypatch.setattr(ann, "train", lambda *_: router)
    got = ranked(ann.search(frame(spark, rows), F.col("vec_id") % 100 == 0, parts=2).collect())
    assert len(got[0]) == 10 and got == brute(rows)


def test_the_nearest_row_repeated_many_times(spark):
    rows = [(i, [float(i), 1.0]) for i in range(60)] + [(1, [1.0, 1.0])] * 20 + [(2, [2.5, 1.0]), (2, [1.5, 1.0])]
    got = ranked(ann.search(frame(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows) and [i for _, i in got[0]] == list(range(1, 11))
