"""Hard negatives against the brute force over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aligner.llm import catalog, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, tile int, slots string, score string"


def brute(rows):
    """Plain Python integers throughout."""
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = (label, [math.floor(256 * float(c)) for c in v])
        own[i] = min(x, own.get(i, x))
    out = []
    for a, (label, v) in own.items():
        if a % 100:
            continue
        scores = sorted((-sum(c * d for c, d in zip(v, x, strict=True)), i, y) for i, (y, x) in own.items() if i != a)
        for p, pid, _ in [s for s in scores if s[2] == label][:5]:
            fit = [(n, i) for n, i, y in scores if y != label and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, pid, rank, i, -p, -n) for rank, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, "", "") for i, label, v in rows], SCHEMA)


def mined(spark, rows, **how):
    return rows_of(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0, **how))


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(0, 0.3, (n, dim))).astype(np.float32)
    return [(i, int(rng.integers(0, labels)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize(("dim", "tile_rows", "block_rows"), [(8, 8192, 8192), (5, 300, 100), (1, 200, 200)])
def test_rows_equal_brute_force(spark, monkeypatch, dim, tile_rows, block_rows):
    monkeypatch.setattr(negatives, "_QUERY_ROWS", 9)
    rows = clustered(2500, dim, dim)
    assert mined(spark, rows, tile_rows=tile_rows, block_rows=block_rows) == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = rows_of(catalog.QUERIES["op11_hard_negatives"](spark, sf))
    assert got and got == brute(rows)


def test_odd_rows_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), same) for i in range(150)] + [(i, 5, same) for i in range(150, 400)] + [(100, 9, same)] * 4
    rows += [(i, 6, [1.0, 2.0, rng.choice([2.5, 2.0, -9.0])]) for i in range(400, 700)] + [rows[3]] * 6 + [(401, 2, [9.0, 9.0, 9.0])]
    odd = [(900, 1, None), (1000, None, same), (1100, 1, [1.0, None, 2.0]), (1200, 1, [nan, 1.0, 1.0]), (1300, 1, [inf, 0.0, 0.0]),
           (None, 1, same), (1400, 1, [])]
    got = mined(spark, rows + odd, block_rows=64)
    assert got and got == brute(rows + odd)
    other = [(1500, 1, [1.0, 2.0]), (1600, 1, [3e37, 0.0, 0.0])]  # another dimension, too large
    assert mined(spark, rows + other, block_rows=64) == got


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, [float(np.float32(rng.uniform(-1, 1) * 350_000)) for _ in range(6)]) for i in range(260)]
    got = mined(spark, rows)
    assert got and got == brute(rows) and max(r[4] for r in got) > 2 ** 53


def test_negative_scores_and_no_rows(spark):
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [0.0]), (2, 2, [0.0])]) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(0, 1, [1.0])]) == [] and mined(spark, [(0, None, None)]) == []
    assert negatives.hard_negatives(frame(spark, [(0, 1, [1.0])]).limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_boxes_prune_clustered_rows():
    rng = np.random.default_rng(0)
    centres = np.array([[1000, 0, 0, 0], [0, 1000, 0, 0], [0, 0, 1000, 0], [0, 0, 0, 1000]])
    x = np.floor(centres[rng.integers(0, 4, 8000)] + rng.normal(0, 60, (8000, 4)))
    tree = negatives.build(x, np.arange(8000), np.zeros(8000, np.int64))
    q = centres[:1].astype(float)
    leaves, nodes = negatives.intervals(q, tree.leaf_low, tree.leaf_high), negatives.intervals(q, tree.node_low, tree.node_high)
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ other

    seen = negatives.Tree(tree.x.view(Counted), *[getattr(tree, f) for f in list(negatives.Tree.__dataclass_fields__)[1:]])
    (scores, _), = negatives.search_tree(seen, q[0], np.ones(8000, bool), (leaves[0][0], leaves[1][0], nodes[0][0], nodes[1][0]),
                                         np.array([-(1 << 62)]), np.array([1 << 62]), 5)
    assert scores.tolist() == sorted((x @ q[0]).tolist(), reverse=True)[:5] and sum(scored) < 800
