"""Best keys in blocks against plain loops, and the share of pairs that are aligned."""

import functools
import random

import numpy as np
import pytest

from aligner.functions.similarity import _edits, edit_distances
from aligner.operators import keysearch


@functools.cache
def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def greedy(left, right):
    free, total = list(right), 0.0
    for w in left:
        if free:
            scores = [1 - plain_edits(w, v) / max(len(w), len(v)) for v in free]
            best = max(scores)
            if best > 0:
                total += best
                free.pop(scores.index(best))
    return total / max(len(left), len(right))


def test_edit_distances_equal_plain_ones():
    rng = random.Random(1)
    a, b = (["".join(rng.choice("abé日\U0001F600") for _ in range(rng.choice([0, 1, 3, 9, 63, 64, 65, 90]))) for _ in range(400)] for _ in range(2))
    wanted = [plain_edits(x, y) for x, y in zip(a, b, strict=True)]
    assert edit_distances(a, b).tolist() == wanted == [_edits(x, y) for x, y in zip(a, b, strict=True)]
    assert len(edit_distances([], [])) == 0


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_best_keys_equal_plain_loops(threshold):
    rng = random.Random(5)
    vocabulary = ["steel", "stel", "steal", "cold", "colt", "rolled", "roled", "sheet", "sheets", "a", "ab", "of", "x1", "x12", "12", "z" * 300]
    keys = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 13))] for _ in range(150)]  # more words than the texts, and fewer
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 12))] for _ in range(60)] + [list(k) for k in keys[:9]]
    numbers = np.array(rng.sample(range(1000), len(keys)))
    got, _ = keysearch.best_in_block(texts, keysearch.KeyBlock(numbers, keys), threshold)
    wanted = []
    for t, text in enumerate(texts):
        scores = sorted((-greedy(text, k), n) for k, n in zip(keys, numbers.tolist(), strict=True))
        if -scores[0][0] >= threshold:
            wanted.append((t, -scores[0][0], scores[0][1]))
    assert sorted(got) == wanted


def test_words_of_one_shape_compare_few_pairs():
    words = [[f"no1{k:05d}"] for k in random.Random(0).sample(range(100_000), 4000)]
    asked = [[f"no1{k:05d}"] for k in random.Random(9).sample(range(100_000), 300)]
    block = keysearch.KeyBlock(np.arange(len(words)), words)
    for texts in (words[:300], asked):
        assert keysearch.best_in_block(texts, block, 0.7)[1] < 0.1 * len(texts) * len(words)


def test_blocks_that_meet_copy_few_rows():
    for asked, known in ((1, 1), (20_000, 20_000), (1_000_000, 1_200_000), (6_000_000, 20_000), (500, 7_000_000)):
        across, down = keysearch.dealt_blocks(asked, known, 48, 512, 1 << 16)
        assert across * known + down * asked <= 50 * (asked + known) + 2 * asked * known / (1 << 16)
    assert keysearch.dealt_blocks(20_000, 20_000, 48, 512, 1 << 16) == (40, 1)  # all cores are busy
    assert keysearch.dealt_blocks(0, 0, 48, 512, 1 << 16) == (1, 1)


@pytest.mark.parametrize("sizes", [(7, 3, 11), (8192, 512, 1 << 16)])
def test_best_of_all_blocks_equals_plain_loops(spark, sizes):
    rng = random.Random(8)
    vocabulary = ["steel", "stel", "steal", "cold", "rolled", "roled", "sheet", "a", "ab", "x1", "x12"]
    keys = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 3))] for _ in range(50)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 3))] for _ in range(25)]
    probes = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "q_id string, words array<string>")
    known = spark.createDataFrame([(7 * i, k) for i, k in enumerate(keys)], "k_no long, words array<string>")
    got = sorted(tuple(r) for r in keysearch.best_keys(probes, known, 0.7, *sizes).select("q_id", "score", "k_no").collect())
    best = ((str(i), min((-greedy(t, k), 7 * n) for n, k in enumerate(keys))) for i, t in enumerate(texts))
    assert got == sorted((i, -s, n) for i, (s, n) in best if -s >= 0.7) and len(got) > 10


def test_texts_of_the_words_of_a_key_are_not_searched(spark, monkeypatch):
    asked, dealt = [], keysearch.dealt_blocks
    monkeypatch.setattr(keysearch, "dealt_blocks", lambda *a: asked.append(a[0]) or dealt(*a))
    keys = [["cold", "steel", "s1"], ["steel", "cold", "s1"], ["a", "a", "b"], ["a", "b", "b"], ["x"]]
    texts = [["s1", "cold", "steel"], ["b", "a", "b"], ["a", "b"], ["cold", "stel", "s1"], ["x"]]
    probes = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "q_id string, words array<string>")
    known = spark.createDataFrame([(9 - i, k) for i, k in enumerate(keys)], "k_no long, words array<string>")
    got = sorted(tuple(r) for r in keysearch.best_keys(probes, known, 0.7).select("q_id", "score", "k_no").collect())
    best = ((str(i), min((-greedy(t, k), 9 - n) for n, k in enumerate(keys))) for i, t in enumerate(texts))
    assert asked == [2] and got == sorted((i, -s, n) for i, (s, n) in best if -s >= 0.7)


def test_what_another_block_reached_is_not_looked_for_again():
    rng = random.Random(4)
    keys = [[rng.choice(["cold", "hot", "old"]), rng.choice(["ring", "bolt", "rod"]), f"s{rng.randint(1, 50)}", f"no{i}"] for i in range(500)]
    texts = [k[:2] + [k[2] + "x", k[3]] for k in keys[::10]]
    half = [keysearch.KeyBlock(np.arange(250) + a, keys[a:a + 250]) for a in (0, 250)]
    alone, first = keysearch.best_in_block(texts, half[1], 0.7), keysearch.best_in_block(texts, half[0], 0.7)[0]
    found, aligned = keysearch.best_in_block(texts, half[1], 0.7, {t: (s, k) for t, s, k in first})
    assert aligned < alone[1]
    both = {t: (s, k) for t, s, k in first} | {t: (s, k) for t, s, k in found}
    whole = keysearch.best_in_block(texts, keysearch.KeyBlock(np.arange(500), keys), 0.7)[0]
    assert sorted((t, s, k) for t, (s, k) in both.items()) == sorted(whole)
