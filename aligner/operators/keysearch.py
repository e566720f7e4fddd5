"""Best key per text by greedy word similarity: classes of keys by word count, bounds from letters, alignments best first.

Two words of lengths a and b that share c letters are at most c / max(a, b) alike, so the words of a text bound what it can reach with a key.
Keys of the very words of a text are joined. The other texts look at a few keys that hold their rarest word first: what these reach leaves the
words of a text little to lose, so a better key holds a word near to one of some chosen words, and only the keys on the lists of such words are
bounded, in falling order of which they are aligned. Texts stop where no bound reaches the best similarity found. Word pairs are compared when
an alignment asks for them; no table of similar words exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.functions.similarity import edit_distances
from aligner.session import stage

_PLACES = 40
#: Occurrences of a letter that have a bit of their own; those beyond are only counted.
_OCCURRENCES = 8
_FIRST_STEP = 8
_TOGETHER = 64
_SLACK = 1e-9
#: Keys on the list of a text's rarest word that are looked at, classes in which that is done, and keys that are aligned before all others.
_SEEN, _CLASSES, _SEEDS = 512, 3, 4
#: Probes of a block at least.
_FEWEST = 512
#: Tasks for every block.
_TASKS = 4
#: Levels of bounds for which the lengths of lists are known.
_LEVELS = 64
_NEAR = 45
#: Keys from which on those that cannot reach the best are left out after every word.
_MANY = 256
#: Numbers that the bounds of a block's words and keys may take up before they are made anew.
_HELD = 1 << 24


def _letters(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), _PLACES), np.uint8)
    for i, word in enumerate(words):
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i] = np.minimum(np.bincount(codes * np.uint32(2654435761) % np.uint32(_PLACES), minlength=_PLACES), 255)
    return out


class Vocabulary:
    """Distinct words with their numbers, lengths and letter counts."""

    def __init__(self, texts: list[list[str]]) -> None:
        self.number: dict[str, int] = {}
        for words in texts:
            for w in words:
                self.number.setdefault(w, len(self.number))
        self.words = list(self.number)
        self.size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.letters = _letters(self.words)

        most = np.minimum(self.letters.max(axis=0, initial=0), _OCCURRENCES).astype(np.int64)
        self.place = np.repeat(np.arange(_PLACES), most)
        self.which = (np.arange(len(self.place)) - np.repeat(np.cumsum(most) - most, most)).astype(np.uint8)
        self.bits = np.ascontiguousarray(self._bits(self.letters).T)
        self.over = self._over(self.letters)

    def _bits(self, letters: np.ndarray) -> np.ndarray:
        """The occurrences of every letter as bits, a row for each word."""
        has = np.zeros((len(letters), max(1, -(-len(self.place) // 64)) * 64), bool)
        has[:, :len(self.place)] = letters[:, self.place] > self.which
        return np.packbits(has, axis=1).view(np.uint64)

    def _over(self, letters: np.ndarray) -> np.ndarray:
        return np.maximum(letters.astype(np.int64) - _OCCURRENCES, 0).sum(axis=1)

    def bounds(self, letters: np.ndarray, size: int) -> np.ndarray:
        """What a word can reach with each of the words."""
        common = np.zeros(len(self.words), np.int64)
        for own, word in zip(self.bits, self._bits(letters[None])[0], strict=True):
            if word:
                common += np.bitwise_count(own & word)
        over = int(self._over(letters[None])[0])
        if over:
            common += np.minimum(self.over, over)
        common = np.where(self.size + size > 255, np.minimum(self.size, size), common)  # counts of very long words may be cut
        return common / np.maximum(self.size, size)


class KeyClass:
    """Keys of one word count: their numbers, in which ties are decided, the numbers of their words, and the keys of every word."""

    def __init__(self, numbers: np.ndarray, words: np.ndarray, vocabulary: int) -> None:
        self.numbers, self.words = numbers, words
        flat = words.ravel()
        by_word = np.argsort(flat, kind="stable")
        self.places = by_word // words.shape[1]
        self.starts = np.searchsorted(flat[by_word], np.arange(vocabulary + 1))
        self.sizes = np.diff(self.starts)

    def having(self, words: np.ndarray) -> np.ndarray:
        """Places of the keys on the lists of some words, one after the other."""
        sizes = self.sizes[words]
        first = np.cumsum(sizes) - sizes
        return self.places[np.repeat(self.starts[words] - first, sizes) + np.arange(int(sizes.sum()))]


class KeyBlock:
    def __init__(self, numbers: np.ndarray, keys: list[list[str]]) -> None:
        self.vocabulary = Vocabulary(keys)
        counts = np.fromiter(map(len, keys), np.int64, len(keys))
        self.classes: dict[int, KeyClass] = {}
        for n in np.unique(counts).tolist():
            at = np.flatnonzero(counts == n)
            at = at[np.argsort(numbers[at], kind="stable")]
            words = np.array([[self.vocabulary.number[w] for w in keys[i]] for i in at.tolist()], np.int64).reshape(len(at), n)
            self.classes[n] = KeyClass(numbers[at], words, len(self.vocabulary.words))

    def reach(self, n: int, bounds: np.ndarray, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a word can reach with the best word of every key of ``n`` words; ``bounds`` are those of the vocabulary."""
        words = self.classes[n].words[places]
        best = bounds[words[:, 0]]
        for j in range(1, n):
            np.maximum(best, bounds[words[:, j]], out=best)
        return best


class Reach:
    """Bounds of a list of texts' words with the keys of a block, kept per word: texts share most of their words."""

    def __init__(self, own: Vocabulary, block: KeyBlock) -> None:
        self.own, self.block = own, block
        self.known = np.array([block.vocabulary.number.get(w, -1) for w in own.words], np.int64)
        self.bounds: dict[int, np.ndarray] = {}
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.lists: dict[tuple[int, int], np.ndarray] = {}
        self.asked: dict[tuple[int, int], int] = {}
        self.size = 0

    def of_words(self, word: int) -> np.ndarray:
        """Bounds of a word with the words of the block."""
        if word not in self.bounds:
            if self.size > _HELD:
                self.bounds, self.held, self.lists, self.size = {}, {}, {}, 0
            self.bounds[word] = self.block.vocabulary.bounds(self.own.letters[word], int(self.own.size[word]))
            self.size += len(self.bounds[word])
        return self.bounds[word]

    def of(self, word: int, n: int) -> np.ndarray:
        if (word, n) not in self.held:
            reach = self.block.reach(n, self.of_words(word))
            self.held[word, n] = reach
            self.size += len(reach)
        return self.held[word, n]

    def at(self, word: int, n: int, places: np.ndarray) -> np.ndarray:
        """The same at some places, for words that are asked often from what is kept of all."""
        self.asked[word, n] = self.asked.get((word, n), 0) + len(places)
        if (word, n) in self.held or self.asked[word, n] > len(self.block.classes[n].numbers):
            return self.of(word, n)[places]
        return self.block.reach(n, self.of_words(word), places)

    def listed(self, word: int, n: int) -> np.ndarray:
        """By level, how many keys of ``n`` words are on the lists of words whose bound has that level or more."""
        if (word, n) not in self.lists:
            bounds = self.of_words(word)
            at = np.bincount((bounds * _LEVELS).astype(np.int64), self.block.classes[n].sizes, _LEVELS + 1)
            self.lists[word, n] = at[::-1].cumsum()[::-1]
        return self.lists[word, n]

    def seeds(self, words: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
        """Some keys that share the rarest word of a text that a class knows, and most others with it."""
        m, known, found = len(words), self.known[words], []
        for n in sorted(self.block.classes, key=lambda c: (abs(c - m), c))[:_CLASSES]:
            own = self.block.classes[n]
            there = known[(known >= 0) & (own.sizes[known] > 0)]
            if min(m, n) < threshold * max(m, n) - _SLACK or not len(there):
                continue
            rarest = there[own.sizes[there].argmin()]
            at = own.places[own.starts[rarest]:own.starts[rarest + 1]][:_SEEN]
            hits = (own.words[at][:, :, None] == there).any(axis=2).sum(axis=1)
            best = np.argsort(-hits, kind="stable")[:_SEEDS]
            found.append((int(hits[best[0]]) / max(m, n), n, np.unique(at[best])))
        return [(n, at) for _, n, at in sorted(found, key=lambda f: -f[0])[:1]]

    def near(self, words: np.ndarray, n: int, loss: float) -> np.ndarray | None:
        """Places of the keys that hold a word near to one of some words of a text; all others lose more than ``loss``. None if these are
        no fewer than most keys.

        Of any p words one loses at most ``loss`` / p."""
        own, m, chosen = self.block.classes[n], len(words), None
        least = len(own.numbers) // 3
        if loss < 1e-6:  # every word of the text is one of the key's
            known = self.known[words]
            rarest = known[own.sizes[known].argmin()] if (known >= 0).all() else -1
            return np.unique(own.places[own.starts[rarest]:own.starts[rarest + 1]]) if rarest >= 0 else np.zeros(0, np.int64)
        first = int(loss) + 1
        for p in sorted({p for p in (first, first + 1, first + 2, first + 3, 2 * first, m) if p <= m}):
            level = 1 - loss / p
            if level < 0.05:
                continue
            sizes = [self.listed(w, n)[int((level - _SLACK) * _LEVELS)] for w in words.tolist()]
            fewest = np.argsort(sizes, kind="stable")[:p]
            total = sum(sizes[i] for i in fewest.tolist())
            if total < least:
                least, chosen = total, (level, fewest)
        if chosen is None:
            return None
        flags = np.zeros(len(own.numbers), bool)
        for i in set(words[chosen[1]].tolist()):
            flags[own.having(np.flatnonzero(self.of_words(i) >= chosen[0] - _SLACK))] = True
        return np.flatnonzero(flags)

    def order(self, words: np.ndarray, threshold: float, best: tuple[float, int]) -> tuple[np.ndarray, ...]:
        """Classes, places in them, bounds and numbers of the keys that can be better than the best one (or reach the threshold), best bounds
        first; and where a bound is made of words that are the same or have nothing in common."""
        m, found, floor = len(words), [], max(threshold, best[0])
        for n, own in self.block.classes.items():
            need = floor * max(m, n) - _SLACK * max(m, n)
            if min(m, n) < need:
                continue
            at = self.near(words, n, m - need)
            if at is None:
                each = [self.of(w, n) for w in words.tolist()]
                total = self._total(each, m, n)
                at = np.flatnonzero(total >= need)
                each, total = np.stack([e[at] for e in each]), total[at]
            else:
                each, total, left = [], np.zeros(len(at)), m
                for w in sorted(words.tolist(), key=lambda w: self.listed(w, n)[_NEAR]):  # few keys are near to the first ones
                    reach = self.at(w, n, at)
                    total, left = total + reach, left - 1
                    each.append(reach)
                    if len(at) > _MANY and left:
                        fits = np.flatnonzero(total + left >= need)
                        if len(fits) < 0.7 * len(at):
                            at, total, each = at[fits], total[fits], [e[fits] for e in each]
                total = self._total(each, m, n)
                fits = np.flatnonzero(total >= need)
                at, total, each = at[fits], total[fits], np.stack(each)[:, fits]
            if len(at):
                found.append((np.full(len(at), n), at, total / max(m, n), own.numbers[at], ((each == 0) | (each == 1)).all(axis=0)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
        out = [np.concatenate(c) for c in zip(*found, strict=True)]
        first = np.lexsort((out[3], -out[2]))
        return tuple(c[first] for c in out)

    def _total(self, each: list[np.ndarray], m: int, n: int) -> np.ndarray:
        if m > n:  # that many words stay alone
            return np.partition(np.stack(each), m - n - 1, axis=0)[m - n:].sum(axis=0)
        return np.sum(each, axis=0)


def _greedy(similar: np.ndarray, m: int, n: int) -> np.ndarray:
    """Greedy similarity of pairs (pairs x m x n): each word takes the first best one that is free."""
    total, free, each = np.zeros(len(similar)), similar.copy(), np.arange(len(similar))
    for i in range(min(m, n) if m <= n else m):
        best = free[:, i].argmax(axis=1)
        gain = free[each, i, best]
        taken = gain > 0
        total = np.where(taken, total + gain, total)
        free[each[taken], :, best[taken]] = -1.0
    return total / max(m, n)


def best_in_block(texts: list[list[str]], block: KeyBlock, threshold: float,
                  found: dict[int, tuple[float, int]] | None = None) -> tuple[list[tuple[int, float, int]], int]:
    """(text, score, key's number) of the best key of every text that has one, the smallest number of equal ones; and the alignments made.

    ``found`` are scores and numbers of the best keys of other blocks: what is no better is not looked for."""
    own, out, aligned = Vocabulary(texts), [], 0
    reach, width = Reach(own, block), len(block.vocabulary.words)
    for a in range(0, len(texts), _TOGETHER):
        numbers = {t: np.array([own.number[w] for w in texts[t]], np.int64) for t in range(a, min(a + _TOGETHER, len(texts))) if len(texts[t])}
        best = {t: (found or {}).get(t, (-1.0, 0)) for t in numbers}

        def align(groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]], numbers: dict = numbers, best: dict = best) -> int:
            """Align texts of ``m`` words with keys of ``n`` words; how many pairs that were."""
            done = 0
            for (m, n), asked in groups.items():
                keys = block.classes[n]
                text = np.concatenate([np.full(len(p), t) for t, p in asked])
                place = np.concatenate([p for _, p in asked])
                left = np.stack([numbers[t] for t in text.tolist()])[:, :, None] + np.zeros((1, 1, n), np.int64)
                right = keys.words[place][:, None, :] + np.zeros((1, m, 1), np.int64)
                pair, where = np.unique(left * width + right, return_inverse=True)
                x, y = pair // width, pair % width
                edits = edit_distances([own.words[i] for i in x.tolist()], [block.vocabulary.words[i] for i in y.tolist()])
                similar = 1.0 - edits / np.maximum(own.size[x], block.vocabulary.size[y])
                score = _greedy(similar[where.reshape(left.shape)], m, n)
                done += len(score)
                for t, s, k in zip(text.tolist(), score.tolist(), keys.numbers[place].tolist(), strict=True):
                    if s >= threshold and (s > best[t][0] or (s == best[t][0] and k < best[t][1])):
                        best[t] = (s, k)
            return done

        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for t, words in numbers.items():
            for n, place in reach.seeds(words, threshold):
                groups.setdefault((len(words), n), []).append((t, place))
        aligned += align(groups)
        orders = {t: reach.order(words, threshold, best[t]) for t, words in numbers.items()}
        at, step, active = dict.fromkeys(orders, 0), _FIRST_STEP, [t for t in orders if len(orders[t][0])]
        while active:
            groups = {}
            for t in active:
                n, place, bound, key, whole = (c[at[t]:at[t] + step] for c in orders[t])
                able = ~(whole & (bound <= best[t][0]) & (key >= best[t][1]))  # without fractions a bound is no less than the score, to the last bit
                for own_n in np.unique(n[able]).tolist():
                    groups.setdefault((len(numbers[t]), own_n), []).append((t, place[able & (n == own_n)]))
            aligned += align(groups)
            still = []
            for t in active:
                at[t] += step
                bounds = orders[t][2]
                if at[t] < len(bounds) and bounds[at[t]] >= best[t][0] - _SLACK:
                    still.append(t)
            active, step = still, step * 2
        out += [(t, s, k) for t, (s, k) in best.items() if s >= 0]
    return out, aligned


def dealt_blocks(asked: int, known: int, tasks: int, probe_rows: int, dealt_rows: int) -> tuple[int, int]:
    """Numbers of blocks of the probes and of the keys, which all meet: as many pairs as occupy the tasks, beyond that as few copies of the
    rows as blocks of ``dealt_rows`` need."""
    down = max(1, -(-known // dealt_rows))
    return max(1, -(-asked // dealt_rows), min(-(-asked // probe_rows), -(-tasks // down))), down


def best_keys(probes: DataFrame, keys: DataFrame, threshold: float, block_rows: int = 1 << 16, probe_rows: int = 4096, dealt_rows: int = 1 << 18) -> DataFrame:
    """``q_id, score, k_no``: the most similar key of every probe at the threshold or above, ties to the smallest ``k_no``.

    ``probes`` are distinct ``(q_id, words)``, ``keys`` ``(k_no, words)``. Both are dealt out in blocks of about ``dealt_rows`` that all meet; a
    task searches ``block_rows`` keys for ``probe_rows`` probes at a time. Probes of the very words of a key are joined to it. Empty word lists
    have no match. The lists of near words grow with the keys, so work still grows with probes times keys; few of the pairs are bounded or aligned.
    """
    same = F.array_join(F.array_sort("words"), " ").alias("same")  # words hold no space; those of the same words reach 1, others don't
    first = keys.where(F.size("words") > 0).groupBy(same).agg(F.min("k_no").alias("k_no"))
    whole = stage(probes.select("q_id", same).join(first, "same").select("q_id", F.lit(1.0).alias("score"), "k_no"), "fuzzy-same")
    probes = stage(probes.join(whole, "q_id", "left_anti").select("q_id", "words"), "fuzzy-rest")
    tasks = 4 * probes.sparkSession.sparkContext.defaultParallelism
    asked = probes.count()
    across, down = dealt_blocks(asked, keys.count(), tasks, min(probe_rows, max(_FEWEST, asked // tasks)), dealt_rows)

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        names, best = left.column("q_id").to_pylist(), {}
        for b in range(0, right.num_rows, block_rows):
            part = right.slice(b, block_rows)
            block = KeyBlock(part.column("k_no").to_numpy(), part.column("words").to_pylist())
            for a in range(0, left.num_rows, probe_rows):
                texts = left.column("words").slice(a, probe_rows).to_pylist()
                for t, score, k in best_in_block(texts, block, threshold, {t: best[a + t] for t in range(len(texts)) if a + t in best})[0]:
                    best[a + t] = (score, k)
        return pa.table({"q_id": pa.array([names[t] for t in best], pa.string()), "score": pa.array([s for s, _ in best.values()], pa.float64()),
                         "k_no": pa.array([k for _, k in best.values()], pa.int64())})

    def dealt(df: DataFrame, column: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(mine, F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int"))
        met = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        # few blocks share a task, so that cores that are done take the next
        return met.repartition(_TASKS * blocks * others, "q_block", "k_block").groupBy("q_block", "k_block")

    met = dealt(probes.select("q_id", "words"), "q_id", "q_block", across, "k_block", down).cogroup(
        dealt(keys.select("k_no", "words"), "k_no", "k_block", down, "q_block", across))
    best = met.applyInArrow(near, "q_id string, score double, k_no long").unionByName(whole)
    return best.groupBy("q_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "k_no")).alias("b")).select(
        "q_id", (-F.col("b.neg")).alias("score"), "b.k_no")
