"""Packing of tokenised texts into windows by multiway differencing (Karmarkar-Karp)."""

from __future__ import annotations

import heapq
import os
import threading
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aligner.llm.common import byte_slices, split_words

_SLICE_BYTES = 8 << 20
#: Words whose ids a worker remembers; beyond that it starts anew. Only speed depends on it.
_REMEMBERED_WORDS = 800_000
#: Runs that are looked up at once; their places take several times the memory of the ids.
_RUNS = 1 << 15
#: Stands between words that are encoded together.
_MARK = "\u241e"
_SUM = itemgetter(0)
#: Punctuation that is a piece of its own after a letter (fixed by the tokenizer's pattern, which parts letters from other characters).
_TAIL = ".,;:!?"
_encoders: dict[str, WordEncoder] = {}
_lock = threading.Lock()


def parted(words: pa.Array) -> tuple[list[str], list[str]]:
    """The words without the punctuation at their ends, and that punctuation ("" if there is none), A-Z as a-z.

    The tokenizer lower-cases and parts letters from punctuation, so the ids of both, one after the other, are those of the word. Only
    words of characters below U+0300, which no normalisation joins, are changed, and only those with a letter before the punctuation.
    """
    if not len(words):
        return [], []
    _, offsets, data = words.cast(pa.large_string()).buffers()
    starts = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words)]
    used = np.append(np.frombuffer(data or b"", np.uint8)[:np.frombuffer(offsets, np.int64)[words.offset + len(words)]], np.uint8(0))
    most = np.maximum.reduceat(used, starts)  # lead bytes of U+0300 and above are 0xCC and above
    plain = pa.array(most < 0xCC)
    lowered = pc.if_else(plain, pc.ascii_lower(words), words)
    cores = pc.utf8_rtrim(lowered, _TAIL)
    last = pc.utf8_slice_codeunits(cores, -1)
    letter = pc.and_(pc.utf8_is_alpha(last), pc.not_equal(last, "\u0130"))  # that one ends in a mark when it is lower-cased
    cores = pc.if_else(pc.and_(plain, letter), cores, lowered)
    cut = pc.subtract(pc.binary_length(lowered), pc.binary_length(cores)).to_numpy()
    tails = [""] * len(words)
    at = np.flatnonzero(cut)
    for i, w, n in zip(at.tolist(), lowered.take(pa.array(at)).to_pylist(), cut[at].tolist(), strict=True):
        tails[i] = w[-n:]
    return cores.to_pylist(), tails


def _spans(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after the other, and their lengths."""
    done = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(done[-1], values.dtype)
    for a in range(0, len(begin), _RUNS):
        b = min(a + _RUNS, len(begin))
        at = np.repeat(begin[a:b] - done[a:b], length[a:b])
        at += np.arange(done[a], done[b])
        out[done[a]:done[b]] = values[at]
    return out, length


class WordEncoder:
    """Ids of texts. The tokenizer drops white space and merges only inside the pieces between it, so a text's ids are those of
    its words one after the other, and a word's those of its parts; each distinct part is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)
        self.used = 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other and where each word's end; encoded as one text with a mark between the words."""
        joined = f" {_MARK} ".join([*words, ""])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
        n = len(self.mark)
        at = np.flatnonzero(np.all([ids[k:len(ids) - n + 1 + k] == self.mark[k] for k in range(n)], axis=0))
        if len(at) != len(words):  # a word's own ids look like the mark
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for e in each for i in e], dtype=np.uint32), np.cumsum([len(e) for e in each])
        marks = (at[:, None] + np.arange(n)).ravel()
        return np.delete(ids, marks), at - n * np.arange(len(at))

    def _add(self, words: list[str]) -> None:
        ids, ends = self._encoded(words)
        at = len(self.slot)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(words) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[at + 1:at + 1 + len(words)] = self.used + ends
        self.slot.update(zip(words, range(at, at + len(words)), strict=True))
        self.used += len(ids)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, ``end_id`` after each text, and where each text begins (one more than texts)."""
        words, codes, offsets = split_words(texts)
        cores, tails = parted(words)
        distinct = set(cores).union(tails)
        if len(self.slot) + len(distinct) > _REMEMBERED_WORDS:
            self.clear()
        new = [w for w in distinct if w not in self.slot]
        for i in range(0, len(new), 512):
            self._add(new[i:i + 512])
        slots = np.fromiter((self.slot[w] for pair in zip(cores, tails, strict=True) for w in pair), np.int64, 2 * len(cores))
        own, sizes = _spans(self.ids, self.starts[slots], self.starts[slots + 1] - self.starts[slots])
        starts = np.concatenate([[0], np.cumsum(sizes.reshape(-1, 2).sum(axis=1))])  # of each distinct word
        flat, length = _spans(own, starts[codes], starts[codes + 1] - starts[codes])
        done = np.concatenate([[0], np.cumsum(length)])
        ends = done[offsets]
        return np.insert(flat, ends[1:], end_id).astype("<u4", copy=False), ends + np.arange(len(ends))


def _encoder(path: str) -> WordEncoder:
    with _lock:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``windows`` parts of near-equal sums.

    A partial partition is a list of parts, of which only those that differ from its smallest sum are kept, largest first. The
    two partial partitions with the largest spreads merge, the large parts of one onto the small parts of the other.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - windows
        if overlap > 0:  # a's smallest kept parts take b's smallest ones, the last with the first
            merged = a[:len(a) - overlap] + b[:len(b) - overlap]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - overlap:], reversed(b[len(b) - overlap:]), strict=True)]
        else:
            merged = a + b
        merged.sort(key=_SUM, reverse=True)
        if len(merged) == windows:
            low = merged[-1][0]
            if low:
                merged = [(s - low, m) for s, m in merged]
        heapq.heappush(heap, (-merged[0][0], i, merged))
    parts = [m for _, m in heap[0][2]] if heap else []
    return parts + [[] for _ in range(windows - len(parts))]


def balanced_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity`` each; the number of parts rises until none exceeds it. Sizes are at most ``capacity``."""
    windows = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while windows:
        parts = difference(sizes, windows)
        over = sum(sum(sizes[i] for i in part) > capacity for part in parts)
        if not over:
            return parts
        windows += max(1, over // 8)
    return []


def _pieces(lengths: np.ndarray, capacity: int, number: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, start, length, window, offset) for every piece: full windows of long texts, their rests balanced together.

    Rests are cut to at most an eighth of a window, which leaves the differencing small items to balance with.
    """
    most = max(1, capacity // 8)
    small: list[tuple[int, int, int]] = []
    for text, n in enumerate(lengths.tolist()):
        full = n // capacity
        for k in range(full):
            yield text, k * capacity, capacity, number, 0
            number += 1
        small += [(text, s, min(most, n - s)) for s in range(full * capacity, n, most)]
    for part in balanced_windows([p[2] for p in small], capacity):
        at = 0
        for i in sorted(part):
            yield *small[i], number, at
            at += small[i][2]
        number += bool(part)


def pack_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
               end_id: int = 2, group_bytes: int = _SLICE_BYTES) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all texts, with ``sequence_length``.

    Texts of a task are taken in groups of ``group_bytes`` (or one text): the group is tokenised, long texts fill whole windows,
    the rests are balanced by differencing. No shuffle: ids never leave the task that made them. ``sequence_id`` is the task's
    number and a count; it is unique but not dense. A null or empty text has one piece with the end id alone; repeated rows
    are packed as often as they occur; null ids stay null; an empty table gives no piece.
    """
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "sequence_length long")

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        encoder = _encoder(tokenizer_path)
        for group in byte_slices(batches, "text", group_bytes):
            ids, begins = encoder.encode(group.column("text"), end_id)
            lengths = np.diff(begins)
            raw = memoryview(ids).cast("B")
            rows = list(_pieces(lengths, capacity, number))
            text, start, length, window, offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
            first = (begins[text] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            filled = np.bincount(window - number, weights=length).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [group.column("doc_id").take(pa.array(text)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 pa.array(lengths[text]), pa.array(window), pa.array(offset), pa.array(filled[window - number])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])
            number = int(window.max()) + 1
            pa.default_memory_pool().release_unused()  # the worker lives on, others beside it

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pack, schema)
