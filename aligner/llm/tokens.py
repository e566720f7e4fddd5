"""Token counts of whole texts, huge texts in overlapping chunks that are spliced where both sides must agree."""

from __future__ import annotations

import threading
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.llm.common import byte_slices

_SLICE_BYTES = 1 << 20
_models: dict[str, SplicingCounter] = {}
_lock = threading.Lock()


class SplicingCounter:
    """Counts pieces of a text as one ``encode`` of the whole text would.

    A boundary between two characters is *stable* if no piece of the vocabulary holds these two next to each other: no
    merge can ever cross it, so the pieces left and right of it don't depend on the other side. Overlapping chunks are
    spliced at a stable boundary at which both encodings also have a piece boundary. Where an overlap holds none it
    is doubled; where the whole chunk holds none, the chunk is.
    """

    def __init__(self, model_path: str, chunk_chars: int = 65536, overlap_chars: int = 512) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk_chars, self.overlap_chars = chunk_chars, overlap_chars
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk_chars]
        out = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], return_type="numpy", num_threads=1), strict=True):
            out[i] = len(ids)
        for i, text in enumerate(texts):
            if len(text) > self.chunk_chars:
                out[i] = self.spliced(text)
        return out

    def _starts(self, text: str, start: int, stop: int) -> list[int]:
        """Positions in ``text`` at which the pieces of the chunk begin (ascending, one per piece)."""
        offsets = self.model.encode(text[start:stop], return_type="offset_mapping")["offsets"]
        return [start + begin for begin, _ in offsets]

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1:at + 1].replace(" ", "▁") not in self.inside

    def spliced(self, text: str) -> int:
        total, counted_from = 0, 0
        start, stop = 0, min(len(text), self.chunk_chars)
        left = self._starts(text, start, stop)
        while stop < len(text):
            overlap, cut = self.overlap_chars, -1
            while cut < 0 and overlap <= stop - max(start, counted_from):
                begin = stop - overlap
                end = min(len(text), begin + max(self.chunk_chars, 2 * overlap))
                right = self._starts(text, begin, end)
                cut = self._common(text, left, right, max(begin, counted_from) + 1, stop)
                overlap *= 2
            if cut < 0:  # nothing stable in the whole chunk: a longer one
                stop = min(len(text), stop + max(self.chunk_chars, stop - start))
                left = self._starts(text, start, stop)
                continue
            total += bisect_left(left, cut) - (bisect_left(left, counted_from) if counted_from else 0)
            start, stop, left, counted_from = begin, end, right, cut
        return total + len(left) - (bisect_left(left, counted_from) if counted_from else 0)

    def _common(self, text: str, left: list[int], right: list[int], low: int, high: int) -> int:
        """A stable boundary in [low, high) where pieces of both chunks begin, the middle one; -1 if there is none."""
        both = sorted(p for p in {*left[bisect_left(left, low):bisect_left(left, high)]} & {*right} if self.stable(text, p))
        return both[len(both) // 2] if both else -1


def _counter(model_path: str, chunk_chars: int, overlap_chars: int) -> SplicingCounter:
    key = f"{model_path}:{chunk_chars}:{overlap_chars}"
    with _lock:
        if key not in _models:
            _models[key] = SplicingCounter(model_path, chunk_chars, overlap_chars)
        return _models[key]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 chunk_chars: int = 65536, overlap_chars: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    A null text counts as empty (0 tokens); null ids and repeated rows stay rows of their own; an empty table gives none; other
    columns are ignored. No shuffle; a task holds one slice of at most 1 MB of text (or one text) at a time.
    """
    schema = "doc_id long, n_bytes long, n_tokens long"

    def count(batches):
        counter = _counter(model_path, chunk_chars, overlap_chars)
        for part in byte_slices(batches, "text", _SLICE_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(np.asarray(counter.counts(texts), dtype=np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
