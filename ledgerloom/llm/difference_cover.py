"""Substring dedup with difference-cover anchors.

Windows of ``gram`` words are hashed only at places whose rest modulo a period lies in a
difference cover. For two equal windows of ``size`` words at any two places there is a shift below
the period that puts both on cover places, so any long match has an aligned anchor; around it the
match is extended to whole windows (see repeats).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_buffer, word_bounds, word_marks
from .repeats import Windows, covered, remove_repeats, runs_of

#: Perfect difference sets: every rest modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
SCHEMA = "doc_id long, n_words long, kept string, spans array<struct<start:int,end:int>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, at = word_bounds(data, offsets)
    first, second = word_marks(data, starts, ends)
    return first, at, second


def _on_cover(period: int) -> Callable:
    member = np.isin(np.arange(period), COVERS[period])

    def places(grams: np.ndarray, offsets: np.ndarray, w: Windows) -> np.ndarray:
        at = np.arange(len(grams))
        begin = np.repeat(offsets[:-1], np.diff(offsets))[: len(grams)]
        return at[member[(at - begin) % period]]

    return places


def difference_cover_dedup(docs: DataFrame, size: int = 20, period: int = 13) -> DataFrame:
    """Removes each word that a window of ``size`` words covers whose words also start earlier (smaller doc_id, or earlier in the same document).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Returns doc_id, n_words, kept (the kept words joined by one
    space) and spans (maximal removed runs of words) for each row with an id. Null and empty texts have no words; rows that share a doc_id count as one document.
    """
    gram = size - period + 1
    if gram < 1:
        raise ValueError("the period must not exceed the window")

    def report(ids: np.ndarray, texts: pa.ChunkedArray, spans_of: Callable) -> pa.Table:
        data, offsets = text_buffer(texts)
        whole = data.tobytes()
        rows = []
        for i, doc_id in enumerate(ids):
            words = whole[offsets[i] : offsets[i + 1]].split()
            start, length = spans_of(doc_id)
            gone = covered(len(words), start, length) if len(start) else np.zeros(0, bool)
            kept = [x for x, g in zip(words, gone.tolist()) if not g] if len(start) else words
            rows.append({"doc_id": int(doc_id), "n_words": len(words), "kept": b" ".join(kept).decode(), "spans": runs_of(gone)})
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return remove_repeats(docs, Windows(size, gram, (period, 1), _tokens, _on_cover(period)), report, SCHEMA)


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.selectExpr("doc_id", "n_words", "cast(aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as long) n_removed", "sha2(kept, 256) kept_sha256")
