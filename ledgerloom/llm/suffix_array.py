"""Suffix-array dedup: a depth-limited radix sort over blocks of digits.

Suffixes are ordered through ``size`` bytes only, most significant digits first, and a group that
is down to one suffix is dropped at once; groups that are still together at full depth are exactly
the repeated windows. The first digit is a block of ``gram`` bytes. Sorting every suffix by it
would move eight bytes for each byte of text, so it is read where a window's own content puts it
(the smallest block hash of the window): equal windows put it at the same offset, so groups are
the same, and about one suffix in thirty-five is moved. The next digits refine the window starts
around it (see repeats).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_tokens, text_buffer
from .repeats import Windows, covered, remove_repeats, runs_of

SCHEMA = "doc_id long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x, step = f(x[: len(x) - step], x[step:]), 2 * step
    rest = width - step
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def _smallest(grams: np.ndarray, offsets: np.ndarray, w: Windows) -> np.ndarray:
    """Places of the smallest gram of any window; where several tie, all of them."""
    width = w.size - w.gram + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    value = (grams >> np.uint64(32)).astype(np.uint32)
    least = _sliding(np.minimum, value, width)
    edge = np.zeros(width - 1, np.uint32)
    return np.flatnonzero(value == _sliding(np.maximum, np.concatenate([edge, least, edge]), width))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_tokens(data), offsets


def suffix_array_dedup(docs: DataFrame, size: int = 100, gram: int = 32) -> DataFrame:
    """Removes each byte that a ``size``-byte string covers which also starts earlier (smaller doc_id, or earlier in the same document).

    Returns doc_id, n_bytes, kept (the remaining bytes) and spans (maximal removed runs) for each row with an id.
    Null and empty texts have no bytes; texts shorter than ``size`` keep all theirs; rows that share a doc_id count
    as one document. Strings are judged on the input. Strings are compared by 128-bit hashes of their whole text.
    """
    most = size - gram + 1

    def report(ids: np.ndarray, texts: pa.ChunkedArray, spans_of: Callable) -> pa.Table:
        data, offsets = text_buffer(texts)
        rows = []
        for i, doc_id in enumerate(ids):
            own = data[offsets[i] : offsets[i + 1]]
            gone = covered(len(own), *spans_of(doc_id))
            rows.append({"doc_id": int(doc_id), "n_bytes": len(own), "kept": own[~gone].tobytes(), "spans": runs_of(gone)})
        return pa.Table.from_pylist(rows, schema=_ARROW)

    return remove_repeats(docs, Windows(size, gram, (most, max(1, most // 8), 1) if most > 8 else (most, 1), _tokens, _smallest), report, SCHEMA)


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.selectExpr("doc_id", "n_bytes", "n_bytes - length(kept) n_removed", "cast(size(spans) as long) n_spans", "sha2(kept, 256) kept_sha256")
