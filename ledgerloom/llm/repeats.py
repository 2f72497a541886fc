"""Exact repeated windows over all documents: the passes that suffix_array and difference_cover share.

A window is T consecutive tokens of one document. Each window holds at least one *anchor*, a
k-token gram at a place that only the window's content (suffix_array) or any pair of equal
windows (difference_cover) settles. Passes, from the most significant digit to the least:

1. ``repeated``: anchors are grouped by their gram; grams that occur once are dropped.
2. For each surviving anchor, the window starts around it form one interval. ``judge`` groups
   intervals by the whole text that their windows span: all but the first of a group are
   removed text. The firsts are grouped by the text that all windows of the interval share;
   those alone in their group are dropped, the rest are cut into smaller intervals.
3. At intervals of one start the groups are exactly the repeated windows.

Items travel packed in binary columns, a bucket of the key's range at a time; documents are bucketed once, as compressed Arrow
streams, and are not shuffled again. Removed text is judged by hashes of 128 bits of all that a window spans. A task first groups its own items, so of a text that makes up a third of all rows each task sends one item,
and the bucket of that text is no larger than others. Nothing is capped, and no pairs are made.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import cut, cut_by, id_text, join_hash, mix, parts, runs, text_buffer

#: kind: 0 a key's item still to be grouped, 1 an item that goes on, 2 an item found to be removed text.
SCHEMA = "part int, kind int, n int, key binary, sec binary, nec binary, doc binary, ref binary, many binary"
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("key", "sec", "nec", "doc", "ref", "many"))])
_KINDS = {"key": np.uint64, "sec": np.uint64, "nec": np.uint64, "doc": np.int64, "ref": np.int64, "many": np.uint8}
_OTHER = np.uint64(0x8BB84B93962EACC9)
#: Bytes of text worked on at once in a task.
CHUNK = 1 << 19


def kept_items(n: int) -> int:
    """Items kept in a task before they are grouped and sent to n parts: enough for rows of several items each, 50 MB at most."""
    return min(1 << 21, max(1 << 18, 8 * n))


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` tokens with anchors of ``gram`` tokens; ``steps``: interval lengths, pass by pass, the last 1."""

    size: int
    gram: int
    steps: tuple[int, ...]
    tokens: Callable  # (bytes, offsets) -> tokens, offsets of the texts in tokens, and hashes of the tokens' own where equal tokens may differ
    anchors: Callable  # (grams, offsets, Windows) -> positions

    def intervals(self) -> list[list[tuple[int, int]]]:
        """For each pass, (a, b): window starts from anchor - b to anchor - a."""
        most = self.size - self.gram
        return [[(a, min(most, a + s - 1)) for a in range(0, most + 1, s)] for s in self.steps]


def _pack(x: np.ndarray) -> bytes:
    """Byte planes: the high bytes of ids and places are mostly zero, which the shuffle's compression then removes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(part: np.ndarray, kind: int, **columns: np.ndarray) -> list[dict]:
    """Rows of items split by part; the items' order is kept within a part."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    sorted_columns = {c: x[order] for c, x in columns.items()}
    return [{"part": int(part[i]), "kind": kind, "n": j - i} | {c: _pack(sorted_columns[c][i:j]) if c in sorted_columns else None for c in _KINDS} for i, j in zip(cuts, cuts[1:])]


def _batch(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ARROW)


def _read(data: pa.Table, kind: int, *columns: str) -> list[np.ndarray]:
    """Named columns of the items of a kind, put together."""
    data = data.filter(pa.compute.equal(data["kind"], kind))
    return [np.concatenate([np.zeros(0, _KINDS[c]), *(_unpack(x.as_py(), _KINDS[c]) for x in data[c])]) for c in columns]


def _key_part(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


def doc_part(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.view(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int32)


def _groups(key: np.ndarray, sec: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, whether each is its group's first, and the group's size. With ``sec`` a key has 128 bits."""
    order = np.argsort(key, kind="stable") if sec is None else np.lexsort((sec, key))
    first = np.ones(len(key), bool)
    ordered = key[order]
    first[1:] = ordered[1:] != ordered[:-1]
    if sec is not None:
        ordered = sec[order]
        first[1:] |= ordered[1:] != ordered[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(key)))
    return order, first, size


def _by_place(doc: np.ndarray, ref: np.ndarray) -> np.ndarray:
    return np.lexsort((ref, doc))


def send_repeats(key: np.ndarray, doc: np.ndarray, ref: np.ndarray, n: int, known: np.ndarray | None = None) -> list[dict]:
    """Rows for ``repeated``: items of a key met twice here go on at once, but for one that is sent for the others' sake."""
    order, first, size = _groups(key)
    known = np.zeros(len(key), bool) if known is None else known[order]
    many = np.repeat(np.logical_or.reduceat(known, np.flatnonzero(first)) if len(key) else known, size) | (np.repeat(size, size) > 1)
    sent, rest = order[first], order[~first]
    return _rows(_key_part(key[sent], n), 0, key=key[sent], doc=doc[sent], ref=ref[sent], many=many[first].astype(np.uint8)) + _rows(doc_part(doc[rest], n), 1, doc=doc[rest], ref=ref[rest])


def send_firsts(key: np.ndarray, sec: np.ndarray, nec: np.ndarray | None, doc: np.ndarray, ref: np.ndarray, n: int) -> list[dict]:
    """Rows for ``judge``: of items that are equal here only the first is sent, the others are removed text."""
    order = _by_place(doc, ref)
    key, sec, doc, ref = key[order], sec[order], doc[order], ref[order]
    more = {} if nec is None else {"nec": nec[order]}
    order, first, _ = _groups(key, sec)
    sent, rest = order[first], order[~first]
    more = {c: x[sent] for c, x in more.items()}
    return _rows(_key_part(key[sent], n), 0, key=key[sent], sec=sec[sent], doc=doc[sent], ref=ref[sent], **more) + _rows(doc_part(doc[rest], n), 2, doc=doc[rest], ref=ref[rest])


def _passed(data: pa.Table) -> pa.Table:
    return data.filter(pa.compute.not_equal(data["kind"], 0))


def repeated(items: DataFrame, n: int) -> DataFrame:
    """Of the items of kind 0, those whose key occurs more than once (kind 1). Others pass."""

    def reduce(data: pa.Table) -> pa.Table:
        key, doc, ref, many = _read(data, 0, "key", "doc", "ref", "many")
        order, first, size = _groups(key)
        if len(key):
            some = np.logical_or.reduceat(many[order] > 0, np.flatnonzero(first)) | (size > 1)
            order = order[np.repeat(some, size)]
        rows = _rows(doc_part(doc[order], n), 1, doc=doc[order], ref=ref[order])
        return pa.concat_tables([_passed(data).cast(_ARROW), _batch(rows)])

    return items.groupBy("part").applyInArrow(reduce, SCHEMA)


def judge(items: DataFrame, n: int, last: bool) -> DataFrame:
    """Of items of kind 0 with equal keys all but the first become kind 2; the firsts go on to ``repeated`` by their other key, unless this is the last pass."""

    def reduce(data: pa.Table) -> pa.Table:
        key, sec, doc, ref = _read(data, 0, "key", "sec", "doc", "ref")
        place = _by_place(doc, ref)
        key, sec, doc, ref = key[place], sec[place], doc[place], ref[place]
        order, first, _ = _groups(key, sec)
        sent, rest = order[first], order[~first]
        rows = _rows(doc_part(doc[rest], n), 2, doc=doc[rest], ref=ref[rest])
        if not last:
            rows += send_repeats(_read(data, 0, "nec")[0][place][sent], doc[sent], ref[sent], n)
        return pa.concat_tables([_passed(data).cast(_ARROW), _batch(rows)])

    return items.groupBy("part").applyInArrow(reduce, SCHEMA)


def levels(tokens: np.ndarray, length: int) -> list[np.ndarray]:
    """Hashes of 1, 2, 4 ... tokens from each place, as far as a window of ``length`` needs."""
    out = [tokens]
    while 2 << (len(out) - 1) <= length:
        h, step = out[-1], 1 << (len(out) - 1)
        out.append(join_hash(h[: len(h) - step], h[step:]) if len(h) > step else h[:0])
    return out


def span_hash(grams: list[np.ndarray], start: np.ndarray, length: int) -> np.ndarray:
    j = length.bit_length() - 1
    return mix(join_hash(grams[j][start], grams[j][start + (length - (1 << j))]) + np.uint64(length))


def _chunks(ids: np.ndarray, text: pa.ChunkedArray, make: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, bytes, byte offsets, tokens, token offsets and maybe second hashes of chunks of texts."""
    data, offsets = text_buffer(text)
    for i, j in runs(offsets, CHUNK):
        at = offsets[i : j + 1]
        piece, at = data[at[0] : at[-1]], at - at[0]
        tokens, token_at, *second = make(piece, at)
        yield ids[i:j], piece, at, tokens, token_at, *second


def _anchor_rows(w: Windows, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.Table:
            key, doc, ref = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return _batch(send_repeats(key, doc, ref, n))

        for batch in batches:
            for ids, _, _, tokens, at, *_ in _chunks(batch["doc_id"].to_numpy(), batch["text"], w.tokens):
                grams = levels(tokens, w.gram)[-1]
                place = w.anchors(grams, at, w)
                of = np.searchsorted(at, place, "right") - 1
                whole = (place + w.gram <= at[of + 1]) & (at[of + 1] - at[of] >= w.size)
                place, of = place[whole], of[whole]
                if len(place):
                    held.append((mix(grams[place]), ids[of], place - at[of]))
                if sum(len(x[0]) for x in held) > kept_items(n):
                    yield from flush().to_batches()
        if held:
            yield from flush().to_batches()

    return run


def _interval_rows(w: Windows, n: int, k: int, codes: list[list[int]]) -> Callable:
    """Pass k: cuts each item of the pass before into intervals and hashes their texts."""
    spans = [x for step in w.intervals() for x in step]
    back = np.array([b for _, b in spans])
    last = k == len(w.steps) - 1
    inside = {c: [d for d in codes[k] if spans[c][0] <= spans[d][0] and spans[d][1] <= spans[c][1]] for c in (codes[k - 1] if k else [0])}

    def run(packed: pa.Table, items: pa.Table) -> pa.Table:
        doc, ref = _read(items, 1, "doc", "ref")
        order = np.argsort(doc, kind="stable")
        doc, ref = doc[order], ref[order]
        docs = _unpack_docs(packed)
        docs = docs.filter(pa.compute.is_in(docs["doc_id"], pa.array(np.unique(doc), pa.int64())))
        held = []
        for ids, _, _, tokens, at, *second in _chunks(docs["doc_id"].to_numpy(), docs["text"], w.tokens):
            lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            of = np.repeat(np.arange(len(ids)), hi - lo)
            own = np.concatenate([ref[i:j] for i, j in zip(lo, hi)])
            code, place = (own & 255, (own >> 8) + back[own & 255]) if k else (np.zeros(len(own), np.int64), own)
            grams = levels(tokens, w.size + w.steps[k] - 1)
            other = levels(second[0] if second else mix(tokens ^ _OTHER), w.size + w.steps[k] - 1)
            for c in np.unique(code):
                pick = np.flatnonzero(code == c)
                for d in inside[int(c)]:
                    a, b = spans[d]
                    length = w.size + b - a
                    x = at[of[pick]] + place[pick]
                    common = (x - a >= at[of[pick]]) & (x - b + w.size <= at[of[pick] + 1])
                    which, x = of[pick][common], x[common]
                    start = x - b
                    fits = (start >= at[which]) & (start + length <= at[which + 1])
                    r = ((start - at[which]) << 8) | d
                    key = mix(mix(ids[which].view(np.uint64)) ^ r.view(np.uint64))  # of its own, where the span leaves the document
                    sec = key.copy()
                    key[fits] = span_hash(grams, start[fits], length)
                    sec[fits] = span_hash(other, start[fits], length)
                    nec = span_hash(grams, x - a, w.size - (b - a)) if a < b else key
                    held.append((key, sec, nec, ids[which], r, np.full(len(r), length)))
        if not held:
            return _batch([])
        key, sec, nec, who, r, length = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((length, r >> 8, who))  # one item for a span that several anchors propose
        same = np.zeros(len(order), bool)
        same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (who, r >> 8, length)])
        order = order[~same]
        return _batch(send_firsts(key[order], sec[order], None if last else nec[order], who[order], r[order], n))

    return run


def removed_spans(items: pa.Table, w: Windows) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """Start and length in tokens of the removed texts of a document."""
    spans = [x for step in w.intervals() for x in step]
    length = np.array([w.size + b - a for a, b in spans])
    doc, ref = _read(items, 2, "doc", "ref")
    order = np.argsort(doc, kind="stable")
    doc, ref = doc[order], ref[order]

    def of(doc_id: int) -> tuple[np.ndarray, np.ndarray]:
        own = ref[np.searchsorted(doc, doc_id, "left") : np.searchsorted(doc, doc_id, "right")]
        return own >> 8, length[own & 255]

    return of


def covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n tokens the spans cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(start, 0, n), 1)
    np.add.at(edge, np.clip(start + length, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _pack_docs(n: int) -> Callable:
    """Rows (part, data): the documents of a part, about 8 MB of a task's texts at a time, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            docs = pa.Table.from_batches(held)
            part = doc_part(docs["doc_id"].to_numpy(), n)
            order = np.argsort(part, kind="stable")
            docs, part = docs.take(pa.array(order)), part[order]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            data = []
            for i, j in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(docs.slice(i, j - i).combine_chunks())
                data.append(sink.getvalue().to_pybytes())
            return pa.record_batch({"part": pa.array(part[cuts[:-1]], pa.int32()), "data": pa.array(data, pa.binary())})

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > 8 << 20:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _unpack_docs(packed: pa.Table) -> pa.Table:
    empty = pa.schema([("doc_id", pa.int64()), ("text", pa.string())]).empty_table()
    return pa.concat_tables([empty, *(pa.ipc.open_stream(x.as_buffer()).read_all().cast(empty.schema) for x in packed["data"])])


def runs_of(gone: np.ndarray) -> list[dict]:
    """Maximal runs (start, end) of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def remove_repeats(docs: DataFrame, w: Windows, report: Callable, schema: str) -> DataFrame:
    """report(doc ids, texts, spans of a doc id) makes the pyarrow table of ``schema`` for a bucket of documents."""
    docs = id_text(docs)
    n = parts(docs)
    by_part = cut_by(docs.mapInArrow(_pack_docs(n), "part int, data binary"), "part", n)
    plan, codes = w.intervals(), []
    for step in plan:
        at = sum(map(len, codes))
        codes.append(list(range(at, at + len(step))))
    assert sum(map(len, codes)) <= 256, "too many intervals for a byte"
    going = cut(repeated(docs.mapInArrow(_anchor_rows(w, n), SCHEMA), n))
    found = []
    for k in range(len(plan)):
        last = k == len(plan) - 1
        rows = by_part.groupBy("part").cogroup(going.where("kind = 1").groupBy("part")).applyInArrow(_interval_rows(w, n, k, codes), SCHEMA)
        rows = judge(rows, n, last)
        going = cut(rows if last else repeated(rows, n))
        found.append(going.where("kind = 2"))
    found = functools.reduce(DataFrame.unionByName, found)

    def finish(packed: pa.Table, items: pa.Table) -> pa.Table:
        docs = _unpack_docs(packed)
        return report(docs["doc_id"].to_numpy(), docs["text"], removed_spans(items, w))

    return by_part.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(finish, schema)
