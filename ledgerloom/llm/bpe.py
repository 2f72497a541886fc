"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into overlapping chunks, which tasks pre-tokenise apart. The pattern never looks
behind, so from any place that both chunks hold as a boundary they agree on; chunks are stitched
there, and pieces of a run that never resynchronises are read again from the last sure boundary.
Each piece is then merged by rank (a piece met before is looked up), and decoding concatenates the
bytes of the ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import id_text

SCHEMA = "doc_id long, ids array<int>, decoded binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
#: Distinct pieces whose ids a task remembers, and characters of the longest of them.
MEMORY, LONGEST = 1 << 18, 64


class Vocabulary(dict):
    """Ids of pieces, worked out when first asked for."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ids = {i: b for b, i in self.rank.items()}
        self.bytes_of = [ids.get(i, b"") for i in range(max(ids) + 1)]
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.rank, special_tokens={})._encode_single_piece
        self.find = regex.compile(pattern).findall
        self.iter = regex.compile(pattern).finditer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > LONGEST:
            return tuple(self.merge(piece))
        if len(self) >= MEMORY:
            self.clear()
        ids = self[piece] = tuple(self.merge(piece))
        return ids

    def boundaries(self, text: str) -> np.ndarray:
        return np.array([m.start() for m in self.iter(text)] + [len(text)], np.int64)


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def stitch(text: str, chunks: list[tuple[int, np.ndarray]], v: Vocabulary) -> list[str]:
    """Pieces of the whole text from (start, boundaries) of its overlapping chunks, in order."""
    cuts: list[int] = [0]
    for k, (start, own) in enumerate(chunks):
        own = own + start
        last = k == len(chunks) - 1
        # what a chunk finds is sure up to the start of its last two pieces: those may go on beyond it
        sure = own if last else own[: max(0, len(own) - 3)]
        if k and sure.size:
            i = int(np.searchsorted(sure, cuts[-1]))
            met = cuts[-1] if i < len(sure) and sure[i] == cuts[-1] else None
            at = len(cuts) - 1
            while met is None and at > 0 and cuts[at] >= start:  # an earlier common boundary
                at -= 1
                i = int(np.searchsorted(sure, cuts[at]))
                if i < len(sure) and sure[i] == cuts[at]:
                    met = cuts[at]
            if met is None:
                continue  # no common boundary: the next chunks, or the reading below, go on from cuts[-1]
            del cuts[at + 1 :]
            cuts.extend(sure[i + 1 :].tolist())
        elif not k:
            cuts.extend(sure[1:].tolist())
    if cuts[-1] < len(text) or not chunks:
        tail = cuts[-1]
        cuts.extend((v.boundaries(text[tail:])[1:] + tail).tolist())
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def encode(pieces: list[str], v: Vocabulary) -> list[int]:
    return list(chain.from_iterable(map(v.__getitem__, pieces)))


def decode(ids: list[int], v: Vocabulary) -> bytes:
    return b"".join(map(v.bytes_of.__getitem__, ids))


def _table(docs: list[tuple[int, list[str]]], v: Vocabulary) -> pa.RecordBatch:
    """A row for each (doc_id, pieces)."""
    ids = [encode(pieces, v) for _, pieces in docs]
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.record_batch([pa.array([i for i, _ in docs], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([decode(x, v) for x in ids], pa.binary())], schema=_ARROW)


def encode_decode(docs: DataFrame, vocabulary_path: str | None = None, pattern: str | None = None, chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """doc_id, ids and decoded (the bytes of the ids) of each row with an id.

    Texts of ``chunk`` characters or fewer are encoded at once, longer ones chunk by chunk. Null and empty texts have no
    tokens; rows that share an id are encoded each. Special tokens are not known: their names are ordinary text. Tasks read the vocabulary from the installed package.
    """
    if vocabulary_path is None or pattern is None:
        import public_tokenizers

        vocabulary_path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    docs = id_text(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                yield _table([(i, v.find(t)) for i, t in zip(some["doc_id"].to_pylist(), some["text"].to_pylist())], v)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path, pattern)
        for batch in batches:
            cuts = [v.boundaries(t).astype(np.int32).tobytes() for t in batch["text"].to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(cuts, pa.binary())], names=[*batch.schema.names, "cuts"])

    def join(group: pa.Table) -> pa.Table:
        v = vocabulary(vocabulary_path, pattern)
        own = group.sort_by("start").to_pylist()
        text = "".join(r["text"][:chunk] for r in own)
        pieces = stitch(text, [(r["start"], np.frombuffer(r["cuts"], np.int32).astype(np.int64)) for r in own], v)
        return pa.Table.from_batches([_table([(own[0]["doc_id"], pieces)], v)])

    short = docs.where(F.length("text") <= chunk).mapInArrow(whole, SCHEMA)
    long = docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()).withColumn("start", F.explode(F.expr(f"sequence(0, length(text) - 1, {chunk})")))
    long = long.withColumn("text", F.expr(f"substring(text, start + 1, {chunk + overlap})"))
    long = long.repartition("doc_id", "start").mapInArrow(pretokenise, "doc_id long, text string, row long, start int, cuts binary")
    return short.unionByName(long.groupBy("row").applyInArrow(join, SCHEMA))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.selectExpr("doc_id", "cast(size(ids) as long) n_tokens", "sha2(array_join(cast(ids as array<string>), ' '), 256) ids_sha256", "sha2(decoded, 256) decoded_sha256")
