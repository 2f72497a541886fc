"""Shared helpers: reading a table, cutting lineage, and numpy text kernels.

Every operator takes the columns it needs by name, so extra columns never matter. Rows
whose ``doc_id`` is null take no part (they cannot be reported on); null texts count as
empty texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scratch import cut, scratch

WHITE = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False

_rng = np.random.default_rng(20)
_BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of the rows that have an id; null texts become ''."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")


#: Buckets of a table; Spark takes no more than 100,000. Beyond that a bucket holds several parts, met one after another.
BUCKETS = 50_000


def cut_by(df: DataFrame, column: str, n: int) -> DataFrame:
    """``cut`` into buckets of a column of n values, so that later groupings by it don't shuffle this side again."""
    n = min(n, BUCKETS)
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", scratch(spark)).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay: the table is external
    return out


def parts_of(size: int, least: int = 4 << 20, most: int = 128 << 20, good: int = 20_000) -> int:
    """Number of parts of ``size`` bytes of text: one for each ``least`` bytes; from ``good`` parts on they grow up to ``most`` bytes first."""
    return size // min(most, max(least, size // good)) + 1


def parts(docs: DataFrame) -> int:
    return parts_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text has a range of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = j
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _K1
    x ^= x >> np.uint64(29)
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a string from hashes of two parts that make it up."""
    x = a * _K1
    x ^= x >> np.uint64(31)
    x += b
    x *= _K2
    x ^= x >> np.uint64(29)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(max(n, 1 << 20), r, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return _BYTE_KEYS[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and n + 1 word offsets of the texts."""
    is_word = np.empty(len(data) + 2, bool)
    is_word[0] = is_word[-1] = False
    is_word[1:-1] = _IS_WORD[data]
    begins, ends = is_word[1:-1] & ~is_word[:-2], is_word[1:-1] & ~is_word[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = is_word[1:-1][inner]
    ends[inner - 1] = is_word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes have equal hashes wherever they stand."""
    p, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts])


#: Longer words are hashed one by one.
_LONG = 128
_SEEDS = (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127)
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte range, each mixed anew from its bytes, eight at a time, so that words that meet in one do not meet in both."""
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    size = ends - starts
    out = [mix(size.astype(np.uint64) + np.uint64(seed)) for seed in _SEEDS]
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live):
        left = size[live] - at
        lane = lanes[starts[live] + at] & _LANE[np.minimum(left, 8)]
        out[0][live] = mix(out[0][live] ^ lane)
        out[1][live] = mix((out[1][live] + lane) * _K1)
        at += 8
        live = live[left > 8]
    for k in np.flatnonzero(size > _LONG).tolist():
        digest = xxhash.xxh3_128_intdigest(data[starts[k] : ends[k]].tobytes())
        out[0][k], out[1][k] = digest >> 64, digest & (2**64 - 1)
    return out[0], out[1]
