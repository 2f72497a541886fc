"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage works on all that the one before kept and returns the columns of documents; the last
returns ids. Every stage's result is written as Parquet and read again, so a lost executor costs at
most one stage.

In every stage null texts count as empty, texts of any length are read whole, extra columns stay, and an empty table gives an
empty table. Rows that share a doc_id stay or go together where a stage decides by id. Rows without an id go in the stages
that decide by id and in the last; the masking stage keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.bpe import encode_decode
from ledgerloom.llm.common import cut, table
from ledgerloom.llm.decontam import contaminated
from ledgerloom.llm.near_copies import near_copies
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.secret_scan import redact


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; empty texts are scored like others."""
    return _only(docs, quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (similarity of five-word shingles 0.8 or more) the document of the smallest id.

    The links of the SimHash operator's search and MinHash bands propose pairs, the exact similarity decides. Empty and null
    texts are copies of one another.
    """
    return _only(docs, near_copies(docs).where("doc_id = component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage."""
    return _only(docs, contaminated(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts; no document goes, null texts stay null."""
    return redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hash of the bytes that they decode to; only long texts are shuffled, empty ones have no ids."""
    return encode_decode(docs).selectExpr("doc_id", "cast(size(ids) as long) n_tokens", "ids", "sha2(decoded, 256) decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_distinct),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("byte_bpe", to_tokens),
]

#: No stage can be said in SQL as a whole; tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
