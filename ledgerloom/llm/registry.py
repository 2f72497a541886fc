"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, difference_cover, oracle, secret_scan, suffix_array
from .common import table
from .conversation_repair import damage, repair
from .filter_audit import filter_interactions
from .minhash import minhash_dedup
from .quality import quality_scores
from .rules import quality_rules
from .sharding import minimax_shards
from .simhash import simhash_dedup
from .toxicity import toxicity_scores


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": lambda s, d: suffix_array.digests(suffix_array.suffix_array_dedup(table(s, d, "documents"))),
        "op2_quality_classifier": lambda s, d: quality_scores(table(s, d, "documents"), table(s, d, "labels")),
        "op3_simhash_near_dedup": lambda s, d: simhash_dedup(table(s, d, "documents")),
        "op4_benchmark_decontamination": lambda s, d: decontam.digests(decontam.contaminated(table(s, d, "documents"), table(s, d, "benchmark"))),
        "op5_quality_rules": lambda s, d: quality_rules(table(s, d, "documents"), table(s, d, "labels")).drop("failed_rules"),
        "op6_substring_dedup": lambda s, d: difference_cover.digests(difference_cover.difference_cover_dedup(table(s, d, "documents"))),
        "op7_sharding": lambda s, d: minimax_shards(table(s, d, "documents")),
        "op8_toxicity": lambda s, d: toxicity_scores(table(s, d, "documents"), table(s, d, "labels")),
        "op9_secret_scan": lambda s, d: secret_scan.digests(secret_scan.find_secrets(table(s, d, "documents"))),
        "op10_bpe_encode_decode": lambda s, d: bpe.digests(bpe.encode_decode(table(s, d, "documents"))),
        "op11_filter_interactions": lambda s, d: filter_interactions(table(s, d, "documents"), table(s, d, "labels")),
        "op12_conversation_repair": lambda s, d: repair(damage(table(s, d, "conversations"))),
        "op13_minhash_near_dedup": lambda s, d: minhash_dedup(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": oracle.SUFFIX_ARRAY, "op5_quality_rules": oracle.quality_rules(), "op6_substring_dedup": oracle.SUBSTRINGS, "op7_sharding": oracle.sharding(), "op11_filter_interactions": oracle.FILTER_AUDIT, "op12_conversation_repair": oracle.CONVERSATIONS, "op13_minhash_near_dedup": oracle.NEAR_COPIES}
