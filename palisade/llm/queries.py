"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc
from . import (
    decontamination, filter_audit, jaccard_join, language_id, mixing, personal_data, piece_codec, quality_classifier, quality_rules,
    quotation, sharding, suffix_dedup, token_alignment,
)
from .base import read_table
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, operator: Callable[..., DataFrame], *tables: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*[read_table(use_utc(spark), sf_dir, table) for table in tables or ["documents"]])

    QUERIES[name] = run


register("op1_quotation_linking", quotation.link_quotations, "conversations")
register("op2_language_id", language_id.identify)
register("op3_quality_rules", quality_rules.quality_rules)
register("op4_ngram_jaccard_join", jaccard_join.near_duplicates)
register("op5_source_mixing", mixing.mix_documents)
register("op6_quality_classifier", quality_classifier.classify, "documents", "labels")
register("op7_benchmark_decontamination", decontamination.find_leaks, "documents", "benchmark")
register("op8_rendezvous_sharding", sharding.shard_documents)
register("op9_personal_data", personal_data.find_personal_data)
register("op10_suffix_array_dedup", suffix_dedup.remove_repeats)
register("op11_filter_audit", filter_audit.audit_filters, "documents", "labels")
register("op12_token_alignment", token_alignment.align_documents)
register("op13_piece_codec", piece_codec.encode_documents)
