"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, fingerprints, html_text, jaccard, line_dedup, mixing, oracles, periodic_runs, quality_classifier, quality_rules, sharding, token_alignment, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_lpt_shards": sharding.op3_lpt_shards,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_jaccard_components": jaccard.op5_jaccard_components,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_order_minhash": fingerprints.op7_order_minhash,
        "op8_html_text": html_text.op8_html_text,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
