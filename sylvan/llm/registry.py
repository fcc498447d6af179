"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from sylvan.llm import chat, jaccard, mixing, neighbours, packing, quality, rules, secrets, toxicity, urls


def queries() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return {
        "op1_length_packing": packing.query,
        "op2_url_filter": urls.query,
        "op3_toxicity": toxicity.query,
        "op4_mix_sources": mixing.query,
        "op5_secret_scan": secrets.query,
        "op6_jaccard_join": jaccard.query,
        "op7_quality_ranking": quality.query,
        "op8_nearest_vectors": neighbours.query,
        "op9_quality_rules": rules.query,
        "op10_chat_format": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same rows."""
    return {
        "op2_url_filter": urls.SQL,
        "op4_mix_sources": mixing.SQL,
        "op5_secret_scan": secrets.SQL,
        "op6_jaccard_join": jaccard.SQL,
        "op9_quality_rules": rules.SQL,
        "op10_chat_format": chat.SQL,
    }
