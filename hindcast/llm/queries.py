"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, conversations, exact_dedup, html_text, mixing, near_dedup, packing, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_html_text": html_text.op7_html_text,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_cross_tokenizer": alignment.op11_cross_tokenizer,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.url_sql(),
        "op5_quality_rules": quality_rules.quality_sql(),
        "op10_exact_dedup": exact_dedup.OP10_SQL,
    }
