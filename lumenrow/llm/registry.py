"""Queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from lumenrow.llm import chat_format, mixing, near_dedup, neighbours, packing, quality_fm, quality_rules, sale_features, secret_scan, sentence_pieces, source_divergence, toxicity, url_filter

QUERIES = {
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op5_quality_classifier": quality_fm.op5_quality_classifier,
    "op1_toxicity": toxicity.op1_toxicity,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op4_chat_format": chat_format.op4_chat_format,
    "op6_url_filter": url_filter.op6_url_filter,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_sale_features": sale_features.op12_sale_features,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}
ORACLES = {
    "op4_chat_format": chat_format.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op12_sale_features": sale_features.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
