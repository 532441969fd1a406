"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from regionspark.llm import byte_bpe, chat_formatting, divergence, fingerprints, html_extraction, jaccard_join, language_id, line_dedup, mixing, piece_bpe, quality_classifier, quality_rules, vector_codes

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": language_id.op2_language_id,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat_formatting": chat_formatting.op6_chat_formatting,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_piece_bpe": piece_bpe.op11_piece_bpe,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op6_chat_formatting": chat_formatting.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
