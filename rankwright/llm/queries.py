"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from rankwright.llm import bpe, decontaminate, hard_negatives, language, lm_score, near_dedup, pii, quality, secret_scan, spelling, suffix_dedup, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_lm_scoring": lm_score.op3_lm_scoring,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_id": language.op5_language_id,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_pii": pii.op7_pii,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_filters": urls.op10_url_filters,
    "op11_secrets": secret_scan.op11_secrets,
    "op12_spelling": spelling.op12_spelling,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_warc": warc.SQL_OP1,
    "op6_decontamination": decontaminate.SQL_OP6,
    "op8_suffix_dedup": suffix_dedup.SQL_OP8,
    "op9_near_dedup": near_dedup.SQL_OP9,
    "op11_secrets": secret_scan.SQL_OP11,
    "op12_spelling": spelling.SQL_OP12,
    "op13_hard_negatives": hard_negatives.SQL_OP13,
}
