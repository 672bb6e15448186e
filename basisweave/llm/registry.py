"""The registered queries of the text-corpus operators, and their SQL."""

from __future__ import annotations

from basisweave.llm import byte_bpe, decontaminate, filter_audit, hard_negatives, html_extract, line_dedup, lm_scoring, quality_classifier, quality_rules, sentencepiece_sampling, simhash_dedup, toxicity, url_filters

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_sentencepiece_sampling": sentencepiece_sampling.op6_sentencepiece_sampling,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": html_extract.op9_html_extraction,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL_BY_QUERY = {
    "op3_url_filters": url_filters.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
