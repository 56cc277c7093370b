"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from rankeval.llm import bpe, chat, decontaminate, knn_quality, licences, line_dedup, ngram_join, quality_rules, secret_scan, spelling, suffix_dedup, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1,
        "op2_toxicity": toxicity.op2,
        "op3_license_scan": licences.op3,
        "op4_benchmark_decontamination": decontaminate.op4,
        "op5_chat_formatting": chat.op5,
        "op6_byte_level_bpe": bpe.op6,
        "op7_quality_rules": quality_rules.op7,
        "op8_suffix_array_dedup": suffix_dedup.op8,
        "op9_line_dedup": line_dedup.op9,
        "op10_quality_classifier": knn_quality.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_vector_codes": vector_codes.op12,
        "op13_secret_scan": secret_scan.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_secret_scan": secret_scan.ORACLE}
