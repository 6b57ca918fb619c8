"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, language, line_dedup, ngram_jaccard, packing, pii, quality, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op1_ablations": quality.op1_ablations,
        "op2_ngram_jaccard_join": ngram_jaccard.op2_ngram_jaccard_join,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_pii": pii.op4_pii,
        "op4_base_digest": pii.op4_base_digest,
        "op5_warc": warc.op5_warc,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
        "op8_language_id": language.op8_language_id,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }


def oracle_sql() -> dict:
    return {**quality.SQL, **ngram_jaccard.SQL, **pii.SQL, **warc.SQL, **line_dedup.SQL}
