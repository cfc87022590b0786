"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import ann, bpe, collocations, exact_dedup, hard_negatives, html_text, jaccard, language_id, packing, quality, substring_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_quality": quality.op2_quality,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_html_text": html_text.op4_html_text,
        "op5_warc": warc.op5_warc,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_bpe": bpe.op7_bpe,
        "op8_nearest": ann.op8_nearest,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_collocations": collocations.op11_collocations,
        "op12_language_id": language_id.op12_language_id,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.OP3_SQL,
        "op5_warc": warc.OP5_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op9_jaccard_join": jaccard.OP9_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
