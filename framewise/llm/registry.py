"""The queries of this subpackage and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from . import binary, collocations, decontaminate, lines, lm_score, main_text, ngram_join, packing, periodic, pii, quality, substring_dedup, topk


def queries() -> dict:
    return {
        "op1_lm_score": lm_score.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_top_k": topk.query,
        "op4_pii": pii.query,
        "op5_packing": packing.query,
        "op6_decontaminate": decontaminate.query,
        "op7_quality": quality.query,
        "op8_token_binary": binary.query,
        "op9_line_dedup": lines.query,
        "op10_ngram_join": ngram_join.query,
        "op11_periodic": periodic.query,
        "op12_collocations": collocations.query,
        "op13_main_text": main_text.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_score": lm_score.SQL,
        "op3_top_k": topk.SQL,
        "op9_line_dedup": lines.SQL,
        "op10_ngram_join": ngram_join.SQL,
        "op11_periodic": periodic.SQL,
        "op12_collocations": collocations.SQL,
    }
