"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from aerolake.llm import exact_dedup, html_text, images, lm_scores, mixing, packing, quality, simhash, spelling, tokens, toxicity, vector_codes, warc


def queries() -> dict:
    """opN_<name> for each operator."""
    return {
        "op1_image_copies": images.op1_image_copies,
        "op2_simhash": simhash.op2_simhash,
        "op6_quality": quality.op6_quality,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": tokens.op8_token_counts,
        "op3_html_text": html_text.op3_html_text,
        "op4_mixing": mixing.op4_mixing,
        "op5_warc": warc.op5_warc,
        "op9_packing": packing.op9_packing,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_lm_scores": lm_scores.op11_lm_scores,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator."""
    return {"op5_warc": warc.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_spelling": spelling.ORACLE}
