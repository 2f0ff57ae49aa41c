"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from microtide.llm import decontaminate, hard_negatives, html_extract, jaccard, language_id, lm_score, mixing, pii, quality, secrets, token_counts, url_filter, whitening


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_html": html_extract.op2_html,
        "op3_mixing": mixing.op3_mixing,
        "op4_secrets": secrets.op4_secrets,
        "op5_language_id": language_id.op5_language_id,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_pii": pii.op8_pii,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_lm_score": lm_score.op10_lm_score,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_whitening": whitening.op12_whitening,
        "op13_url_filter": url_filter.op13_url_filter,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    """Where SQL can't express a result, tests hold the query against a brute-force version."""
    return {"op3_mixing": mixing.ORACLE_SQL, "op6_decontamination": decontaminate.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op13_url_filter": url_filter.ORACLE_SQL}
