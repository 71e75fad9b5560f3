"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from kelpline.llm import op1_quality, op2_pii, op3_html, op4_lm, op5_mixing, op6_binary, op7_embeddings, op8_licenses, op9_neardup, op10_packing

QUERIES = {
    "op1_quality_rules": op1_quality.op1_quality_rules,
    "op2_pii": op2_pii.op2_pii,
    "op3_html": op3_html.op3_html,
    "op4_lm_scores": op4_lm.op4_lm_scores,
    "op5_mixing": op5_mixing.op5_mixing,
    "op6_binary": op6_binary.op6_binary,
    "op7_embedding_dedup": op7_embeddings.op7_embedding_dedup,
    "op8_licences": op8_licenses.op8_licences,
    "op9_near_dedup": op9_neardup.op9_near_dedup,
    "op10_packing": op10_packing.op10_packing,
}
SQL = {"op8_licences": op8_licenses.sql()}
