"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, decontam, language_id, licences, line_dedup, media, mixing, near_dedup, periodic, token_counts, token_output, toxicity, vector_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_token_output": token_output.op2_token_output,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_media": media.op6_media,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_licences": licences.op9_licences,
    "op10_mixing": mixing.op10_mixing,
    "op11_vector_dedup": vector_dedup.op11_vector_dedup,
    "op12_alignment": alignment.op12_alignment,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op10_mixing": mixing.oracle()}
