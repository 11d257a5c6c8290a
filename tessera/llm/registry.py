"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tessera.llm import attention_lm, conversation_repair, decontaminate, exact_dedup, language_id, license_scan, line_dedup, line_runs, near_dedup, packing, secret_scan, token_alignment, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_lm_scoring": attention_lm.op5_lm_scoring,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_language_id": language_id.op10_language_id,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_line_runs": line_runs.op12_line_runs,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL = {
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op12_line_runs": line_runs.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
