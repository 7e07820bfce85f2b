"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from strandloom.llm import byte_bpe, decontamination, language_id, pii, quality_rules, simhash, substring_dedup, token_count, toxicity, warc

QUERIES: dict = {
    "op1_language_id": language_id.op1_language_id,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_token_count": token_count.op3_token_count,
    "op4_simhash": simhash.op4_simhash,
    "op5_pii": pii.op5_pii,
    "op6_warc": warc.op6_warc,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op6_warc": warc.OP6_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
}
