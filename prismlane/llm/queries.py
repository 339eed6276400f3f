"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from prismlane.llm import langid, leaks, linededup, mixing, neardup, quality, repetition, toxicity, urlfilter, webtext

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_wrapper_text": webtext.op2_wrapper_text,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_repetition_coverage": repetition.op7_repetition_coverage,
    "op8_hyperminhash": neardup.op8_hyperminhash,
    "op9_decontaminate": leaks.op9_decontaminate,
    "op10_url_vocabulary": urlfilter.op10_url_vocabulary,
}

#: Queries without SQL here are held against brute force or held-out rows in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op7_repetition_coverage": repetition.OP7_SQL,
    "op8_hyperminhash": neardup.OP8_SQL,
    "op10_url_vocabulary": urlfilter.OP10_SQL,
}
