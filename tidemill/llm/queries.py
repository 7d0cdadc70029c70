"""Queries of this subpackage and their SQL, as the entry module registers them."""

from __future__ import annotations

from tidemill.llm import (
    divergence, language_id, line_dedup, minhash, mixing, packing, personal_data, quality_model, quality_rules, spelling, suffix_dedup, topk, warc,
)

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_language_id": language_id.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_mixing": mixing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_quality_classifier": quality_model.query,
    "op7_topk": topk.query,
    "op8_minhash": minhash.query,
    "op9_packing": packing.query,
    "op10_personal_data": personal_data.query,
    "op11_warc": warc.query,
    "op12_divergence": divergence.query,
    "op13_spelling": spelling.query,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op7_topk": topk.SQL,
    "op8_minhash": minhash.SQL,
    "op11_warc": warc.SQL,
    "op12_divergence": divergence.SQL,
}
