"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from fieldlab.llm import op1_decontamination, op9_order_minhash, op10_warc, op11_whitening, op12_block_naming, op13_spelling, op2_pii, op3_license, op4_html, op5_packing, op6_jaccard, op7_line_dedup, op8_toxicity

OPERATORS = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_license": op3_license,
    "op4_html": op4_html,
    "op5_packing": op5_packing,
    "op6_jaccard": op6_jaccard,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_order_minhash": op9_order_minhash,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_block_naming": op12_block_naming,
    "op13_spelling": op13_spelling,
}
QUERIES = {name: module.query for name, module in OPERATORS.items()}
ORACLES = {name: module.ORACLE for name, module in OPERATORS.items() if hasattr(module, "ORACLE")}
