"""One query per operator, over whole tables with production parameters, and the SQL where there is one."""

from __future__ import annotations

from . import bpe, decontaminate, html_extract, line_dedup, minhash, pii, quality, substring_dedup, suffix_dedup, token_store

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1,
    "op2_byte_level_bpe": bpe.op2,
    "op3_suffix_array_dedup": suffix_dedup.op3,
    "op4_quality_rules": quality.op4,
    "op5_minhash_near_dedup": minhash.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_pii_pseudonyms": pii.op7,
    "op8_html_extraction": html_extract.op8,
    "op9_token_store": token_store.op9,
    "op10_line_dedup": line_dedup.op10,
}
ORACLE_SQL = {
    "op4_quality_rules": quality.OP4_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
