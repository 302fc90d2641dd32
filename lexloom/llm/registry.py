"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: query -> module
MODULES = {
    "op1_pii": "pii",
    "op2_line_dedup": "linededup",
    "op3_url_filter": "urlfilter",
    "op4_toxicity": "toxicity",
    "op5_decontamination": "decontam",
    "op6_fingerprints": "fingerprint",
    "op7_substring_dedup": "substring",
    "op8_suffix_dedup": "suffixdedup",
    "op9_simhash_dedup": "simhash",
    "op10_bpe": "bpe",
}


def queries() -> dict:
    return {name: import_module(f"lexloom.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(import_module(f"lexloom.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
