"""The operators' queries, each over its whole table, and the SQL to hold them against."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this subpackage that has the function of that name
_QUERIES = {
    "op10_licenses": "licenses",
    "op1_substring_dedup": "substrings",
    "op2_decontamination": "decontamination",
    "op3_lm": "lm",
    "op4_fingerprints": "fingerprints",
    "op5_token_counts": "token_counts",
    "op6_quality": "quality",
    "op7_jaccard": "jaccard",
    "op8_secrets": "secrets",
    "op9_packing": "packing",
}


def queries() -> dict:
    return {"pipeline": import_module("corpus_pipeline").run} | {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {}
