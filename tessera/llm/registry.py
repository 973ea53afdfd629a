"""Queries of the training-data operators, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this package that defines it
QUERIES = {
    "op7_line_dedup": "line_dedup",
    "op9_quality": "quality",
    "op10_licenses": "licenses",
    "op6_simhash": "simhash",
    "op8_language": "langid",
    "op2_html_text": "html_text",
    "op1_suffix_dedup": "suffix_dedup",
    "op3_bpe": "bpe",
    "op5_decontaminate": "decontaminate",
    "op4_token_counts": "token_counts",
    "op11_sentence_pieces": "sentence_pieces",
    "op12_whitening": "whitening",
    "op13_spelling": "spelling",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in QUERIES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}).get(name):
            found[name] = sql
    return found
