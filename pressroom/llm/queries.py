"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

#: Query name: module of this package that defines it.
MODULES = {
    "op1_chat": "chat",
    "op2_token_file": "tokenfile",
    "op3_byte_bpe": "bpe",
    "op4_substring_dedup": "chunks",
    "op5_pii": "pii",
    "op6_long_repeats": "repeats",
    "op7_language_id": "langid",
    "op8_jaccard_join": "jaccard",
    "op9_quality": "quality",
    "op10_decontamination": "decontaminate",
    "op11_sharding": "shards",
    "op12_collocations": "collocations",
    "op13_merkle": "merkle",
}


def queries() -> dict:
    found = {name: getattr(import_module(f"pressroom.llm.{module}"), name) for name, module in MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"pressroom.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}
