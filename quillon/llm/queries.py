"""The queries of this subpackage, by name, and the SQL that states those SQL can."""

from __future__ import annotations

import importlib

_MODULES = ("html", "order_minhash", "ngram_join", "recompression", "toxicity", "quality", "packing", "licenses", "embeddings", "mixing")


def queries() -> dict:
    out = {}
    for name in _MODULES:
        module = importlib.import_module(f"quillon.llm.{name}")
        out |= {k: f for k, f in vars(module).items() if k.startswith("op") and k[2].isdigit() and callable(f)}
    from quillon.llm.chain import pipeline

    return out | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in _MODULES:
        out |= getattr(importlib.import_module(f"quillon.llm.{name}"), "ORACLE", {})
    return out
