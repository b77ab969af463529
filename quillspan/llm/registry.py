"""The queries of the corpus operators and their SQL, collected from the operators' modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("factorisation", "pivots", "packing", "order_minhash", "line_dedup", "warc", "phrases", "secrets", "quality_rules", "bpe")


def _collected(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"quillspan.llm.{module}"), name)
    return out


def queries() -> dict:
    return _collected("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collected("ORACLE_SQL")
