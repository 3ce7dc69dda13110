"""The registered queries of the operators in this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["exact_dedup", "html_text", "language", "mixing", "mtree", "near_dedup", "packing", "repeats", "sstable", "toxicity"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"brookspan.llm.{_name}_queries")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
