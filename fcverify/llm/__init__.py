"""Operators of a training-data pipeline, each in its own module with its query.

``QUERIES`` and ``ORACLE_SQL`` gather what the modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["substring_dedup", "suffix_dedup", "near_dedup", "packing", "quality_rules", "decontamination", "secret_scan", "quality_classifier", "license_scan", "html_extraction",
           "token_alignment", "spelling_variants", "toxicity"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"fcverify.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
