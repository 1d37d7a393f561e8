"""Queries of the operators for training data."""

from __future__ import annotations

from importlib import import_module

MODULES = ("components_q", "caps_q", "sampling_q", "overlap_q", "form_duplicates_q", "tokens_q", "leaks_q", "encoding_q", "shared_spans_q")
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    _mod = import_module(f"loupe.llm.{_m}")
    QUERIES |= _mod.QUERIES
    SQL |= _mod.SQL
