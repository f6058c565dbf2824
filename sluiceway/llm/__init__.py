"""Operators of a training-data pipeline. Nothing else in the package imports this subpackage."""

from __future__ import annotations

from . import chat, decontaminate, language, line_dedup, main_text, near_dup, packing, quality, token_file, toxicity

MODULES = [line_dedup, token_file, decontaminate, toxicity, language, quality, chat, main_text, packing, near_dup]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
