"""Loads the modules of this subpackage and hands out their queries and SQL."""

from __future__ import annotations

import importlib

from spendlens.llm.shared import QUERIES, SQL

MODULES = ["token_files", "packing", "merge_replay", "toxicity", "quality", "token_counts", "url_rules", "near_duplicates", "cover_tree", "bit_codes", "whitening",
           "spelling", "license_scan"]


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"spendlens.llm.{module}")
    return QUERIES, SQL
