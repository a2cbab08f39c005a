"""Registered queries over the driver's tables, each with an independent SQL text where SQL can say it."""

import importlib

from checks.registry import ORACLES, QUERIES, oracle_sql, queries

for _name in ("q_sources", "q_quality", "q_slices", "q_features", "q_models", "q_ordering", "q_ledger", "q_explain", "q_stored", "q_recorded"):
    importlib.import_module(f"checks.{_name}")

__all__ = ["ORACLES", "QUERIES", "oracle_sql", "queries"]
