"""Queries of the corpus operators and the SQL of those that SQL expresses."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in _MODULES:
        module = importlib.import_module(f"quillspark.llm.queries.{name}")
        found[module.NAME] = module.query
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in _MODULES:
        module = importlib.import_module(f"quillspark.llm.queries.{name}")
        if module.SQL:
            found[module.NAME] = module.SQL
    return found
