"""All queries of the library outside the training-data subpackage, with their DuckDB twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "par_result"
#: Modules that define QUERIES (name -> fn(spark, sf_dir)) and ORACLE (name -> SQL).
MODULES = ["graph_queries", "par_queries", "text_queries", "eval_queries", "review_queries", "experiment_queries", "intake_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= importlib.import_module(f"tessera.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"tessera.plans.{name}").ORACLE
    return found
