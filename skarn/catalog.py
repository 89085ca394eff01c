"""Names of the core queries and their SQL; the training-data queries of the llm subpackage register there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.operators.quantities import p1_found
from skarn.operators.widening import p4_found
from skarn.queries import REGISTRY
from skarn import reads  # noqa: F401 - adds its queries to the registry

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p4_found": p4_found} | {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
