"""Registered queries of the engine: name -> (query, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "a1_all_metrics"


def _modules() -> list:
    from tessera.plans import concepts, consolidation, control, geometry, lattice, lexical, memory, metrics, series, signals, streams, upkeep

    return [lexical, metrics, geometry, consolidation, signals, streams, series, control, upkeep, memory, concepts, lattice]


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _modules() for name, q in m.oracle_sql().items()}
