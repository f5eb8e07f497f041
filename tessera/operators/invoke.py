"""The operator registry: functions by name, and compositions defined by data.

A composition is an ordered list of (operator, arguments); a step's own
arguments override the caller's. Cycles and depths over 16 are refused. A source
is a declared reader of parquet. What is plugged in from outside keeps to one of
the protocols below.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import consolidate, index, maintenance, metrics, writers
from tessera.sources.ingest import Declared, records

DEPTH = 16


class Embedder(Protocol):
    """Makes vectors of texts: a column function, its width and its name."""

    model_id: str
    dim: int

    def encode(self, texts: Column) -> Column: ...


class Engine(Protocol):
    """Answers a question from the rows that were found for it, a bounded top list."""

    def answer(self, query: str, rows: list[Any]) -> str: ...


class Refill(Protocol):
    """Gives rows (id, vec, cell) of cells that are not held here."""

    def fetch(self, missing: DataFrame) -> DataFrame: ...


def refilled(held: DataFrame, wanted: DataFrame, source: Refill) -> DataFrame:
    """held (id, vec, cell) with the rows of wanted cells (cell) that it lacks, fetched from a source."""
    missing = wanted.select("cell").distinct().join(held.select("cell").distinct(), "cell", "left_anti")
    return held.unionByName(source.fetch(missing))


class Registry:
    def __init__(self) -> None:
        self._functions: dict[str, Callable[..., Any]] = {}
        self._compositions: dict[str, list[tuple[str, dict]]] = {}

    def register(self, name: str, function: Callable[..., Any]) -> None:
        self._functions[name] = function

    def define(self, name: str, steps: list[tuple[str, dict]]) -> None:
        if name in self._functions:
            raise ValueError(f"{name} is built in")
        self._compositions[name] = list(steps)

    def source(self, spark: SparkSession, name: str, path: str, spec: Declared) -> None:
        """Define a source: invoking it reads the records of a parquet path."""
        self.register(name, lambda **_: records(spark.read.parquet(path), spec))

    def names(self) -> list[str]:
        return sorted([*self._functions, *self._compositions])

    def invoke(self, name: str, **arguments: Any) -> Any:
        """The result of an operator; of a composition the result of its last step, each step given the one before as ``df``."""
        return self._run(name, arguments, ())

    def _run(self, name: str, arguments: dict, path: tuple[str, ...]) -> Any:
        if name in path:
            raise ValueError("cycle: " + " > ".join([*path, name]))
        if len(path) >= DEPTH:
            raise ValueError(f"deeper than {DEPTH}")
        if name in self._functions:
            return self._functions[name](**arguments)
        if name not in self._compositions:
            raise KeyError(name)
        result, given = None, dict(arguments)
        for step, own in self._compositions[name]:
            result = self._run(step, given | own, (*path, name))
            given = given | {"df": result}
        return result


#: What a node offers without being told: consolidations, readings and upkeep, each on artifacts given as ``df``.
CONSOLIDATIONS = {"op.exact": consolidate.exact_groups, "op.archive": lambda df: consolidate.archived(df)[0], "op.merge": lambda df, group="content_ref": consolidate.merge(df, group)}
CONTROLS = {
    "op.metrics": lambda df: metrics.all_metrics(df, metrics.consolidated(df)), "op.audit": metrics.audit_provenance, "op.backfill": metrics.backfill_provenance,
    "op.types": metrics.types_and_fitness, "op.fields": index.fields, "op.sketch": lambda df: maintenance.sketches(df.select(F.col("content_ref").alias("ref"), F.col("content").alias("body"))),
    "op.mint": writers.minted, "op.seal": lambda df: writers.sealed(df)[0],
}


def standard() -> Registry:
    """A registry with all controls and consolidations."""
    r = Registry()
    for name, function in (CONTROLS | CONSOLIDATIONS).items():
        r.register(name, lambda df, f=function, **_: f(df))
    return r
