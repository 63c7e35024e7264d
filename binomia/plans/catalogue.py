"""The catalogue of named queries: one per operator, each with DuckDB oracle SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of queries; each has QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("q_names", "q_corpus", "q_streams")


@cache
def _modules() -> tuple:
    return tuple(import_module(f"binomia.plans.{m}") for m in MODULES)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLES
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["classify_full"](spark, sf_dir)
