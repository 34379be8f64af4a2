"""Queries and SQL oracles of the library's own operators, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import association, evaluation, evidence, inputs, location, monitoring, scalars

_ALL = location.QUERIES | monitoring.QUERIES | association.QUERIES | evaluation.QUERIES | evidence.QUERIES | scalars.QUERIES | inputs.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
