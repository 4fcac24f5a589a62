"""Checks of physical plans: what a query reads and how it moves rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> int:
    """Shuffles of the plan, reused ones once."""
    return len(re.findall(r"\bExchange (?:hash|range|round|Single)", plan_of(df)))


def read_columns(df: DataFrame) -> set[str]:
    """Columns that the scans read."""
    return {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df)) for c in schema.split(",") if c}
