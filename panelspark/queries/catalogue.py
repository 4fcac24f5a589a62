"""Collects the queries and SQL that the family modules register."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("chains", "linkage", "measures", "texts", "resolving", "evaluating", "layers", "printed", "routines", "obligations", "modelling", "reading", "records", "holdings")


def _collect(name: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"panelspark.queries.{family}"), name)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged |= part
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
