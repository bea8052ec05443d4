"""Queries and their SQL by name; parsers of template documents; operations on masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Root element of a template document -> function from documents to structures.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: Name of a step -> function (mask, other masks, parameters, grid) to mask.
OPERATIONS: dict[str, Callable] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def register_parser(root: str):
    """Registers a parser of documents with that root element; a later one replaces an earlier one."""

    def register(f):
        PARSERS[root] = f
        return f

    return register


def register_operation(name: str):
    """Registers a step for mask pipelines; a later one replaces an earlier one."""

    def register(f):
        OPERATIONS[name] = f
        return f

    return register
