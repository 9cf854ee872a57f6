"""Named queries over the driver's tables, each with its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vigilog.plans.oracle import sql


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    check: str | None
    rows: str


QUERIES: dict[str, Query] = {}


def query(name: str, rows: str, check: str | None = None, blocks: dict[str, str] | None = None):
    """Register a query: `rows` names the inventory rows it covers, `blocks` the parts of its SQL that differ from the common ones."""
    def add(build):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = Query(build, None if check is None else sql(check, blocks), rows)
        return build
    return add
