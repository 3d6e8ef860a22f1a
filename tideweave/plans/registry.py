"""All queries over the supplied tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideweave.plans import documents, graphs, lattices, protocols, streams

_PARTS = (lattices, graphs, documents, protocols, streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
