"""All queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import blocks, content, copies, links, references, streams, worked

MODULES = (references, blocks, copies, content, links, streams, worked)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}
