"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnstile.plans import dashboard, domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**dashboard.QUERIES, **domain.QUERIES}
ORACLES: dict[str, str] = {**dashboard.ORACLES, **domain.ORACLES}
