"""All queries of the library core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import core, service

flagship = core.flagship
assert service  # registers its queries beside those of core


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(core.SQL)
