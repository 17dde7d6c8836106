"""The one total order of code units, and limits over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows a search, a page of units and a page of repositories may ask for.
MAX_LIMIT, MAX_UNITS, MAX_REPOSITORIES = 100, 500, 100


def canonical(*scores: Column) -> list[Column]:
    """The scores, then path, start, the longer unit first, kind, id: no two units are equal."""
    return [
        *scores,
        F.col("path").asc_nulls_last(),
        F.col("start_line").asc_nulls_last(),
        F.col("end_line").desc_nulls_last(),
        F.col("kind").asc_nulls_last(),
        F.col("code_unit_id").asc_nulls_last(),
    ]


def check_limit(limit: int, most: int = MAX_LIMIT) -> int:
    """The limit, if it is one."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must be an integer from 1 to {most}")
    return limit


def top(df: DataFrame, order: list[Column], limit: int, by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first rows in an order, per group if groups are given, with their 1-based rank.

    Per group this is a window of which Spark keeps only the first rows before it shuffles; over all rows it is a
    sorted limit that never sorts more than ``limit`` rows a task.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)
    first = df.orderBy(*order).limit(limit)
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def look_ahead(df: DataFrame, order: list[Column], limit: int, by: list[str]) -> DataFrame:
    """The first ``limit`` rows of each group and whether there are more (``truncated``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit + 1)
    more = F.max("rank").over(Window.partitionBy(*by)) > limit
    return kept.withColumn("truncated", more).where(F.col("rank") <= limit)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = MAX_UNITS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order."""
    check_limit(limit, most)
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def in_requested_order(requested: DataFrame, rows: DataFrame, key: str, position: str = "position") -> DataFrame:
    """The rows of requested keys in the order of the request; a key requested twice comes twice, an unknown one fails."""
    known = rows.withColumn("_known", F.lit(True))
    both = requested.join(known, key, "left")
    lost = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no such row: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
    return both.where(lost).drop("_known").orderBy(position)
