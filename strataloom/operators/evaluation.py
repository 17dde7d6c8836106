"""Quality of retrieval: recall at k, reciprocal rank, averages over questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import search

KS = (1, 3, 5, 10)


def hits(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_no, rank): first rank at which each target was found.

    ``targets``: (query_id, target_no, path, symbol_name); a null symbol is met by any unit of the file.
    """
    t = targets.select("query_id", "target_no", "path", F.col("symbol_name").alias("want"))
    met = results.select("query_id", "path", "symbol_name", "rank").join(t, ["query_id", "path"])
    met = met.where(F.col("want").isNull() | (F.col("symbol_name") == F.col("want")))
    return met.groupBy("query_id", "target_no").agg(F.min("rank").alias("rank"))


def per_question(results: DataFrame, targets: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(query_id, recall_at_k..., reciprocal_rank, first_rank); questions without a hit count with zeros."""
    if not ks or min(ks) <= 0:
        raise ValueError("k must be positive")
    total = targets.groupBy("query_id").agg(F.countDistinct("target_no").alias("targets"))
    found = hits(results, targets).groupBy("query_id").agg(
        F.min("rank").alias("first_rank"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks]
    )
    both = total.join(found, "query_id", "left")
    return both.select(
        "query_id",
        *[F.round(F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.col("targets"), 6).alias(f"recall_at_{k}") for k in ks],
        F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.col("first_rank"),
    )


def macro(metrics: DataFrame, ks: tuple[int, ...] = KS, by: list[str] | None = None) -> DataFrame:
    """Averages over questions, each counting the same."""
    columns = [F.round(F.avg(f"recall_at_{k}"), 6).alias(f"recall_at_{k}") for k in ks]
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("questions"), *columns, F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def by_mode(units: DataFrame, questions: DataFrame, targets: DataFrame, limit: int = 10, width: int | None = None) -> DataFrame:
    """(mode, questions, recall_at_k..., mrr) of semantic, hybrid and reranked search, over all questions at once."""
    depth = min(search.HYBRID_DEPTH * min(search.RERANK_DEPTH * limit, 100), 100)
    s = durable(search.semantic(units, questions, depth, width=width))  # each search runs once, to the greatest depth
    x = durable(search.lexical(units, questions, depth))
    targets = durable(targets)
    first = lambda df, n: df.where(F.col("rank") <= n)
    shallow, wide = search.HYBRID_DEPTH * limit, min(search.RERANK_DEPTH * limit, 100)
    modes = {
        "semantic": first(s, limit),
        "hybrid": search.fuse(first(s, shallow), first(x, shallow), limit),
        "reranked": search.rerank(search.fuse(s, x, wide), units, questions, limit),
    }
    rows = [per_question(results, targets).withColumn("mode", F.lit(mode)) for mode, results in modes.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return macro(out, by=["mode"])


def guard(control: DataFrame, expected: dict[str, float], fell_back: bool) -> None:
    """Refuse to write a baseline when the reranker was missing or the control metrics moved."""
    if fell_back:
        raise RuntimeError("the reranker was not available")
    row = control.head()
    moved = {k: row[k] for k, v in expected.items() if row is None or abs(row[k] - v) > 1e-6}
    if moved:
        raise RuntimeError(f"control metrics moved: {moved}")
