"""Evaluate retrieval from the command line: ``python -m strataloom.evaluate SET.json UNITS FILES --repository ID``.

Prints recall and reciprocal rank of the three ways to search, and with ``--write-baseline`` writes them as a report,
unless the reranker was missing or the control metrics moved. Nothing of the evaluated tables is changed or stored.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import evaluation, search
from .session import session
from .sources import evaluation as source


def evaluate(spark: SparkSession, path: str, units: DataFrame, repository_id: str, width: int, questions: int | None = 10) -> DataFrame:
    """(mode, questions, recall_at_k..., mrr) of the evaluation set in a file against located units of one repository."""
    asked, targets = source.read(spark, path, questions)
    made = asked.withColumn("query_vector", vectors.digest_vector(F.col("question"), width)).withColumn("repository_id", F.lit(repository_id))
    return evaluation.by_mode(units, made, targets, 10, width)


def summary(metrics: DataFrame) -> str:
    """One line per mode."""
    rows = sorted(metrics.collect(), key=lambda r: r["mode"])  # three modes
    shown = [c for c in metrics.columns if c not in ("mode", "questions")]
    return "\n".join(f"{r['mode']}: " + ", ".join(f"{c} {r[c]:.6f}" for c in shown) for r in rows)


def write_baseline(metrics: DataFrame, target: str, control: dict[str, float], fell_back: bool = False) -> None:
    """Write the report, or refuse: the control is what semantic search must give."""
    evaluation.guard(metrics.where("mode = 'semantic'"), control, fell_back)
    Path(target).write_text(source.report(metrics), encoding="utf-8")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The command."""
    parser = argparse.ArgumentParser(prog="strataloom.evaluate", description="Evaluate retrieval over stored units.")
    parser.add_argument("set")
    parser.add_argument("units")
    parser.add_argument("files")
    parser.add_argument("--repository", required=True)
    parser.add_argument("--width", type=int, default=384)
    parser.add_argument("--questions", type=int, default=10)
    parser.add_argument("--write-baseline", metavar="REPORT")
    parser.add_argument("--control", action="append", default=[], metavar="METRIC=VALUE", help="what semantic search must give")
    given = parser.parse_args(arguments)
    spark = spark or session()
    units = search.located(spark.read.parquet(given.units), spark.read.parquet(given.files))
    metrics = evaluate(spark, given.set, units, given.repository, given.width, given.questions).cache()
    print(summary(metrics))
    if given.write_baseline:
        control = {k: float(v) for k, _, v in (c.partition("=") for c in given.control)}
        try:
            write_baseline(metrics, given.write_baseline, control)
        except RuntimeError as e:
            print(f"not written: {e}")
            return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
