"""Evaluation sets and reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "version int, repository struct<type:string,name:string,path:string>, questions array<struct<id:string,"
    "category:string,question:string,expected_targets:array<struct<path:string,symbol:string>>>>"
)


def read(spark: SparkSession, path: str, questions: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """(questions, targets) of a file: (query_id, category, question), (query_id, target_no, path, symbol_name).

    A file of another version, with another number of questions, repeated ids, or a question without targets, fails.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    asked = raw.select("version", F.explode("questions").alias("q")).select("version", "q.*")
    facts = asked.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("version").alias("version"),
        F.count_if(F.coalesce(F.size("expected_targets"), F.lit(0)) < 1).alias("bare"),
    ).head()
    if facts["version"] != 1 or facts["bare"] or facts["ids"] != facts["n"] or questions not in (None, facts["n"]):
        raise ValueError("not a valid evaluation set")
    named = asked.withColumnRenamed("id", "query_id")
    targets = named.select("query_id", F.posexplode("expected_targets").alias("target_no", "t")).select(
        "query_id", "target_no", F.col("t.path").alias("path"), F.col("t.symbol").alias("symbol_name")
    )
    return named.select("query_id", "category", "question"), targets


def report(metrics: DataFrame, modes: str = "mode") -> str:
    """Metrics per mode as JSON of a stable layout: keys in the order of the columns, rounded, with a final line end."""
    import json

    rows = sorted(metrics.collect(), key=lambda r: r[modes])  # a few modes
    data = {r[modes]: {c: round(r[c], 6) if isinstance(r[c], float) else r[c] for c in metrics.columns if c != modes} for r in rows}
    return json.dumps(data, indent=2) + "\n"
