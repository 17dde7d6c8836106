"""What is measured: metric samples from logs of requests, indexing runs, searches and model calls, and their text form.

Logs are tables or streams with one row per event; samples are (ts, metric, labels, value). Labels are bounded: nothing
a caller sends becomes one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import status_class
from .metrics import INDEX_BOUNDS, METHODS, MODEL_BOUNDS, REQUEST_BOUNDS

OUTCOMES = ("success", "error", "cancelled")
MODEL_OUTCOMES = ("success", "timeout", "unavailable", "response_error", "error", "cancelled")
#: Kind of metric: name -> (bounds or None for a counter, labels).
FAMILIES: dict[str, tuple[tuple[float, ...] | None, tuple[str, ...]]] = {
    "http_requests_total": (None, ("method", "route", "status_class")),
    "http_request_duration_seconds": (REQUEST_BOUNDS, ("method", "route", "status_class")),
    "indexing_executions_total": (None, ("mode", "outcome")),
    "indexing_duration_seconds": (INDEX_BOUNDS, ("mode", "outcome")),
    "indexing_files_hashed_total": (None, ()),
    "indexing_code_units_parsed_total": (None, ()),
    "retrieval_duration_seconds": (REQUEST_BOUNDS, ("pipeline", "outcome")),
    "llm_request_duration_seconds": (MODEL_BOUNDS, ("outcome",)),
}


def method(name: Column) -> Column:
    """A known HTTP method, or OTHER."""
    return F.when(name.isin(*METHODS), name).otherwise("OTHER")


def route(path: Column, routes: dict[str, str]) -> Column:
    """The template of the first route whose pattern a path matches, or ``unmatched``; never the path itself."""
    found = F.lit("unmatched")
    for template, pattern in reversed(routes.items()):
        found = F.when(path.rlike(pattern), template).otherwise(found)
    return found


def requests(log: DataFrame, routes: dict[str, str], own: str = "/metrics") -> DataFrame:
    """Events of HTTP requests (ts, method, path, status, ended, seconds): (ts, seconds, method, route, status_class).

    Requests for the metrics themselves are none. ``ended`` is ``done``, ``cancelled`` or ``error``: an error before any
    status is a 5xx, one after it left the response incomplete.
    """
    ended = F.coalesce("ended", F.lit("done"))
    shown = (
        F.when(ended == "cancelled", "cancelled")
        .when((ended == "error") & F.col("status").isNull(), "5xx")
        .when((ended == "error") | F.col("status").isNull(), "incomplete")
        .otherwise(status_class(F.col("status")))
    )
    kept = log.where(~F.coalesce(F.col("path") == own, F.lit(False)))
    return kept.select("ts", "seconds", method(F.col("method")).alias("method"), route(F.col("path"), routes).alias("route"), shown.alias("status_class"))


def outcome(name: Column, allowed: tuple[str, ...] = OUTCOMES) -> Column:
    """A known outcome, or error."""
    return F.when(name.isin(*allowed), name).otherwise("error")


def samples(events: DataFrame, metric: str, value: str | None = None, every: str = "15 seconds") -> DataFrame:
    """(ts, metric, labels, value) at the end of every scrape interval in which a series grew, cumulated from the start.

    Counters count events, or sum ``value``; durations give the cumulative ``_bucket`` series of their bounds, ``_sum``
    and ``_count``. Negative durations count as zero. One aggregation per interval, then running sums over the much
    smaller table of intervals.
    """
    bounds, labels = FAMILIES[metric]
    at = F.window("ts", every)["end"].alias("ts")
    named = F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c))]) if labels else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    if bounds is None:
        grown = events.groupBy(at, *labels).agg(F.coalesce(F.sum(value) if value else F.count("*"), F.lit(0)).cast("double").alias("v"))
        run = Window.partitionBy(*labels, F.lit(0)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return grown.select("ts", F.lit(metric).alias("metric"), named.alias("labels"), F.sum("v").over(run).alias("value"))
    seconds = F.greatest(F.col(value or "seconds"), F.lit(0.0))
    counts = [F.count_if(seconds <= b).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)]
    grown = events.where(F.col(value or "seconds").isNotNull()).groupBy(at, *labels).agg(*counts, F.count("*").cast("double").alias("n"), F.sum(seconds).alias("total"))
    run = Window.partitionBy(*labels, F.lit(0)).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    added = grown.select("ts", named.alias("labels"), *[F.sum(c).over(run).alias(c) for c in [*[f"b{i}" for i in range(len(bounds))], "n", "total"]])
    text = lambda b: str(int(b)) + ".0" if float(b).is_integer() else str(b)
    row = lambda suffix, labels_, v: F.struct(F.lit(metric + suffix).alias("metric"), labels_.alias("labels"), v.alias("value"))
    le = lambda b: F.map_concat("labels", F.create_map(F.lit("le"), F.lit(b)))
    parts = [row("_bucket", le(text(b)), F.col(f"b{i}")) for i, b in enumerate(bounds)]
    parts += [row("_bucket", le("+Inf"), F.col("n")), row("_count", F.col("labels"), F.col("n")), row("_sum", F.col("labels"), F.col("total"))]
    return added.select("ts", F.inline(F.array(*parts)))


def exposition(rows: DataFrame) -> DataFrame:
    """(line): the last sample of every series in the text format that scrapers read, in order of metric and labels."""
    key = F.to_json(F.array_sort(F.map_entries("labels")))
    last = rows.groupBy("metric", key.alias("k")).agg(F.max_by(F.struct("labels", "value"), "ts").alias("s"))
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("s.labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    shown = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return last.orderBy("metric", "k").select(F.concat("metric", shown, F.lit(" "), F.col("s.value").cast("string")).alias("line"))


def retained(rows: DataFrame, days: int = 7) -> DataFrame:
    """Samples not older than the newest by more than so many days."""
    newest = rows.agg(F.max("ts").alias("newest"))
    return rows.join(newest, F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("newest")


def scrape(events: DataFrame, handle, checkpoint: str, every: str = "15 seconds"):
    """A running stream that hands the events of every interval to ``handle(batch, number)``, exactly once per number."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
