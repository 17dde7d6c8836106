"""Rates, increases and quantiles of counters and histograms, over stored samples or a stream.

Samples: (series, ts, value, labels...). Values of a counter only grow, except for resets to zero. Nothing is
extrapolated to the edges of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The upper bounds of the duration buckets of requests, indexing and model calls, in seconds.
REQUEST_BOUNDS = (0.005, 0.025, 0.1, 0.5, 1.0, 5.0, 15.0, 60.0, 180.0)
INDEX_BOUNDS = (0.1, 1.0, 5.0, 15.0, 60.0, 180.0, 600.0, 1800.0)
MODEL_BOUNDS = (0.1, 0.5, 1.0, 5.0, 15.0, 30.0, 60.0, 120.0, 180.0)
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "TRACE", "CONNECT")


def deltas(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Samples with ``delta``: the growth since the sample before; after a reset all of the value. The first has none."""
    w = Window.partitionBy(*series).orderBy(ts)
    before = F.lag(value).over(w)
    grown = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("delta", grown)


def bounds(samples: DataFrame, width: str, slide: str | None = None, ts: str = "ts") -> Column:
    """The windows a sample falls into."""
    return F.window(ts, width, slide) if slide else F.window(ts, width)


def rate(grown: DataFrame, by: list[str], seconds: int = 300, slide_seconds: int | None = None, ts: str = "ts") -> DataFrame:
    """(window_start, by..., increase, rate): growth per window and per second, summed over series."""
    width, slide = f"{seconds} seconds", f"{slide_seconds} seconds" if slide_seconds else None
    grouped = grown.where(F.col("delta").isNotNull()).groupBy(bounds(grown, width, slide, ts).alias("w"), *by)
    out = grouped.agg(F.sum("delta").alias("increase"))
    return out.select(F.col("w.start").alias("window_start"), *by, F.round("increase", 6).alias("increase"), F.round(F.col("increase") / seconds, 9).alias("rate"))


def increase(grown: DataFrame, by: list[str]) -> DataFrame:
    """(by..., increase) over the whole range."""
    return grown.where(F.col("delta").isNotNull()).groupBy(*by).agg(F.round(F.sum("delta"), 6).alias("increase"))


def error_percentage(grown: DataFrame, failed: Column, seconds: int = 300, ts: str = "ts") -> DataFrame:
    """(window_start, percentage): failed share of the growth, zero where nothing failed, no row where nothing grew."""
    w = bounds(grown, f"{seconds} seconds", None, ts).alias("w")
    sums = grown.where(F.col("delta").isNotNull()).groupBy(w).agg(F.sum("delta").alias("every"), F.sum(F.when(failed, F.col("delta"))).alias("bad"))
    share = 100 * F.coalesce("bad", F.lit(0.0)) / F.col("every")
    return sums.where("every > 0").select(F.col("w.start").alias("window_start"), F.round(share, 6).alias("percentage"))


def latest(samples: DataFrame, series: list[str], ts: str = "ts") -> DataFrame:
    """The last sample of each series."""
    rest = [c for c in samples.columns if c not in series]
    return samples.groupBy(*series).agg(F.max_by(F.struct(*rest), ts).alias("s")).select(*series, "s.*")


def bucket_counts(observed: DataFrame, by: list[str], value: str, upper: tuple[float, ...]) -> DataFrame:
    """(by..., le, count): cumulative counts of observations up to each bound; the last bound is infinite."""
    counts = [F.count_if(F.col(value) <= b).cast("double") for b in upper] + [F.count(value).cast("double")]
    les = [F.lit(b) for b in upper] + [F.lit(float("inf"))]
    row = observed.groupBy(*by).agg(F.array(*[F.struct(le.alias("le"), c.alias("count")) for le, c in zip(les, counts)]).alias("b"))
    return row.select(*by, F.inline("b"))


def quantile(buckets: DataFrame, by: list[str], q: float = 0.95) -> DataFrame:
    """(by..., quantile): linear within the first bucket that reaches the rank, from 0 in the lowest.

    ``buckets``: (by..., le, count), cumulative. A rank in the infinite bucket gives the greatest finite bound. No
    observations, no row.
    """
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*by))
    rows = buckets.select(*by, "le", "count", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lower"),
                          F.coalesce(F.lag("count").over(w), F.lit(0.0)).alias("below"), total.alias("total"))
    reach = rows.where((F.col("total") > 0) & (F.col("count") >= q * F.col("total")))
    first = reach.withColumn("n", F.row_number().over(w)).where("n = 1")
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (q * F.col("total") - F.col("below")) / (F.col("count") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside)
    return first.select(*by, F.round(value, 6).alias("quantile"))


def stream_rates(samples: DataFrame, by: list[str], seconds: int = 300, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Streaming form of the rate: events counted per window once the watermark has passed it.

    ``samples`` is a stream of single events (a counter that grows by ``value``); late events within the watermark
    are counted, later ones dropped.
    """
    grouped = samples.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by)
    out = grouped.agg(F.sum("value").alias("increase"))
    return out.select(F.col("w.start").alias("window_start"), *by, "increase", (F.col("increase") / seconds).alias("rate"))


def stream_quantiles(observed: DataFrame, by: list[str], value: str, upper: tuple[float, ...], seconds: int = 300, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Streaming form of the buckets per window: (window_start, by..., buckets), ready for :func:`quantile`."""
    counts = F.array(*[F.count_if(F.col(value) <= b) for b in upper], F.count(value))
    grouped = observed.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by)
    return grouped.agg(counts.alias("buckets")).select(F.col("w.start").alias("window_start"), *by, "buckets")


_STATE = "last double, at timestamp"


def stream_deltas(samples: DataFrame, late: str = "10 minutes"):
    """Streaming growth of counters with resets, one state per series: (series, ts, delta)."""
    import pandas as pd

    def grow(key, frames, state):
        last = state.get[0] if state.exists else None
        at = state.get[1] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, value in zip(rows["ts"], rows["value"]):
            if at is not None and ts <= at:
                continue  # a repeated or older sample
            if last is not None:
                out.append((key[0], ts, value if value < last else value - last))
            last, at = float(value), ts
        if last is not None:
            state.update((last, at))
        yield pd.DataFrame(out, columns=["series", "ts", "delta"])

    return samples.withWatermark("ts", late).groupBy("series").applyInPandasWithState(
        grow, "series string, ts timestamp, delta double", _STATE, "append", "NoTimeout"
    )
