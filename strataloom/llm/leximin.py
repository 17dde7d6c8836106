"""One ranking from several differently-scaled scores.

Leximin: every score becomes a percentile within its query, an item's percentiles are sorted ascending, and items are
compared by these arrays lexicographically, so a weak score cannot be masked by a strong one and no score counts more
because its range is larger.

``fair_top`` gives the k items of which each beats every item outside in a majority of the scores. Such an item may be
last in a score that the majority can do without, so here the vectors are compared from the weakest score of the best
majority on, and what is weaker breaks ties: leximin over a majority. Its first k items are the answer nearly always; an
exact check of the few items that can belong to the top settles the rest.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Items of one query that are compared with each other at once.
BLOCK = 256
#: Items of a query from which on its positions come from a sort over many tasks instead of one.
HOT = 200_000


def _known(score: Column, higher: bool) -> Column:
    """The score with higher as better; null for NaN."""
    value = score.cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return value if higher else -value


def _distinct_items(df: DataFrame, query: str, item: str, scores: dict[str, bool]) -> DataFrame:
    """One row per item of a query. Repeats count once; of differing repeats the best known value of each score."""
    return df.groupBy(F.col(query).alias("query_id"), F.col(item).alias("item_id")).agg(
        *[F.max(_known(F.col(name), higher)).alias(f"s{i}") for i, (name, higher) in enumerate(scores.items())]
    )


def _percentiles(items: DataFrame, count: int) -> DataFrame:
    """(query_id, item_id, percentiles): the share of the query's items that are strictly worse, per score.

    A missing score is worse than any number and equal to another missing one. Queries of ordinary size are ranked
    each within a task, with one shuffle for all scores; those above HOT by a sort over many tasks. Both give the same.
    """
    sizes = items.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = durable(sizes.select(F.col("query_id").alias("hot_id")))
    if hot.isEmpty():
        return _within_tasks(items, count)
    same = F.col("query_id").eqNullSafe(F.col("hot_id"))
    cold = _within_tasks(items.join(hot, same, "left_anti"), count)
    return cold.unionByName(_over_tasks(items.join(hot, same, "left_semi"), count))


def _within_tasks(items: DataFrame, count: int) -> DataFrame:
    """Percentiles by window functions that all share one partitioning."""
    query = Window.partitionBy("query_id")
    others = F.greatest(F.count("*").over(query) - 1, F.lit(1))
    worse = lambda i: F.rank().over(query.orderBy(F.col(f"s{i}").asc_nulls_first())) - 1
    return items.select(
        "query_id", "item_id", F.count("*").over(query).alias("items"), *[(worse(i) / others).alias(f"p{i}") for i in range(count)]
    )


def _over_tasks(items: DataFrame, count: int) -> DataFrame:
    """Percentiles from one global sort by (query, score, value): each range partition counts its rows, the counts give
    every partition its offset, and no query ever has to fit into one task."""
    long = items.select(
        "query_id",
        "item_id",
        F.explode(F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"s{i}").alias("value")) for i in range(count)])).alias(
            "s"
        ),
    ).select("query_id", "item_id", "s.score", "s.value")
    # equal values share a position, so they are counted first and only distinct values are ranked
    counts = long.groupBy("query_id", "score", "value").agg(F.count("*").alias("n"))
    ordered = durable(
        counts.repartitionByRange(F.col("query_id"), F.col("score"), F.col("value").asc_nulls_first()).withColumn(
            "part", F.spark_partition_id()
        )
    )
    inside = Window.partitionBy("part", "query_id", "score").orderBy(F.col("value").asc_nulls_first())
    before = Window.partitionBy("query_id", "score").orderBy("part")
    offsets = (
        ordered.groupBy("query_id", "score", "part")
        .agg(F.sum("n").alias("m"))
        .withColumn("offset", F.sum("m").over(before) - F.col("m"))
        .withColumn("total", F.sum("m").over(Window.partitionBy("query_id", "score")))
        .select(F.col("query_id").alias("q"), F.col("score").alias("s"), F.col("part").alias("p"), "offset", "total")
    )
    here = F.col("query_id").eqNullSafe(F.col("q")) & (F.col("score") == F.col("s")) & (F.col("part") == F.col("p"))
    ranked = (
        ordered.withColumn("worse", F.sum("n").over(inside) - F.col("n"))
        .join(offsets, here)
        .select(
            "query_id",
            "score",
            "value",
            ((F.col("worse") + F.col("offset")) / F.greatest(F.col("total") - 1, F.lit(1))).alias("percentile"),
            "total",
        )
    )
    same = (
        (long["query_id"].eqNullSafe(ranked["query_id"]))
        & (long["score"] == ranked["score"])
        & (long["value"].eqNullSafe(ranked["value"]))
    )
    each = long.join(ranked, same).select(long["query_id"], long["item_id"], long["score"], ranked["percentile"], ranked["total"])
    return each.groupBy("query_id", "item_id").agg(
        F.max("total").alias("items"),
        *[F.max(F.when(F.col("score") == i, F.col("percentile"))).alias(f"p{i}") for i in range(count)]
    )


def leximin(df: DataFrame, query: str, item: str, scores: dict[str, bool]) -> DataFrame:
    """(query_id, item_id, items, percentiles, leximin): how many items the query has, the percentiles in the order of
    ``scores``, and the same sorted.

    ``scores`` maps column names to whether higher is better. Ordering by ``leximin`` descending is the ranking; ties
    are broken by item_id. Repeated rows count once, a null or NaN score has percentile 0 unless all are missing, a
    query with one item gives percentiles of 0, an empty table gives no rows. Null query or item ids are kept as a
    group and an item of their own.
    """
    n = len(scores)
    ranked = _percentiles(_distinct_items(df, query, item, scores), n)
    vector = F.array(*[F.col(f"p{i}") for i in range(n)])
    return ranked.select(
        "query_id", "item_id", "items", vector.alias("percentiles"), F.array_sort(vector).alias("leximin")
    )


def leximin_top(ranked: DataFrame, k: int) -> DataFrame:
    """The first k items of each query in leximin order, with their 1-based rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("leximin").desc(), F.col("item_id").asc())
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _beats(p: np.ndarray) -> np.ndarray:
    """beats[a, b]: a is strictly better than b in a majority of the scores."""
    wins = (p[:, None, :] > p[None, :, :]).sum(axis=2)
    return wins * 2 > p.shape[1]


def _order(p: np.ndarray) -> np.ndarray:
    """Positions in leximin order over a majority: the scores that a majority can do without count last."""
    v = np.sort(p, axis=1)
    spare = (p.shape[1] - 1) // 2
    keys = [*range(spare, p.shape[1]), *range(spare)]
    return np.lexsort([-v[:, i] for i in reversed(keys)])


def _survivors(p: np.ndarray, k: int) -> np.ndarray:
    """Positions that fail to beat fewer than k others of their block, in order, blocks taken again until one is left."""
    keep = _order(p)
    while True:
        parts = [keep[i : i + BLOCK] for i in range(0, len(keep), BLOCK)]
        left = np.concatenate([b[(~_beats(p[b])).sum(axis=1) - 1 < k] for b in parts]) if parts else keep
        if len(parts) <= 1 or len(left) == len(keep):
            return left
        keep = left


def _chosen(p: np.ndarray, k: int) -> tuple[np.ndarray, bool]:
    """The k positions that each beat every other in a majority; if there are no such, the first k in order."""
    if len(p) <= k:
        return np.arange(len(p)), True
    left = _survivors(p, k)
    if len(left) >= k:
        found = _dominant(_beats(p[left]), k) if len(left) > k else np.arange(k)
        if found is not None:
            inside = left[found]
            outside = np.setdiff1d(np.arange(len(p)), inside)
            if ((p[inside][:, None, :] > p[outside][None, :, :]).sum(axis=2) * 2 > p.shape[1]).all():
                return inside, True
    return _order(p)[:k], False


def _pick(batches, k: int, last: bool):
    """Of every row's list of (item_id, percentiles) the items that may belong to the top; with ``last`` the top itself."""
    for batch in batches:
        found = batch.column(1)
        items, offsets = found.values, found.offsets.to_numpy()
        names, vectors, could = items.field("item_id"), items.field("percentiles"), items.field("could")
        able = could.to_numpy(zero_copy_only=False)
        flat = vectors.values.to_numpy(zero_copy_only=False)
        starts = vectors.offsets.to_numpy()
        width = int(starts[1] - starts[0]) if len(vectors) else 1
        p = flat[starts[0] : starts[-1]].reshape(-1, width) if len(vectors) else np.empty((0, 1))
        rows, at, exact = [], [], []
        for i in range(len(found)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if last:
                kept, sure = _chosen(p[a:b], k)
                sure = sure and bool(able[kept + a].all())
            else:
                kept, sure = np.union1d(_survivors(p[a:b], k), _order(p[a:b])[:k]), False
            rows.append(np.full(len(kept), i))
            at.append(kept + a)
            exact.append(np.full(len(kept), sure))
        row = pa.array(np.concatenate(rows) if rows else np.empty(0, dtype=np.int64))
        which = pa.array(np.concatenate(at) if at else np.empty(0, dtype=np.int64))
        out = [batch.column(0).take(row), names.take(which)]
        if last:
            out.append(pa.array(np.concatenate(exact) if exact else np.empty(0, dtype=bool)))
        else:
            out += [vectors.take(which), could.take(which)]
        yield pa.RecordBatch.from_arrays(out, names=["query_id", "item_id", *(["exact"] if last else ["percentiles", "could"])])


def _dominant(beats: np.ndarray, k: int) -> np.ndarray | None:
    """The k positions of which each beats all others outside.

    Grown from every possible first member: whatever a member fails to beat must be a member too.
    """
    n = len(beats)
    np.fill_diagonal(beats, True)
    for first in range(n):
        inside = {first}
        todo = [first]
        while todo and len(inside) <= k:
            for b in np.flatnonzero(~beats[todo.pop()]):
                if b not in inside:
                    inside.add(int(b))
                    todo.append(int(b))
        if len(inside) > k:
            continue
        # closed below k: extend by the closure of the smallest possible next member
        rest = sorted(set(range(n)) - inside, key=lambda i: (~beats[i]).sum())
        for more in rest:
            if len(inside) == k:
                break
            grown, todo = inside | {more}, [more]
            while todo and len(grown) <= k:
                for b in np.flatnonzero(~beats[todo.pop()]):
                    if b not in grown:
                        grown.add(int(b))
                        todo.append(int(b))
            if len(grown) <= k:
                inside = grown
        if len(inside) == k:
            return np.array(sorted(inside))
    return None


def fair_top(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, exact): of each query the k items that each beat every item outside in most scores.

    ``ranked`` is the result of :func:`leximin`. Where no such k items exist ``exact`` is false and the first k in
    leximin order over a majority are given; queries of at most k items give all of them. Members are compared with the
    items that are looked at: if k such items exist at all, they are these.

    A member beats all but k - 1 others in a majority of m scores, so over all scores it is better than m * (n - k)
    others, counted once a score; only such items, and the first k in leximin order, are looked at. Their lists are
    split into parts of bounded size, which leave at most 2k - 1 items each, or 3k - 1 with the first k, and then the
    parts of a query are put together.
    """
    kind = dict(ranked.dtypes)
    vector = F.col("percentiles")
    m = F.floor(F.size(vector) / 2) + 1
    better = F.round(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x) * F.greatest(F.col("items") - 1, F.lit(1)))
    first = Window.partitionBy("query_id").orderBy(*_majority_order(), F.col("item_id").asc())
    slim = ranked.withColumn("_first", F.row_number().over(first))
    slim = slim.withColumn("could", (better >= m * (F.col("items") - k)) | (F.col("items") <= k))
    slim = slim.where(F.col("could") | (F.col("_first") <= k))
    part = F.pmod(F.xxhash64("item_id"), F.ceil(F.col("items") / BLOCK).cast("long"))
    lists = slim.groupBy("query_id", part.alias("part")).agg(F.collect_list(F.struct("item_id", "percentiles", "could")).alias("found"))
    fields = f"query_id {kind['query_id']}, item_id {kind['item_id']}"
    kept = lists.select("query_id", "found").mapInArrow(partial(_pick, k=k, last=False), f"{fields}, percentiles array<double>, could boolean")
    whole = kept.groupBy("query_id").agg(F.collect_list(F.struct("item_id", "percentiles", "could")).alias("found"))
    return whole.mapInArrow(partial(_pick, k=k, last=True), f"{fields}, exact boolean")


def _majority_order() -> list[Column]:
    """Leximin over a majority: the sorted percentiles, beginning with the least of the best majority of them, the
    weaker ones, which a majority can do without, last."""
    v = F.col("leximin")
    spare = F.floor((F.size(v) - 1) / 2).cast("int")
    strong = F.slice(v, spare + 1, F.size(v))
    weak = F.slice(v, F.lit(1), spare)
    return [strong.desc(), weak.desc()]
