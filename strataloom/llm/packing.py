"""Filling fixed-capacity containers with items.

Bounded-space online packing. Every partition keeps a fixed number of open windows. An item goes to the open window
it fills best; where none has room, the fullest window is emitted and a new one is opened. The windows still open
when a partition ends are leftovers: they are items of a following round that packs the leftovers of many partitions
together, until one group is left. Only sizes move between rounds, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, spread
from .tokens import counter, default_vocabulary

#: Partitions whose leftovers one task of a following round packs together.
FAN_IN = 32

_PIECES = "item_id long, piece_no int, token_start long, n_tokens long"
_PLACED = "window string, fill long, closed boolean, " + _PIECES
_OUT = pa.schema(
    [("window", pa.string()), ("fill", pa.int64()), ("closed", pa.bool_()), ("item_id", pa.int64())]
    + [("piece_no", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int64())]
)


class OpenWindows:
    """At most ``slots`` windows of ``capacity``; holds what was put in as opaque lists."""

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots = capacity, slots
        self.fill: list[int] = []
        self.held: list[list] = []

    def put(self, size: int, what: list) -> tuple[int, list] | None:
        """Place an item best-fit; the (fill, contents) of a window that had to be emitted, if one had."""
        best, room = -1, self.capacity + 1
        for i, f in enumerate(self.fill):
            left = self.capacity - f - size
            if 0 <= left < room:
                best, room = i, left
        out = None
        if best < 0:
            if len(self.fill) == self.slots:
                i = max(range(self.slots), key=self.fill.__getitem__)
                out = self.fill.pop(i), self.held.pop(i)
            self.fill.append(0)
            self.held.append([])
            best = len(self.fill) - 1
        self.fill[best] += size
        self.held[best].extend(what)
        if self.fill[best] == self.capacity:
            return_now = self.fill.pop(best), self.held.pop(best)
            if out is None:
                return return_now
            self.fill.append(return_now[0])  # rare: emitted by the next full turn or as a leftover
            self.held.append(return_now[1])
        return out

    def rest(self) -> list[tuple[int, list]]:
        """The windows still open."""
        return [(f, h) for f, h in zip(self.fill, self.held) if h]


def _cut(item: int, size: int, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """An item as pieces (id, no, start, size): one, unless it alone exceeds the capacity."""
    for no, start in enumerate(range(0, max(size, 1), capacity)):
        yield item, no, start, min(capacity, size - start)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _OUT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _pack_texts(batches, path: str, capacity: int, slots: int):
    count, windows, task, serial = counter(path).count, OpenWindows(capacity, slots), TaskContext.get(), 0
    name = f"0-{task.partitionId() if task else 0}"
    for batch in batches:
        rows: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in _cut(item, count(text) if text else 0, capacity):
                if (full := windows.put(piece[3], [piece])) is not None:
                    rows.extend((f"{name}-{serial}", full[0], True, *p) for p in full[1])
                    serial += 1
        yield _batch(rows)
    rows = []
    for fill, held in windows.rest():
        rows.extend((f"{name}-{serial}", fill, fill == capacity, *p) for p in held)
        serial += 1
    yield _batch(rows)


def _pack_leftovers(key, pdf, capacity: int, slots: int, level: int):
    """Pack whole leftover windows of one group together; largest first, which best-fit profits from."""
    import pandas as pd

    windows, renamed, serial = OpenWindows(capacity, slots), [], 0
    name = f"{level}-{key[0]}"
    sizes = pdf.drop_duplicates("window").sort_values(["fill", "window"], ascending=[False, True])
    for window, fill in zip(sizes["window"], sizes["fill"]):
        if (full := windows.put(int(fill), [window])) is not None:
            renamed.extend((w, f"{name}-{serial}", full[0], True) for w in full[1])
            serial += 1
    for fill, held in windows.rest():
        renamed.extend((w, f"{name}-{serial}", fill, fill == capacity) for w in held)
        serial += 1
    to = pd.DataFrame(renamed, columns=["window", "to", "to_fill", "to_closed"])
    out = pdf.drop(columns=["closed", "group"]).merge(to, on="window")
    out["window"], out["fill"], out["closed"] = out["to"], out["to_fill"], out["to_closed"]
    return out[["window", "fill", "closed", "item_id", "piece_no", "token_start", "n_tokens"]]


def _packer(capacity: int, slots: int, level: int):
    def run(key, pdf):
        return _pack_leftovers(key, pdf, capacity, slots, level)

    return run


def pack(
    df: DataFrame, item: str, text: str, capacity: int = 2048, slots: int = 64, vocabulary: str | None = None
) -> DataFrame:
    """Containers of at most ``capacity`` tokens: (container_id, container_tokens, item_id, piece_no, token_start,
    n_tokens), one row per item, or per piece of an item that alone exceeds the capacity.

    Repeated rows are packed as often as they occur. A null or empty text is an item of no tokens and takes no
    space. An empty table gives no rows. Which items share a container depends on how the input is partitioned; the
    guarantees do not: every item once, none cut that fits, no container above the capacity. Other columns of the
    input, whatever their names, are not read.
    """
    if capacity < 1 or slots < 1:
        raise ValueError("capacity and slots must be positive")
    source = df.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text"))
    run = partial(_pack_texts, path=vocabulary or default_vocabulary(), capacity=capacity, slots=slots)
    placed = durable(spread(source).mapInArrow(run, _PLACED))
    done, level = [placed.where("closed")], 0
    # partitions that have leftovers: their numbers are in the names of the windows
    most = placed.where(~F.col("closed")).agg(F.max(F.split("window", "-")[1].cast("int"))).head()[0]
    groups = 0 if most is None else most + 1
    last = groups <= 1
    while not last:
        level += 1
        groups = -(-groups // FAN_IN)
        last = groups == 1
        task = F.split("window", "-")[1].cast("int")
        grouped = placed.where(~F.col("closed")).withColumn("group", F.floor(task / FAN_IN).cast("int"))
        placed = grouped.groupBy("group").applyInPandas(_packer(capacity, slots, level), _PLACED)
        if not last:
            placed = durable(placed)
            done.append(placed.where("closed"))
    done.append(placed if level else placed.where(~F.col("closed")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("window").alias("container_id"),
        F.col("fill").alias("container_tokens"),
        "item_id",
        "piece_no",
        "token_start",
        "n_tokens",
    )
