"""Most similar vectors for every vector.

Score-aware quantisation after a coarse partition:

1. A sample that grows with the table fits spherical k-means centres (the cells), in tasks where it is large; a bounded
   one fits, on the residuals to them, a product code of four bits per block of dimensions. The code is anisotropic: it
   penalises the part of the residual that is parallel to the vector, which is what changes an inner product, more than
   the part across it.
2. Cells grow in number with the table, not in size, since neighbours part where a cell holds many unrelated clusters.
   Cells that lie together form a group, for which a task works. Every vector goes to the group of its nearest cell with
   its exact values, and as a question to the groups of the next cells too.
3. In a cell, a question's inner products with all members are read from tables of sixteen entries per block (two
   blocks are looked up at once); the best candidates are reranked with exact inner products.
4. The answers of a question's cells are merged per vector, and copies get the answer of their group.

Everything that travels is packed: a task ships one compressed block per group, with exact values for members and for
questions. Copies of a vector travel once per task with at most k+1 ids; the other ids travel with a hash only. A group that is large is split over several tasks, and each question visits all.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a cell, about, in a large table.
CELL_VECTORS = 128
#: Vectors the index is fitted on at the driver: so many per cell, at least and at most.
PER_CELL, LEAST_SAMPLE, SAMPLE = 40, 10_000, 65_536
#: Vectors per cell on which tasks fit the centres where the driver's sample has too few, and how often they do.
SPREAD_PER_CELL, SPREAD_ROUNDS = 12, 2
#: Members one task of a group should have; groups expected to have more are split.
GROUP_ROWS = 4_096
#: Rows per task of a shuffle.
TASK_ROWS = 4_096
#: Centres and vectors that are compared at once, which bounds the memory of a task.
CENTRES, VECTORS = 4_096, 2_048
#: Dimensions of a block, entries of its table, and how much a parallel error weighs against one across.
BLOCK, ENTRIES, PARALLEL = 4, 16, 4.0
#: Candidates per question and cell whose inner products are computed exactly.
RERANK = 40
#: Questions scored at once, which bounds the memory of a task.
QUESTIONS = 512


class Index:
    """Fitted centres and codebooks; shipped with the tasks. The centres take 768 bytes a cell of 384 dimensions."""

    def __init__(self, sample: np.ndarray, cells: int, rows: int, seed: int = 7, centres: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.rows = rows
        self.dim = sample.shape[1]
        self.centres = _spherical_kmeans(sample, min(cells, len(sample)), rng) if centres is None else centres
        some = self.centres[rng.permutation(len(self.centres))[:SAMPLE]].astype(np.float32)
        # half as many rows a group as a task should have, so that few groups are split
        together = _spherical_kmeans(some, min(len(some), -(-2 * rows // GROUP_ROWS)), rng)
        self.group = _nearest(self.centres.astype(np.float32), together, 1)[:, 0]
        nearest = self.nearest(sample, 1)[:, 0]
        share = np.bincount(self.group[nearest], minlength=len(together)) / len(sample)
        self.splits = np.maximum(1, np.ceil(share * rows / GROUP_ROWS)).astype(np.int64)
        pad = -self.dim % (2 * BLOCK)
        self.blocks = (self.dim + pad) // BLOCK
        residual = _padded(sample - self.centres[nearest].astype(np.float32), pad).reshape(len(sample), self.blocks, BLOCK)
        direction = _padded(sample, pad).reshape(residual.shape)
        self.pad = pad
        self.books = _fit_codes(residual, direction, rng)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of unit vectors, nearest first: (rows, probes)."""
        return _nearest(x, self.centres, probes)

    def encode(self, x: np.ndarray, cell: int) -> np.ndarray:
        """Codes of unit vectors in a cell, two blocks to a byte: (rows, blocks / 2)."""
        n = len(x)
        residual = _padded(x - self.centres[cell].astype(np.float32), self.pad).reshape(n, self.blocks, BLOCK)
        direction = _padded(x, self.pad).reshape(n, self.blocks, BLOCK)
        codes = _assign(residual, direction, self.books)
        return (codes[:, 0::2] * ENTRIES + codes[:, 1::2]).astype(np.uint8)

    def scan(self, questions: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """Approximate inner products from table lookups: (members, questions)."""
        q = _padded(questions, self.pad).reshape(len(questions), self.blocks, BLOCK)
        tables = np.einsum("qbd,bed->beq", q, self.books).astype(np.float32)
        both = (tables[0::2, :, None, :] + tables[1::2, None, :, :]).reshape(self.blocks // 2, ENTRIES**2, -1)
        out = np.zeros((len(codes), len(questions)), dtype=np.float32)
        for b in range(self.blocks // 2):
            out += both[b].take(codes[:, b], axis=0)
        out += questions @ self.centres[cell].astype(np.float32)
        return out


def _padded(x: np.ndarray, pad: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, pad))) if pad else x


def _nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The centres with the largest inner products, largest first; all are compared, a block at a time."""
    probes = min(probes, len(centres))
    best = np.full((len(x), probes), -np.inf, dtype=np.float32)
    cells = np.zeros((len(x), probes), dtype=np.int32)
    for first in range(0, len(centres), CENTRES):
        block = centres[first : first + CENTRES].astype(np.float32).T
        for start in range(0, len(x), VECTORS):
            sims = x[start : start + VECTORS] @ block
            rows = np.arange(len(sims))
            for _ in range(min(probes, block.shape[1])):
                at = sims[rows].argmax(axis=1) if len(rows) < len(sims) else sims.argmax(axis=1)
                value = sims[rows, at]
                better = value > best[start + rows, -1]
                rows, at, value = rows[better], at[better], value[better]
                if not len(rows):
                    break
                sims[rows, at] = -np.inf
                both = np.concatenate([best[start + rows], value[:, None]], axis=1)
                named = np.concatenate([cells[start + rows], first + at[:, None].astype(np.int32)], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
                best[start + rows] = np.take_along_axis(both, order, axis=1)
                cells[start + rows] = np.take_along_axis(named, order, axis=1)
    return cells


def _spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        found, sums = _sums(x, _nearest(x, centres, 1)[:, 0])
        norms = np.linalg.norm(sums, axis=1)
        good = norms > 1e-12
        centres[found[good]] = sums[good] / norms[good, None]
    return centres.astype(np.float32)


def _sums(x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur, and the sum of the vectors of each."""
    order = np.argsort(cells, kind="stable")
    found, first = np.unique(cells[order], return_index=True)
    return found, np.add.reduceat(x[order], first, axis=0)


def _assign(residual: np.ndarray, direction: np.ndarray, books: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Codes that minimise |error|^2 + (PARALLEL-1) * (error . direction)^2 by coordinate descent over the blocks."""
    n, blocks, _ = residual.shape
    square = (books**2).sum(axis=2)
    codes = np.empty((n, blocks), dtype=np.int16)
    parallel = np.zeros(n, dtype=np.float32)
    rows = np.arange(n)
    for b in range(blocks):  # start: nearest entry of each block
        cost = square[b] - 2 * residual[:, b] @ books[b].T
        codes[:, b] = cost.argmin(axis=1)
        parallel += ((residual[:, b] - books[b][codes[:, b]]) * direction[:, b]).sum(axis=1)
    for _ in range(rounds):
        for b in range(blocks):
            along = direction[:, b] @ books[b].T
            without = parallel + along[rows, codes[:, b]]
            cost = square[b] - 2 * residual[:, b] @ books[b].T + (PARALLEL - 1) * (without[:, None] - along) ** 2
            codes[:, b] = cost.argmin(axis=1)
            parallel = without - along[rows, codes[:, b]]
    return codes


def _fit_codes(residual: np.ndarray, direction: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Codebooks (blocks, entries, block): k-means per block, then centres that solve the anisotropic least squares."""
    n, blocks, d = residual.shape
    books = np.empty((blocks, ENTRIES, d), dtype=np.float32)
    for b in range(blocks):
        x = residual[:, b]
        c = x[rng.choice(n, ENTRIES, replace=n < ENTRIES)].copy()
        for _ in range(6):
            near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            count = np.bincount(near, minlength=ENTRIES)
            for j in range(d):
                total = np.bincount(near, weights=x[:, j], minlength=ENTRIES)
                c[:, j] = np.where(count > 0, total / np.maximum(count, 1), c[:, j])
        books[b] = c
    codes = _assign(residual, direction, books)
    parallel = np.zeros(n, dtype=np.float32)
    for b in range(blocks):
        parallel += ((residual[:, b] - books[b][codes[:, b]]) * direction[:, b]).sum(axis=1)
    for b in range(blocks):
        u, r = direction[:, b], residual[:, b]
        others = parallel - ((r - books[b][codes[:, b]]) * u).sum(axis=1)
        for e in range(ENTRIES):
            rows = codes[:, b] == e
            if rows.sum() <= d:
                continue
            v = u[rows]
            left = rows.sum() * np.eye(d) + (PARALLEL - 1) * v.T @ v
            target = others[rows] + (r[rows] * v).sum(axis=1)
            right = r[rows].sum(axis=0) + (PARALLEL - 1) * v.T @ target
            books[b, e] = np.linalg.solve(left, right)
        parallel = others + ((r - books[b][codes[:, b]]) * u).sum(axis=1)
    return books


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the usable vectors of a list column: not null, no null or non-finite part, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = lengths[lengths > 0]
    if not len(known):
        return np.empty(0, dtype=np.int64), np.empty((0, 0), dtype=np.float32)
    dim = int(np.bincount(known).argmax())
    at = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(at)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return at[good], values[good]


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    # the largest part first, so that neither very large nor very small vectors overflow
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _keys(values: np.ndarray) -> list[bytes]:
    clean = np.ascontiguousarray(values + np.float32(0))  # -0.0 equals 0.0
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in clean]


_BLOCKS = "place int, split int, members boolean, count int, data binary, keys binary, cells binary, ids string"
_SEP, _SEP2 = "\x1e", "\x1f"


def _pack(x: np.ndarray) -> bytes:
    """A matrix of float32, byte planes apart, compressed."""
    raw = np.ascontiguousarray(x.astype(np.float32)).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(data: bytes, rows: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view(np.float32).reshape(rows, -1)


def _route(batches, index: Index, probes: int, k: int):
    """Blocks of members and of questions per group of cells; copies within the task are one row with their k+1 least ids."""
    ids: list[str] = []
    parts: list[np.ndarray] = []
    for batch in batches:
        at, values = _matrix(batch.column(1))
        if len(at) and values.shape[1] == index.dim:
            names = batch.column(0).take(pa.array(at)).to_pylist()
            ids.extend(names)
            parts.append(values)
            if sum(map(len, parts)) >= 8_192:
                yield from _blocks(ids, np.concatenate(parts), index, probes, k)
                ids, parts = [], []
    if parts:
        yield from _blocks(ids, np.concatenate(parts), index, probes, k)


def _blocks(ids: list[str], values: np.ndarray, index: Index, probes: int, k: int):
    keys = _keys(values)
    group: dict[bytes, list[str]] = {}
    first: dict[bytes, int] = {}
    for i, (key, name) in enumerate(zip(keys, ids)):
        if name is not None:
            group.setdefault(key, []).append(name)
            first.setdefault(key, i)
    at = np.array(list(first.values()), dtype=np.int64)
    if not len(at):
        return
    keys = list(first)
    names = [_SEP2.join(sorted(set(group[key]))[: k + 1]) for key in keys]
    exact = values[at]
    x = _unit(exact)
    cells = index.nearest(x, probes)
    places = index.group[cells]
    salt = np.array([key[0] | key[1] << 8 for key in keys])
    rows = []
    for place in np.unique(places):
        n = int(index.splits[place])
        home = np.flatnonzero(places[:, 0] == place)
        ask = np.flatnonzero((places[:, 1:] == place).any(axis=1) & (places[:, 0] != place))
        for s in range(n):
            rows.append((place, s, True, home[salt[home] % n == s]))
            # members of the other splits of a group ask here as well
            rows.append((place, s, False, np.concatenate([ask, home[salt[home] % n != s]])))
    out = [
        (int(g), s, m, len(r), _pack(exact[r]), b"".join(keys[i] for i in r))
        + (np.where(places[r] == g, cells[r], -1).astype(np.int32).tobytes(), _SEP.join(names[i] for i in r) if m else "")
        for g, s, m, r in rows
        if len(r)
    ]
    if out:
        columns = list(zip(*out))
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
        labels = ["place", "split", "members", "count", "data", "keys", "cells", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=labels)


_ANSWERS = "key binary, ids array<string>, distances array<double>"


def _answer(pdf: pd.DataFrame, index: Index, k: int) -> pd.DataFrame:
    """The nearest members in each cell of one split of a group, for its members and for the questions sent to it."""
    members, questions = pdf[pdf["members"]], pdf[~pdf["members"]]
    if not len(members):
        return pd.DataFrame({"key": [], "ids": [], "distances": []}, dtype=object)
    keys: dict[bytes, int] = {}
    names: list[set[str]] = []
    chosen: list[tuple[int, int]] = []
    asked: list[np.ndarray] = []
    blocks = [_unpack(d, n) for d, n in zip(members["data"], members["count"])]
    cells = [np.frombuffer(c, dtype=np.int32).reshape(n, -1) for c, n in zip(members["cells"], members["count"])]
    for b, (packed, listed) in enumerate(zip(members["keys"], members["ids"])):
        for i, listed_ids in enumerate(listed.split(_SEP)):
            key = packed[16 * i : 16 * i + 16]
            own = set(listed_ids.split(_SEP2))
            if key in keys:  # a copy that another task sent
                names[keys[key]] |= own
            else:
                keys[key] = len(names)
                names.append(own)
                chosen.append((b, i))
                asked.append(cells[b][i])
    exact = np.stack([blocks[b][i] for b, i in chosen])
    del blocks
    x = _unit(exact)
    home = np.array([c[0] for c in asked])
    ids = [sorted(n)[: k + 1] for n in names]
    out_keys: list[bytes] = []
    out_ids: list[list[str]] = []
    out_far: list[list[float]] = []

    def ask(cell: int, own: np.ndarray, codes: np.ndarray, q_keys: list[bytes], q: np.ndarray) -> None:
        for start in range(0, len(q), QUESTIONS):
            given = q[start : start + QUESTIONS]
            part = _unit(given)
            scores = index.scan(part, codes, cell)
            most = min(RERANK, len(own))
            best = np.argpartition(-scores, most - 1, axis=0)[:most]
            sims = np.einsum("cqd,qd->qc", x[own[best]], part)
            # single-precision products are enough to choose, not to report
            short = own[np.take_along_axis(best.T, np.argsort(-sims, axis=1)[:, : k + 3], axis=1)]
            precise = _distances(given, exact, short)
            for i in range(len(part)):
                ranked = sorted((d, name) for d, j in zip(precise[i], short[i]) for name in ids[j])[: k + 1]
                out_keys.append(q_keys[start + i])
                out_ids.append([name for _, name in ranked])
                out_far.append([float(d) for d, _ in ranked])

    held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for packed, data, places, n in zip(questions["keys"], questions["data"], questions["cells"], questions["count"]):
        rows, where = _unpack(data, n), np.frombuffer(places, dtype=np.int32).reshape(n, -1)
        for i in range(n):
            held.setdefault(packed[16 * i : 16 * i + 16], (rows[i], where[i]))
    all_keys = [*keys, *held]
    wanted = np.stack([*asked, *(c for _, c in held.values())])
    vectors = np.concatenate([exact, np.stack([v for v, _ in held.values()])]) if held else exact
    order = np.argsort(wanted, axis=None, kind="stable")
    sorted_cells, askers = wanted.ravel()[order], order // wanted.shape[1]
    for cell in np.unique(home).tolist():
        own = np.flatnonzero(home == cell)
        who = askers[slice(*np.searchsorted(sorted_cells, (cell, cell + 1)))]
        ask(cell, own, index.encode(x[own], cell), [all_keys[i] for i in who], vectors[who])
    return pd.DataFrame({"key": out_keys, "ids": out_ids, "distances": out_far})


def _distances(questions: np.ndarray, members: np.ndarray, short: np.ndarray) -> np.ndarray:
    """1 - cosine in double precision, rounded to nine decimals."""
    b = members[short].astype(np.float64)
    b /= np.abs(b).max(axis=2, keepdims=True)
    a = questions.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    dots = np.einsum("qd,qcd->qc", a, b)
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=2)
    return np.round(1.0 - dots / norms, 9) + 0.0


def fit(df: DataFrame, vector: str) -> Index | None:
    """Fit the index on a sample of the usable vectors; None if there are none.

    The cells grow as the square root of the rows, so that assigning a vector to cells and scanning them cost alike, and
    in proportion to them where CELL_VECTORS asks for more: the work per vector then grows with the table.
    """
    usable = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    rows = usable.count()
    if not rows:
        return None
    cells = max(1, int(np.sqrt(rows) * 1.5), rows // CELL_VECTORS)
    size = min(SAMPLE, max(LEAST_SAMPLE, PER_CELL * cells))
    share = min(1.0, 1.1 * size / rows)
    sample = (usable if share == 1 else usable.sample(share, seed=11)).limit(size).toArrow()
    _, values = _matrix(sample.column(0))
    if not len(values):
        return None
    x = np.unique(values, axis=0)
    x = _unit(x[np.random.default_rng(3).permutation(len(x))])
    if PER_CELL * cells > SAMPLE and (centres := _spread_centres(usable, rows, cells, x.shape[1])) is not None:
        return Index(x, cells, rows, centres=centres)
    return Index(x, min(cells, max(1, len(x) // 16)), rows)


def _spread_centres(usable: DataFrame, rows: int, cells: int, dim: int) -> np.ndarray | None:
    """Centres of spherical k-means over SPREAD_PER_CELL vectors a cell, which stay with the tasks, in half precision.

    The driver holds the centres only.
    """
    share = min(1.0, SPREAD_PER_CELL * cells / rows)
    units = usable.sample(share, seed=12).mapInArrow(partial(_packed_units, dim=dim), "data binary").persist()
    try:
        first = units.sample(min(1.0, 1.1 * cells / (share * rows)), seed=13).distinct().limit(cells)
        centres = _halves(first.toArrow().column(0), dim)
        if not len(centres):
            return None
        tasks = max(usable.sparkSession.sparkContext.defaultParallelism, -(-int(share * rows) // TASK_ROWS))
        for _ in range(SPREAD_ROUNDS):
            parts = units.mapInArrow(partial(_partial_sums, centres=centres), "cell int, data binary")
            means = parts.repartition(tasks, "cell").mapInArrow(partial(_means, dim=dim), "cell int, data binary").toArrow()
            centres[means.column(0).to_numpy()] = _halves(means.column(1), dim)
    finally:
        units.unpersist()
    return centres


def _halves(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(b"".join(c.to_pylist()), dtype=np.float16) for c in chunks]
    return np.concatenate([*parts, np.empty(0, dtype=np.float16)]).reshape(-1, dim)


def _packed_units(batches, dim: int):
    for batch in batches:
        _, values = _matrix(batch.column(0))
        x = _unit(values).astype(np.float16) if len(values) and values.shape[1] == dim else []
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["data"])


def _named(cells: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    data = pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), data], names=["cell", "data"])


def _partial_sums(batches, centres: np.ndarray):
    for batch in batches:
        if batch.num_rows:
            x = _halves(batch.column(0), centres.shape[1]).astype(np.float32)
            yield _named(*_sums(x, _nearest(x, centres, 1)[:, 0]))


def _means(batches, dim: int):
    """Unit centres from the partial sums of whole cells; a cell whose vectors cancel out gets none."""
    held = [b for b in batches if b.num_rows]
    if held:
        x = np.concatenate([_halves(b.column(1), dim) for b in held]).astype(np.float32)
        cells, sums = _sums(x, np.concatenate([b.column(0).to_numpy() for b in held]))
        good = np.isfinite(sums).all(axis=1) & (np.linalg.norm(sums, axis=1) > 1e-6)
        if good.any():
            yield _named(cells[good], _unit(sums[good]))


def neighbours(df: DataFrame, item: str, vector: str, k: int = 5, probes: int = 3) -> DataFrame:
    """(id, ids, distances): the k nearest other rows of each row, nearest first; ties go to the smaller id.

    Null vectors, those with a null or non-finite part, all-zero ones, and ones of another length than most take no
    part. Copies of a vector are each other's neighbours at distance 0; a group of copies of any size gets the
    neighbours of its k+1 least ids. Rows repeated under one id count once. An empty table gives no rows. The search
    is approximate: a neighbour is lost if it lies in none of the ``probes`` cells asked, or its code misleads.
    """
    spark = df.sparkSession
    slim = df.select(F.col(item).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    slim = slim.where(F.col("v").isNotNull() & F.col("id").isNotNull())
    index = fit(slim, "v")
    if index is None:
        return spark.createDataFrame([], "id string, ids array<string>, distances array<double>")
    blocks = slim.mapInArrow(partial(_route, index=index, probes=probes, k=k), _BLOCKS)
    answer = partial(_answer, index=index, k=k)
    # as many tasks as the rows ask for, so that none grows with the table; the partitionings serve all that follows
    tasks = max(spark.sparkContext.defaultParallelism, -(-index.rows // TASK_ROWS))
    groups = blocks.repartition(tasks, "place", "split").groupBy("place", "split")
    answers = groups.applyInPandas(lambda pdf: answer(pdf), _ANSWERS).repartition(tasks, "key")
    # a member lies in one cell of one split, so no neighbour comes twice; a key has an answer per cell asked and split
    pairs = F.arrays_zip("distances", "ids")
    merged = answers.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("found"))
    owners = slim.mapInArrow(_owners, "id string, key binary").repartition(tasks, "key").distinct()
    joined = owners.join(merged, "key")
    first = F.filter("found", lambda p: p["ids"] != F.col("id"))
    return joined.select("id", F.slice(first, 1, k).alias("n")).select(
        "id", F.col("n.ids").alias("ids"), F.col("n.distances").alias("distances")
    )


def _owners(batches):
    for batch in batches:
        at, values = _matrix(batch.column(1))
        names = batch.column(0).take(pa.array(at)).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(_keys(values) if len(at) else [], pa.binary())],
            names=["id", "key"],
        )


def neighbour_pairs(df: DataFrame, item: str, vector: str, k: int = 5, probes: int = 3) -> DataFrame:
    """(id_a, id_b): unordered pairs, smaller id first, of which one is among the k nearest of the other."""
    each = neighbours(df, item, vector, k, probes).select("id", F.explode("ids").alias("other"))
    return each.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
