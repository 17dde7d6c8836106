"""Evaluation texts leaking into training text.

Pigeonhole edit matching. A quotation may have one word in six changed, so a stretch of n words has at most n / 6 errors,
and cut into one piece more than that it keeps a piece unchanged. A quotation may begin at any word of an item, so each
item is split that way from every word on; the pieces of all items form a dictionary, and every document is scanned for
exact hits. Around each hit the words before and after it, in the item and in the document, are compared with Myers'
bit-parallel edit distance: its columns, Python integers of as many bits as the item has words, tell how far the run goes
before its errors exceed the budget. Runs of one item that follow each other closely are put together.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

#: A quotation counts from this share of an item's words, with at most one word in WRONG changed.
SHARE, WRONG = 3, 6
#: Words that may stand between two runs of one quotation.
NEAR = 40
#: Words that a run needs to count.
LEAST_RUN = 6
#: Words that the longest run of a quotation has at least, if it needs so many.
LONGEST = 12
#: Rows of hits up to which their order is looked at before they are compared word by word.
CHAINED = 64
#: Bytes of items that one pass over the documents searches for; more items take more passes.
PASS_BYTES = 32 * 2**20


def piece_words(length: int) -> int:
    """Words of the pieces of an item of so many words.

    A quotation needs a third of them, in runs of which one has LONGEST words or all that are needed. A run of n words
    has n // WRONG errors at most, so of its n // WRONG + 1 pieces one is unchanged. The least piece of all these
    lengths serves for all of them; an item of few words is one piece.
    """
    need = -(-length // SHARE)
    return max(1, min(n // (n // WRONG + 1) for n in range(min(LONGEST, need), need + 1)))


_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]{0,9}(?:\s[^<>\n]{0,200})?/?>|&(?:#\d{1,6}|#x[0-9a-fA-F]{1,5}|[a-zA-Z]{2,8});")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrtbfv\"'\\/])")
_ESCAPED = {"n": "\n", "r": "\n", "t": "\t", "b": " ", "f": " ", "v": " "}
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")
_HYPHEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


def _entity(m: re.Match) -> str:
    s = m.group()
    return html.unescape(s) if s[0] == "&" else " " if s[1:3].isspace() else ""


def _unescape(m: re.Match) -> str:
    s = m.group()[1:]
    return chr(int(s[1:], 16)) if s[0] in "ux" and len(s) > 1 else _ESCAPED.get(s, s)


def words(text: str) -> list[str]:
    """The words of a text, without case, punctuation, markup, escapes and invisible characters."""
    if "<" in text or "&" in text:
        text = _TAG.sub(_entity, text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if not text.isascii():
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text.casefold())


@dataclass
class Items:
    """Items of one pass: their words as numbers, and the sorted hashes of their pieces."""

    ids: list[int]
    vocabulary: dict[str, int]
    texts: list[np.ndarray]
    hashes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray
    pieces: np.ndarray
    made: dict[int, tuple[_Side, _Side]] = field(default_factory=dict)

    def sides(self, i: int) -> tuple[_Side, _Side]:
        """An item's words forwards and backwards."""
        if i not in self.made:
            w = self.texts[i].tolist()
            self.made[i] = _Side(w), _Side(w[::-1])
        return self.made[i]

    @property
    def kinds(self) -> list[int]:
        """The lengths that pieces have."""
        return np.unique(self.pieces).tolist()

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        texts, ids = [], []
        for item, passage in rows:
            w = words(passage or "")
            if w:
                ids.append(item)
                texts.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.int64))
        pieces = np.array([piece_words(len(t)) for t in texts], dtype=np.int64)
        hashed = [_hashes(t, n) for t, n in zip(texts, pieces.tolist())]
        owner = np.concatenate([np.full(len(h), i) for i, h in enumerate(hashed)] or [np.empty(0, dtype=np.int64)])
        offset = np.concatenate([np.arange(len(h)) for h in hashed] or [np.empty(0, dtype=np.int64)])
        flat = np.concatenate(hashed or [np.empty(0, dtype=np.uint64)])
        order = np.argsort(flat, kind="stable")
        unique, starts = np.unique(flat[order], return_index=True)
        return cls(ids, vocabulary, texts, unique, np.append(starts, len(flat)), owner[order], offset[order], pieces)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words; runs of different lengths never share one but by chance."""
    x = numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    h = np.full(max(0, len(x) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ x[i : i + len(h)]) * _BASE
        h ^= h >> np.uint64(31)
    return h


def myers(pattern: np.ndarray, text: np.ndarray) -> int:
    """Edit distance of two word sequences, by bit-parallel columns."""
    m = len(pattern)
    if not m:
        return len(text)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        where[w] = where.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for w in text.tolist():
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return score


def _spare(length):
    """Errors that a run of an item of so many words may have to each side of a hit."""
    return length // SHARE // WRONG + 1


class _Side:
    """The words of an item in one direction, and for each word the places where it stands, as bits."""

    def __init__(self, words_: list[int]):
        self.words = words_
        self.where: dict[int, int] = {}
        for i, w in enumerate(words_):
            self.where[w] = self.where.get(w, 0) | (1 << i)


def _reach(side: _Side, skip: int, doc: list[int], spare: int, words_before: int, errors_before: int) -> tuple[int, int, int]:
    """(words of the item, words of ``doc``, errors) of the longest beginning of the item after its first ``skip`` words
    that begins ``doc`` as well.

    Together with what is before it, the beginning may have one error in WRONG words, and at most ``spare`` itself; it
    ends in two words that agree, or with the item. Columns of the edit distance of all beginnings of the item come from
    Myers' recurrence; the distance in a row is the sum of the column's differences above it. A word of the document
    that agrees with no row within ``spare`` is an error of every run that goes past it.
    """
    item, where = side.words, side.where
    m = min(len(item) - skip, len(doc) + spare)
    if m <= 0:
        return 0, 0, 0
    full, wide, length = (1 << m) - 1, (1 << (2 * spare + 1)) - 1, len(item) - skip
    pv, mv, lost = full, 0, 0
    far, at, wrong = 0, 0, 0
    get = where.get
    for j, word in enumerate(doc[: m + spare], 1):
        same = get(word, 0) >> skip & full
        low = j - 1 - spare if j > spare else 0
        ends = same >> low & wide
        if not ends:
            lost += 1
            if lost > spare:
                break
        if same:
            xv = same | mv
            xh = (((same & pv) + pv) ^ pv) | same
            ph = ((mv | (full & ~(xh | pv))) << 1 | 1) & full
            mh = ((pv & xh) << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        else:  # what is left of the same steps for a word that stands nowhere
            ph = ((mv | (full ^ pv)) << 1 | 1) & full
            pv = full ^ (mv | ph)
            mv &= ph
            continue
        while ends:
            top = ends.bit_length()
            i = low + top  # rows that end in this word, the furthest first
            if i <= far:
                break
            ends ^= 1 << (top - 1)
            if i > 1 and i < length and not (j > 1 and item[skip + i - 2] == doc[j - 2]):
                continue
            above = (1 << i) - 1
            errors = j + (pv & above).bit_count() - (mv & above).bit_count()
            if errors <= spare and (errors + errors_before) * WRONG <= i + words_before:
                far, at, wrong = i, j, errors
                break
    return far, at, wrong


def _runs(doc: np.ndarray, sides: tuple[_Side, _Side], at: np.ndarray, off: np.ndarray, piece: int) -> list[tuple[int, int, int, int]]:
    """Runs (doc start, doc end, item start, item end) around the hits of one item that lie in no run yet."""
    on, back = sides
    length = len(on.words)
    spare = _spare(length)
    most = length + spare
    order = np.lexsort((off, at))
    first = max(0, int(at.min()) - most)
    text = doc[first : int(at.max()) + piece + most].tolist()
    found: list[tuple[int, int, int, int]] = []
    for a, o in zip((at[order] - first).tolist(), off[order].tolist()):
        if any(r[0] <= a < r[1] and abs((a - o) - (r[0] - r[2])) <= 8 + spare and r[2] <= o < r[3] for r in found):
            continue
        i, j, errors = _reach(on, o + piece, text[a + piece : a + piece + most], spare, piece, 0)
        p, d, _ = _reach(back, length - o, text[max(0, a - most) : a][::-1], spare, piece + i, errors)
        found.append((a - d, a + piece + j, o - p, o + piece + i))
    return [(first + d0, first + d1, p0, p1) for d0, d1, p0, p1 in found]


def _agreeing(side: _Side, start: int, end: int, doc: list[int]) -> int:
    """Words of an item from ``start`` to ``end`` that ``doc`` has in the same order, by bit-parallel columns."""
    get, full = side.where.get, (1 << (end - start)) - 1
    left = full
    for word in doc:
        if same := left & get(word, 0) >> start:
            left = ((left + same) | (left - same)) & full
    return end - start - left.bit_count()


def _together(runs: list[tuple[int, int, int, int, int]], length: int) -> int:
    """The most words, the last of each run, of runs that follow each other closely; words that two runs share count once."""
    best = 0
    totals: list[int] = []
    for i, (d0, _, p0, _, size) in enumerate(runs):
        most = size
        for j in range(i - 1, -1, -1):
            e0, e1, _, q1, _ = runs[j]
            if d0 - e0 > NEAR + 2 * length:
                break
            if e1 - 2 <= d0 <= e1 + NEAR and q1 - 2 <= p0:
                most = max(most, totals[j] + size - max(0, q1 - p0))
        totals.append(most)
        best = max(best, most)
    return best


def quoted(doc: np.ndarray, sides: tuple[_Side, _Side], at: np.ndarray, off: np.ndarray, piece: int) -> int:
    """Words of an item that ``doc`` repeats in order, in one run or in runs that follow each other closely.

    The changed words of a run, one in WRONG at most, count if the run is long enough by itself. Of several runs only the
    words that agree add up: sentences of one pattern with other words in it are no quotation, however many there are.
    """
    on, length = sides[0], len(sides[0].words)
    runs = sorted(
        (*run, run[3] - run[2])
        for run in set(_runs(doc, sides, at, off, piece))
        if run[3] - run[2] >= min(LEAST_RUN, length)
    )
    need = -(-length // SHARE)
    longest = max((size for *_, size in runs), default=0)
    if _together(runs, length) < need:
        return longest
    agreed = [(d0, d1, p0, p1, _agreeing(on, p0, p1, doc[d0:d1].tolist())) for d0, d1, p0, p1, _ in runs]
    return max(longest, _together(agreed, length))


def _scan(batches, items: Items):
    get = items.vocabulary.get
    lengths = np.array([len(t) for t in items.texts], dtype=np.int64)
    need = -(-lengths // SHARE)
    for batch in batches:
        rows: list[tuple[int, int, float]] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            w = words(text)
            if not w:
                continue
            doc = np.array(list(map(get, w, repeat(0))), dtype=np.int64)
            for i, n in _leaks(doc, items, need, lengths):
                rows.append((doc_id, items.ids[i], n / int(lengths[i])))
        columns = list(zip(*rows)) if rows else [[]] * 3
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "share"])


def _likely(owner: np.ndarray, place: np.ndarray, off: np.ndarray, need: np.ndarray, lengths: np.ndarray, pieces: np.ndarray):
    """Slices of the hits, given by owner and place, outside of which ``quoted`` finds no ``need`` words together.

    A run of s words with e errors, e <= s / WRONG, has at least s - e - (b - 1) * (e + 1) whole pieces of b words, so
    one with h pieces has at most WRONG / (WRONG - b) * (h + b - 1) words. Pieces that follow each other word by word lie
    in one run, and runs that follow each other share no piece: the pieces and the unbroken rows of them, each counted
    once, bound the words of any number of runs. Between the hits of one run there are no more words than its errors
    let pass without a whole piece; between runs there are NEAR words more.
    """
    size_of = pieces[owner]
    bare = (pieces + 1) * _spare(lengths) + pieces - 1
    reach = pieces + 2 * bare + NEAR
    begins = np.append(True, (np.diff(owner) != 0) | (np.diff(place) > reach[owner[1:]]))
    group = np.cumsum(begins) - 1
    diagonal = np.lexsort((place, place - off, owner))
    o, p, d = owner[diagonal], place[diagonal], (place - off)[diagonal]
    row = np.append(True, (np.diff(o) != 0) | (np.diff(d) != 0) | (np.diff(p) != 1))
    cell = group * 2**32 + off
    size = group[-1] + 1
    whole = np.bincount(np.unique(cell) >> 32, minlength=size)
    rows = np.bincount(np.unique(cell[diagonal][row]) >> 32, minlength=size)
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(owner))
    b = size_of[first]
    words_most = np.where(b < WRONG, WRONG * (whole + (b - 1) * rows) // np.maximum(WRONG - b, 1), lengths[owner[first]])
    for g in np.flatnonzero(words_most >= need[owner[first]]).tolist():
        i, part = int(owner[first[g]]), slice(first[g], last[g])
        if rows[g] > CHAINED or _chained(place[part].tolist(), off[part].tolist(), int(pieces[i])) >= need[i]:
            yield i, part


def _chained(place: list[int], off: list[int], b: int) -> int:
    """The most words that rows of hits can stand for which follow each other in the document and in the item.

    Each row is worth what :func:`_likely` counts for it. A run goes past its rows by no more words than its worth, and
    lies no further from the next than NEAR; runs overlap by two words at most.
    """
    if b >= WRONG:
        return 1 << 30
    hits = sorted(zip([p - o for p, o in zip(place, off)], place, off))
    rows: list[list[int]] = []  # place, end of place, offset, end of offset, worth
    diagonal = None
    for d, p, o in hits:
        if d == diagonal and p == rows[-1][1] - b + 1:
            rows[-1][1] += 1
            rows[-1][3] += 1
        elif d != diagonal or p != rows[-1][1] - b:
            rows.append([p, p + b, o, o + b, 0])
        diagonal = d
    rows.sort()
    best = 0
    for n, r in enumerate(rows):
        worth = WRONG * (r[1] - r[0]) // (WRONG - b)  # its pieces and b - 1 more are the words of a row
        most = worth
        for q in rows[:n]:
            if q[1] - 2 <= r[0] <= q[1] + NEAR + worth + q[5] and q[3] - 2 <= r[2]:
                most = max(most, q[4] + worth)
        r[4] = most
        r.append(worth)
        best = max(best, most)
    return best


def _leaks(doc: np.ndarray, items: Items, need: np.ndarray, lengths: np.ndarray):
    if not len(items.hashes):
        return
    each = [_hashes(doc, n) for n in items.kinds]
    h, spots = np.concatenate(each), np.concatenate([np.arange(len(x)) for x in each])
    if not len(h):
        return
    spot = np.searchsorted(items.hashes, h)
    spot[spot == len(items.hashes)] = 0
    at = np.flatnonzero(items.hashes[spot] == h)
    if not len(at):
        return
    first = items.starts[spot[at]]
    many = items.starts[spot[at] + 1] - first
    place = np.repeat(spots[at], many)
    index = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    owner, off = items.owners[index], items.offsets[index]
    # a hit alone stands for few words: what :func:`_likely` counts for hits that are all rows of their own
    hits = np.bincount(owner, minlength=len(need))
    alone = np.where(items.pieces < WRONG, WRONG * items.pieces * hits // np.maximum(WRONG - items.pieces, 1), lengths)
    enough = (alone >= need)[owner]
    if not enough.any():
        return
    owner, off, place = owner[enough], off[enough], place[enough]
    order = np.lexsort((off, place, owner))
    owner, off, place = owner[order], off[order], place[order]
    best: dict[int, int] = {}
    for i, part in _likely(owner, place, off, need, lengths, items.pieces):
        n = quoted(doc, items.sides(i), place[part], off[part], int(items.pieces[i]))
        if n >= need[i]:
            best[i] = max(n, best.get(i, 0))
    yield from best.items()


def _passes(items: DataFrame, item: str, passage: str, limit: int):
    """The items in blocks of bounded size; the driver holds one block."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(item).cast("long"), F.col(passage).cast("string")).distinct().toLocalIterator()
    for row in rows:
        if row[0] is None or not row[1]:
            continue
        block.append((row[0], row[1]))
        size += 4 * len(row[1]) + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """(doc_id, item_id, share): documents that repeat at least a third of an item's words, in order.

    ``share`` is the part of the item's words found. Null and empty texts and passages take no part; repeated rows
    count once. The items are a stated query set: they are shipped to the documents in blocks of ``pass_bytes``, one
    pass over the documents each, and the documents are never shuffled.
    """
    spark: SparkSession = docs.sparkSession
    source = spread(docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")))
    schema = "doc_id long, item_id long, share double"
    out = None
    for block in _passes(items, item, passage, pass_bytes):
        found = source.mapInArrow(partial(_scan, items=Items.of(block)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
