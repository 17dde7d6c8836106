"""Splitting oversized items at natural boundaries.

Agglomerative merging. A text is cut into atomic segments (lines and sentences; where one is too large, words; where
a word is too large, characters). Every boundary between neighbours has a strength. A heap holds the adjacent pairs,
weakest boundary first; a pair is merged while its size plus the overlap fits the limit. What stays apart is held
apart by the strongest boundaries that the limit allows. Each piece but the first then starts with the last tokens
of the piece before it.
"""

from __future__ import annotations

import heapq
import re
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .tokens import Counter, counter, default_vocabulary

#: Strength of a boundary by the white space that follows it and the characters around.
HARD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(7)

_SCHEMA = "item_id long, piece_no int, char_start long, char_end long, own_start long, n_tokens long, text string"
_ARROW = pa.schema(
    [("item_id", pa.int64()), ("piece_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64())]
    + [("own_start", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string())]
)
#: A boundary lies before a run of white space. There the counts of both sides add up exactly: the splitting pattern
#: of the tokenizer looks ahead only from inside a run.
_BREAK = re.compile(r"[\n.!?…](?:(?<=\n)[ \t\n\x0b\x0c\r]*|(?<=[.!?…])[\"'”’)\]]?[ \t]+(?![ \t\n\x0b\x0c\r]))")
_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def _strength(gap: str, after: str) -> int:
    """Strength of the boundary before the white space ``gap`` that ``after`` follows."""
    lines = gap.count("\n")
    if not lines:
        return SENTENCE
    if after in "#`~" and lines:
        return HEADING
    return PARAGRAPH if lines > 1 else LINE


def _atoms(text: str, c: Counter, most: int) -> tuple[list[int], list[int], list[int], bool]:
    """Starts, sizes and the strength of the boundary after each segment, none above ``most`` tokens; whether some
    boundary lies inside a word or a run of white space, where counts need not add up."""
    starts: list[int] = []
    sizes: list[int] = []
    strong: list[int] = []
    odd, at, count = False, 0, c.count

    def add(start: int, end: int, strength: int) -> None:
        nonlocal odd
        part = text[start:end]
        size = count(part)
        if size <= most:
            starts.append(start)
            sizes.append(size)
            strong.append(strength)
            return
        # Words are joined at once as far as they fit: theirs are the weakest boundaries, merged first in any case.
        pieces, tokens = c.pieces(part)
        n, here, pos = 0, start, start
        for piece, k in zip(pieces, tokens):
            if n + k > most and pos > here:
                starts.append(here)
                sizes.append(n)
                strong.append(WORD if piece[0].isspace() else HARD)
                odd = odd or text[pos - 1].isspace()
                n, here = 0, pos
            if k > most:
                odd = True
                for cut, m in _characters(piece, count, most):
                    starts.append(pos)
                    sizes.append(m)
                    strong.append(HARD)
                    pos += len(cut)
                here = pos
                continue
            n += k
            pos += len(piece)
        if pos > here:
            starts.append(here)
            sizes.append(n)
            strong.append(strength)
        else:
            strong[-1] = strength

    for m in _BREAK.finditer(text):
        cut, end = m.span()
        if text[cut] == "\n":
            while cut > at and text[cut - 1] in " \t\x0b\x0c\r":
                cut -= 1
        else:
            cut += 1 if text[cut + 1] in " \t" else 2
        if cut > at and end < len(text):
            add(at, cut, _strength(text[cut:end], text[end]))
            at = cut
    add(at, len(text), HARD)
    return starts, sizes, strong, odd


def _characters(piece: str, count, most: int):
    """A piece that is too large, cut between characters into parts of at most ``most`` tokens."""
    start, n = 0, len(piece)
    while start < n:
        # a token has at least one byte, so most characters always fit; grow from there
        step = max(1, most // 4)
        end = min(n, start + step)
        k = count(piece[start:end])
        while k > most and end > start + 1:
            end = start + max(1, (end - start) // 2)
            k = count(piece[start:end])
        while end < n:
            further = min(n, end + step)
            j = count(piece[start:further])
            if j > most:
                break
            end, k = further, j
        yield piece[start:end], k
        start = end


def merge(sizes: list[int], strengths: list[int], most: int) -> list[int]:
    """Starts of the groups that remain when adjacent segments are merged, weakest boundary first, up to ``most``.

    Ties go to the smaller combined size, then to the earlier pair.
    """
    n = len(sizes)
    size, follow, before = list(sizes), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, stamp = [True] * n, [0] * n
    heap = [(strengths[i], size[i] + size[i + 1], i, 0, 0) for i in range(n - 1) if size[i] + size[i + 1] <= most]
    heapq.heapify(heap)
    while heap:
        _, both, i, a, b = heapq.heappop(heap)
        if not alive[i] or stamp[i] != a:
            continue
        j = follow[i]
        if j >= n or stamp[j] != b or size[i] + size[j] != both:
            continue
        size[i] = both
        stamp[i] += 1
        strengths[i] = strengths[j]
        alive[j] = False
        follow[i] = k = follow[j]
        if k < n:
            before[k] = i
            if both + size[k] <= most:
                heapq.heappush(heap, (strengths[i], both + size[k], i, stamp[i], stamp[k]))
        p = before[i]
        if p >= 0 and size[p] + both <= most:
            heapq.heappush(heap, (strengths[p], size[p] + both, p, stamp[p], stamp[i]))
    return [i for i in range(n) if alive[i]]


def _suffix(text: str, c: Counter, overlap: int) -> tuple[int, int]:
    """Length and tokens of the longest end of ``text`` of at most ``overlap`` tokens, cut between words if it can."""
    if overlap <= 0:
        return 0, 0
    tail = text[-overlap * 6 :]
    while True:
        pieces, sizes = c.pieces(tail)
        if sum(sizes) - sizes[0] >= overlap or len(tail) == len(text):
            break
        tail = text[-2 * len(tail) :]
    length = taken = 0
    for piece, size in zip(reversed(pieces), reversed(sizes)):
        if taken + size > overlap:
            break
        taken += size
        length += len(piece)
    if not length:  # one long word: as many of its last characters as fit
        last, low, high = pieces[-1], 0, 1
        while high < len(last) and c.count(last[-high:]) <= overlap:
            low, high = high, 2 * high
        high = min(high, len(last))
        while low < high:
            middle = (low + high + 1) // 2
            if c.count(last[-middle:]) <= overlap:
                low = middle
            else:
                high = middle - 1
        length, taken = low, c.count(last[-low:]) if low else 0
    return length, taken


def split_text(text: str, c: Counter, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, own start, tokens) of the pieces of ``text``; the own parts tile it, start..own start repeats."""
    if not text:
        return []
    if len(text) < 5 * limit and (n := c.count(text)) <= limit:
        return [(0, len(text), 0, n)]
    most = limit - overlap
    exotic = _EXOTIC(text) is not None
    while True:
        starts, tokens, strong, odd = _atoms(text, c, most)
        total = sum(tokens)
        if total <= limit and (not (odd or exotic) or c.count(text) <= limit):
            return [(0, len(text), 0, c.count(text) if odd or exotic else total)]
        heads = merge(tokens, strong, most)
        sums = [0, *accumulate(tokens)]
        cuts = [*heads, len(starts)]
        starts.append(len(text))
        out = []
        for a, b in zip(cuts, cuts[1:]):
            own, end = starts[a], starts[b]
            back, more = _suffix(text[out[-1][2] : own], c, overlap) if out else (0, 0)
            n = more + sums[b] - sums[a]
            out.append((own - back, end, own, c.count(text[own - back : end]) if odd or exotic else n))
        if all(o[3] <= limit for o in out) or most <= 1:
            return out
        most = max(1, most - max(1, max(o[3] for o in out) - limit))


def _run(batches, path: str, limit: int, overlap: int):
    c = counter(path)
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for no, (start, end, own, n) in enumerate(split_text(text or "", c, limit, overlap)):
                rows.append((item, no, start, end, own, n, text[start:end]))
        columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW)], schema=_ARROW)


def split(
    df: DataFrame, item: str, text: str, limit: int = 512, overlap: int = 64, vocabulary: str | None = None
) -> DataFrame:
    """Pieces of at most ``limit`` tokens: (item_id, piece_no, char_start, char_end, own_start, n_tokens, text).

    Offsets count characters. Each piece but the first of an item repeats the end of the one before it, as many
    whole words as ``overlap`` tokens hold: characters char_start..own_start. A text within the limit is one piece.
    A null or empty text gives none. Repeated rows give repeated pieces. Nothing is shuffled.
    """
    if not 0 <= overlap < limit or limit - overlap < 8:
        raise ValueError("the overlap must leave at least 8 tokens of the limit")
    source = df.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text"))
    run = partial(_run, path=vocabulary or default_vocabulary(), limit=limit, overlap=overlap)
    return spread(source).mapInArrow(run, _SCHEMA)
