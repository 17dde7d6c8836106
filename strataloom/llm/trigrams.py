"""Which trigrams a regex requires, and an index of the trigrams that occur in chunks of text.

The analysis follows the known scheme for regex search over a trigram index: walk the pattern's syntax tree, keep the
set of strings a part can match while it stays small, and turn literal strings into conditions on trigrams. Letters
are folded to lower case on both sides, so case-insensitive patterns lose nothing.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser

import numpy as np

_FOLD = bytes(ord(chr(b).lower()) if b < 128 else b for b in range(256))

#: Strings a part of a pattern may stand for before it is reduced to a condition.
MOST_STRINGS = 48

#: Repetitions of one class of characters from which on they are a condition.
LEAST_RUN = 8

#: True (nothing is required), ("and", (...)), ("or", (...)), a trigram of three bytes, or ("run", bytes, n): somewhere
#: n bytes of a class follow each other.
Condition = bool | tuple | bytes


def _join(kind: str, parts: list) -> Condition:
    flat: list = []
    for x in parts:
        flat.extend(x[1] if isinstance(x, tuple) and x[0] == kind else [x])
    if kind == "or" and True in flat:
        return True
    flat = list(dict.fromkeys(x for x in flat if x is not True))
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> Condition:
    """What any of the strings requires."""
    each = []
    for s in sorted(strings):
        raw = s.lower().encode()
        each.append(_join("and", [raw[i : i + 3] for i in range(len(raw) - 2)]))
    return _join("or", each) if each else True


def _analyse(tree) -> tuple[set[str] | None, Condition]:
    """(all strings that match, if they are few, else None; a condition that every match fulfils)."""
    run: set[str] = {""}  # strings that the current run of known parts can match
    exact = True
    conditions: list = []
    for op, arg in tree:
        strings, condition = _one(op, arg)
        conditions.append(condition)
        if strings is not None:
            joined = {a + b for a in run for b in strings}
            if len(joined) <= MOST_STRINGS:
                run = joined
                continue
        exact = False
        conditions.append(_of_strings(run))
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
    condition = _join("and", [*conditions, _of_strings(run)])
    return (run if exact else None), condition


def _one(op, arg) -> tuple[set[str] | None, Condition]:
    if op is c.LITERAL:
        return ({chr(arg).lower()}, True) if arg < 128 else (None, True)
    if op is c.IN:
        chars = {chr(a).lower() for o, a in arg if o is c.LITERAL and a < 128}
        few = len(chars) <= 6 and all(o is c.LITERAL and a < 128 for o, a in arg)
        return (chars if few else None), True
    if op is c.SUBPATTERN:
        return _analyse(arg[3])
    if op is c.BRANCH:
        parts = [_analyse(p) for p in arg[1]]
        condition = _join("or", [k for _, k in parts])
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), condition
        return None, condition
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        least, most, part = arg
        if least >= LEAST_RUN and len(part) == 1 and (known := _class(*part[0])) is not None:
            return None, ("run", known, least)
        strings, condition = _analyse(part)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, True
        if least == most == 1:
            return strings, condition
        return None, condition if least else True
    if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return {""}, True
    return None, True


def _class(op, arg) -> bytes | None:
    """The bytes, letters folded, that the UTF-8 of a character of a class begins or goes on with; None if most do."""
    if op is c.LITERAL:
        parts = [(c.LITERAL, arg)]
    elif op is c.IN:
        parts = arg
    else:
        return None
    found: set[int] = set()
    for o, a in parts:
        if o is c.LITERAL and a < 128:
            found.add(a)
        elif o is c.RANGE and a[1] < 128:
            found.update(range(a[0], a[1] + 1))
        elif o is c.CATEGORY and a is c.CATEGORY_WORD:
            found.update(b"abcdefghijklmnopqrstuvwxyz0123456789_", range(128, 256))
        elif o is c.CATEGORY and a is c.CATEGORY_DIGIT:
            found.update(b"0123456789", range(128, 256))
        else:
            return None
    return bytes(sorted({_FOLD[x] for x in found}))


def required(pattern: str) -> Condition:
    """The condition on the trigrams of a text that every match of ``pattern`` in it fulfils."""
    return _analyse(_parser.parse(pattern))[1]


def terms(condition: Condition) -> set:
    """All trigrams and runs that a condition names."""
    if condition is True:
        return set()
    if isinstance(condition, tuple) and condition[0] != "run":
        return set().union(*(terms(x) for x in condition[1]))
    return {condition}


class Index:
    """Postings of the given trigrams and runs over chunks: term -> ascending chunk numbers."""

    def __init__(self, wanted: set):
        self.wanted = sorted(x for x in wanted if isinstance(x, bytes))
        self.runs = [x for x in wanted if isinstance(x, tuple)]
        self.codes = np.array([int.from_bytes(t, "big") for t in self.wanted], dtype=np.int64)
        self.known = np.zeros(1 << 24, dtype=bool)
        self.known[self.codes] = True

    def postings(self, chunks: list[bytes]) -> dict:
        """Postings of UTF-8 chunks. A null byte parts chunks; trigrams of patterns have none."""
        ends = np.cumsum([len(x) + 1 for x in chunks])
        a = np.frombuffer(b"\0".join(chunks).translate(_FOLD), dtype=np.uint8).astype(np.int32)
        if len(a) < 3:
            return {}
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        at = np.flatnonzero(self.known[code])
        which = np.searchsorted(self.codes, code[at])
        chunk = np.searchsorted(ends, at, side="right")
        pairs = np.unique(which * len(chunks) + chunk)
        which, chunk = np.divmod(pairs, len(chunks))
        cuts = np.searchsorted(which, np.arange(len(self.wanted) + 1))
        found = {t: chunk[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.wanted) if cuts[i] < cuts[i + 1]}
        for term in self.runs:
            inside = np.zeros(256, dtype=bool)
            inside[list(term[1])] = True
            edges = np.flatnonzero(np.diff(inside[a], prepend=False, append=False))
            starts, stops = edges[::2], edges[1::2]
            found[term] = np.unique(np.searchsorted(ends, starts[stops - starts >= term[2]], side="right"))
        return found


def candidates(condition: Condition, postings: dict, chunks: int) -> np.ndarray:
    """Chunks that fulfil a condition, by intersecting and uniting postings."""
    if condition is True:
        return np.arange(chunks)
    if isinstance(condition, bytes) or condition[0] == "run":
        return postings.get(condition, np.empty(0, dtype=np.int64))
    parts = [candidates(x, postings, chunks) for x in condition[1]]
    if condition[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    found = parts[0]
    for p in parts[1:]:
        found = np.intersect1d(found, p, assume_unique=True)
    return found


def search_all(patterns: dict[str, str], flags: int = 0) -> dict[str, tuple[re.Pattern, Condition]]:
    """Compiled patterns with their conditions."""
    return {name: (re.compile(p, flags), required(p)) for name, p in patterns.items()}
