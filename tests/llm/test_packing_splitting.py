"""Guarantees of containers and pieces."""

import random
from collections import defaultdict

import pytest

from strataloom.llm import packing, splitting
from strataloom.llm.tokens import counter, default_vocabulary

WORDS = "the ledger reads größe niño übung and (x) -- 12,345 don't we'll façade 模型 \t\n\n\n .".split(" ")
C = counter(default_vocabulary())


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "\n\n", ". ", "? "]) for _ in range(n))


def test_counts_equal_the_tokenizer():
    rng = random.Random(1)
    for n in (0, 1, 5, 60, 300):
        t = text(rng, n)
        whole = len(C.encoding.encode_ordinary(t))
        pieces, sizes = C.pieces(t)
        assert C.count(t) == whole == sum(sizes) and "".join(pieces) == t
    assert C.count("a\x1cb \x85c") == len(C.encoding.encode_ordinary("a\x1cb \x85c"))


@pytest.mark.parametrize("partitions", [1, 3, 80])
def test_every_item_is_packed_once(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i, text(rng, rng.choice([1, 5, 20, 60, 400])), "") for i in range(300)] + [(900, None, ""), (901, "", ""), (5, "again", "")]
    df = spark.createDataFrame(rows, "doc long, body string, n_tokens string").repartition(partitions)
    out = packing.pack(df, "doc", "body", capacity=256, slots=8).collect()
    fill, sizes = defaultdict(int), defaultdict(list)
    for r in out:
        fill[r.container_id] += r.n_tokens
        sizes[r.item_id].append((r.piece_no, r.token_start, r.n_tokens))
    assert all(fill[r.container_id] == r.container_tokens <= 256 for r in out)
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += C.count(t) if t else 0
    assert {i: sum(n for _, _, n in p) for i, p in sizes.items()} == dict(want)
    for i, p in sizes.items():
        if i != 5:
            assert len(p) == max(1, -(-want[i] // 256)) and all(start == no * 256 for no, start, _ in p)
    least = -(-sum(want.values()) // 256)
    assert len(fill) <= least * 1.05 + 3


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "doc long, body string")
    assert packing.pack(empty, "doc", "body").count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, "doc", "body", capacity=0)


def check(t, limit, overlap):
    pieces = splitting.split_text(t, C, limit, overlap)
    assert "".join(t[own:end] for _, end, own, _ in pieces) == t
    for i, (start, end, own, n) in enumerate(pieces):
        assert n == C.count(t[start:end]) <= limit and start <= own < end
        if i:
            back = C.count(t[start:own])
            assert back <= overlap and start >= pieces[i - 1][2]
            if overlap >= 32 and C.count(t[pieces[i - 1][2] : own]) > overlap:
                assert back > overlap / 2
    return pieces


@pytest.mark.parametrize(("limit", "overlap"), [(64, 0), (64, 16), (128, 40), (512, 64)])
def test_pieces_fit_tile_and_overlap(limit, overlap):
    rng = random.Random(limit)
    for n in (1, 30, 200, 2000):
        check(text(rng, n), limit, overlap)
    for t in ("a" * 5000, "\n" * 2000, " " * 3000, "é" * 3000, "x y " * 3000, "a\x1cb\x85 " * 500, "word\r\n" * 800, "模型" * 2000, "." * 3000):
        check(t, limit, overlap)


def test_strong_boundaries_are_kept():
    part = "One line of it here. " * 6
    t = "# A\n" + part + "\n\n# B\n" + part + "\n\n# C\n" + part
    pieces = check(t, 60, 0)
    assert [t[own:end].strip()[:3] for _, end, own, _ in pieces] == ["# A", "# B", "# C"]


def test_merging_is_weakest_first():
    assert splitting.merge([3, 3, 3, 3], [1, 5, 1, 0], 6) == [0, 2]
    assert splitting.merge([3, 3, 3, 3], [5, 1, 5, 0], 6) == [0, 1, 3]
    assert splitting.merge([3, 3, 3, 3], [1, 1, 1, 0], 100) == [0]
    assert splitting.merge([9], [0], 10) == [0]


def test_split_table(spark):
    rng = random.Random(9)
    rows = [(1, text(rng, 900), 0), (2, "short", 0), (3, "", 0), (4, None, 0), (2, "short", 0)]
    out = splitting.split(spark.createDataFrame(rows, "doc long, body string, piece_no int"), "doc", "body", 128, 32).collect()
    assert sorted({r.item_id for r in out}) == [1, 2] and sum(r.item_id == 2 for r in out) == 2
    first = sorted((r for r in out if r.item_id == 1), key=lambda r: r.piece_no)
    assert "".join(rows[0][1][r.own_start : r.char_end] for r in first) == rows[0][1]
    assert all(r.text == rows[0][1][r.char_start : r.char_end] for r in first)
    with pytest.raises(ValueError):
        splitting.split(spark.createDataFrame(rows, "doc long, body string, piece_no int"), "doc", "body", 64, 64)
