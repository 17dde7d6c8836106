"""Rankings against a slow comparison of all items."""

import itertools
import random

import pytest

from strataloom.llm import leximin

SCORES = {"far": False, "hits": True, "mix": True}
SCHEMA = "query_id long, item string, far double, hits int, mix double, rank string"


def value(x, higher):
    if x is None or x != x:
        return float("-inf")
    return x if higher else -x


def slow_percentiles(rows):
    items = sorted({r[1] for r in rows}, key=lambda i: (i is not None, i))
    best = {i: [max(value(r[2 + k], h) for r in rows if r[1] == i) for k, h in enumerate(SCORES.values())] for i in items}
    return {i: [sum(best[j][k] < best[i][k] for j in items) / max(len(items) - 1, 1) for k in range(3)] for i in items}


def planted(rng, query, size):
    """Rows of which five beat all others in two of three scores."""
    rows = []
    for n in range(size):
        top = n < 5
        weak = rng.randrange(3) if top else None
        score = [rng.uniform(10, 11) if top and k != weak else rng.uniform(0, 9) for k in range(3)]
        if not top and rng.random() < 0.3:
            score[rng.randrange(3)] = rng.choice([None, float("nan")])
        rows.append((query, f"{query}-{n:03d}", -score[0] if score[0] is not None else None, None if score[1] is None or score[1] != score[1] else int(score[1] * 100), score[2], "x"))
    return rows + rng.sample(rows, size // 5)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = [r for q in range(12) for r in planted(rng, q, rng.choice([3, 5, 6, 20, 60]))] + planted(rng, 99, 900)
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("hot", [leximin.HOT, 30, 0])
def test_percentiles_and_order(data, monkeypatch, hot):
    rows, df = data
    monkeypatch.setattr(leximin, "HOT", hot)
    ranked = leximin.leximin(df, "query_id", "item", SCORES)
    got = {}
    for r in ranked.collect():
        got.setdefault(r.query_id, {})[r.item_id] = r
    for q in {r[0] for r in rows}:
        slow = slow_percentiles([r for r in rows if r[0] == q])
        assert set(slow) == set(got[q])
        for i, p in slow.items():
            assert got[q][i].percentiles == pytest.approx(p) and got[q][i].leximin == pytest.approx(sorted(p))
    top = leximin.leximin_top(ranked, 3).where("query_id = 99").orderBy("rank").collect()
    slow = slow_percentiles([r for r in rows if r[0] == 99])
    assert [r.item_id for r in top] == sorted(slow, key=lambda i: ([-x for x in sorted(slow[i])], i))[:3]


def test_fair_top_is_the_planted_five(data):
    rows, df = data
    got = {}
    for r in leximin.fair_top(leximin.leximin(df, "query_id", "item", SCORES), 5).collect():
        assert r.exact
        got.setdefault(r.query_id, set()).add(r.item_id)
    for q in {r[0] for r in rows}:
        items = {r[1] for r in rows if r[0] == q}
        assert got[q] == {i for i in items if int(i[-3:]) < 5}


def test_dominant_sets_by_trying_all():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        p = rng.integers(0, 4, (7, 3)).astype(float)
        beats = leximin._beats(p)
        sets = [c for c in itertools.combinations(range(7), 3) if all(beats[a, b] for a in c for b in set(range(7)) - set(c))]
        found = leximin._dominant(beats.copy(), 3)
        assert (found is None) == (not sets)
        if sets:
            assert tuple(found) == sets[0] and len(sets) == 1


@pytest.mark.parametrize("hot", [leximin.HOT, 0])
def test_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(leximin, "HOT", hot)
    empty = spark.createDataFrame([], SCHEMA)
    assert leximin.leximin(empty, "query_id", "item", SCORES).count() == 0
    assert leximin.fair_top(leximin.leximin(empty, "query_id", "item", SCORES), 5).count() == 0
    odd = spark.createDataFrame([(1, None, 1.0, 1, 1.0, ""), (None, "a", None, None, float("nan"), ""), (1, "b", 1.0, 1, 1.0, ""), (1, "b", None, 2, 1.0, "")], SCHEMA)
    ranked = {(r.query_id, r.item_id): r.percentiles for r in leximin.leximin(odd, "query_id", "item", SCORES).collect()}
    assert ranked == {(1, None): [0.0, 0.0, 0.0], (1, "b"): [0.0, 1.0, 0.0], (None, "a"): [0.0, 0.0, 0.0]}


def test_without_a_top_five_the_first_in_order_are_given(spark):
    rows = [(1, f"{i}", float(-i), 0, 0.0, "") for i in range(9)] + [(2, f"{i}", float(-i), 9 - i, float(i), "") for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = leximin.fair_top(leximin.leximin(df, "query_id", "item", SCORES), 5).collect()
    assert sorted((r.query_id, r.item_id) for r in got if r.query_id == 2) == [(2, str(i)) for i in range(695, 700)]
    first = [r for r in got if r.query_id == 1]
    assert len(first) == 5 and not any(r.exact for r in first) and all(r.exact for r in got if r.query_id == 2)
