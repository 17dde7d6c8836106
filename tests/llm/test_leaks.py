"""Leaked passages, and the bit-parallel distance against the plain one."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import leaks

VOCABULARY = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran tel vis mop sud".split()]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.lists(st.integers(0, 3), max_size=80))
def test_myers(a, b):
    assert leaks.myers(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == plain_distance(a, b)


def words(rng, n):
    return [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(n)]


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, p, 0) for i, p in enumerate(items)], "item_id long, passage string, doc_id int")
    return {(r.doc_id, r.item_id) for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "passage", **more).collect()}


def test_planted_quotations(spark):
    rng = random.Random(7)
    items = [words(rng, n) for n in (60, 90, 120, 150)]
    around = lambda w: " ".join(words(rng, 200)) + "\n\n" + w + "\n\n" + " ".join(words(rng, 200))
    docs, want = [], set()
    for k, item in enumerate(items):
        n = len(item)
        cut = lambda share, at=10: item[at : at + int(n * share)]

        def add(text, leaked, k=k):
            if leaked:
                want.add((len(docs), k))
            docs.append(around(text))

        add(" ".join(item), True)
        add(" ".join(cut(0.5)), True)
        add(" ".join(cut(0.2)), False)
        changed = cut(0.7)
        for i in range(3, len(changed), 9):
            changed[i] = "other"
        add(" ".join(changed), True)
        wrong = cut(0.7)
        for i in range(0, len(wrong), 3):
            wrong[i] = "other"
        add(" ".join(wrong), False)
        shuffled = item[:]
        rng.shuffle(shuffled)
        add(" ".join(shuffled), False)
        half = cut(0.6)
        m = len(half) // 2
        add(" ".join(half[:m]) + "\n\n" + " ".join(words(rng, 15)) + "\n\n" + " ".join(half[m:]), True)
        add("\n".join("> " + " ".join(half[i : i + 6]).upper() + "," for i in range(0, len(half), 6)), True)
        add("\\n".join("<b>" + w + "</b>" for w in half), True)
        add("&nbsp;".join(f"_{w}_" for w in half), True)
    docs += ["", None, "x " * 60_000]
    texts = [" ".join(i) for i in items]
    assert found(spark, docs, texts) == want
    assert found(spark, docs, texts, pass_bytes=1) == want  # one pass per item gives the same


def test_runs_that_keep_few_pieces(spark):
    rng = random.Random(11)
    item = words(rng, 150)
    runs = lambda size, count, apart: [item[i * apart : i * apart + size] for i in range(count)]
    changed = runs(12, 6, 20)
    for run in changed:
        run[4], run[8] = "other", "another"
    long = item[20:72]
    long[5::7] = ["other"] * len(long[5::7])
    join = lambda parts, gap: " ".join(" ".join(x + words(rng, gap)) for x in parts)
    docs = [join(changed, 15), join(runs(6, 9, 14), 34), " ".join(long), join(changed[:4], 15), join(runs(6, 8, 14), 34), join(runs(6, 9, 14), 90), " ".join(long[:48])]
    docs = [" ".join(words(rng, 100)) + " " + x + " " + " ".join(words(rng, 100)) for x in docs]
    assert found(spark, docs, [" ".join(item)]) == {(0, 0), (1, 0), (2, 0)}


def test_runs_of_a_pattern_with_other_words_do_not_add_up(spark):
    rng = random.Random(13)
    other = lambda run: ["other" if i in (3, 8) else w for i, w in enumerate(run)]
    item = words(rng, 90)
    parts = [item[a : a + 12] for a in (10, 30, 50)]
    docs = [sum([other(p) + words(rng, 9) for p in parts], []), sum([p + words(rng, 9) for p in parts], []), other(item[10:22]) + item[22:42]]
    docs = [" ".join(words(rng, 50) + d + words(rng, 50)) for d in docs]
    # 36 words of 90, of which 30 and then 36 agree; 32 words in one run
    assert found(spark, docs, [" ".join(item)]) == {(0, 0), (1, 0), (2, 0)}
    item = words(rng, 93)
    parts = [item[a : a + 12] for a in (10, 30, 50)]
    docs = [sum([other(p) + words(rng, 9) for p in parts], []), sum([p + words(rng, 9) for p in parts], []), other(item[10:22]) + item[22:42]]
    docs = [" ".join(words(rng, 50) + d + words(rng, 50)) for d in docs]
    # 31 are needed
    assert found(spark, docs, [" ".join(item)]) == {(1, 0), (2, 0)}


def test_words_that_agree():
    side = leaks._Side([5, 1, 2, 3, 4, 1, 9])
    assert leaks._agreeing(side, 1, 6, [1, 2, 7, 4, 1]) == 4
    assert leaks._agreeing(side, 1, 6, [1, 7, 2, 3, 4, 1]) == 5
    assert leaks._agreeing(side, 1, 6, [4, 3, 2]) == 1
    assert leaks._agreeing(side, 1, 6, [5, 9]) == 0


def test_only_hopeless_hits_are_passed_over(monkeypatch):
    def everything(owner, place, off, need, lengths, pieces):
        for i in np.unique(owner).tolist():
            yield i, slice(*np.searchsorted(owner, (i, i + 1)))

    rng = random.Random(5)
    texts = [[str(rng.randrange(40)) for _ in range(n)] for n in (3, 5, 12, 30, 60, 150)]
    items = leaks.Items.of([(i, " ".join(t)) for i, t in enumerate(texts)])
    lengths = np.array([len(t) for t in texts])
    need = -(-lengths // leaks.SHARE)
    numbers, both = items.vocabulary, 0
    for _ in range(300):
        doc: list[int] = []
        for _ in range(rng.randrange(1, 12)):
            t = rng.choice(texts)
            a = rng.randrange(len(t))
            part = [numbers[w] for w in t[a : a + rng.randrange(4, 40)]]
            doc += [0 if rng.random() < 0.12 else w for w in part] + [0] * rng.randrange(0, 50)
        d = np.array(doc)
        got = dict(leaks._leaks(d, items, need, lengths))
        with monkeypatch.context() as m:
            m.setattr(leaks, "_likely", everything)
            want = dict(leaks._leaks(d, items, need, lengths))
        assert got == want
        both += len(got)
    assert both > 100


def test_edges(spark):
    assert found(spark, ["a b c d e f"], [None, ""]) == set()
    assert found(spark, [], ["a b c d e f g h i"]) == set()
    assert found(spark, ["one two three"] * 2, ["one two three"]) == {(0, 0), (1, 0)}
    d = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta")] * 3, "doc_id long, text string")
    e = spark.createDataFrame([(1, "Alpha, beta gamma delta: epsilon zeta eta!")] * 2, "item_id long, passage string")
    assert leaks.leaks(d, "doc_id", "text", e, "item_id", "passage").count() == 1
