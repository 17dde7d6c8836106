"""Packing, citations, evaluation and cache against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import cache, context, evaluation

EVIDENCE = "query_id int, idx int, repository_name string, path string, symbol_name string, start_line int, end_line int, content string"


def block(row, idx, shown, cut):
    span = f"Line: {row[5]}" if row[5] == row[6] else f"Lines: {row[5]}-{row[6]}"
    head = [f"[Evidence {idx}]", f"Repository: {row[2]}", f"Path: {row[3]}", f"Symbol: {row[4] or '<none>'}", span, f"Content-Characters: {shown}/{len(row[7])}", "Content:"]
    return "\n".join(head) + "\n" + row[7][:shown] + ("\n[TRUNCATED]" if cut else "") + f"\n[End Evidence {idx}]"


def slow_pack(rows, budget):
    out, used, cut = [], 0, False
    for row in rows:
        gap = 2 if out else 0
        whole = block(row, row[1], len(row[7]), False)
        if used + gap + len(whole) <= budget:
            out.append(whole)
            used += gap + len(whole)
            continue
        fitting = [k for k in range(len(row[7])) if used + gap + len(block(row, row[1], k, True)) <= budget]
        if fitting:
            out.append(block(row, row[1], max(fitting), True))
        cut = True
        break
    return "\n\n".join(out), len(out), cut


def test_packing_equals_a_search_over_every_length(spark):
    rng = random.Random(5)
    rows, want = [], {}
    budget = 700
    for q in range(30):
        mine = [(q, i, "repo", "src/é.py", rng.choice([None, "f"]), 1, rng.choice([1, 9]), "xé\n" * rng.choice([0, 1, 3, 30, 40, 70, 330])) for i in range(1, rng.randint(1, 6))]
        rows += mine
        if mine:
            want[q] = slow_pack(mine, budget)
    got = {r.query_id: r for r in context.assemble(spark.createDataFrame(rows, EVIDENCE), budget).collect()}
    assert set(got) == set(want)
    for q, (text, n, cut) in want.items():
        assert (got[q].text, got[q].included, got[q].truncated, got[q].used) == (text, n, cut, len(text))
        assert got[q].used <= budget


def test_prompt_and_empty_evidence(spark):
    df = spark.createDataFrame([("q", "", 0, False), ("q", "body", 2, True)], "q string, b string, n int, t boolean")
    got = [r.p for r in df.select(context.prompt(F.col("q"), F.col("b"), F.col("n"), F.col("t")).alias("p")).collect()]
    assert got[0] == "Question:\nq\n\nAllowed evidence IDs: none\n\nRepository Evidence:\n"
    assert got[1].startswith("Question:\nq\n\nAllowed evidence IDs: 1..2\n\nNote: ") and got[1].endswith("Repository Evidence:\nbody")
    assert df.select(context.answer(F.col("b"), F.lit("x")).alias("a")).collect()[0].a == context.INSUFFICIENT


def test_citations_and_markers(spark):
    answer = "a [Evidence 2][Evidence 1] b [Evidence 2] [Evidence 0] [Evidence 3] [Evidence 01] [evidence 1] [Evidence 99999999999999999999]"
    df = spark.createDataFrame([(1, answer, 2), (2, "", 2), (3, "none", 0)], "query_id int, answer string, included int")
    assert [(r.query_id, r.evidence_id) for r in context.citations(df).orderBy("query_id", "citation_order").collect()] == [(1, 2), (1, 1)]
    parts = context.marker_tokens(df).where("query_id = 1").orderBy("pos").collect()
    assert [r.value for r in parts if r.kind == "marker"] == ["2", "1", "2"]
    assert "".join(r.value if r.kind == "text" else f"[Evidence {r.value}]" for r in parts) == answer


def test_recall_and_reciprocal_rank(spark):
    results = spark.createDataFrame(
        [(1, "a.py", "f", 1), (1, "a.py", "f", 2), (1, "b.py", None, 4), (2, "c.py", "x", 1)], "query_id int, path string, symbol_name string, rank int"
    )
    targets = spark.createDataFrame(
        [(1, 0, "a.py", "f"), (1, 1, "b.py", None), (2, 0, "c.py", "y"), (3, 0, "d.py", None)], "query_id int, target_no int, path string, symbol_name string"
    )
    got = {r.query_id: r for r in evaluation.per_question(results, targets).collect()}
    assert (got[1].recall_at_1, got[1].recall_at_3, got[1].recall_at_5, got[1].reciprocal_rank, got[1].first_rank) == (0.5, 0.5, 1.0, 1.0, 1)
    assert (got[2].recall_at_10, got[2].reciprocal_rank, got[2].first_rank) == (0.0, 0.0, None)
    mean = evaluation.macro(evaluation.per_question(results, targets)).head()
    assert (mean.questions, mean.recall_at_1, mean.mrr) == (3, round(0.5 / 3, 6), round(1 / 3, 6))
    with pytest.raises(ValueError):
        evaluation.per_question(results, targets, (0,))
    with pytest.raises(RuntimeError):
        evaluation.guard(spark.createDataFrame([(0.5,)], "mrr double"), {"mrr": 0.8}, False)
    with pytest.raises(RuntimeError):
        evaluation.guard(spark.createDataFrame([(0.8,)], "mrr double"), {"mrr": 0.8}, True)


def test_cache_hits_need_age_size_and_generation(spark):
    now = dt.datetime(2025, 1, 1, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    rows = [("k1", "r", 3, '{"a": 1}', ago(10)), ("k2", "r", 3, "{}", ago(301)), ("k3", "r", 3, "no json", ago(1)), ("k4", "r", 2, "{}", ago(1)), ("k5", "r", 3, '"' + "x" * cache.MAX_BYTES + '"', ago(1))]
    table = spark.createDataFrame(rows, "key string, repository_id string, generation long, payload string, created_at timestamp_ntz")
    asked = spark.createDataFrame([(i, f"k{i}", "r", 3) for i in range(1, 7)], "query_id int, key string, repository_id string, generation long")
    assert [(r.query_id, r.payload) for r in cache.hits(table, asked, F.lit(now)).collect()] == [(1, '{"a": 1}')]
    results = table.withColumn("current_generation", F.lit(3).cast("long"))
    assert {r.key for r in cache.storable(results).collect()} == {"k1", "k2", "k3"}
