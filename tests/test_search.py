"""Tiers, ties, filters and fusion, with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph, order, search
from strataloom.providers import scorer

SCHEMA = (
    "code_unit_id string, file_id string, repository_id string, path string, kind string, language string, "
    "start_line int, end_line int, symbol_name string, content string, embedding array<float>"
)


def unit(i, symbol=None, path="src/a.py", content="x", embedding=None, kind="function", start=1, end=2, language="python", repo="r"):
    return (f"u{i:02d}", "f", repo, path, kind, language, start, end, symbol, content, embedding)


def asked(spark, question="parse", vector=None, repo="r"):
    return spark.createDataFrame([(1, repo, question, vector)], "query_id long, repository_id string, question string, query_vector array<double>")


def test_lexical_tiers(spark):
    rows = [
        unit(9, "parse"), unit(8, "Parse"), unit(7, "do_parse"), unit(6, "doPARSE"), unit(5, None, "src/parse/x.py"), unit(4, None, "src/PARSE.py"),
        unit(3, None, content="call parse()"), unit(2, None, content="PARSEr"), unit(0, None, content="nothing"),
    ]
    found = search.lexical(spark.createDataFrame(rows, SCHEMA), asked(spark), 100).collect()
    assert {r.code_unit_id: r.lexical_score for r in found} == {f"u0{i}": i for i in range(2, 10)}
    assert [r.rank for r in sorted(found, key=lambda r: -r.lexical_score)] == list(range(1, 9))


def test_full_text_tier_needs_every_token(spark):
    rows = [unit(1, None, content="beta, then alpha"), unit(2, None, content="alpha only"), unit(3, "alpha_beta", content="gamma")]
    found = search.lexical(spark.createDataFrame(rows, SCHEMA), asked(spark, "alpha beta"), 10).collect()
    # an underscore parts tokens, as it is neither letter nor digit
    assert {(r.code_unit_id, r.lexical_score) for r in found} == {("u01", 1), ("u03", 1)}


def test_ties_follow_the_canonical_order(spark):
    rows = [
        unit(1, "parse", "src/b.py"), unit(2, "parse", "src/a.py", start=5, end=6), unit(3, "parse", "src/a.py", start=1, end=2),
        unit(4, "parse", "src/a.py", start=1, end=9), unit(6, "parse", "src/a.py", start=1, end=9, kind="class"), unit(5, "parse", "src/a.py", start=1, end=9),
    ]
    found = search.lexical(spark.createDataFrame(rows, SCHEMA), asked(spark), 10).orderBy("rank").collect()
    assert [r.code_unit_id for r in found] == ["u06", "u04", "u05", "u03", "u02", "u01"]


def test_filters_are_literal_and_come_first(spark):
    rows = [unit(1, "a_b", "src/100%/x.py"), unit(2, "aXb", "src/100x/x.py"), unit(3, None, "src/100%/y.py", language="Python")]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = lambda f: {r.code_unit_id for r in f.apply(df).collect()}
    assert ids(search.Filters(path="0%")) == {"u01", "u03"}
    assert ids(search.Filters(symbol="a_b")) == {"u01"}
    assert ids(search.Filters(language="python")) == {"u01", "u02"}
    assert ids(search.Filters()) == {"u01", "u02", "u03"}
    with pytest.raises(ValueError):
        search.Filters(path="")


def test_semantic_distances_and_unusable_vectors(spark):
    rows = [
        unit(1, embedding=[1.0, 0.0]), unit(2, embedding=[1.0, 1.0]), unit(3, embedding=[0.0, 2.0]), unit(4, embedding=[-3.0, 0.0]),
        unit(5, embedding=None), unit(6, embedding=[0.0, 0.0]), unit(7, embedding=[1.0]), unit(8, embedding=[float("nan"), 1.0]),
        unit(9, embedding=[1.0, 0.0], repo="other"),
    ]
    found = search.semantic(spark.createDataFrame(rows, SCHEMA), asked(spark, vector=[2.0, 0.0]), 10, width=2).orderBy("rank").collect()
    assert [(r.code_unit_id, round(r.cosine_distance, 6)) for r in found] == [("u01", 0.0), ("u02", 0.292893), ("u03", 1.0), ("u04", 2.0)]


def test_hybrid_scores_and_provenance(spark):
    rows = [unit(1, "parse", embedding=[0.0, 1.0]), unit(2, None, content="none", embedding=[1.0, 0.0]), unit(3, "parser", embedding=None)]
    found = {r.code_unit_id: r for r in search.hybrid(spark.createDataFrame(rows, SCHEMA), asked(spark, vector=[1.0, 0.0]), 10).collect()}
    assert found["u01"].hybrid_score == pytest.approx(1 / 62 + 1 / 61)
    assert (found["u02"].semantic_rank, found["u02"].lexical_rank, found["u02"].lexical_score) == (1, None, None)
    assert (found["u03"].semantic_rank, found["u03"].lexical_rank, found["u03"].cosine_distance) == (None, 2, None)
    assert [u for u, _ in sorted(found.items(), key=lambda kv: kv[1].rank)] == ["u01", "u02", "u03"]


def test_rerank_order_fallback_and_bad_scores(spark):
    rows = [unit(1, "parse", content="parse one"), unit(2, "parser", content="parse two")]
    df, q = spark.createDataFrame(rows, SCHEMA), asked(spark)

    class Longest:
        def score(self, question, documents):
            return [float("two" in d) for d in documents]

    best = search.reranked(df, q, 2, score=scorer(Longest)).orderBy("rank").collect()
    assert [(r.code_unit_id, r.original_hybrid_rank) for r in best] == [("u02", 2), ("u01", 1)]
    kept = search.reranked(df, q, 2, score=None).orderBy("rank").collect()
    assert [(r.code_unit_id, r.rerank_score) for r in kept] == [("u01", None), ("u02", None)]
    with pytest.raises(Exception, match="bad rerank score"):
        search.reranked(df, q, 2, score=lambda a, b: F.lit(float("nan"))).collect()


@pytest.mark.parametrize("limit", [0, 101, True, "3"])
def test_limits_are_checked(limit):
    with pytest.raises(ValueError):
        order.check_limit(limit)


def expansion(spark, limit, neighbours, direct=10):
    metas = "query_id long, code_unit_id string, file_id string, path string, kind string, language string, start_line int, end_line int, symbol_name string, rank int"
    rows = [(1, f"d{i}", "f", "p", "function", "python", i, i, None, i) for i in range(1, min(direct, limit) + 1)]
    edges = [(f"d{1 + i // 2}", f"n{i}") for i in range(neighbours)] + [("d1", "d1"), ("d1", "d2")]
    others = [(f"n{i}", "f", "q", "function", "python", i + 1, i + 1, None) for i in range(neighbours)]
    units = spark.createDataFrame([r[1:9] for r in rows] + others, metas.replace("query_id long, ", "").replace(", rank int", ""))
    out = graph.expand(spark.createDataFrame(rows, metas), spark.createDataFrame(edges, "source_unit_id string, target_unit_id string"), units, limit)
    return [r.code_unit_id for r in out.orderBy("position").collect()]


@pytest.mark.parametrize(("limit", "neighbours", "added"), [(1, 4, 0), (2, 4, 0), (3, 4, 1), (10, 0, 0), (10, 2, 2), (10, 6, 3), (12, 6, 4)])
def test_expansion_allowance(spark, limit, neighbours, added):
    got = expansion(spark, limit, neighbours, direct=limit)
    assert got == [f"d{i}" for i in range(1, limit - added + 1)] + [f"n{i}" for i in range(added)]


def test_impact_truncation_and_recursion(spark):
    u = spark.createDataFrame([unit(i, f"s{i}", start=i, end=i) for i in range(1, 6)], SCHEMA)
    edges = spark.createDataFrame([("u02", "u01"), ("u03", "u01"), ("u04", "u01"), ("u01", "u01"), ("u02", "u01")], "source_unit_id string, target_unit_id string")
    targets = spark.createDataFrame([("t", "u01"), ("e", "u05")], "query_id string, code_unit_id string")
    two = graph.impact_of_symbols(targets, edges, u, 2).orderBy("rank").collect()
    assert [(r.query_id, r.code_unit_id, r.truncated) for r in two] == [("t", "u02", True), ("t", "u03", True)]
    assert [r.truncated for r in graph.impact_of_symbols(targets, edges, u, 3).collect()] == [False] * 3
