"""Lexical, semantic, hybrid and reranked search.

Every search takes a table of questions, so one plan answers one question or many: (query_id, repository_id, question
[, query_vector]). Filters apply before ranking. Units are those of :func:`located`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import order

#: The constant of reciprocal rank fusion, candidates per result of a hybrid and of a reranked search.
RRF_K, HYBRID_DEPTH, RERANK_DEPTH = 60, 3, 2
META = ["code_unit_id", "file_id", "path", "kind", "language", "start_line", "end_line", "symbol_name"]


@dataclass(frozen=True)
class Filters:
    """Conditions on units: literal part of the path, exact language, literal part of the symbol."""

    path: str | None = None
    language: str | None = None
    symbol: str | None = None

    def __post_init__(self):
        for value, most in ((self.path, 2000), (self.language, 64), (self.symbol, 2000)):
            if value is not None and not 1 <= len(value) <= most:
                raise ValueError("a filter must have between 1 and its most characters")

    def apply(self, units: DataFrame) -> DataFrame:
        """Units that meet every condition given. A null symbol meets none."""
        parts: list[Column] = []
        if self.path is not None:
            parts.append(F.contains(F.col("path"), F.lit(self.path)))
        if self.language is not None:
            parts.append(F.col("language") == self.language)
        if self.symbol is not None:
            parts.append(F.contains(F.col("symbol_name"), F.lit(self.symbol)))
        return units.where(reduce(lambda a, b: a & b, parts)) if parts else units


def located(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units with the repository and path of their file: an inner join on the file."""
    places = files.select(F.col("id").alias("file_id"), "repository_id", "path")
    return units.withColumnRenamed("id", "code_unit_id").join(places, "file_id")


def lexical_score(question: Column) -> Column:
    """Relevance of a unit in nine tiers, the first that holds; 0 if none does."""
    symbol, path, content = F.col("symbol_name"), F.col("path"), F.col("content")
    low = F.lower(question)
    document = F.concat_ws(" ", F.coalesce(symbol, F.lit("")), path, content)
    return (
        F.when(symbol == question, 9)
        .when(F.lower(symbol) == low, 8)
        .when(F.contains(symbol, question), 7)
        .when(F.contains(F.lower(symbol), low), 6)
        .when(F.contains(path, question), 5)
        .when(F.contains(F.lower(path), low), 4)
        .when(F.contains(content, question), 3)
        .when(F.contains(F.lower(content), low), 2)
        .when(text.has_all_tokens(document, question), 1)
        .otherwise(0)
    )


def needle(question: Column) -> Column:
    """The longest run of plain letters and digits of a question, in lower case; empty if it has none.

    Whatever the tier, the lower-case text of a unit that matches contains it: the run is part of the question, and of
    one of its tokens, and the lower case of plain letters depends on no neighbour.
    """
    runs = F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9]+)"), 1)
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    return F.coalesce(longest["run"], F.lit(""))


def matches(units: DataFrame, questions: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(query_id, metadata, content, lexical_score): every unit of the question's repository that matches.

    The lower-case text is made once per unit. Pairs whose unit lacks the question's needle end in the join; tiers and
    tokens are looked at for the others only. Questions are the small side, which Spark broadcasts while it is small, so
    units stay where they are.
    """
    pool = (filters or Filters()).apply(units).select("repository_id", *META, "content")
    pool = pool.withColumn("low", F.lower(F.concat_ws(" ", F.coalesce("symbol_name", F.lit("")), "path", "content")))
    asked = questions.select("query_id", F.col("repository_id").alias("r"), "question", needle(F.col("question")).alias("needle"))
    found = pool.join(asked, (F.col("repository_id") == F.col("r")) & F.contains("low", F.col("needle")))
    found = found.withColumn("lexical_score", lexical_score(F.col("question"))).where(F.col("lexical_score") > 0)
    return found.select("query_id", *META, "content", "lexical_score")


def lexical(units: DataFrame, questions: DataFrame, limit: int = 10, filters: Filters | None = None) -> DataFrame:
    """(query_id, metadata, lexical_score, rank): the units of the question's repository that match, best first."""
    order.check_limit(limit)
    found = matches(units, questions, filters).select("query_id", *META, "lexical_score")
    return order.top(found, order.canonical(F.col("lexical_score").desc()), limit, ["query_id"])


def tiers(units: DataFrame, questions: DataFrame) -> DataFrame:
    """(lexical_score, units): pairs of a question and a unit of its repository per tier, those without a match as 0."""
    scored = matches(units, questions).groupBy("lexical_score").agg(F.count("*").alias("units"))
    both = units.groupBy("repository_id").agg(F.count("*").alias("u")).join(questions.groupBy("repository_id").agg(F.count("*").alias("q")), "repository_id")
    pairs = both.agg(F.coalesce(F.sum(F.col("u") * F.col("q")), F.lit(0)).alias("units"))
    rest = scored.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("found"))
    none = pairs.join(rest).select(F.lit(0).alias("lexical_score"), (F.col("units") - F.col("found")).alias("units"))
    return scored.unionByName(none.where("units > 0"))


def semantic(
    units: DataFrame, questions: DataFrame, limit: int = 10, filters: Filters | None = None, width: int | None = None
) -> DataFrame:
    """(query_id, metadata, cosine_distance, rank): exact nearest units; unusable vectors take no part."""
    order.check_limit(limit)
    pool = (filters or Filters()).apply(units).where(vectors.usable(F.col("embedding"), width))
    pool = pool.select("repository_id", *META, "embedding").withColumn("n", vectors.norm(F.col("embedding")))
    asked = questions.where(vectors.usable(F.col("query_vector"), width)).select(
        "query_id", "repository_id", "query_vector", vectors.norm(F.col("query_vector")).alias("m")
    )
    distance = vectors.cosine_distance(F.col("embedding"), F.col("query_vector"), F.col("n"), F.col("m"))
    found = pool.join(asked, "repository_id").select(
        "query_id", *META, F.round(distance, 9).alias("cosine_distance")
    )
    return order.top(found, order.canonical(F.col("cosine_distance").asc()), limit, ["query_id"])


def fuse(semantic_rows: DataFrame, lexical_rows: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; metadata comes from the semantic side where it has the unit."""
    s = semantic_rows.select("query_id", "code_unit_id", F.struct(*META[1:]).alias("sm"), "cosine_distance", F.col("rank").alias("semantic_rank"))
    x = lexical_rows.select("query_id", "code_unit_id", F.struct(*META[1:]).alias("lm"), "lexical_score", F.col("rank").alias("lexical_rank"))
    term = lambda r: F.coalesce(F.lit(1.0) / (RRF_K + F.col(r)), F.lit(0.0))
    both = s.join(x, ["query_id", "code_unit_id"], "full_outer").withColumn("meta", F.coalesce("sm", "lm"))
    both = both.select(
        "query_id", "code_unit_id", "meta.*", (term("semantic_rank") + term("lexical_rank")).alias("hybrid_score"),
        "semantic_rank", "lexical_rank", "cosine_distance", "lexical_score",
    )
    return order.top(both, order.canonical(F.col("hybrid_score").desc()), limit, ["query_id"])


def hybrid(
    units: DataFrame, questions: DataFrame, limit: int = 10, filters: Filters | None = None, width: int | None = None
) -> DataFrame:
    """Hybrid search: both searches to three times the limit, fused."""
    order.check_limit(limit)
    depth = min(HYBRID_DEPTH * limit, order.MAX_LIMIT)
    return fuse(semantic(units, questions, depth, filters, width), lexical(units, questions, depth, filters), limit)


def rerank_document(path: Column, symbol: Column, content: Column) -> Column:
    """What a reranker reads of a unit."""
    named = F.when(symbol.isNotNull(), F.concat(F.lit("\nSymbol: "), symbol)).otherwise("")
    return F.concat(F.lit("Path: "), path, named, F.lit("\nContent:\n"), content)


def overlap_score(question: Column, document: Column) -> Column:
    """Default reranker: the share of the question's tokens that the document has."""
    wanted = text.tokens(question)
    shared = F.size(F.array_intersect(wanted, text.tokens(document)))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(0.0)


def reranked(
    units: DataFrame,
    questions: DataFrame,
    limit: int = 10,
    filters: Filters | None = None,
    width: int | None = None,
    score=overlap_score,
) -> DataFrame:
    """Hybrid candidates to twice the limit, ordered by ``score(question, document)``, then by their hybrid rank.

    ``score`` is any function of two columns, also a pandas UDF around a model; None means that no reranker is at
    hand: the hybrid order stays and the score is null. A score that is null or not finite fails the query.
    """
    order.check_limit(limit)
    depth = min(RERANK_DEPTH * limit, order.MAX_LIMIT)
    return rerank(hybrid(units, questions, depth, filters, width), units, questions, limit, score)


def rerank(candidates: DataFrame, units: DataFrame, questions: DataFrame, limit: int, score=overlap_score) -> DataFrame:
    """The last step of :func:`reranked`, on candidates that are there already."""
    candidates = candidates.withColumnRenamed("rank", "original_hybrid_rank")
    if score is None:
        ranked = candidates.withColumn("rerank_score", F.lit(None).cast("double"))
        return order.top(ranked, [F.col("original_hybrid_rank")], limit, ["query_id"])
    contents = units.select("code_unit_id", "content")
    asked = questions.select("query_id", "question")
    full = candidates.join(contents, "code_unit_id").join(asked, "query_id")
    value = score(F.col("question"), rerank_document(F.col("path"), F.col("symbol_name"), F.col("content"))).cast("double")
    checked = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit("bad rerank score")).cast("double")).otherwise(value)
    ranked = full.withColumn("rerank_score", F.round(checked, 9)).drop("content", "question")
    return order.top(ranked, [F.col("rerank_score").desc(), F.col("original_hybrid_rank")], limit, ["query_id"])
