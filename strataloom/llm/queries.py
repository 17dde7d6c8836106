"""The pN_ queries of this subpackage over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import credentials, docpairs, filekinds, leaks, leximin, neighbours, packing, splitting, syntax

#: Scores of a hybrid search result and whether a higher value is better.
SCORES = {"cosine_distance": False, "lexical_score": True, "hybrid_score": True}
#: Tokens of a container (problem 8), of a piece and of the overlap of two pieces (problem 10).
CAPACITY, LIMIT, OVERLAP = 2048, 512, 64


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leximin.leximin(table(spark, sf_dir, "hybrid_results"), "query_id", "code_unit_id", SCORES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five results of each query that form the top of the fair ranking."""
    top = leximin.fair_top(_ranked(spark, sf_dir), 5)
    return top.select("query_id", F.col("item_id").alias("code_unit_id"))


def p1_leximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten results of each query in leximin order."""
    top = leximin.leximin_top(_ranked(spark, sf_dir), 10)
    return top.select(
        "query_id",
        F.col("item_id").alias("code_unit_id"),
        "rank",
        *[F.round(F.col("leximin")[i], 9).alias(f"least_{i}") for i in range(len(SCORES))],
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of code units on which a credential begins."""
    found = credentials.find(table(spark, sf_dir, "code_units").select("id", "content"), "id", "content")
    return found.select(F.col("id").alias("code_unit_id"), "line_no").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code unit with its credentials starred out."""
    units = table(spark, sf_dir, "code_units").select("id", "content")
    return credentials.redact(units, "id", "content").withColumnRenamed("id", "code_unit_id")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and line ends of every unit after its credentials were starred out: as many as before."""
    kept = p2_redacted(spark, sf_dir)
    ends = F.length(F.regexp_replace("content", r"[^\r\n]", ""))
    return kept.select("code_unit_id", F.length("content").alias("characters"), ends.alias("line_ends"))


def _verdicts(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    return syntax.check(files, "file_id", "repository_id", "language", "relative_path", "content", every)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not follow the grammar of their language."""
    return _verdicts(spark, sf_dir).where(F.col("verdict").isin(*syntax.FAULTY)).select("file_id").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files per repository and language."""
    return syntax.rates(_verdicts(spark, sf_dir))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files held to each grammar per repository, the valid ones too."""
    return p3_rates(spark, sf_dir).select("repository_id", "language", "files")


def p3_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all files held to each grammar how many each grammar accepts."""
    rows = _verdicts(spark, sf_dir, True).dropDuplicates(["file_id"])
    return rows.select("grammar", F.explode("accepted").alias("accepted_by")).groupBy("grammar", "accepted_by").agg(F.count("*").alias("files"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "code_units").where(F.col("kind") == "function")
    return docpairs.pairs(units, "id", "symbol_name", "language", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function units with non-trivial documentation of their own."""
    return _pairs(spark, sf_dir).select(F.col("id").alias("code_unit_id")).distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description and code of every really documented function."""
    return _pairs(spark, sf_dir).withColumnRenamed("id", "code_unit_id")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    return filekinds.beliefs(files, "file_id", "repository_id", "relative_path", "content")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python, JavaScript and TypeScript files that were not written by hand."""
    kinds = _kinds(spark, sf_dir).where(F.col("label") != "handwritten")
    return kinds.where(F.lower("path").rlike(r"\.(?:py|pyi|js|jsx|mjs|cjs|ts)$")).select("file_id")


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each label per repository."""
    return _kinds(spark, sf_dir).groupBy("repository_id", "label").agg(F.count("*").alias("files"))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that got a label per repository: every file once."""
    return _kinds(spark, sf_dir).groupBy("repository_id").agg(F.count("*").alias("files"))


def p6_handwritten_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code units of the files that remain: those written by hand."""
    kept = _kinds(spark, sf_dir).where(F.col("label") == "handwritten").select("file_id")
    return table(spark, sf_dir, "code_units").select("id", "file_id", "kind", "symbol_name").join(kept, "file_id", "left_semi")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of code units of which one is among the five nearest of the other."""
    pairs = neighbours.neighbour_pairs(table(spark, sf_dir, "code_units"), "id", "embedding", 5)
    return pairs.select(F.col("id_a").alias("code_unit_id_a"), F.col("id_b").alias("code_unit_id_b"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed in a container of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of every document follow each other without a gap."""
    whole = (F.sum("n_tokens") == F.max(F.col("token_start") + F.col("n_tokens"))) & (F.count("*") == F.max("piece_no") + 1)
    return p8_packed(spark, sf_dir).groupBy("item_id").agg(whole.alias("whole"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers above their capacity, and such whose items do not add up to what is said of them."""
    sums = p8_packed(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max("container_tokens").alias("said"))
    return sums.agg(F.count_if(F.col("n") > CAPACITY).alias("over_capacity"), F.count_if(F.col("n") != F.col("said")).alias("wrong_totals"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks.leaks(documents, "doc_id", "text", items, "item_id", "passage")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they contain."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every leaked item the number of documents and the largest share found."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.round(F.max("share"), 6).alias("largest_share")
    )


def p10_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of at most 512 tokens that overlap by 64."""
    return splitting.split(table(spark, sf_dir, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def p10_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own parts of the pieces of every document, put together again, and its pieces above the limit."""
    own = F.struct("piece_no", F.substring(F.col("text"), (F.col("own_start") - F.col("char_start") + 1).cast("int"), F.length("text")).alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["part"]), "")
    tiled = p10_split(spark, sf_dir).groupBy("item_id").agg(F.md5(text.cast("binary")).alias("digest"), F.count_if(F.col("n_tokens") > LIMIT).alias("over_limit"))
    return tiled


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    every = (p1_found, p1_leximin, p2_found, p2_redacted, p2_kept, p3_found, p3_rates, p3_totals, p3_grammars, p5_found, p5_pairs, p6_found, p6_labels, p6_totals,
             p6_handwritten_units, p7_found, p8_packed, p8_placed, p8_fill, p9_found, p9_items, p10_split, p10_tiled)
    return {f.__name__: f for f in every}
