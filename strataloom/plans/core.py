"""Queries of the core operators over the test tables, each with its SQL where SQL can say it.

Searches take the questions whose id is divisible by 20, whole and by their last word, against all units of their
repository; the flagship takes all questions, whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text, vectors
from ..operators import cache, chunks, context, evaluation, graph, incremental, overview, search, snapshot
from ..parsers import references, units as parsing
from ..sources import validation
from ..session import durable
from ..streaming import metrics
from ..tables import table
from . import planted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- what several queries share

META = "code_unit_id, file_id, path, kind, language, start_line, end_line, symbol_name"
U = """u AS (
  SELECT c.id AS code_unit_id, c.file_id, f.repository_id, f.path, c.kind, c.language, c.start_line, c.end_line,
         c.symbol_name, c.content, c.embedding
  FROM code_units c JOIN files f ON f.id = c.file_id
)"""
Q = r"""asked AS (
  SELECT query_id, repository_id, question FROM search_queries WHERE query_id % 20 = 0
  UNION ALL SELECT query_id + 1000000000, repository_id, regexp_extract(question, '(\p{L}+)[^\p{L}]*$', 1) FROM search_queries WHERE query_id % 20 = 0
), q AS (
  SELECT query_id, repository_id, question,
         list_transform(range(384), lambda i:
           ((instr('0123456789abcdef', substr(sha256(question), CAST((i % 32) * 2 + 1 AS INTEGER), 1)) - 1) * 16
            + instr('0123456789abcdef', substr(sha256(question), CAST((i % 32) * 2 + 2 AS INTEGER), 1)) - 1 + 1) / 256.0) AS v
  FROM asked
)"""
TOK = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
TIERS = f"""CASE WHEN symbol_name = question THEN 9 WHEN lower(symbol_name) = lower(question) THEN 8
  WHEN contains(symbol_name, question) THEN 7 WHEN contains(lower(symbol_name), lower(question)) THEN 6
  WHEN contains(path, question) THEN 5 WHEN contains(lower(path), lower(question)) THEN 4
  WHEN contains(content, question) THEN 3 WHEN contains(lower(content), lower(question)) THEN 2
  WHEN len({TOK.format('question')}) > 0 AND list_has_all({TOK.format("concat_ws(' ', coalesce(symbol_name, ''), path, content)")},
       {TOK.format('question')}) THEN 1 ELSE 0 END"""
CANON = "path, start_line, end_line DESC, kind, code_unit_id"
LEX = f"""scored AS (SELECT q.query_id, u.*, {TIERS} AS lexical_score FROM u JOIN q ON q.repository_id = u.repository_id),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, {CANON}) AS rank
        FROM scored WHERE lexical_score > 0)"""
SEM = f"""dist AS (
  SELECT q.query_id, u.*, round(list_cosine_distance(CAST(u.embedding AS DOUBLE[]), CAST(q.v AS DOUBLE[])), 9) AS cosine_distance
  FROM u JOIN q ON q.repository_id = u.repository_id
  WHERE u.embedding IS NOT NULL AND len(list_filter(u.embedding, lambda x: x <> 0)) > 0
), sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine_distance, {CANON}) AS rank FROM dist)"""


def _hybrid_sql(depth: int, limit: int) -> str:
    return f"""{LEX}, {SEM}, fused AS (
  SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.code_unit_id, l.code_unit_id) AS code_unit_id,
         coalesce(s.path, l.path) AS path, coalesce(s.kind, l.kind) AS kind, coalesce(s.start_line, l.start_line) AS start_line,
         coalesce(s.end_line, l.end_line) AS end_line, coalesce(s.symbol_name, l.symbol_name) AS symbol_name,
         coalesce(s.content, l.content) AS content, coalesce(s.repository_id, l.repository_id) AS repository_id,
         coalesce(s.file_id, l.file_id) AS file_id,
         coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS hybrid_score,
         s.rank AS semantic_rank, l.rank AS lexical_rank, s.cosine_distance, l.lexical_score
  FROM (SELECT * FROM sem WHERE rank <= {depth}) s
  FULL JOIN (SELECT * FROM lex WHERE rank <= {depth}) l ON l.query_id = s.query_id AND l.code_unit_id = s.code_unit_id
), hyb AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, {CANON}) AS rank FROM fused
), hybrid AS (SELECT * FROM hyb WHERE rank <= {limit})"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code units with their place."""
    return search.located(table(spark, sf_dir, "code_units"), table(spark, sf_dir, "files"))


def with_vectors(found: DataFrame) -> DataFrame:
    """Questions as they were asked, with their vectors."""
    made = found.withColumn("query_vector", vectors.digest_vector(F.col("question"), 384))
    return made.select("query_id", "repository_id", "question", "query_vector")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of questions, those whose id is divisible by 20: each whole, and its last word as one more
    question under an id of its own, so that every tier of the lexical score has results."""
    stated = table(spark, sf_dir, "search_queries").where(F.col("query_id") % 20 == 0).select("query_id", "repository_id", "question")
    word = F.regexp_extract("question", r"(\p{L}+)[^\p{L}]*$", 1).alias("question")
    return with_vectors(stated.unionByName(stated.select((F.col("query_id") + 1_000_000_000).alias("query_id"), "repository_id", word)))


def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned files, repeated rows once."""
    return table(spark, sf_dir, "source_files").dropDuplicates(["file_id"])


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned files of the parsed languages; a null language is read from the suffix."""
    path = F.col("relative_path")
    language = F.coalesce("language", paths.parser(path)).alias("language")
    files = distinct_files(spark, sf_dir).select("file_id", "repository_id", path.alias("path"), language, "content")
    return files.where(F.col("language").isin("python", "javascript", "typescript"))


# ---- scan and filters


@query(f"WITH {U} SELECT code_unit_id, path FROM u WHERE contains(path, 'src/')")
def filter_path_literal(spark, d):
    """Units below a literal part of a path."""
    return search.Filters(path="src/").apply(units(spark, d)).select("code_unit_id", "path")


@query(f"WITH {U} SELECT code_unit_id, language FROM u WHERE language = 'typescript'")
def filter_language(spark, d):
    """Units of one language."""
    return search.Filters(language="typescript").apply(units(spark, d)).select("code_unit_id", "language")


@query(f"WITH {U} SELECT code_unit_id, symbol_name FROM u WHERE contains(symbol_name, '_')")
def filter_symbol_null(spark, d):
    """Units whose symbol has a literal underscore; a null symbol never matches."""
    return search.Filters(symbol="_").apply(units(spark, d)).select("code_unit_id", "symbol_name")


@query(f"WITH {U} SELECT code_unit_id FROM u WHERE contains(path, 'lib') AND language = 'python' AND contains(symbol_name, 'token')")
def filter_conjunction(spark, d):
    """Units that meet three conditions."""
    return search.Filters("lib", "python", "token").apply(units(spark, d)).select("code_unit_id")


_SUFFIX = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.].*?(\.[^.]+)$', 1))"
_NAME = "lower(regexp_extract(path, '[^/]*$'))"


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"""SELECT path, CASE WHEN {_SUFFIX} = '.py' THEN 'python' WHEN {_SUFFIX} IN ('.js', '.jsx') THEN 'javascript'
  WHEN {_SUFFIX} = '.ts' THEN 'typescript'
  WHEN {_SUFFIX} IN {_list(paths.DOCUMENTATION_SUFFIXES)} OR ({_SUFFIX} = '' AND {_NAME} IN {_list(paths.DOCUMENTATION_NAMES)}) THEN 'documentation'
  WHEN {_SUFFIX} IN {_list(paths.CONFIGURATION_SUFFIXES)} OR {_NAME} IN {_list(paths.CONFIGURATION_NAMES)} THEN 'configuration' END AS parser
FROM (SELECT DISTINCT relative_path AS path FROM source_files)""")
def dispatch_parser_by_suffix(spark, d):
    """The parser of every scanned path."""
    seen = table(spark, d, "source_files").select(F.col("relative_path").alias("path")).distinct()
    return seen.select("path", paths.parser(F.col("path")).alias("parser"))


@query(f"""SELECT path, CASE WHEN {_NAME} IN {_list(paths.SAFE_TEMPLATES)} THEN false
  WHEN {_NAME} IN {_list(paths.SECRET_NAMES)} OR starts_with({_NAME}, '.env.') THEN true
  WHEN {_NAME} IN {_list(paths.DENIED_NAMES)} OR {' OR '.join(f"ends_with({_NAME}, '{e}')" for e in paths.DENIED_ENDINGS)} THEN true
  ELSE {_SUFFIX} IN {_list(paths.DENIED_SUFFIXES)} END AS denied_file,
  len(list_intersect(string_split(lower(path), '/')[:-2], {[*paths.DENIED_DIRECTORIES]})) > 0 AS denied_directory
FROM (SELECT DISTINCT relative_path AS path FROM source_files)""")
def deny_file_names(spark, d):
    """Which scanned paths a scan would have passed over, by name and by directory."""
    seen = table(spark, d, "source_files").select(F.col("relative_path").alias("path")).distinct()
    p = F.col("path")
    return seen.select("path", paths.denied_file(p).alias("denied_file"), paths.denied_directory(p).alias("denied_directory"))


@query("""SELECT file_id, octet_length(encode(any_value(content))) <= 1048576 AS small_enough,
  contains(substr(any_value(content), 1, 8192), chr(0)) AS binary_content FROM source_files GROUP BY file_id""")
def size_and_binary_filter(spark, d):
    """Size limit and binary sniff of every scanned file."""
    body = F.encode("content", "UTF-8")
    return distinct_files(spark, d).select("file_id", (F.octet_length("content") <= paths.MAX_FILE_BYTES).alias("small_enough"), paths.binary(body).alias("binary_content"))


@query("SELECT file_id, sha256(any_value(content)) AS content_hash FROM source_files GROUP BY file_id")
def content_hash(spark, d):
    """Hash of every scanned file."""
    return distinct_files(spark, d).select("file_id", snapshot.content_hash(F.col("content")).alias("content_hash"))


@query(f"""SELECT source, CASE WHEN regexp_matches(source, '^https://[a-z0-9.-]+/.+') THEN 'https' ELSE 'other' END AS verdict FROM repositories
UNION ALL SELECT * FROM ({planted.values(list(planted.SOURCES.items()))}) t(source, verdict)""")
def validate_source(spark, d):
    """Verdict on every repository source of the tables, and on planted ones that must get every kind of verdict."""
    known = spark.createDataFrame([(s,) for s in planted.SOURCES], "source string")
    every = table(spark, d, "repositories").select("source").unionByName(known)
    return every.select("source", validation.verdict(F.col("source")).alias("verdict"))


_FORGE = "git.lumen-forge.invalid"


@query(rf"""WITH s AS (SELECT source FROM repositories UNION ALL SELECT 'HTTPS://GitHub.com/' || upper(replace(name, '.', '-')) || '/' || name || '.git/' FROM repositories),
p AS (SELECT source, lower(regexp_extract(source, '^[A-Za-z]+://([^/:]+)', 1)) AS host, string_split(regexp_replace(lower(source), '/$', ''), '/') AS parts FROM s)
SELECT source, 'https://' || host || '/' || parts[4] || '/' || regexp_replace(parts[5], '\.git$', '') AS canonical, regexp_replace(parts[5], '\.git$', '') AS name
FROM p WHERE host IN ('github.com', '{_FORGE}') AND len(parts) = 5 AND regexp_matches(parts[4], '^[a-z0-9]+(-[a-z0-9]+)*$') AND length(parts[4]) <= 39
AND regexp_matches(regexp_replace(parts[5], '\.git$', ''), '^[a-z0-9_.-]{{1,100}}$')""")
def canonical_source(spark, d):
    """Registered spelling of every stored source on one forge, and of addresses on another in mixed case with a final
    slash, made from the repositories' names."""
    known = table(spark, d, "repositories")
    made = F.concat(F.lit("HTTPS://GitHub.com/"), F.upper(F.replace("name", F.lit("."), F.lit("-"))), F.lit("/"), "name", F.lit(".git/"))
    every = known.select("source").unionByName(known.select(made.alias("source")))
    both = F.coalesce(validation.canonical(F.col("source")), validation.canonical(F.col("source"), _FORGE))
    return every.select("source", both.alias("c")).where("c is not null").select("source", F.col("c.source").alias("canonical"), F.col("c.name").alias("name"))


# ---- texts

_ENDS = r"'\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'"


@query(rf"""WITH f AS (
  SELECT file_id, any_value(content) AS c FROM (SELECT file_id, content, relative_path AS path, language FROM source_files)
  WHERE CASE WHEN language IS NOT NULL THEN language IN ('documentation', 'config') ELSE
    {_SUFFIX} IN {_list(paths.DOCUMENTATION_SUFFIXES)} OR ({_SUFFIX} = '' AND {_NAME} IN {_list(paths.DOCUMENTATION_NAMES)})
    OR {_SUFFIX} IN {_list(paths.CONFIGURATION_SUFFIXES)} OR {_NAME} IN {_list(paths.CONFIGURATION_NAMES)} END GROUP BY file_id
), n AS (
  SELECT file_id, c, unnest(range(0, CAST(ceil(length(c) / 2000.0) AS BIGINT))) AS k FROM f WHERE regexp_replace(c, '[\s\x1C-\x1F\x{85}\pZ]', '', 'g') <> ''
), s AS (
  SELECT file_id, c, CAST(k AS INTEGER) AS chunk_no, substr(c, k * 2000 + 1, 2000) AS chunk, substr(c, 1, k * 2000) AS before FROM n
), l AS (
  SELECT *, len(regexp_extract_all(before, {_ENDS})) + 1
            - CASE WHEN ends_with(before, chr(13)) AND starts_with(chunk, chr(10)) THEN 1 ELSE 0 END AS start_line FROM s
)
SELECT file_id, chunk_no, chunk, CAST(start_line AS INTEGER) AS start_line, CAST(start_line + len(regexp_extract_all(
  CASE WHEN ends_with(chunk, chr(13) || chr(10)) THEN left(chunk, length(chunk) - 2) ELSE left(chunk, length(chunk) - 1) END, {_ENDS})) AS INTEGER) AS end_line
FROM l""")
def chunk_fixed(spark, d):
    """Documentation and configuration in slices of 2,000 characters with their lines."""
    language = F.coalesce("language", paths.parser(F.col("relative_path")))
    docs = distinct_files(spark, d).where(language.isin("documentation", "config", "configuration")).select("file_id", "content")
    return chunks.fixed(docs)


@query(f"""SELECT doc_id, chunk_no, length(chunk) AS characters FROM (
  SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT)))::INTEGER AS chunk_no, text FROM documents
  WHERE regexp_replace(text, '[\\s\\x1C-\\x1F\\x{{85}}\\pZ]', '', 'g') <> ''), LATERAL (SELECT substr(text, chunk_no * 2000 + 1, 2000) AS chunk)""")
def chunk_documents(spark, d):
    """Sizes of the slices of every document."""
    made = chunks.fixed(table(spark, d, "documents").select("doc_id", "text"), "text")
    return made.select("doc_id", "chunk_no", F.length("chunk").alias("characters"))


@query()
def markdown_sections(spark, d):
    """Sections of the Markdown files."""
    docs = distinct_files(spark, d).where(F.lower("relative_path").rlike(r"\.(?:md|markdown)$"))
    return chunks.markdown_sections(docs.select("file_id", "content"))


@query(r"""SELECT file_id, md5(regexp_replace(any_value(content), '[\s\x1C-\x1F\x{85}\pZ]', '', 'g')) AS digest FROM source_files
WHERE regexp_matches(lower(relative_path), '\.(md|markdown)$') AND regexp_replace(content, '[\s\x1C-\x1F\x{85}\pZ]', '', 'g') <> '' GROUP BY file_id""")
def markdown_whole(spark, d):
    """The sections of every Markdown file put together again, white space aside."""
    docs = distinct_files(spark, d).where(F.lower("relative_path").rlike(r"\.(?:md|markdown)$"))
    sections = chunks.markdown_sections(docs.select("file_id", "content"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "section"))), lambda s: s["section"]), "")
    return sections.groupBy("file_id").agg(F.md5(F.regexp_replace(whole, text.BLANK, "").cast("binary")).alias("digest"))


@query(rf"""WITH l AS (SELECT id, regexp_split_to_array(content, {_ENDS})[1] AS line FROM code_units WHERE kind = 'document')
SELECT id, nullif(trim(regexp_replace(trim(regexp_extract(line, '^ {{0,3}}#{{1,6}}(?:\s+(.*))?$', 1)), '(?:^|[ \t]+)#+$', '')), '') AS heading
FROM l WHERE regexp_matches(line, '^ {{0,3}}#{{1,6}}(?:\s|$)')""")
def heading_text(spark, d):
    """Heading of every documentation unit that begins with one, whatever ends the line."""
    line = F.get(text.lines(F.col("content")), F.lit(0))
    docs = table(spark, d, "code_units").where("kind = 'document'").select("id", line.alias("line"))
    heads = docs.where(text.heading_level(F.col("line")) > 0)
    return heads.select("id", text.heading_text(F.col("line")).alias("heading"))


@query(f"SELECT doc_id, len({TOK.format('text')}) AS distinct_tokens FROM documents")
def token_set(spark, d):
    """Number of distinct tokens of every document."""
    return table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("distinct_tokens"))


@query(rf"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, {_ENDS}))
  + CASE WHEN regexp_matches(text, '(?:{_ENDS[1:-1]})$') THEN 0 ELSE 1 END END AS lines FROM documents""")
def line_split(spark, d):
    """Number of lines of every document."""
    return table(spark, d, "documents").select("doc_id", F.size(text.lines(F.col("text"))).cast("long").alias("lines"))


@query("""SELECT id, CAST(start_line + length(content) - length(replace(content, chr(10), ''))
  - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS last_line FROM code_units""")
def unit_line_ranges(spark, d):
    """Last line of every unit as its content says."""
    last = text.inclusive_end_line(F.col("start_line"), F.col("content"))
    return table(spark, d, "code_units").select("id", last.cast("int").alias("last_line"))


# ---- search


@query(f"WITH {U}, {Q}, {LEX} SELECT query_id, {META}, lexical_score, CAST(rank AS INTEGER) AS rank FROM lex WHERE rank <= 10")
def lexical_top10(spark, d):
    """Ten best lexical results of every question."""
    return search.lexical(units(spark, d), questions(spark, d), 10)


@query(f"WITH {U}, {Q}, {LEX} SELECT lexical_score, count(*) AS units FROM scored GROUP BY lexical_score")
def lexical_tiers_histogram(spark, d):
    """Units per tier of relevance, over all questions."""
    return search.tiers(units(spark, d), questions(spark, d))


@query(f"""WITH {U} SELECT code_unit_id FROM u WHERE list_has_all(
  {TOK.format("concat_ws(' ', coalesce(symbol_name, ''), path, content)")}, ['return', 'token', 'payload'])""")
def lexical_fts_only(spark, d):
    """Units that have all of three tokens, in whatever place."""
    document = F.concat_ws(" ", F.coalesce("symbol_name", F.lit("")), "path", "content")
    return units(spark, d).where(text.has_all_tokens(document, F.lit("payload TOKEN; return"))).select("code_unit_id")


@query(f"WITH {U}, {Q}, {SEM} SELECT query_id, {META}, round(cosine_distance, 6) AS cosine_distance, CAST(rank AS INTEGER) AS rank FROM sem WHERE rank <= 10")
def semantic_top10(spark, d):
    """Ten nearest units of every question."""
    return search.semantic(units(spark, d), questions(spark, d), 10).withColumn("cosine_distance", F.round("cosine_distance", 6))


@query(f"""WITH {U}, {Q}, {SEM}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine_distance, {CANON}) AS n
  FROM dist WHERE language = 'python' AND contains(path, 'src'))
SELECT query_id, code_unit_id, CAST(n AS INTEGER) AS rank FROM f WHERE n <= 10""")
def semantic_filtered(spark, d):
    """Ten nearest Python units below src: the filter comes before the rank."""
    found = search.semantic(units(spark, d), questions(spark, d), 10, search.Filters(path="src", language="python"))
    return found.select("query_id", "code_unit_id", "rank")


@query(f"""SELECT kind, count(*) AS units, count_if(embedding IS NULL) AS without,
  count_if(embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero,
  count_if(embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS usable FROM code_units GROUP BY kind""")
def semantic_skip_null_zero(spark, d):
    """Units with and without a usable vector."""
    e = F.col("embedding")
    usable = F.coalesce(vectors.usable(e, 384), F.lit(False))
    return table(spark, d, "code_units").groupBy("kind").agg(
        F.count("*").alias("units"), F.count_if(e.isNull()).alias("without"),
        F.count_if(e.isNotNull() & ~usable).alias("zero"), F.count_if(usable).alias("usable"),
    )


@query(f"WITH {U}, {Q}, {_hybrid_sql(30, 10)} SELECT query_id, code_unit_id, round(hybrid_score, 6) AS hybrid_score, CAST(rank AS INTEGER) AS rank FROM hybrid")
def hybrid_rrf(spark, d):
    """Ten best results of both searches fused."""
    found = search.hybrid(units(spark, d), questions(spark, d), 10)
    return found.select("query_id", "code_unit_id", F.round("hybrid_score", 6).alias("hybrid_score"), "rank")


@query(f"""WITH {U}, {Q}, {_hybrid_sql(30, 10)} SELECT query_id, code_unit_id, CAST(semantic_rank AS INTEGER) AS semantic_rank,
  CAST(lexical_rank AS INTEGER) AS lexical_rank, round(cosine_distance, 6) AS cosine_distance, lexical_score FROM hybrid""")
def hybrid_provenance(spark, d):
    """Where each fused result came from."""
    found = search.hybrid(units(spark, d), questions(spark, d), 10)
    return found.select("query_id", "code_unit_id", "semantic_rank", "lexical_rank", F.round("cosine_distance", 6).alias("cosine_distance"), "lexical_score")


@query(f"WITH {U}, {Q}, {_hybrid_sql(60, 20)} SELECT query_id, count(*) AS results, count(semantic_rank) AS from_semantic, count(lexical_rank) AS from_lexical FROM hybrid GROUP BY query_id")
def hybrid_depth60(spark, d):
    """Fused results at a limit of 20, which takes 60 candidates of each search."""
    found = search.hybrid(units(spark, d), questions(spark, d), 20)
    return found.groupBy("query_id").agg(F.count("*").alias("results"), F.count("semantic_rank").alias("from_semantic"), F.count("lexical_rank").alias("from_lexical"))


_RERANK = f"""docs AS (
  SELECT h.*, q.question, {TOK.format("'Path: ' || path || CASE WHEN symbol_name IS NOT NULL THEN chr(10) || 'Symbol: ' || symbol_name ELSE '' END || chr(10) || 'Content:' || chr(10) || content")} AS t
  FROM hybrid h JOIN q USING (query_id)
), scores AS (
  SELECT *, round(CASE WHEN len({TOK.format('question')}) > 0 THEN len(list_intersect({TOK.format('question')}, t)) / len({TOK.format('question')}) ELSE 0 END, 9) AS rerank_score FROM docs
), rer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS n FROM scores)"""


@query(f"""WITH {U}, {Q}, {_hybrid_sql(60, 20)}, {_RERANK}
SELECT query_id, code_unit_id, round(rerank_score, 6) AS rerank_score, CAST(rank AS INTEGER) AS original_hybrid_rank, CAST(n AS INTEGER) AS rank FROM rer WHERE n <= 10""")
def rerank_overlap(spark, d):
    """Twenty hybrid candidates, the ten that share most tokens with the question first."""
    found = search.reranked(units(spark, d), questions(spark, d), 10)
    return found.select("query_id", "code_unit_id", F.round("rerank_score", 6).alias("rerank_score"), "original_hybrid_rank", "rank")


@query(f"WITH {U}, {Q}, {_hybrid_sql(60, 20)} SELECT query_id, code_unit_id, CAST(NULL AS DOUBLE) AS rerank_score, CAST(rank AS INTEGER) AS rank FROM hybrid WHERE rank <= 10")
def rerank_fallback(spark, d):
    """Without a reranker: the hybrid order, no score."""
    return search.reranked(units(spark, d), questions(spark, d), 10, score=None).select("query_id", "code_unit_id", "rerank_score", "rank")


# ---- graphs: edges of a fixed rule, so that SQL can follow

EDGES = f"""numbered AS (
  SELECT code_unit_id, repository_id, row_number() OVER (PARTITION BY repository_id ORDER BY code_unit_id) - 1 AS i,
         count(*) OVER (PARTITION BY repository_id) AS n FROM u WHERE kind = 'function'
), pairs AS (
  SELECT code_unit_id AS s, repository_id, (7 * i + 3) % n AS j, i FROM numbered
  UNION ALL SELECT code_unit_id, repository_id, (3 * i + 1) % n, i FROM numbered
  UNION ALL SELECT code_unit_id, repository_id, i, i FROM numbered WHERE i % 5 = 0
), edges AS (
  SELECT DISTINCT p.s AS source_unit_id, t.code_unit_id AS target_unit_id, p.repository_id FROM pairs p
  JOIN numbered t ON t.repository_id = p.repository_id AND t.i = p.j
)"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the functions of a repository by a fixed rule, self-edges included."""
    w = Window.partitionBy("repository_id")
    f = units(spark, sf_dir).where("kind = 'function'").select("code_unit_id", "repository_id")
    f = f.withColumn("i", F.row_number().over(w.orderBy("code_unit_id")) - 1).withColumn("n", F.count("*").over(w))
    own = F.when(F.col("i") % 5 == 0, F.array("i")).otherwise(F.array().cast("array<int>"))
    j = F.concat(F.array((7 * F.col("i") + 3) % F.col("n"), (3 * F.col("i") + 1) % F.col("n")), own.cast("array<bigint>"))
    out = f.select(F.col("code_unit_id").alias("source_unit_id"), "repository_id", F.explode(F.array_distinct(j)).alias("j"))
    to = f.select("repository_id", F.col("i").cast("long").alias("j"), F.col("code_unit_id").alias("target_unit_id"))
    return out.join(to, ["repository_id", "j"]).select("source_unit_id", "target_unit_id", "repository_id")


@query(f"""WITH {U}, {EDGES}, t AS (SELECT code_unit_id AS query_id FROM u WHERE kind = 'function'), c AS (
  SELECT DISTINCT e.target_unit_id AS query_id, e.source_unit_id AS code_unit_id FROM edges e WHERE e.source_unit_id <> e.target_unit_id
), r AS (
  SELECT c.query_id, u.*, row_number() OVER (PARTITION BY c.query_id ORDER BY u.path, u.start_line, u.end_line DESC, u.kind, u.code_unit_id) AS rank,
         count(*) OVER (PARTITION BY c.query_id) AS n FROM c JOIN u ON u.code_unit_id = c.code_unit_id
) SELECT query_id, code_unit_id, CAST(rank AS INTEGER) AS rank, n > 2 AS truncated FROM r WHERE rank <= 2""")
def impact_symbol(spark, d):
    """Callers of every function, at most two, and whether there are more."""
    u = units(spark, d)
    targets = u.where("kind = 'function'").select(F.col("code_unit_id").alias("query_id"), "code_unit_id")
    return graph.impact_of_symbols(targets, call_edges(spark, d), u, 2).select("query_id", "code_unit_id", "rank", "truncated")


_IMPORTS = """fn AS (SELECT id, repository_id, path, row_number() OVER (PARTITION BY repository_id ORDER BY id) - 1 AS i,
  count(*) OVER (PARTITION BY repository_id) AS n FROM files
), ie AS (
  SELECT a.id AS source_file_id, b.id AS target_file_id FROM fn a JOIN fn b ON b.repository_id = a.repository_id AND b.i IN ((5 * a.i + 2) % a.n, (2 * a.i) % a.n)
)"""


def _import_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("repository_id")
    f = table(spark, sf_dir, "files").select("id", "repository_id")
    f = f.withColumn("i", (F.row_number().over(w.orderBy("id")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    j = F.explode(F.array_distinct(F.array((5 * F.col("i") + 2) % F.col("n"), (2 * F.col("i")) % F.col("n"))))
    out = f.select(F.col("id").alias("source_file_id"), "repository_id", j.alias("j"))
    to = f.select("repository_id", F.col("i").alias("j"), F.col("id").alias("target_file_id"))
    return out.join(to, ["repository_id", "j"])


@query(f"""WITH {_IMPORTS}, c AS (SELECT DISTINCT target_file_id AS query_id, source_file_id AS file_id FROM ie WHERE source_file_id <> target_file_id),
r AS (SELECT c.query_id, c.file_id, f.path, row_number() OVER (PARTITION BY c.query_id ORDER BY f.path, c.file_id) AS rank,
  count(*) OVER (PARTITION BY c.query_id) AS n FROM c JOIN files f ON f.id = c.file_id)
SELECT query_id, file_id, path, CAST(rank AS INTEGER) AS rank, n > 20 AS truncated FROM r WHERE rank <= 20""")
def impact_file(spark, d):
    """Files that import each file."""
    files = table(spark, d, "files")
    targets = files.select(F.col("id").alias("query_id"), F.col("id").alias("file_id"))
    return graph.impact_of_files(targets, _import_pairs(spark, d), files, 20).select("query_id", "file_id", "path", "rank", "truncated")


@query(f"""WITH {U}, t AS (SELECT repository_id, path, symbol_name FROM u WHERE symbol_name IS NOT NULL GROUP BY ALL)
SELECT repository_id, path, symbol_name, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(code_unit_id) END AS code_unit_id
FROM u JOIN t USING (repository_id, path, symbol_name) GROUP BY repository_id, path, symbol_name""")
def impact_ambiguous(spark, d):
    """How many units each path and symbol name; the unit where it is one."""
    u = units(spark, d)
    named = u.where("symbol_name is not null").select("repository_id", "path", "symbol_name").distinct()
    targets = named.withColumn("query_id", F.struct("repository_id", "path", "symbol_name"))
    found = graph.find_symbol(targets, u)
    return found.select("query_id.*", "matches", "code_unit_id")


_EXPAND = f"""direct AS (SELECT query_id, code_unit_id, path, kind, start_line, end_line, rank AS position FROM hybrid WHERE rank <= 10),
seeds AS (SELECT * FROM direct WHERE position <= 3),
nb AS (
  SELECT s.query_id, s.position AS seed, u.code_unit_id, row_number() OVER (PARTITION BY s.query_id, s.position ORDER BY u.path, u.start_line, u.end_line DESC, u.kind, u.code_unit_id) AS k
  FROM seeds s JOIN edges e ON e.source_unit_id = s.code_unit_id AND e.target_unit_id <> e.source_unit_id JOIN u ON u.code_unit_id = e.target_unit_id
  WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.query_id = s.query_id AND x.code_unit_id = u.code_unit_id)
), once AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, code_unit_id ORDER BY seed, k) AS n FROM nb WHERE k <= 2
), added AS (
  SELECT query_id, code_unit_id, row_number() OVER (PARTITION BY query_id ORDER BY seed, k) AS a FROM once WHERE n = 1
), kept_added AS (SELECT * FROM added WHERE a <= 3), counts AS (SELECT query_id, count(*) AS m FROM kept_added GROUP BY query_id),
kept AS (SELECT d.query_id, d.code_unit_id, d.position FROM direct d LEFT JOIN counts c USING (query_id) WHERE d.position <= 10 - coalesce(c.m, 0)),
last AS (SELECT query_id, max(position) AS p FROM kept GROUP BY query_id)
SELECT query_id, code_unit_id, CAST(position AS INTEGER) AS position, false AS added FROM kept
UNION ALL SELECT a.query_id, a.code_unit_id, CAST(l.p + a.a AS INTEGER), true FROM kept_added a JOIN last l USING (query_id)"""


@query(f"WITH {U}, {Q}, {_hybrid_sql(30, 10)}, {EDGES}, {_EXPAND}")
def expand_outgoing(spark, d):
    """Hybrid results with the functions they call added."""
    u = units(spark, d)
    direct = search.hybrid(u, questions(spark, d), 10)
    return graph.expand(direct, call_edges(spark, d), u, 10).select("query_id", "code_unit_id", "position", "added")


_MODULES = r"""i AS (SELECT c.content, c.language, f.path, f.repository_id FROM code_units c JOIN files f ON f.id = c.file_id WHERE c.kind = 'import'),
m AS (SELECT *, regexp_replace(regexp_replace(content, '#[^\n]*', '', 'g'), '\\\r?\n', ' ', 'g') AS t FROM i),
p AS (SELECT *, regexp_extract(t, '^\s*from\s+(\.*\s*[\w.]*)\s+import\b', 1) AS fm,
  regexp_extract(content, '(?:^\s*import|\bfrom)\s*(?:"([^"\\\n]*)"|''([^''\\\n]*)'')', ['d', 's']) AS js FROM m),
modules AS (SELECT repository_id, path AS source_path, language, unnest(CASE WHEN language = 'python' THEN
  CASE WHEN fm <> '' THEN [regexp_replace(fm, '\s', '', 'g')] ELSE
    list_filter(list_transform(string_split(regexp_extract(t, '^\s*import\s+([\s\S]+)$', 1), ','), lambda n: trim(regexp_extract(n, '^\s*([\w.]+)', 1))), lambda n: n <> '') END
  WHEN language IN ('javascript', 'typescript') AND js.d || js.s <> '' THEN [js.d || js.s] END) AS module FROM p)"""


@query(f"WITH {_MODULES} SELECT * FROM modules")
def import_modules(spark, d):
    """Modules that the stored import units of all languages name."""
    return references.import_modules(units(spark, d)).select("repository_id", "source_path", "language", "module")


_REFERENCES = r"""py AS (SELECT DISTINCT repository_id, path, regexp_replace(path, '(/__init__)?\.py$', '') AS base FROM files WHERE ends_with(path, '.py')),
js AS (SELECT DISTINCT repository_id, path, regexp_replace(path, '\.[jt]sx?$', '') AS base FROM files WHERE regexp_matches(path, '\.(js|jsx|ts)$')),
kept AS (SELECT repository_id, path FROM files UNION SELECT repository_id, array_to_string(string_split(path, '/')[1:k], '/') || '/__init__.py'
  FROM (SELECT repository_id, path, unnest(range(1, len(string_split(path, '/')))) AS k FROM py)),
refs AS (SELECT repository_id, source_path, language, module FROM modules
  UNION SELECT repository_id, 'zz_main.py', 'python', replace(base, '/', '.') FROM py
  UNION SELECT repository_id, regexp_replace(base, '[^/]*$', '') || 'zz.py', 'python', '.' || regexp_extract(base, '[^/]*$') FROM py WHERE contains(base, '/')
  UNION SELECT repository_id, 'zz/entry.ts', 'typescript', '../' || base FROM js
  UNION SELECT repository_id, 'zz/deep/entry.js', 'javascript', './../../' || path FROM js),
inv AS (SELECT * FROM kept UNION SELECT repository_id, source_path FROM refs)"""
_PREFIXES = "list_transform(range(1, len({0}) + 1), lambda i: array_to_string({0}[1:i], '/'))"
_RESOLVED = rf"""pr AS (
  SELECT *, length(regexp_extract(module, '^(\.*)', 1)) AS level, string_split(source_path, '/')[1:-2] AS pkg FROM refs WHERE language = 'python'
), pp AS (
  SELECT *, CASE WHEN level > 0 THEN list_concat(pkg[1:greatest(len(pkg) - level + 1, 0)], CASE WHEN substr(module, level + 1) = '' THEN [] ELSE string_split(substr(module, level + 1), '.') END)
    ELSE string_split(module, '.') END AS parts FROM pr WHERE level = 0 OR (len(pkg) > 0 AND level <= len(pkg))
), pu AS (
  SELECT *, list_distinct(list_concat(CASE WHEN level > 0 THEN {_PREFIXES.format('pkg')} ELSE [] END, {_PREFIXES.format('parts[1:-2]')})) AS packages, array_to_string(parts, '/') AS base
  FROM pp WHERE len(parts) > 0 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^[\p{{L}}_][\p{{L}}\p{{N}}_]*$'))) = 0
    AND NOT (level = 0 AND parts[1] IN {_list(graph.outside_names())})
), pc AS (
  SELECT repository_id, source_path, language, module, packages, unnest([base || '.py', base || '/__init__.py']) AS path FROM pu
), jn AS (
  SELECT *, list_reduce(list_transform(string_split(regexp_replace(source_path, '[^/]*$', '') || module, '/'), lambda x: [x]),
    lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:-2] ELSE a || x END, []::VARCHAR[]) AS parts
  FROM refs WHERE language IN ('javascript', 'typescript') AND regexp_matches(module, '^\.\.?/') AND NOT regexp_matches(module, '[\\?#]')
), jt AS (
  SELECT *, array_to_string(parts, '/') AS target, coalesce(regexp_extract(parts[-1], '[^.].*?(\.[^.]+)$', 1), '') AS suffix, ends_with(module, '/') AS folder
  FROM jn WHERE NOT list_contains(parts, '..')
), jc AS (
  SELECT repository_id, source_path, language, module, []::VARCHAR[] AS packages, unnest(CASE
    WHEN suffix <> '' AND NOT folder THEN CASE WHEN suffix IN ('.js', '.jsx', '.ts') THEN [target] ELSE [] END
    ELSE list_distinct(list_concat(CASE WHEN folder THEN [] ELSE [target || '.js', target || '.jsx', target || '.ts'] END,
      list_transform(['.js', '.jsx', '.ts'], lambda s: CASE WHEN target = '' THEN '' ELSE target || '/' END || 'index' || s))) END) AS path FROM jt
), hit AS (
  SELECT c.repository_id, c.source_path, c.module, any_value(c.packages) AS packages, min(c.path) AS target_path
  FROM (SELECT * FROM pc UNION ALL SELECT * FROM jc) c JOIN inv USING (repository_id, path) GROUP BY 1, 2, 3 HAVING count(*) = 1
), way AS (SELECT repository_id, source_path, module, unnest(packages) AS package FROM hit), bad AS (
  SELECT repository_id, source_path, module FROM way w WHERE NOT EXISTS (SELECT 1 FROM inv WHERE inv.repository_id = w.repository_id AND inv.path = w.package || '/__init__.py')
  OR EXISTS (SELECT 1 FROM inv WHERE inv.repository_id = w.repository_id AND inv.path = w.package || '.py')
), resolved AS (SELECT repository_id, source_path, module, target_path FROM hit ANTI JOIN bad USING (repository_id, source_path, module))"""


def _module_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, inventory): what stored imports name, and references made from the stored paths: every Python file
    by its dotted name from the root and by its name from beside it, every script by its path with and without suffix.
    The inventory has the files that name something, and a package file in every directory above a Python file."""
    stored = references.import_modules(units(spark, sf_dir))
    files = table(spark, sf_dir, "files").select("repository_id", "path").distinct()
    made = lambda df, source, language, module: df.select("repository_id", source.alias("source_path"), F.lit(language).alias("language"), module.alias("module"))
    py = files.where(F.endswith("path", F.lit(".py"))).withColumn("base", F.regexp_replace("path", r"(/__init__)?\.py$", ""))
    js = files.where(F.col("path").rlike(r"\.(js|jsx|ts)$")).withColumn("base", F.regexp_replace("path", r"\.[jt]sx?$", ""))
    inner = py.where(F.contains("base", F.lit("/")))
    every = [
        made(py, F.lit("zz_main.py"), "python", F.replace("base", F.lit("/"), F.lit("."))),
        made(inner, F.concat(F.regexp_replace("base", "[^/]*$", ""), F.lit("zz.py")), "python", F.concat(F.lit("."), F.substring_index("base", "/", -1))),
        made(js, F.lit("zz/entry.ts"), "typescript", F.concat(F.lit("../"), "base")),
        made(js, F.lit("zz/deep/entry.js"), "javascript", F.concat(F.lit("./../../"), "path")),
    ]
    found = reduce(DataFrame.unionByName, every, stored.select("repository_id", "source_path", "language", "module"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/__init__.py")))
    packages = py.where(F.size(parts) > 1).select("repository_id", F.explode(above).alias("path"))
    sources = found.select("repository_id", F.col("source_path").alias("path"))
    return found, files.unionByName(packages).unionByName(sources).distinct()


@query(f"WITH {_MODULES}, {_REFERENCES}, {_RESOLVED} SELECT repository_id, source_path, module, target_path FROM resolved")
def import_resolve(spark, d):
    """Files that module names stand for, in all languages: those of stored imports, and some made from stored paths."""
    return graph.resolve_modules(*_module_references(spark, d)).select("repository_id", "source_path", "module", "target_path")


@query(f"""WITH {_MODULES}, {_REFERENCES}, {_RESOLVED}
SELECT DISTINCT r.repository_id, r.source_path, r.target_path FROM resolved r SEMI JOIN inv ON inv.repository_id = r.repository_id AND inv.path = r.source_path WHERE r.source_path <> r.target_path""")
def import_edge_rows(spark, d):
    """Import edges between files of the inventory: each once, none from a file to itself."""
    return graph.import_edges(*_module_references(spark, d))


@query("""WITH e AS (SELECT l_returnflag || l_linestatus AS repository_id, l_suppkey AS s, l_partkey AS t, l_orderkey * 10 + l_linenumber AS place FROM lineitem)
SELECT repository_id, s, t, min(place) AS first_at FROM e GROUP BY ALL""")
def edge_dedup_first(spark, d):
    """First occurrence of every edge between suppliers and parts, in four repositories of very different size."""
    return graph.first_edges(_line_edges(spark, d), "s", "t", "at").withColumnRenamed("at", "first_at")


@query("""WITH e AS (SELECT l_returnflag || l_linestatus AS repository_id, l_suppkey AS s, l_partkey AS t, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT repository_id, s, t, place AS first_at FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY place, s, t) AS n FROM e) WHERE n <= 100""")
def edge_cap_first(spark, d):
    """The first hundred edges of each repository, where a cap is asked for."""
    return graph.first_edges(_line_edges(spark, d), "s", "t", "at", most=100).withColumnRenamed("at", "first_at")


def _line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("repository_id"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t"), at.alias("at"))


def _call_edges_of(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Call edges of files (file_id, repository_id, path, language, content) between the stored functions in them."""
    analysis = durable(references.analyse_calls(files))  # parsed once, read three times
    ends = references.endpoints_with_units(analysis, stored)
    calls = references.call_rows(analysis, ends)
    return graph.resolve_calls(calls, references.binding_rows(analysis), ends, files)


def _planted(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(files, units) of the planted repository, parsed; a unit's id is its path and name."""
    rows = [(path, "planted", path, language, content) for path, (language, content) in planted.FILES.items()]
    files = spark.createDataFrame(rows, "file_id string, repository_id string, path string, language string, content string")
    name = F.coalesce("symbol_name", F.concat_ws("-", "start_line", "end_line"))
    made = parsing.parse_files(files).withColumn("code_unit_id", F.concat_ws(":", "path", name))
    return files, made.withColumn("embedding", F.lit(None).cast("array<float>"))


@query(f"""SELECT 'planted' AS repository_id, source_unit_id, target_unit_id FROM ({planted.values(planted.CALLS)}) t(source_unit_id, target_unit_id)""")
def call_resolve(spark, d):
    """Call edges of the planted repository and of the scanned texts of the tables, which have none between stored
    functions."""
    files, made = _planted(spark)
    return _call_edges_of(code_files(spark, d).unionByName(files, allowMissingColumns=True), units(spark, d).unionByName(made.select(*units(spark, d).columns), allowMissingColumns=True))


@query(f"SELECT source_path, target_path FROM ({planted.values(planted.IMPORTS)}) t(source_path, target_path)")
def import_edges_planted(spark, d):
    """Import edges of the planted repository, from its parsed units."""
    files, made = _planted(spark)
    return graph.import_edges(references.import_modules(made), files).select("source_path", "target_path")


@query(f"""WITH e AS ({planted.values(planted.CALLS)}) SELECT e.col1 AS query_id, e.col0 AS code_unit_id FROM e WHERE e.col0 <> e.col1""")
def impact_resolved(spark, d):
    """Callers of every function of the planted repository, from resolved calls."""
    files, made = _planted(spark)
    targets = made.where("kind = 'function'").select(F.col("code_unit_id").alias("query_id"), "code_unit_id")
    return graph.impact_of_symbols(targets, _call_edges_of(files, made), made, 20).select("query_id", "code_unit_id")


@query(f"""SELECT path, kind, symbol_name, start_line, end_line FROM ({planted.values(planted.UNITS)}) t(path, kind, symbol_name, start_line, end_line)""")
def parse_planted(spark, d):
    """Units of the planted repository: decorated, nested, exported, several to a line."""
    return _planted(spark)[1].select("path", "kind", "symbol_name", "start_line", "end_line")


@query()
def parse_units(spark, d):
    """Units of the scanned Python, JavaScript and TypeScript files, counted per repository and kind."""
    parsed = parsing.parse_files(code_files(spark, d))
    return parsed.groupBy("repository_id", "language", F.coalesce("kind", F.lit("unparsable")).alias("kind")).agg(F.count("*").alias("rows"))


# ---- overviews


_FILES = "(SELECT repository_id, count(*) AS n FROM files GROUP BY 1)"
_UNITS = "(SELECT f.repository_id, count(*) AS n, count(c.symbol_name) AS named FROM code_units c JOIN files f ON f.id = c.file_id GROUP BY 1)"


@query(f"""SELECT r.id AS repository_id, CAST(r.index_generation AS VARCHAR) AS index_generation, coalesce(f.n, 0) AS files,
  coalesce(u.n, 0) AS code_units, coalesce(u.named, 0) AS named_code_units
FROM repositories r LEFT JOIN {_FILES} f ON f.repository_id = r.id LEFT JOIN {_UNITS} u ON u.repository_id = r.id""")
def overview_counts(spark, d):
    """Counts of every repository."""
    return overview.counts(table(spark, d, "repositories"), table(spark, d, "files"), table(spark, d, "code_units"))


@query("""SELECT f.repository_id, CASE WHEN c.language IN ('python', 'javascript', 'typescript', 'documentation', 'config') THEN c.language ELSE 'other' END AS language,
  count(*) AS count FROM code_units c JOIN files f ON f.id = c.file_id GROUP BY 1, 2""")
def overview_by_language(spark, d):
    """Units per repository and language."""
    return overview.by_group(table(spark, d, "code_units"), table(spark, d, "files"), overview.bucketed(F.col("language")), "language")


@query("SELECT f.repository_id, c.kind, count(*) AS count FROM code_units c JOIN files f ON f.id = c.file_id GROUP BY 1, 2")
def overview_by_kind(spark, d):
    """Units per repository and kind."""
    return overview.by_group(table(spark, d, "code_units"), table(spark, d, "files"), F.col("kind"), "kind")


def _grouped_json(expression: str, name: str) -> str:
    return f"""(SELECT repository_id, CAST(to_json(list({{'{name}': k, 'count': n}} ORDER BY k)) AS VARCHAR) AS j FROM (
  SELECT f.repository_id, {expression} AS k, count(*) AS n FROM code_units c JOIN files f ON f.id = c.file_id GROUP BY 1, 2) GROUP BY 1)"""


_LANGUAGE = "CASE WHEN c.language IN ('python', 'javascript', 'typescript', 'documentation', 'config') THEN c.language ELSE 'other' END"


@query(f"""SELECT r.id AS repository_id, CAST(r.index_generation AS VARCHAR) AS index_generation, j.id AS job_id, j.status, coalesce(f.n, 0) AS files,
  coalesce(u.n, 0) AS code_units, coalesce(u.named, 0) AS named_code_units, coalesce(l.j, '[]') AS by_language, coalesce(k.j, '[]') AS by_kind
FROM repositories r LEFT JOIN {_FILES} f ON f.repository_id = r.id LEFT JOIN {_UNITS} u ON u.repository_id = r.id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS n FROM indexing_jobs) WHERE n = 1) j ON j.repository_id = r.id
LEFT JOIN {_grouped_json(_LANGUAGE, 'language')} l ON l.repository_id = r.id LEFT JOIN {_grouped_json('c.kind', 'kind')} k ON k.repository_id = r.id""")
def overview_json(spark, d):
    """Nested overview of every repository."""
    return overview.overview_json(*(table(spark, d, t) for t in ("repositories", "indexing_jobs", "files", "code_units")))


_LATEST = "(SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS n FROM indexing_jobs)"


@query(f"SELECT repository_id, id AS job_id, status, created_at FROM {_LATEST} WHERE n = 1")
def summary_latest_job(spark, d):
    """Last job of every repository that has one."""
    return overview.latest_jobs(table(spark, d, "indexing_jobs"))


@query(f"""SELECT r.id AS repository_id, j.id AS job_id, j.status, j.created_at,
  CASE WHEN j.status = 'completed' THEN coalesce(f.n, 0) END AS files, CASE WHEN j.status = 'completed' THEN coalesce(u.n, 0) END AS code_units
FROM repositories r LEFT JOIN (SELECT * FROM {_LATEST} WHERE n = 1) j ON j.repository_id = r.id
LEFT JOIN {_FILES} f ON f.repository_id = r.id LEFT JOIN {_UNITS} u ON u.repository_id = r.id""")
def summary_conditional_counts(spark, d):
    """Last job of every repository, with counts only where it was completed."""
    return overview.summary(*(table(spark, d, t) for t in ("repositories", "indexing_jobs", "files", "code_units")))


@query(f"WITH {U} SELECT {META} FROM u WHERE kind = 'class' ORDER BY {CANON} LIMIT 50 OFFSET 100")
def list_units_page(spark, d):
    """The third page of 50 classes."""
    return overview.list_units(units(spark, d).select(*search.META), "class", 50, 100)


@query("SELECT id, name, created_at FROM repositories ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5")
def list_repositories(spark, d):
    """Twenty repositories, newest first, after the first five."""
    return overview.list_repositories(table(spark, d, "repositories").select("id", "name", "created_at"), 20, 5)


@query("""SELECT 'repositories.id' AS "check", count(*) AS violations FROM (SELECT id FROM repositories GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'repositories.source', count(*) FROM (SELECT source FROM repositories GROUP BY source HAVING count(*) > 1)
UNION ALL SELECT 'files.id', count(*) FROM (SELECT id FROM files GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'files.repository_path', count(*) FROM (SELECT repository_id, path FROM files GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'code_units.id', count(*) FROM (SELECT id FROM code_units GROUP BY id HAVING count(*) > 1)""")
def unique_violations_dq(spark, d):
    """Keys that occur more than once."""
    return overview.unique_checks(*(table(spark, d, t) for t in ("repositories", "files", "code_units")))


@query("""SELECT 'files.repository_id' AS "check", count(*) AS violations FROM files WHERE repository_id NOT IN (SELECT id FROM repositories)
UNION ALL SELECT 'code_units.file_id', count(*) FROM code_units WHERE file_id NOT IN (SELECT id FROM files)
UNION ALL SELECT 'indexing_jobs.repository_id', count(*) FROM indexing_jobs WHERE repository_id NOT IN (SELECT id FROM repositories)""")
def fk_violations_dq(spark, d):
    """Rows without their parent."""
    return overview.reference_checks(*(table(spark, d, t) for t in ("repositories", "files", "code_units", "indexing_jobs")))


@query("""SELECT 'repositories.index_generation' AS "check", count_if(index_generation < 0) AS violations FROM repositories
UNION ALL SELECT 'files.content_hash', count_if(content_hash IS NOT NULL AND NOT regexp_matches(content_hash, '^[0-9a-f]{64}$')) FROM files
UNION ALL SELECT 'code_units.kind', count_if(kind NOT IN ('class', 'config', 'document', 'function', 'import')) FROM code_units
UNION ALL SELECT 'code_units.lines', count_if(start_line < 1 OR end_line < start_line) FROM code_units
UNION ALL SELECT 'code_units.content', count_if(content = '') FROM code_units
UNION ALL SELECT 'indexing_jobs.status', count_if(status NOT IN ('pending', 'running', 'completed', 'failed')) FROM indexing_jobs""")
def value_violations_dq(spark, d):
    """Values outside their domain."""
    return overview.value_checks(*(table(spark, d, t) for t in ("repositories", "files", "code_units", "indexing_jobs")))


@query("""SELECT repository_id, count_if(status IN ('pending', 'running')) AS active, count_if(status IN ('completed', 'failed')) AS terminal,
  count_if(status IN ('pending', 'running')) > 1 AS overlapping FROM indexing_jobs GROUP BY repository_id""")
def job_transitions_dq(spark, d):
    """Active and final jobs of every repository."""
    return overview.transition_checks(table(spark, d, "indexing_jobs"))


# ---- snapshots

_CLASSES = """cur AS (SELECT repository_id, relative_path AS path, sha256(any_value(content)) AS h FROM source_files GROUP BY file_id, repository_id, relative_path),
cls AS (SELECT coalesce(c.repository_id, f.repository_id) AS repository_id, coalesce(c.path, f.path) AS path,
  CASE WHEN c.path IS NULL THEN 'removed' WHEN f.path IS NULL OR f.content_hash IS NULL OR f.content_hash <> c.h THEN 'refresh' ELSE 'unchanged' END AS status
  FROM cur c FULL JOIN files f ON f.repository_id = c.repository_id AND f.path = c.path)"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = distinct_files(spark, sf_dir).select("repository_id", F.col("relative_path").alias("path"), snapshot.content_hash(F.col("content")).alias("content_hash"))
    return snapshot.classify(now, table(spark, sf_dir, "files").select("repository_id", "path", "content_hash"))


@query(f"WITH {_CLASSES} SELECT repository_id, path, status FROM cls")
def snapshot_classify(spark, d):
    """What became of every path since the stored state."""
    return _classes(spark, d)


@query(f"""WITH {_CLASSES}, ch AS (SELECT repository_id, count_if(status <> 'unchanged') AS n FROM cls GROUP BY 1)
SELECT r.id AS repository_id, coalesce(ch.n, 0) AS changed, CAST(CAST(r.index_generation AS HUGEINT) + CASE WHEN coalesce(ch.n, 0) > 0 THEN 1 ELSE 0 END AS VARCHAR) AS next_generation
FROM repositories r LEFT JOIN ch ON ch.repository_id = r.id""")
def snapshot_generation(spark, d):
    """The next generation of every repository: one more where something changed."""
    following = snapshot.generations(_classes(spark, d), table(spark, d, "repositories"))
    return following.withColumn("next_generation", F.col("next_generation").cast("string"))


@query(f"""WITH {_CLASSES}, {U} SELECT u.code_unit_id, u.path, 'stored' AS origin FROM u JOIN cls ON cls.repository_id = u.repository_id AND cls.path = u.path AND cls.status = 'unchanged'
UNION ALL SELECT s.file_id, s.path, 'parsed' FROM (SELECT DISTINCT file_id, repository_id, relative_path AS path FROM source_files) s
JOIN cls ON cls.repository_id = s.repository_id AND cls.path = s.path AND cls.status = 'refresh'""")
def snapshot_carry_forward(spark, d):
    """Units of the next generation: the stored ones of unchanged files, and of refreshed files the one unit that a
    parser of whole files gives."""
    stored = units(spark, d).select("code_unit_id", "repository_id", "path", F.lit("stored").alias("origin"))
    parsed = distinct_files(spark, d).select(F.col("file_id").alias("code_unit_id"), "repository_id", F.col("relative_path").alias("path"), F.lit("parsed").alias("origin"))
    return snapshot.carry_forward(stored, _classes(spark, d), parsed).select("code_unit_id", "path", "origin")


@query("""WITH e AS (SELECT user_id % 50 AS job, event_id, ts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS s,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status FROM events),
h AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY ts, s) AS previous FROM e)
SELECT event_id, status, previous, CASE WHEN previous IS NULL THEN status = 'pending' WHEN previous = 'pending' THEN status IN ('running', 'failed')
  WHEN previous = 'running' THEN status IN ('completed', 'failed') ELSE false END AS valid FROM h""")
def job_status_history(spark, d):
    """Validity of every change in a log of states."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    w = Window.partitionBy(F.col("user_id") % 50).orderBy("ts", "event_id")
    log = e.select("event_id", (F.col("user_id") % 50).alias("job_id"), status.alias("status"), F.col("ts").alias("at"), F.row_number().over(w).alias("sequence"))
    return overview.status_history(log.withColumnRenamed("event_id", "event")).select(
        F.col("event").alias("event_id"), "status", "previous", "valid"
    )


# ---- context, citations, cache


def evidence(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """Lexical results of every question as evidence."""
    u = units(spark, sf_dir)
    found = search.lexical(u, questions(spark, sf_dir) if asked is None else asked, 10).select("query_id", "code_unit_id", F.col("rank").alias("idx"))
    names = table(spark, sf_dir, "repositories").select(F.col("id").alias("repository_id"), F.col("name").alias("repository_name"))
    full = found.join(u, "code_unit_id").join(names, "repository_id")
    return full.select("query_id", "idx", "repository_name", "path", "symbol_name", "start_line", "end_line", "content")


_BLOCK = """'[Evidence ' || idx || ']' || chr(10) || 'Repository: ' || repository_name || chr(10) || 'Path: ' || path || chr(10) || 'Symbol: ' || coalesce(symbol_name, '<none>')
  || chr(10) || CASE WHEN start_line = end_line THEN 'Line: ' || start_line ELSE 'Lines: ' || start_line || '-' || end_line END || chr(10)
  || 'Content-Characters: ' || {shown} || '/' || length(content) || chr(10) || 'Content:' || chr(10) || substr(content, 1, {shown}) || {mark} || chr(10) || '[End Evidence ' || idx || ']'"""
_PACK = f"""ev AS (
  SELECT l.query_id, l.rank AS idx, r.name AS repository_name, l.path, l.symbol_name, l.start_line, l.end_line, l.content
  FROM lex l JOIN repositories r ON r.id = l.repository_id WHERE l.rank <= 10
), w AS (SELECT *, {_BLOCK.format(shown='length(content)', mark="''")} AS full_block FROM ev),
s AS (SELECT *, length(full_block) AS whole, sum(length(full_block) + 2) OVER (PARTITION BY query_id ORDER BY idx) - 2 AS upto FROM w),
o AS (SELECT *, sum(CASE WHEN upto > 8000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY idx) AS overs FROM s),
cut AS (
  SELECT *, (SELECT max(k) FROM unnest(range(0, length(content))) t(k) WHERE length({_BLOCK.format(shown='0', mark="(chr(10) || '[TRUNCATED]')")}) - 1 + length(CAST(k AS VARCHAR)) + k <= 8000 - (upto - whole)) AS shown
  FROM o WHERE upto > 8000 AND overs = 1
), blocks AS (
  SELECT query_id, idx, full_block AS block, false AS block_truncated FROM o WHERE upto <= 8000
  UNION ALL SELECT query_id, idx, {_BLOCK.format(shown='shown', mark="(chr(10) || '[TRUNCATED]')")}, true FROM cut WHERE shown IS NOT NULL
)"""


@query(f"WITH {U}, {Q}, {LEX}, {_PACK} SELECT query_id, CAST(idx AS INTEGER) AS idx, block, block_truncated, CAST(sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY idx) - 2 AS BIGINT) AS used FROM blocks")
def context_pack(spark, d):
    """Evidence of every question packed into 8,000 characters."""
    return context.pack(evidence(spark, d))


_PROMPT = f"""{LEX}, {_PACK}, j AS (
  SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY idx) AS text, count(*) AS n, bool_or(block_truncated) AS c FROM blocks GROUP BY query_id
), g AS (SELECT query_id, count(*) AS given FROM ev GROUP BY query_id)
SELECT g.query_id, md5('Question:' || chr(10) || q.question || chr(10) || chr(10) || 'Allowed evidence IDs: ' || CASE WHEN coalesce(n, 0) > 0 THEN '1..' || n ELSE 'none' END || chr(10) || chr(10)
  || CASE WHEN coalesce(c, false) OR coalesce(n, 0) < given THEN '{context.TRUNCATED}' || chr(10) || chr(10) ELSE '' END || 'Repository Evidence:' || chr(10) || coalesce(text, '')) AS prompt_digest,
  coalesce(n, 0) AS included, coalesce(c, false) OR coalesce(n, 0) < given AS truncated
FROM g LEFT JOIN j USING (query_id) JOIN q USING (query_id)"""


def _prompts(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    packed = context.assemble(evidence(spark, sf_dir, asked)).join(asked.select("query_id", "question"), "query_id")
    message = context.prompt(F.col("question"), F.col("text"), F.col("included"), F.col("truncated"))
    return packed.select("query_id", F.md5(message.cast("binary")).alias("prompt_digest"), "included", "truncated")


@query(f"WITH {U}, {Q}, {_PROMPT}")
def prompt_build(spark, d):
    """The message of every question, as a digest."""
    return _prompts(spark, d, questions(spark, d))


_ANSWERS = "a AS (SELECT doc_id AS query_id, 'See [Evidence ' || (doc_id % 7) || '] and [Evidence ' || (doc_id % 5 + 1) || '], not [Evidence 0' || (doc_id % 3) || '] or [Evidence ' || (doc_id % 7) || ']. End' AS answer, 4 AS included FROM documents)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    made = F.concat(F.lit("See [Evidence "), n % 7, F.lit("] and [Evidence "), n % 5 + 1, F.lit("], not [Evidence 0"), n % 3, F.lit("] or [Evidence "), n % 7, F.lit("]. End"))
    return table(spark, sf_dir, "documents").select(n.alias("query_id"), made.alias("answer"), F.lit(4).alias("included"))


@query(rf"""WITH {_ANSWERS}, m AS (SELECT query_id, regexp_extract_all(answer, '\[Evidence ([1-9][0-9]*)\]', 1) AS l FROM a),
x AS (SELECT query_id, CAST(unnest(l) AS BIGINT) AS e, unnest(range(len(l))) AS p FROM m), f AS (SELECT query_id, e, min(p) AS p FROM x WHERE e <= 4 GROUP BY 1, 2)
SELECT query_id, e AS evidence_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) AS INTEGER) AS citation_order FROM f""")
def citations_extract(spark, d):
    """Ids that answers cite, in order, each once."""
    return context.citations(_answers(spark, d))


@query(rf"""WITH {_ANSWERS}, p AS (
  SELECT query_id, string_split_regex(answer, '\[Evidence [1-9][0-9]*\]') AS t, regexp_extract_all(answer, '\[Evidence ([1-9][0-9]*)\]', 1) AS m FROM a
), f AS (
  SELECT query_id, list_filter(flatten(list_transform(range(len(t)), lambda i: [{{'k': 'text', 'v': t[i + 1]}}, {{'k': 'marker', 'v': m[i + 1]}}])),
    lambda x: x.v IS NOT NULL AND NOT (x.k = 'text' AND x.v = '')) AS l FROM p
), r AS (SELECT query_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM f)
SELECT query_id, CAST(pos AS INTEGER) AS pos, CASE WHEN x.k = 'marker' AND TRY_CAST(x.v AS BIGINT) <= 4 THEN 'marker' ELSE 'text' END AS kind,
  CASE WHEN x.k = 'marker' AND TRY_CAST(x.v AS BIGINT) > 4 THEN '[Evidence ' || x.v || ']' ELSE x.v END AS value FROM r""")
def citation_markers(spark, d):
    """Answers as alternating text and known markers."""
    return context.marker_tokens(_answers(spark, d))


@query(rf"""WITH h AS (SELECT id, content, left(content, 4000) AS p FROM code_units),
v AS (SELECT id, content, CASE WHEN length(p) - length(replace(p, chr(10), '')) >= 100 THEN array_to_string(string_split(p, chr(10))[1:100], chr(10)) || chr(10) ELSE p END AS preview FROM h)
SELECT id AS code_unit_id, preview, length(preview) < length(content) AS preview_truncated FROM v""")
def source_preview(spark, d):
    """Preview of every unit."""
    return context.previews(table(spark, d, "code_units").select(F.col("id").alias("code_unit_id"), "content"))


@query("""SELECT q.query_id, 'strataloom:v1:repo:' || q.repository_id || ':snapshot:' || r.index_generation || ':search:' ||
  sha256('{"embedding_dimension":384,"embedding_model":"digest","limit":10,"operation":"semantic_search","q":' || to_json(q.question) || '}') AS cache_key
FROM search_queries q JOIN repositories r ON r.id = q.repository_id""")
def cache_key(spark, d):
    """Cache key of every question against the stored generation."""
    asked = table(spark, d, "search_queries").join(table(spark, d, "repositories").select(F.col("id").alias("repository_id"), "index_generation"), "repository_id")
    request = cache.request(F.col("question"), F.lit(10), "digest", 384)
    return asked.select("query_id", cache.key(F.col("repository_id"), F.col("index_generation"), request).alias("cache_key"))


# ---- evaluation: the best hybrid results against planted targets

_TARGETS = """t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY code_unit_id) - 1 AS target_no, path,
  CASE WHEN query_id % 3 = 0 THEN NULL ELSE symbol_name END AS want FROM lexical_best)"""
_EVAL = f"""{LEX}, {SEM}, lexical_best AS (SELECT query_id, code_unit_id, path, symbol_name FROM lex WHERE rank <= 2), {_TARGETS},
res AS (SELECT query_id, path, symbol_name, rank FROM sem WHERE rank <= 10),
hit AS (SELECT t.query_id, t.target_no, min(r.rank) AS rank FROM t JOIN res r ON r.query_id = t.query_id AND r.path = t.path AND (t.want IS NULL OR t.want = r.symbol_name) GROUP BY 1, 2),
pq AS (
  SELECT n.query_id, round(count_if(coalesce(h.rank, 99) <= 1) / any_value(n.k), 6) AS recall_at_1, round(count_if(coalesce(h.rank, 99) <= 3) / any_value(n.k), 6) AS recall_at_3,
    round(count_if(coalesce(h.rank, 99) <= 5) / any_value(n.k), 6) AS recall_at_5, round(count_if(coalesce(h.rank, 99) <= 10) / any_value(n.k), 6) AS recall_at_10,
    round(coalesce(1.0 / min(h.rank), 0), 6) AS reciprocal_rank, CAST(min(h.rank) AS INTEGER) AS first_rank
  FROM (SELECT query_id, count(*) AS k FROM t GROUP BY 1) n LEFT JOIN hit h USING (query_id) GROUP BY n.query_id
)"""


def _targets(u: DataFrame, q: DataFrame) -> DataFrame:
    """Planted targets: the two best lexical results, of every third question by their path only."""
    best = search.lexical(u, q, 2)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("code_unit_id")) - 1
    want = F.when(F.col("query_id") % 3 != 0, F.col("symbol_name"))
    return best.select("query_id", number.alias("target_no"), "path", want.alias("symbol_name"))


def _per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, q = units(spark, sf_dir), questions(spark, sf_dir)
    return evaluation.per_question(search.semantic(u, q, 10), _targets(u, q))


def _modes_sql() -> str:
    shallow = _hybrid_sql(30, 10)
    wide = _hybrid_sql(60, 20)[len(f"{LEX}, {SEM}, "):]
    rerank = _RERANK
    for name in ("fused", "hybrid", "hyb"):
        wide = re.sub(rf"\b{name}\b", f"{name}_wide", wide)
        rerank = re.sub(rf"\b{name}\b", f"{name}_wide", rerank)
    per_mode = _EVAL[_EVAL.index("hit AS ("):]
    for old, new in (
        ("SELECT t.query_id, t.target_no, min", "SELECT r.mode, t.query_id, t.target_no, min"), ("t.want = r.symbol_name) GROUP BY 1, 2)", "t.want = r.symbol_name) GROUP BY 1, 2, 3)"),
        ("SELECT n.query_id, round", "SELECT n.mode, n.query_id, round"), ("(SELECT query_id, count(*) AS k FROM t GROUP BY 1) n", "(SELECT mode, query_id, count(*) AS k FROM t, (VALUES ('semantic'), ('hybrid'), ('reranked')) m(mode) GROUP BY ALL) n"),
        ("LEFT JOIN hit h USING (query_id) GROUP BY n.query_id", "LEFT JOIN hit h ON h.query_id = n.query_id AND h.mode = n.mode GROUP BY n.mode, n.query_id"),
    ):
        assert old in per_mode
        per_mode = per_mode.replace(old, new)
    return f"""WITH {U}, {Q}, {shallow}, {wide}, {rerank}, lexical_best AS (SELECT query_id, code_unit_id, path, symbol_name FROM lex WHERE rank <= 2), {_TARGETS},
res AS (SELECT 'semantic' AS mode, query_id, path, symbol_name, rank FROM sem WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, path, symbol_name, rank FROM hybrid
  UNION ALL SELECT 'reranked', query_id, path, symbol_name, n FROM rer WHERE n <= 10), {per_mode}
SELECT mode, count(*) AS questions, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_3), 6) AS recall_at_3, round(avg(recall_at_5), 6) AS recall_at_5,
  round(avg(recall_at_10), 6) AS recall_at_10, round(avg(reciprocal_rank), 6) AS mrr FROM pq GROUP BY mode"""


@query(_modes_sql())
def eval_modes(spark, d):
    """Averages of the three ways to search."""
    u = units(spark, d)
    return evaluation.by_mode(u, questions(spark, d), _targets(u, questions(spark, d)))


@query(f"WITH {U}, {Q}, {_EVAL} SELECT * FROM pq")
def eval_recall_at_k(spark, d):
    """Recall and reciprocal rank of every question."""
    return _per_question(spark, d)


@query(f"""WITH {U}, {Q}, {_EVAL} SELECT count(*) AS questions, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_3), 6) AS recall_at_3,
  round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(reciprocal_rank), 6) AS mrr FROM pq""")
def eval_macro(spark, d):
    """Averages over the questions."""
    return evaluation.macro(_per_question(spark, d))


# ---- metrics: counters with resets made from the events

_SAMPLES = """smp AS (SELECT user_id, event_type, ts, value, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) % 15 + 1 AS c FROM events),
gr AS (SELECT *, CASE WHEN c < lag(c) OVER w THEN c ELSE c - lag(c) OVER w END AS delta FROM smp WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts))"""


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    samples = table(spark, sf_dir, "events").withColumn("c", (F.row_number().over(w) - 1) % 15 + 1)
    return metrics.deltas(samples, ["user_id", "event_type"], "ts", "c")


@query(f"""WITH {_SAMPLES} SELECT time_bucket(INTERVAL 5 minutes, ts) AS window_start, round(sum(delta)::DOUBLE, 6) AS increase, round(sum(delta) / 300, 9) AS rate
FROM gr WHERE delta IS NOT NULL GROUP BY 1""")
def counter_rate_5m(spark, d):
    """Growth of all counters per five minutes."""
    return metrics.rate(_grown(spark, d).withColumn("delta", F.col("delta").cast("double")), [], 300)


@query(f"""WITH {_SAMPLES} SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, round(sum(delta)::DOUBLE, 6) AS increase, round(sum(delta) / 3600, 9) AS rate
FROM gr WHERE delta IS NOT NULL AND event_type IN ('error', 'click') GROUP BY 1, 2""")
def rate_by_class(spark, d):
    """Growth per hour of two classes."""
    grown = _grown(spark, d).where(F.col("event_type").isin("error", "click")).withColumn("delta", F.col("delta").cast("double"))
    return metrics.rate(grown, ["event_type"], 3600)


@query(f"""WITH {_SAMPLES} SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, round(100 * coalesce(sum(CASE WHEN event_type = 'error' THEN delta END), 0) / sum(delta), 6) AS percentage
FROM gr WHERE delta IS NOT NULL GROUP BY 1 HAVING sum(delta) > 0""")
def error_percentage(spark, d):
    """Share of errors in the growth of every hour."""
    grown = _grown(spark, d).withColumn("delta", F.col("delta").cast("double"))
    return metrics.error_percentage(grown, F.col("event_type") == "error", 3600)


@query(f"WITH {_SAMPLES} SELECT event_type, round(sum(delta)::DOUBLE, 6) AS increase FROM gr WHERE delta IS NOT NULL GROUP BY 1")
def increase_range(spark, d):
    """Growth over the whole range."""
    return metrics.increase(_grown(spark, d).withColumn("delta", F.col("delta").cast("double")), ["event_type"])


@query(f"""WITH le AS (SELECT unnest([{', '.join(map(str, metrics.REQUEST_BOUNDS))}, 'infinity'::DOUBLE]) AS le),
b AS (SELECT event_type, le, count_if(value <= le)::DOUBLE AS c FROM events, le GROUP BY 1, 2),
x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS below, max(c) OVER (PARTITION BY event_type) AS total FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS n FROM x WHERE total > 0 AND c >= 0.95 * total)
SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * total - below) / (c - below) END, 6) AS quantile FROM f WHERE n = 1""")
def histogram_p95(spark, d):
    """95th percentile of the values of each event type, from fixed buckets."""
    buckets = metrics.bucket_counts(table(spark, d, "events"), ["event_type"], "value", metrics.REQUEST_BOUNDS)
    return metrics.quantile(buckets, ["event_type"], 0.95)


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def latest_sample(spark, d):
    """Time of the last sample of every user."""
    return metrics.latest(table(spark, d, "events").select("user_id", "ts"), ["user_id"]).select("user_id", "ts")


# ---- new and changed records


@query(r"""WITH seen AS (
  SELECT o.*, regexp_replace(o.path, '^(\./+)+', '') AS p FROM file_observations o
  JOIN (SELECT id, max(index_generation) AS g FROM repositories GROUP BY id) r ON r.id = o.repository_id WHERE o.index_generation > r.g
), newest AS (
  SELECT *, row_number() OVER (PARTITION BY repository_id, p ORDER BY index_generation DESC, observed_at DESC, observation_id DESC) AS n FROM seen
)
SELECT repository_id, p AS path FROM newest WHERE n = 1 AND status = 'present' AND NOT EXISTS (
  SELECT 1 FROM files f WHERE f.repository_id = newest.repository_id
    AND regexp_replace(f.path, '^(\./+)+', '') = newest.p AND lower(trim(f.content_hash)) = lower(trim(newest.content_hash)))""")
def p4_found(spark, d):
    """The added or changed paths that the next run must take."""
    tables = (table(spark, d, n) for n in ("file_observations", "repositories", "files"))
    return incremental.changed_paths(*tables).select("repository_id", "path")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked hybrid search of all questions with one hop of calls added."""
    u = units(spark, sf_dir)
    direct = search.reranked(u, with_vectors(table(spark, sf_dir, "search_queries")), 10)
    return graph.expand(direct, call_edges(spark, sf_dir), u, 10).orderBy("query_id", "position")
