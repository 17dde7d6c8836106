"""Queries of what a service offers: answers, impact, cached search, summaries, metric samples; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import ask, cache, graph, order, overview
from ..parsers import units as parsing
from ..providers import FixedAnswer
from ..streaming import metrics, producers
from ..tables import table
from . import core
from .core import query

# ---- answers

_DIRECT = "n AS position FROM rer WHERE n <= 10"
_STEPS, _FINAL = core._EXPAND.replace("rank AS position FROM hybrid WHERE rank <= 10", _DIRECT).split("\nSELECT query_id, code_unit_id, CAST(position", 1)
_EVIDENCE = f"""final AS (SELECT query_id, code_unit_id, CAST(position{_FINAL}), ev AS (
  SELECT f.query_id, f.position AS idx, r.name AS repository_name, u.path, u.symbol_name, u.start_line, u.end_line, u.content
  FROM final f JOIN u USING (code_unit_id) JOIN repositories r ON r.id = u.repository_id
)"""
_ASK = f"""{core.U}, {core.Q}, {core._hybrid_sql(60, 20)}, {core._RERANK}, {core.EDGES}, {_STEPS}, {_EVIDENCE}, {core._PACK[core._PACK.index("w AS ("):]}"""
_SAID = "The pack is kept here [Evidence 3], and there [Evidence 1] [Evidence 3], never in [Evidence 99] or [Evidence 01]."


@query(f"""WITH {_ASK}, j AS (
  SELECT query_id, count(*) AS n, bool_or(block_truncated) AS cut FROM blocks GROUP BY query_id
), g AS (SELECT query_id, count(*) AS given FROM ev GROUP BY query_id), cited AS (
  SELECT e.query_id, list({{'evidence_id': e.idx, 'path': e.path, 'preview': left(e.content, 4000)}} ORDER BY e.idx DESC) AS c
  FROM ev e JOIN j USING (query_id) WHERE e.idx IN (1, 3) AND e.idx <= j.n GROUP BY e.query_id
)
SELECT q.query_id, 'answered' AS outcome, 200 AS status, CASE WHEN coalesce(j.n, 0) = 0 THEN 'The available evidence is insufficient to answer the question.' ELSE '{_SAID}' END AS answer,
  coalesce(j.n, 0) AS included, coalesce(j.cut, false) OR coalesce(j.n, 0) < coalesce(g.given, 0) AS truncated, coalesce(len(cited.c), 0) AS citations,
  md5(coalesce(array_to_string(list_transform(cited.c, lambda x: x.evidence_id || ':' || x.path), ' '), '')) AS cited
FROM q LEFT JOIN j USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN cited USING (query_id)""")
def ask_answers(spark, d):
    """Answers of a fixed model to all stated questions: what was in the prompt, and what the answer cites of it."""
    u = core.units(spark, d)
    said = ask.ask(core.questions(spark, d), table(spark, d, "repositories"), u, core.call_edges(spark, d), lambda: FixedAnswer(_SAID))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(c["evidence_id"].cast("string"), F.lit(":"), c["path"])), " ")
    return said.select("query_id", "outcome", "status", "answer", "included", "truncated", F.size("citations").alias("citations"), F.md5(cited.cast("binary")).alias("cited"))


# ---- impact

_TARGETS = """targets AS (
  SELECT 'f' || id AS query_id, repository_id, path, CAST(NULL AS VARCHAR) AS symbol_name FROM files
  UNION ALL SELECT DISTINCT 's' || f.repository_id || f.path || c.symbol_name, f.repository_id, f.path, c.symbol_name FROM code_units c JOIN files f ON f.id = c.file_id WHERE c.symbol_name IS NOT NULL
  UNION ALL SELECT 'x' || id, id, 'no/such.file', NULL FROM repositories
  UNION ALL SELECT 'd' || id, id, '../up', NULL FROM repositories
  UNION ALL SELECT 'n' || id, repository_id, path, 'no such symbol' FROM files
  UNION ALL SELECT 'r', 'no such repository', 'a.py', NULL
), heads AS (
  SELECT t.query_id, CASE WHEN t.path = '../up' THEN 'bad_path' WHEN t.repository_id = 'no such repository' THEN 'no_repository' WHEN t.path = 'no/such.file' THEN 'no_file'
    WHEN t.symbol_name IS NULL THEN 'ok' WHEN count(u.code_unit_id) = 0 THEN 'no_symbol' WHEN count(u.code_unit_id) > 1 THEN 'ambiguous' ELSE 'ok' END AS outcome,
    CASE WHEN t.symbol_name IS NULL THEN 'file' ELSE 'symbol' END AS mode, substr(t.query_id, 2) AS file_id, min(u.code_unit_id) AS unit
  FROM targets t LEFT JOIN u ON u.repository_id = t.repository_id AND u.path = t.path AND u.symbol_name = t.symbol_name GROUP BY t.query_id, t.repository_id, t.path, t.symbol_name
)"""


def _impact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, repositories, u = table(spark, sf_dir, "files"), table(spark, sf_dir, "repositories"), core.units(spark, sf_dir)
    none = F.lit(None).cast("string").alias("symbol_name")
    named = u.where("symbol_name is not null").select("repository_id", "path", "symbol_name").distinct()
    row = lambda df, query_id, repository, path, symbol: df.select(query_id.alias("query_id"), repository.alias("repository_id"), path.alias("path"), symbol)
    c, lit = F.col, F.lit
    targets = (
        row(files, F.concat(lit("f"), c("id")), c("repository_id"), c("path"), none)
        .unionByName(row(named, F.concat(lit("s"), c("repository_id"), c("path"), c("symbol_name")), c("repository_id"), c("path"), c("symbol_name")))
        .unionByName(row(repositories, F.concat(lit("x"), c("id")), c("id"), lit("no/such.file"), none))
        .unionByName(row(repositories, F.concat(lit("d"), c("id")), c("id"), lit("../up"), none))
        .unionByName(row(files, F.concat(lit("n"), c("id")), c("repository_id"), c("path"), lit("no such symbol").alias("symbol_name")))
        .unionByName(row(spark.range(1), lit("r"), lit("no such repository"), lit("a.py"), none))
    )
    return graph.impact(targets, repositories, files, u, core._import_pairs(spark, sf_dir), core.call_edges(spark, sf_dir), 20)


@query(f"WITH {core.U}, {_TARGETS} SELECT query_id, outcome, mode FROM heads")
def impact_outcomes(spark, d):
    """What becomes of every impact request: found, ambiguous, or what was not found."""
    return _impact(spark, d)[0].select("query_id", "outcome", "mode")


@query(f"""WITH {core.U}, {core.EDGES}, {core._IMPORTS}, {_TARGETS}, i AS (
  SELECT DISTINCT h.query_id, ie.source_file_id AS id, 'imports' AS relationship_type FROM heads h JOIN ie ON ie.target_file_id = h.file_id AND ie.source_file_id <> h.file_id WHERE h.outcome = 'ok' AND h.mode = 'file'
  UNION ALL SELECT DISTINCT h.query_id, e.source_unit_id, 'calls' FROM heads h JOIN edges e ON e.target_unit_id = h.unit AND e.source_unit_id <> h.unit WHERE h.outcome = 'ok' AND h.mode = 'symbol'
) SELECT query_id, relationship_type, least(count(*), 20) AS items, count(*) > 20 AS truncated FROM i GROUP BY ALL""")
def impact_items(spark, d):
    """How many dependents every found target has."""
    items = _impact(spark, d)[1]
    return items.groupBy("query_id", "relationship_type").agg(F.count("*").alias("items"), F.max("truncated").alias("truncated"))


# ---- cached search


@query(f"""WITH {core.U}, {core.Q}, {core.SEM}, first AS (SELECT query_id, code_unit_id, rank FROM sem WHERE rank <= 10)
SELECT q.query_id, q.query_id % 40 = 0 AS cached, md5(coalesce(string_agg(f.code_unit_id, ' ' ORDER BY f.rank), '')) AS results
FROM q JOIN repositories r ON r.id = q.repository_id LEFT JOIN first f USING (query_id) GROUP BY q.query_id""")
def cached_search(spark, d):
    """Semantic search behind the cache, which has the valid responses of every second question."""
    u, q, r = core.units(spark, d), core.questions(spark, d), table(spark, d, "repositories")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "key string, repository_id string, generation long, payload string, created_at timestamp_ntz")
    _, rows = cache.read_through(u, q.where("query_id % 40 = 0"), r, empty, now)
    current = r.select(F.col("id").alias("repository_id"), F.col("index_generation").alias("current_generation"))
    stored = cache.storable(rows.join(current, "repository_id")).select(*empty.columns)
    results, _ = cache.read_through(u, q, r, stored, now)
    ids = F.array_join(F.transform("response.items", lambda x: x["code_unit_id"]), " ")
    return results.select("query_id", "cached", F.md5(ids.cast("binary")).alias("results"))


# ---- overviews


@query("""SELECT f.id AS file_id, count(c.id) AS units, md5(coalesce(string_agg(c.id, ' ' ORDER BY c.start_line, c.end_line DESC, c.kind, c.id), '')) AS ids
FROM files f LEFT JOIN code_units c ON c.file_id = f.id GROUP BY f.id""")
def units_by_file(spark, d):
    """The units of every file, in order."""
    listed = overview.grouped_units(table(spark, d, "code_units"), table(spark, d, "files"))
    ids = F.array_join(F.transform("units", lambda x: x["id"]), " ")
    return listed.select("file_id", F.size("units").alias("units"), F.md5(ids.cast("binary")).alias("ids"))


@query("""SELECT * FROM (VALUES ('sum of language', 0), ('sum of kind', 0), ('repeated language', 0), ('repeated kind', 0), ('named above all', 0), ('units without files', 0)) t("check", violations)""")
def overview_consistency_dq(spark, d):
    """Contradictions between the counts of the overviews."""
    r, f, u = (table(spark, d, t) for t in ("repositories", "files", "code_units"))
    by = lambda column, name: overview.by_group(u, f, column, name)
    return overview.consistency_checks(overview.counts(r, f, u), by(overview.bucketed(F.col("language")), "language"), by(F.col("kind"), "kind"))


@query("""SELECT 'regions' AS "table", count(*) AS rows, 5 AS expected, count(*) = 5 AS as_expected FROM region
UNION ALL SELECT 'nations', count(*), 24, count(*) = 24 FROM nation""")
def row_count_dq(spark, d):
    """Tables with a known number of rows; one expectation is wrong on purpose."""
    tables = {"regions": table(spark, d, "region"), "nations": table(spark, d, "nation")}
    return overview.row_counts({"regions": 5, "nations": 24}, tables)


@query(f"""WITH req AS (SELECT repository_id AS id, min(query_id) AS position FROM search_queries GROUP BY 1 UNION ALL SELECT 'no such repository', -1)
SELECT q.id AS repository_id, q.position, r.id IS NOT NULL AS found, j.id AS job_id, j.status, CASE WHEN j.status = 'completed' THEN coalesce(f.n, 0) END AS files,
  CASE WHEN j.status = 'completed' THEN coalesce(u.n, 0) END AS code_units
FROM req q LEFT JOIN repositories r ON r.id = q.id LEFT JOIN (SELECT * FROM {core._LATEST} WHERE n = 1) j ON j.repository_id = r.id
LEFT JOIN {core._FILES} f ON f.repository_id = r.id LEFT JOIN {core._UNITS} u ON u.repository_id = r.id""")
def summary_requested(spark, d):
    """Summaries of requested repositories, each once, in order of request; unknown ones are told."""
    requested = table(spark, d, "search_queries").select("repository_id", F.col("query_id").alias("position"))
    requested = requested.unionByName(spark.createDataFrame([("no such repository", -1)], "repository_id string, position long"))
    rows = overview.requested_summary(requested, *(table(spark, d, t) for t in ("repositories", "indexing_jobs", "files", "code_units")))
    return rows.select("repository_id", "position", "found", "job_id", "status", "files", "code_units")


@query("""SELECT q.query_id AS position, r.id, r.name FROM search_queries q JOIN repositories r ON r.id = q.repository_id""")
def rows_in_requested_order(spark, d):
    """Repositories in the order in which questions name them."""
    requested = table(spark, d, "search_queries").select(F.col("repository_id").alias("id"), F.col("query_id").alias("position"))
    return order.in_requested_order(requested, table(spark, d, "repositories").select("id", "name"), "id")


@query(r"""WITH p AS (SELECT DISTINCT relative_path AS path FROM source_files UNION ALL SELECT * FROM (VALUES ('/abs'), ('a//b'), ('a/../b'), ('./a'), ('a\b'), (''), ('a/'), ('ok/x.py')) t(path))
SELECT path, NOT regexp_matches(path, '(^|/)(\.{1,2})?(/|$)') AND NOT contains(path, '\') AS valid FROM p""")
def valid_paths(spark, d):
    """Which scanned and which written-out paths are relative and without dot parts."""
    known = spark.createDataFrame([(p,) for p in ("/abs", "a//b", "a/../b", "./a", "a\\b", "", "a/", "ok/x.py")], "path string")
    every = table(spark, d, "source_files").select(F.col("relative_path").alias("path")).distinct().unionByName(known)
    return every.select("path", paths.valid_relative(F.col("path")).alias("valid"))


@query("""SELECT id, CASE WHEN kind NOT IN ('class', 'config', 'document', 'function', 'import') THEN 'kind' WHEN content IS NULL OR content = '' THEN 'content'
  WHEN language <> lower(language) THEN 'language' WHEN start_line < 1 OR end_line < start_line THEN 'lines' WHEN trim(symbol_name) = '' THEN 'symbol'
  WHEN regexp_matches(path, '(^|/)(\\.{1,2})?(/|$)') THEN 'path' END AS problem
FROM (SELECT c.id || '!' AS id, c.kind, c.content, c.language, c.end_line AS start_line, c.start_line AS end_line, c.symbol_name, f.path FROM code_units c JOIN files f ON f.id = c.file_id
  UNION ALL SELECT c.id, c.kind, c.content, c.language, c.start_line, c.end_line, c.symbol_name, f.path FROM code_units c JOIN files f ON f.id = c.file_id)
WHERE problem IS NOT NULL""")
def unit_problems(spark, d):
    """Rules that units break: the stored ones, and the same with their lines the wrong way round."""
    u = core.units(spark, d).withColumnRenamed("code_unit_id", "id")
    turned = u.withColumn("id", F.concat("id", F.lit("!"))).withColumn("s", F.col("end_line")).withColumn("end_line", F.col("start_line")).withColumn("start_line", F.col("s")).drop("s")
    return parsing.unit_checks(u.unionByName(turned)).select("id", "problem")


# ---- metric samples


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("user_id")
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "purchase", "POST").otherwise("BREW")
    status = F.when(F.col("event_type") == "error", 503).when(n % 7 == 0, 404).when(n % 11 != 0, 200)
    path = F.when(n % 3 == 0, F.concat(F.lit("/repositories/"), n.cast("string"), F.lit("/impact"))).when(n % 3 == 1, "/search").otherwise(F.concat(F.lit("/odd/"), n.cast("string")))
    ended = F.when(n % 13 == 0, "cancelled").when(n % 11 == 0, "error").otherwise("done")
    return e.select("ts", method.alias("method"), path.alias("path"), status.alias("status"), ended.alias("ended"), F.col("value").cast("double").alias("seconds"))


ROUTES = {"/repositories/{id}/impact": r"^/repositories/[^/]+/impact$", "/search": "^/search$"}
_LOG = """l AS (SELECT ts, value AS seconds, CASE event_type WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'POST' ELSE 'OTHER' END AS method,
  CASE user_id % 3 WHEN 0 THEN '/repositories/{id}/impact' WHEN 1 THEN '/search' ELSE 'unmatched' END AS route,
  CASE WHEN user_id % 13 = 0 THEN 'cancelled' WHEN user_id % 11 = 0 AND event_type <> 'error' AND user_id % 7 <> 0 THEN '5xx' WHEN user_id % 11 = 0 THEN 'incomplete'
    WHEN event_type = 'error' THEN '5xx' WHEN user_id % 7 = 0 THEN '4xx' ELSE '2xx' END AS status_class FROM events)"""


@query(f"""WITH {_LOG}, g AS (SELECT time_bucket(INTERVAL 1 day, ts) + INTERVAL 1 day AS ts, method, route, status_class, count(*)::DOUBLE AS v FROM l GROUP BY ALL)
SELECT ts, method, route, status_class, sum(v) OVER (PARTITION BY method, route, status_class ORDER BY ts) AS value FROM g""")
def metric_request_samples(spark, d):
    """Samples of the counter of requests, made from a log, at the end of every day."""
    rows = producers.samples(producers.requests(_log(spark, d), ROUTES), "http_requests_total", every="1 day")
    label = lambda k: F.col("labels")[k].alias(k)
    return rows.select("ts", label("method"), label("route"), label("status_class"), "value")


@query(f"""WITH {_LOG}, le AS (SELECT unnest([{', '.join(map(str, metrics.REQUEST_BOUNDS))}, 'infinity'::DOUBLE]) AS le)
SELECT status_class, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, count_if(greatest(seconds, 0) <= le)::DOUBLE AS value FROM l, le GROUP BY ALL""")
def metric_duration_buckets(spark, d):
    """Last cumulative buckets of the durations of requests per class of status."""
    rows = producers.samples(producers.requests(_log(spark, d), ROUTES), "http_request_duration_seconds", every="1 day")
    keys = [F.col("labels")[k].alias(k) for k in ("method", "route", "status_class", "le")]
    buckets = rows.where(F.endswith("metric", F.lit("_bucket"))).select("ts", *keys, "value")
    last = metrics.latest(buckets, ["method", "route", "status_class", "le"])
    return last.groupBy("status_class", "le").agg(F.sum("value").alias("value"))


@query(f"""WITH {_LOG} SELECT 'http_requests_total{{method="' || method || '",route="' || route || '",status_class="' || status_class || '"}} ' || CAST(count(*) AS VARCHAR) || '.0' AS line
FROM l GROUP BY method, route, status_class""")
def metric_exposition(spark, d):
    """The counter of requests as text for a scraper."""
    return producers.exposition(producers.samples(producers.requests(_log(spark, d), ROUTES), "http_requests_total", every="1 day"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def metric_retention(spark, d):
    """Samples of the last seven days."""
    return producers.retained(table(spark, d, "events").select("event_id", "ts"), 7)


@query("""SELECT embedding IS NOT NULL AS usable, count(*) AS units FROM code_units GROUP BY 1""")
def attached_embeddings(spark, d):
    """Stored vectors taken off and attached again: every unit has the vector it had."""
    from ..operators import snapshot

    u = table(spark, d, "code_units").select("id", "file_id", "embedding")
    given = u.where("embedding is not null").select("id", "embedding")
    bare = u.withColumn("embedding", F.lit(None).cast("array<float>"))
    return snapshot.attach_embeddings(bare, given, 384).groupBy(F.col("embedding").isNotNull().alias("usable")).agg(F.count("*").alias("units"))


@query("""SELECT s.repository_id, s.path FROM (SELECT DISTINCT repository_id, relative_path AS path FROM source_files) s
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repository_id = s.repository_id AND f.path = s.path)""")
def append_missing_files(spark, d):
    """Scanned paths that are not stored yet, each once."""
    from ..operators import snapshot

    seen = table(spark, d, "source_files").select("repository_id", F.col("relative_path").alias("path"))
    return snapshot.append_missing(seen, table(spark, d, "files").select("repository_id", "path"), ["repository_id", "path"])
