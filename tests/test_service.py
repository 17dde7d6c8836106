"""Answers, impact, cached responses, local models and metric samples on small tables."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from strataloom.operators import ask, cache, context, graph, order
from strataloom.providers import FixedAnswer, LocalChat, ProviderResponseError, ProviderTimeout, ProviderUnavailable, scorer
from strataloom.streaming import producers

UNITS = "code_unit_id string, file_id string, repository_id string, path string, kind string, language string, start_line int, end_line int, symbol_name string, content string, embedding array<float>"


def corpus(spark):
    rows = [(f"u{i}", f"f{i}", "r", f"src/m{i}.py", "function", "python", i, i + 1, f"load_{i}", f"def load_{i}(): return {i}", [1.0, float(i)]) for i in range(1, 6)]
    repositories = spark.createDataFrame([("r", "name", 3), ("empty", "none", 0)], "id string, name string, index_generation long")
    return spark.createDataFrame(rows, UNITS), repositories


def picky():
    class Picky:
        """A model that fails as the question tells it to."""

        def chat(self, messages):
            assert [r for r, _ in messages] == ["system", "user"] and messages[0][1] == context.RULES
            for word, error in (("slow", ProviderTimeout), ("away", ProviderUnavailable), ("odd", ProviderResponseError), ("broken", KeyError)):
                if word in messages[1][1].split("\n")[1]:
                    raise error("no")
            return "" if "silent" in messages[1][1].split("\n")[1] else "It is [Evidence 2], then [Evidence 1] and [Evidence 9] and [Evidence 2]."

    return Picky


def test_answers_and_outcomes(spark):
    units, repositories = corpus(spark)
    asked = ["load", "slow load", "away load", "odd load", "broken load", "silent load", " ", "x" * 2001]
    rows = [(i, "r", q, [1.0, 1.0]) for i, q in enumerate(asked)] + [(20, "empty", "load", [1.0, 1.0]), (21, "gone", "load", [1.0, 1.0]), (22, "r", None, [1.0, 1.0])]
    questions = spark.createDataFrame(rows, "query_id int, repository_id string, question string, query_vector array<float>")
    edges = spark.createDataFrame([], "source_unit_id string, target_unit_id string")
    got = {r.query_id: r for r in ask.ask(questions, repositories, units, edges, picky(), limit=3).collect()}
    outcomes = ["answered", "timeout", "unavailable", "response_error", "error", "response_error", "bad_question", "bad_question"]
    assert [got[i].outcome for i in range(8)] == outcomes and [got[i].status for i in range(8)] == [ask.STATUS[o] for o in outcomes]
    assert (got[20].outcome, got[20].answer, got[20].included, got[20].citations) == ("answered", context.INSUFFICIENT, 0, [])
    assert (got[21].outcome, got[21].status, got[22].outcome) == ("not_found", 404, "bad_question")
    assert [c.evidence_id for c in got[0].citations] == [2, 1] and got[0].included == 3
    assert all(c.source_preview.startswith("def load_") and not c.source_preview_truncated for c in got[0].citations)


def test_impact_outcomes(spark):
    units, repositories = corpus(spark)
    twice = units.unionByName(units.where("code_unit_id = 'u1'").withColumn("code_unit_id", F.lit("again")))
    files = spark.createDataFrame([(f"f{i}", "r", f"src/m{i}.py") for i in range(1, 6)], "id string, repository_id string, path string")
    imports = spark.createDataFrame([("f2", "f1"), ("f3", "f1"), ("f1", "f1")], "source_file_id string, target_file_id string")
    calls = spark.createDataFrame([("u3", "u2"), ("u2", "u2")], "source_unit_id string, target_unit_id string")
    rows = [("file", "r", "src/m1.py", None), ("symbol", "r", "src/m2.py", "load_2"), ("ambiguous", "r", "src/m1.py", "load_1"), ("no_symbol", "r", "src/m1.py", "x"), ("no_file", "r", "src/m9.py", None), ("no_repository", "q", "src/m1.py", None), ("bad_path", "r", "/src", None), ("bad_path2", "r", "src/m1.py", " ")]
    targets = spark.createDataFrame(rows, "query_id string, repository_id string, path string, symbol_name string")
    heads, items = graph.impact(targets, repositories, files, twice, imports, calls, 1)
    assert {r.query_id: r.outcome for r in heads.collect()} == {"file": "ok", "symbol": "ok", "ambiguous": "ambiguous", "no_symbol": "no_symbol", "no_file": "no_file", "no_repository": "no_repository", "bad_path": "bad_path", "bad_path2": "bad_path"}
    assert sorted((r.query_id, r.file_id, r.relationship_type, r.truncated) for r in items.collect()) == [("file", "f2", "imports", True), ("symbol", "f3", "calls", False)]


def test_cached_responses_must_be_what_was_asked(spark):
    item = {"code_unit_id": "u", "file_id": "f", "path": "p", "kind": "function", "content": "c", "language": "python", "start_line": 1, "end_line": 2, "symbol_name": None, "cosine_distance": 0.5}
    make = lambda items, **more: json.dumps({"schema": "v1", "key": "k", "response": {"items": items, "limit": 2}} | more)
    good = [make([]), make([item]), make([item, item | {"code_unit_id": "v"}])]
    bad = [
        make([item], schema="v0"), make([item], key="other"), make([item], extra=1), make([item], response={"items": [item], "limit": 3}), make([item], response={"items": [item]}), make([item, item]),
        make([item | {"cosine_distance": None}]), make([item | {"start_line": 0}]), make([item | {"end_line": 0}]), make([item | {"start_line": "1"}]), make([item | {"more": 1}]), make([{k: v for k, v in item.items() if k != "symbol_name"}]),
        make([item | {"code_unit_id": str(i)} for i in range(3)]), "{}", "[]", "no json", make("x"), make(None), '{"schema": "v1"',
    ]
    found = spark.createDataFrame(list(enumerate(good + bad)), "query_id int, payload string")
    requests = spark.createDataFrame([(i, "k", 2) for i in range(len(good + bad))], "query_id int, key string, limit int")
    assert sorted(r.query_id for r in cache.responses(found, requests).collect()) == list(range(len(good)))


def test_a_second_search_comes_from_the_cache(spark):
    units, repositories = corpus(spark)
    q = spark.createDataFrame([(1, "r", "a", [1.0, 0.0]), (2, "r", "b", [0.0, 1.0]), (3, "empty", "c", [1.0, 0.0])], "query_id int, repository_id string, question string, query_vector array<float>")
    now = F.lit(dt.datetime(2025, 1, 1))
    empty = spark.createDataFrame([], "key string, repository_id string, generation long, payload string, created_at timestamp_ntz")
    first, rows = cache.read_through(units, q, repositories, empty, now, limit=2, width=2)
    stored = spark.createDataFrame(rows.collect(), rows.schema)
    second, more = cache.read_through(units, q, repositories, stored, now, limit=2, width=2)
    plain = lambda df: {r.query_id: r.response for r in df.collect()}
    assert not any(r.cached for r in first.collect()) and all(r.cached for r in second.collect()) and more.count() == 0
    assert plain(first) == plain(second) and len(plain(first)[1]["items"]) == 2 and plain(first)[3]["items"] == []
    moved = repositories.withColumn("index_generation", F.col("index_generation") + 1)
    assert not any(r.cached for r in cache.read_through(units, q, moved, stored, now, limit=2, width=2)[0].collect())


def test_a_model_on_this_machine():
    replies = [(200, {"message": {"role": "assistant", "content": "hello"}}), (200, {"message": {"role": "assistant", "content": " "}}), (200, []), (503, {}), (500, {}), (302, {})]
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            status, body = replies[len(seen) - 1]
            self.send_response(status)
            self.send_header("Location", "http://127.0.0.1:9/")
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = LocalChat("m", f"http://127.0.0.1:{server.server_port}", 5)
    assert model.chat([("user", "q")]) == "hello" and seen[0]["messages"] == [{"role": "user", "content": "q"}] and seen[0]["stream"] is False
    for error in (ProviderResponseError, ProviderResponseError, ProviderUnavailable, ProviderResponseError, ProviderResponseError):
        with pytest.raises(error):
            model.chat([("user", "q")])
    server.shutdown()
    server.server_close()
    with pytest.raises(ProviderUnavailable):
        model.chat([("user", "q")])
    for address in ("https://127.0.0.1", "http://example.com", "http://10.0.0.1", "http://u@localhost", "http://localhost/x"):
        with pytest.raises(ValueError):
            LocalChat("m", address)


def test_a_reranker_is_made_once_per_worker_and_checked(spark):
    class Lengths:
        made = 0

        def __init__(self):
            Lengths.made += 1

        def score(self, question, documents):
            return [float(len(d)) + 1000 * Lengths.made for d in documents]

    df = spark.createDataFrame([("q", "a" * i) for i in range(40)], "q string, d string").coalesce(1)
    with_small_batches = df.select(scorer(Lengths)(F.col("q"), F.col("d")).alias("s"))
    assert sorted(r.s for r in with_small_batches.collect()) == [1000.0 + i for i in range(40)]


def test_metric_samples_and_their_text(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    log = [(t(1), "GET", "/search", 200, "done", 0.02), (t(2), "BREW", "/search", None, "error", 0.2), (t(3), "GET", "/x", 200, "error", -1.0), (t(20), "GET", "/search", 201, None, 500.0), (t(21), "GET", "/metrics", 200, "done", 0.1), (t(22), "GET", "/search", 404, "cancelled", None)]
    df = spark.createDataFrame(log, "ts timestamp_ntz, method string, path string, status int, ended string, seconds double")
    events = producers.requests(df, {"/search": "^/search$"})
    assert sorted((r.method, r.route, r.status_class) for r in events.collect()) == [("GET", "/search", "2xx"), ("GET", "/search", "2xx"), ("GET", "/search", "cancelled"), ("GET", "unmatched", "incomplete"), ("OTHER", "/search", "5xx")]
    lines = [r.line for r in producers.exposition(producers.samples(events, "http_requests_total")).collect()]
    assert 'http_requests_total{method="GET",route="/search",status_class="2xx"} 2.0' in lines and len(lines) == 4
    buckets = producers.samples(events, "http_request_duration_seconds")
    last = {r.labels["le"]: r.value for r in buckets.where("metric like '%_bucket' and labels['status_class'] = '2xx'").orderBy("ts").collect()}
    assert last["0.025"] == 1.0 and last["180.0"] == 1.0 and last["+Inf"] == 2.0
    files = spark.createDataFrame([(t(1),), (t(2),), (t(40),)], "ts timestamp_ntz")
    assert [r.value for r in producers.samples(files, "indexing_files_hashed_total").orderBy("ts").collect()] == [2.0, 3.0]
    assert producers.retained(buckets.withColumn("ts", F.col("ts") - F.expr("INTERVAL 8 DAYS")).unionByName(buckets)).count() == buckets.count()


def test_requested_order(spark):
    requested = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "position int, id string")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert [r.n for r in order.in_requested_order(requested, rows, "id").collect()] == [2, 1, 2]
    with pytest.raises(Exception, match="no such row"):
        order.in_requested_order(requested, rows.where("id = 'a'"), "id").collect()


def test_a_fixed_model_needs_messages():
    with pytest.raises(Exception):
        FixedAnswer("x").chat([])
