"""Snapshots, jobs, incremental runs, overviews, sources and metrics."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from strataloom.operators import incremental, overview, snapshot
from strataloom.providers import DigestEmbedding, FixedAnswer, ProviderError, embedded
from strataloom.functions import paths, vectors
from strataloom.plans import planted
from strataloom.sources import evaluation as evaluation_source
from strataloom.sources import repository, validation
from strataloom.streaming import metrics


@pytest.mark.parametrize(
    ("now", "then", "want"),
    [
        ({"a": "1"}, {"a": "1"}, {"a": "unchanged"}), ({"a": "2"}, {"a": "1"}, {"a": "refresh"}), ({"a": "1"}, {"a": None}, {"a": "refresh"}),
        ({"b": "1"}, {"a": "1"}, {"a": "removed", "b": "refresh"}), ({}, {"a": "1"}, {"a": "removed"}), ({"a": "1"}, {}, {"a": "refresh"}), ({}, {}, {}),
    ],
)
def test_snapshot_classes(spark, now, then, want):
    schema = "repository_id string, path string, content_hash string"
    make = lambda d: spark.createDataFrame([("r", p, h) for p, h in d.items()], schema)
    assert {r.path: r.status for r in snapshot.classify(make(now), make(then)).collect()} == want


def test_generation_and_carry_forward(spark):
    classes = spark.createDataFrame([("r", "a", "unchanged"), ("r", "b", "refresh"), ("s", "c", "unchanged")], "repository_id string, path string, status string")
    repos = spark.createDataFrame([("r", 4), ("s", 7), ("t", 0)], "id string, index_generation long")
    assert {r.repository_id: r.next_generation for r in snapshot.generations(classes, repos).collect()} == {"r": 5, "s": 7, "t": 0}
    schema = "id string, repository_id string, path string"
    stored = spark.createDataFrame([("u1", "r", "a"), ("u2", "r", "b"), ("u3", "r", "gone")], schema)
    parsed = spark.createDataFrame([("n1", "r", "b"), ("n2", "r", "a")], schema)
    assert {r.id for r in snapshot.carry_forward(stored, classes, parsed).collect()} == {"u1", "n1"}


def test_store_publishes_whole_generations(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path / "s"))
    assert store.generation() == 0
    assert store.publish({"t": spark.range(3).toDF("x")}) == 1
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        store.publish({"t": spark.range(1).toDF("x"), "u": bad})
    assert store.generation() == 1 and store.read("t").count() == 3
    assert store.publish({"t": spark.range(5).toDF("x")}) == 2
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3
    assert len(os.listdir(tmp_path / "s" / "tables")) == 2  # what failed is gone
    with pytest.raises(RuntimeError):
        store.publish({"t": spark.range(1).toDF("x")}, base=1)  # computed from a generation that is no longer the last
    other = snapshot.SnapshotStore(spark, str(tmp_path / "s"), "r")
    assert other.generation() == 0 and other.publish({"t": spark.range(7).toDF("x")}) == 1 and store.generation() == 2


def test_job_states(spark, tmp_path):
    jobs = snapshot.Jobs(spark, str(tmp_path / "j"))
    job = jobs.reserve("r")
    with pytest.raises(RuntimeError):
        jobs.reserve("r")
    assert jobs.move("r", job, "running") and jobs.move("r", job, "completed")
    assert not jobs.move("r", job, "failed") and not jobs.move("r", "unknown", "running")
    assert jobs.reserve("r") != job
    assert jobs.reserve("s") == snapshot.derived_id("job", "s", 1)  # the same on every attempt
    log = jobs.log().orderBy("job_id", "sequence")
    assert overview.status_history(log).where("not valid").count() == 0


OBSERVED = "observation_id long, repository_id string, path string, content_hash string, status string, index_generation long, observed_at timestamp_ntz, extra int"


def observations(spark, rows):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    return spark.createDataFrame([(i, "r", p, h, s, g, t(m), 0) for i, p, h, s, g, m in rows], OBSERVED)


def changed(spark, rows, stored, generation=5):
    repos = spark.createDataFrame([("r", generation)], "id string, index_generation long")
    files = spark.createDataFrame([("r", p, h) for p, h in stored.items()], "repository_id string, path string, content_hash string")
    return sorted(r.path for r in incremental.changed_paths(observations(spark, rows), repos, files).collect())


def test_changed_paths(spark):
    rows = [
        (1, "old", "aa", "present", 5, 0), (2, "new", "aa", "present", 6, 0), (3, "./same", "AA", "present", 6, 0), (4, "nullhash", "aa", "present", 6, 0),
        (5, "gone", "aa", "present", 6, 0), (6, "gone", None, "removed", 6, 1), (7, "back", None, "removed", 6, 0), (8, "./back", "bb", "present", 6, 2),
        (9, "late", "cc", "present", 7, 0), (10, "late", "dd", "present", 6, 9), (2, "new", "aa", "present", 6, 0), (11, None, "aa", "present", 6, 0),
        (12, "tie", "aa", "present", 6, 0), (13, "tie", None, "removed", 6, 0),
    ]
    assert changed(spark, rows, {"same": "aa", "nullhash": None, "late": "dd"}) == ["back", "late", "new", "nullhash"]
    assert changed(spark, [], {"a": "b"}) == []
    assert changed(spark, [(1, "a", "x", "present", 2**62, 0)], {}, 2**62 - 1) == ["a"]


def test_ledger_survives_failures_without_skips_or_repeats(spark, tmp_path):
    ledger = incremental.ProcessedLedger(spark, str(tmp_path / "ledger"))
    schema = "repository_id string, path string, content_hash string"
    batch = lambda *rows: spark.createDataFrame([("r", p, h) for p, h in rows], schema)
    done = []

    def fail(df):
        raise OSError("lost")

    first = batch(("a", "1"), ("b", "1"))
    with pytest.raises(OSError):
        ledger.commit("1", ledger.take(first), fail)
    assert ledger.take(first).count() == 2  # nothing was skipped
    assert ledger.commit("1", ledger.take(first), lambda df: done.extend(r.path for r in df.collect()))
    assert not ledger.commit("1", first)  # a repeated commit is refused
    second = batch(("a", "1"), ("b", "2"), ("c", "1"))
    assert ledger.commit("2", ledger.take(second), lambda df: done.extend(r.path for r in df.collect()))
    assert sorted(done) == ["a", "b", "b", "c"] and ledger.take(second).count() == 0


def test_overview_counts_do_not_fan_out(spark):
    repos = spark.createDataFrame([("r", 2**62), ("empty", 0)], "id string, index_generation long")
    files = spark.createDataFrame([("f1", "r"), ("f2", "r")], "id string, repository_id string")
    units = spark.createDataFrame([("f1", "rust", "function", "a"), ("f1", "go", "class", None), ("f2", "python", "function", "b")], "file_id string, language string, kind string, symbol_name string")
    got = {r.repository_id: r for r in overview.counts(repos, files, units).collect()}
    assert (got["r"].files, got["r"].code_units, got["r"].named_code_units, got["r"].index_generation) == (2, 3, 2, str(2**62))
    assert (got["empty"].files, got["empty"].code_units) == (0, 0)
    languages = overview.by_group(units, files, overview.bucketed(F.col("language")), "language")
    assert {(r.language, r["count"]) for r in languages.collect()} == {("other", 2), ("python", 1)}
    jobs = spark.createDataFrame([("j1", "r", "failed", 1), ("j2", "r", "completed", 1)], "id string, repository_id string, status string, created_at int")
    assert overview.latest_jobs(jobs).head().job_id == "j2"
    nested = {r.repository_id: r for r in overview.overview_json(repos, jobs, files, units).collect()}
    assert nested["r"].by_kind == '[{"kind":"class","count":1},{"kind":"function","count":2}]' and nested["empty"].by_language == "[]"


def test_repository_source(spark, tmp_path):
    root = tmp_path / "repo"
    files = {
        "a.py": b"x = 1\n", ".gitignore": b"*.log\n", "src/b.js": b"1", "src/deep/c.ts": b"2", "node_modules/x.js": b"no", "Build/y.js": b"no", ".env": b"no", ".env.example": b"K=",
        "src/app.min.js": b"no", "src/pic.png": b"no", "src/bin.txt": b"a\x00b", "nested/.git/config": b"no", "nested/z.py": b"no", ".git/HEAD": b"no", "big.txt": b"z" * 200, "poetry.lock": b"no",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "link.py").symlink_to(root / "a.py")
    repository.register(spark)
    rows = spark.read.format("repository").option("path", str(root)).option("max_bytes", "100").load()
    got = {r.path: bytes(r.content) for r in rows.collect()}
    assert got == {k: files[k] for k in ("a.py", ".gitignore", "src/b.js", "src/deep/c.ts", ".env.example")}
    assert rows.where(F.sha2("content", 256) != F.col("content_hash")).count() == 0
    for name in files:
        row = spark.createDataFrame([(name,)], "p string").select(paths.denied_file(F.col("p")).alias("d")).head()
        assert row.d == repository.denied(name.rpartition("/")[2])


SOURCES = {
    "https://host.example/o/n": "https", "HTTPS://h.example:443/x": "https", "/local/dir": "local", "C:\\work": "local", "C:/work": "local", "": "bad_empty", "  ": "bad_empty",
    " https://h/x": "bad_margin", "http://h/x": "bad_scheme", "git@h:o/n": "bad_scp", "https://u:p@h/x": "bad_credentials", "https://h/x?y": "bad_query", "https://h/x#y": "bad_fragment",
    "https://h": "bad_path", "https://h/": "bad_path", "https://h:/x": "bad_port", "https://h:0/x": "bad_port", "https://h:99999/x": "bad_url", "https://localhost/x": "bad_localhost",
    "https://a.LOCALHOST./x": "bad_localhost", "https://127.0.0.1/x": "bad_address", "https://[::1]/x": "bad_address", "https://8.8.8.8/x": "https", "https://h/../x": "bad_dot_path",
    "file:/etc/passwd": "bad_scheme", "http:example.com/x": "bad_scheme", "git:foo/bar": "bad_scheme", "javascript:alert": "bad_scheme", "c:https://example.com/t/p.git": "bad_scheme", "https:x/y": "bad_host",
    "https://h/a b": "bad_whitespace", "https://h\\x/y": "bad_backslash", "a\tb": "bad_control", "ssh://h/x": "bad_scheme",
}


def test_planted_sources(spark):
    df = spark.createDataFrame([(s,) for s in [*planted.SOURCES, None]], "s string")
    assert {r.s: r.v for r in df.select("s", validation.verdict(F.col("s")).alias("v")).collect()} == {**planted.SOURCES, None: "bad_empty"}


def test_source_verdicts(spark):
    df = spark.createDataFrame([(s,) for s in SOURCES], "s string")
    assert {r.s: r.v for r in df.select("s", validation.verdict(F.col("s")).alias("v")).collect()} == SOURCES


def test_canonical_sources(spark):
    given = {"https://GitHub.com/A-b/C.d.git/": "https://github.com/a-b/c.d", "https://github.com:443/a/b": "https://github.com/a/b", "https://github.com/-a/b": None, "https://github.com/a--b/c": None, "https://gitlab.com/a/b": None, "https://github.com/a/b/c": None, "https://github.com/a/..": None, "https://github.com/" + "a" * 40 + "/b": None}
    df = spark.createDataFrame([(s,) for s in given], "s string")
    assert {r.s: r.c for r in df.select("s", validation.canonical(F.col("s"))["source"].alias("c")).collect()} == given


def test_evaluation_source(spark, tmp_path):
    good = '{"version": 1, "repository": {"type": "local"}, "questions": [{"id": "a", "category": "exact", "question": "?", "expected_targets": [{"path": "x.py", "symbol": null}, {"path": "y.py", "symbol": "f"}]}]}'
    (tmp_path / "e.json").write_text(good)
    asked, targets = evaluation_source.read(spark, str(tmp_path / "e.json"), 1)
    assert asked.count() == 1 and [tuple(r) for r in targets.orderBy("target_no").collect()] == [("a", 0, "x.py", None), ("a", 1, "y.py", "f")]
    for bad in (good.replace('"version": 1', '"version": 2'), good.replace('[{"path": "x.py", "symbol": null}, {"path": "y.py", "symbol": "f"}]', "[]")):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ValueError):
            evaluation_source.read(spark, str(tmp_path / "b.json"), 1)


def test_counters_reset_and_quantiles(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", t(0), 10.0), ("a", t(60), 15.0), ("a", t(120), 3.0), ("a", t(400), 4.0), ("b", t(30), 7.0)]
    grown = metrics.deltas(spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double"), ["series"])
    assert [r.delta for r in grown.orderBy("series", "ts").collect()] == [None, 5.0, 3.0, 1.0, None]
    assert [(r.increase, round(r.rate, 6)) for r in metrics.rate(grown, []).orderBy("window_start").collect()] == [(8.0, round(8 / 300, 6)), (1.0, round(1 / 300, 6))]
    buckets = spark.createDataFrame([("x", 0.1, 0.0), ("x", 1.0, 10.0), ("x", float("inf"), 10.0), ("y", 0.1, 1.0), ("y", float("inf"), 10.0), ("z", 0.1, 0.0), ("z", float("inf"), 0.0)], "k string, le double, count double")
    assert {r.k: r.quantile for r in metrics.quantile(buckets, ["k"], 0.95).collect()} == {"x": 0.955, "y": 0.1}


def test_streaming_rates_and_deltas(spark, tmp_path):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", t(0), 1.0), ("a", t(200), 2.0), ("b", t(250), 4.0), ("a", t(310), 8.0), ("a", t(5000), 0.0)]
    spark.createDataFrame(rows, "series string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("series string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = metrics.stream_rates(stream(), []).writeStream.outputMode("append").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert [r.increase for r in spark.table("rates").orderBy("window_start").collect()] == [7.0, 8.0]
    q = metrics.stream_deltas(stream()).writeStream.outputMode("append").format("memory").queryName("grown").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.series, r.delta) for r in spark.table("grown").collect()) == [("a", 0.0), ("a", 1.0), ("a", 6.0)]


def test_providers(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "t string")
    rows = embedded(df, "t", lambda: DigestEmbedding(8), 8).collect()
    assert rows[1].embedding is None and rows[0].embedding == pytest.approx(DigestEmbedding(8).embed(["x"])[0])
    same = df.where("t = 'x'").select(vectors.digest_vector(F.col("t"), 8).alias("v")).head().v
    assert same == pytest.approx(rows[0].embedding)
    with pytest.raises(Exception, match="not usable"):
        embedded(df, "t", lambda: DigestEmbedding(4), 8).collect()
    model = FixedAnswer("hello")
    assert model.chat([("user", "q")]) == "hello" and len(model.calls) == 1
    with pytest.raises(ProviderError):
        model.chat([])


def test_embeddings_are_attached_once(spark):
    units = spark.createDataFrame([("a", "f", [1.0, 0.0]), ("b", "f", None)], "id string, file_id string, embedding array<float>")
    new = lambda *rows: spark.createDataFrame(list(rows), "id string, embedding array<float>")
    got = {r.id: r.embedding for r in snapshot.attach_embeddings(units, new(("b", [0.0, 0.0])), 2).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 0.0]}
    for bad in ([("b", [1.0])], [("b", [1.0, 2.0]), ("b", [1.0, 2.0])], [("z", [1.0, 2.0])], [("b", [float("nan"), 1.0])]):
        with pytest.raises(Exception, match="bad embedding|no such unit"):
            snapshot.attach_embeddings(units, new(*bad), 2).collect()
