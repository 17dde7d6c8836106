"""The ledger of processed versions: content that comes back, removals, late transactions."""

from strataloom.operators import incremental

OBSERVED = "observation_id long, repository_id string, path string, content_hash string, status string, index_generation long, observed_at timestamp_ntz"


def test_content_that_comes_back_is_work_again(spark, tmp_path):
    ledger = incremental.ProcessedLedger(spark, str(tmp_path / "ledger"))
    one = lambda h: spark.createDataFrame([("r", "a", h)], "repository_id string, path string, content_hash string")
    for run, content in (("9", "a1"), ("10", "b2"), ("11", "a1")):  # names of runs need not sort as they came
        assert ledger.take(one(content)).count() == 1
        assert ledger.commit(run, ledger.take(one(content)))
        assert ledger.take(one(content)).count() == 0


def test_removed_paths_late_transactions_and_redelivery(spark, tmp_path):
    import datetime as dt

    ledger = incremental.ProcessedLedger(spark, str(tmp_path / "ledger"))
    log = []

    def run(name, new, oldest_open):
        log.extend((i, "r", p, h, s, g, dt.datetime(2025, 1, 1, g)) for i, p, h, s, g in new)
        versions = incremental.newest_versions(ledger.reread(spark.createDataFrame(log, OBSERVED)))
        taken = []
        opened = spark.createDataFrame([("r", oldest_open)], "repository_id string, index_generation long")
        assert ledger.commit(name, ledger.take(versions), lambda df: taken.extend((r.path, r.status) for r in df.collect()), opened)
        return sorted(taken)

    assert run("1", [(1, "a", "A", "present", 5), (2, "b", "B", "present", 7), (3, "z", None, "removed", 5)], 6) == [("a", "present"), ("b", "present")]
    assert run("2", [(4, "./a", None, "removed", 8), (5, "c", "C", "present", 6), (6, "b", "OLD", "present", 6)], 8) == [("a", "removed"), ("c", "present")]
    assert run("3", [(7, "a", "a ", "present", 9), (8, "b", "B", "present", 9)], 9) == [("a", "present")]
    assert run("4", [(9, "a", "A", "present", 9)], 9) == []


SCHEMA = "repository_id string, path string, content_hash string"


def test_of_two_writers_one_publishes(spark, tmp_path):
    ledger = incremental.ProcessedLedger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], SCHEMA)
    inner = {}

    def work(df):
        if "same" not in inner:
            inner["same"] = None
            inner["same"] = ledger.commit("1", ledger.take(rows), work)  # another writer of the run is faster
            inner["other"] = ledger.commit("2", ledger.take(rows), work)  # a run that found the first's work done
        return df.select("path")

    assert not ledger.commit("1", ledger.take(rows), work)
    assert inner == {"same": True, "other": True}
    assert sorted(r.path for r in ledger.outputs().collect()) == ["a", "b"]  # once each
    assert ledger.runs() == ["1", "2"] and ledger.take(rows).count() == 0
    assert ledger.sweep() == 0  # the loser removed what it wrote


def test_a_crash_after_the_work_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    ledger = incremental.ProcessedLedger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("r", "a", "1")], SCHEMA)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ledger, "_publish", crash)
        try:
            ledger.commit("1", ledger.take(rows), lambda df: df.select("path"))
        except KeyboardInterrupt:
            pass
    assert ledger.outputs() is None and ledger.runs() == [] and ledger.take(rows).count() == 1
    assert ledger.commit("1", ledger.take(rows), lambda df: df.select("path"))
    assert ledger.outputs().count() == 1
    assert ledger.sweep() == 1 and ledger.sweep() == 0 and ledger.outputs().count() == 1


def test_compaction_keeps_what_is_newest(spark, tmp_path):
    ledger = incremental.ProcessedLedger(spark, str(tmp_path / "ledger"))
    one = lambda p, h: spark.createDataFrame([("r", p, h)], SCHEMA)
    opened = spark.createDataFrame([("r", 7)], "repository_id string, index_generation long")
    for run, (p, h) in enumerate((("a", "1"), ("b", "1"), ("a", "2"))):
        assert ledger.commit(str(run), ledger.take(one(p, h)), oldest_open=opened)
    assert ledger.compact() and ledger.runs() == ["0", "1", "2"]
    assert {(r.path, r.content_hash) for r in ledger.pairs().collect()} == {("a", "2"), ("b", "1")}
    assert ledger.take(one("a", "2")).count() == 0 and ledger.take(one("a", "1")).count() == 1
    seen = spark.createDataFrame([("r", 6), ("r", 7)], "repository_id string, index_generation long")
    assert [r.index_generation for r in ledger.reread(seen).collect()] == [7]
    assert ledger.sweep() == 3 and {(r.path, r.content_hash) for r in ledger.pairs().collect()} == {("a", "2"), ("b", "1")}
    assert not ledger.commit("2", one("z", "1"))
