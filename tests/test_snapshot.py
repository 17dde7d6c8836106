"""Whole snapshots: parsing what changed, carrying the rest over, graphs anew; jobs and leases under races."""

import pytest
from pyspark.sql import functions as F

from strataloom.operators import shared, snapshot
from strataloom.parsers import units as parsing
from strataloom.plans import planted


def tree(spark, changes=None, drop=()):
    texts = {p: c.encode() for p, (_, c) in planted.FILES.items() if p not in drop} | {"logo.dat": b"\xff\xfe", "a.b/notes": b"\xff"} | (changes or {})
    rows = [(f"new-{p}", "r", p, bytearray(c)) for p, c in texts.items()]
    df = spark.createDataFrame(rows, "file_id string, repository_id string, path string, content binary")
    return df.withColumn("content_hash", F.sha2("content", 256))


def parse(parsed):
    def run(files):
        parsed.append(files.select("path").distinct())
        made = parsing.parse_files(files)
        broken = F.raise_error(F.concat(F.lit("unparsable "), "path")).cast("string")
        made = made.withColumn("kind", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("kind")))
        return made.withColumn("code_unit_id", F.concat_ws(":", "path", "start_line", "symbol_name", F.md5("content"))).drop("error")

    return run


def test_generations_of_a_repository(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path / "store"), "r")
    none = spark.createDataFrame([], "id string, repository_id string, path string, content_hash string")
    seen = []
    no_units = parsing.parse_files(tree(spark).select("file_id", "repository_id", "path", F.lit("x").alias("language"), F.lit("").alias("content"))).drop("error").withColumn("code_unit_id", F.lit("")).limit(0)
    first = snapshot.index_snapshot(tree(spark), none, no_units, parse(seen))
    assert store.publish(first) == 1
    imports = {(r.source_file_id, r.target_file_id) for r in store.read("relationships").collect()}
    assert imports == {(f"new-{a}", f"new-{b}") for a, b in planted.IMPORTS}
    assert store.read("code_relationships").count() == len(planted.CALLS)
    stored = store.read("files")
    assert {r.path for r in stored.collect()} >= {"logo.dat", "a.b/notes"}  # kept without being decoded
    assert snapshot.index_snapshot(tree(spark), stored, store.read("code_units"), parse(seen)) is None
    # g moves out of pkg/a.py: its unchanged callers lose their edges, all else keeps its ids
    later = tree(spark, {"pkg/a.py": b"def h():\n    return 3\n"}, drop=("lib/m.ts",)).withColumn("file_id", F.concat(F.lit("later-"), "path"))
    second = snapshot.index_snapshot(later, stored, store.read("code_units"), parse(seen))
    assert {r.path for r in seen[-1].collect()} == {"pkg/a.py"}
    assert store.publish(second, base=1) == 2
    assert {r.id for r in store.read("files").collect()} == {r.id for r in stored.where("path <> 'lib/m.ts'").collect()}
    before = {r.code_unit_id for r in store.read("code_units", 1).where("path not in ('pkg/a.py', 'lib/m.ts')").collect()}
    assert before < {r.code_unit_id for r in store.read("code_units").collect()}
    called = {(r.source_unit_id.split(":")[0], r.target_unit_id.split(":")[0]) for r in store.read("code_relationships").collect()}
    assert ("pkg/b.py", "pkg/a.py") in called and ("lib/n.js", "lib/m.ts") not in called and len(called) == 4
    with pytest.raises(Exception, match="unparsable|UTF"):
        store.publish(snapshot.index_snapshot(tree(spark, {"pkg/b.py": b"x = '\xff'"}), stored, store.read("code_units"), parse(seen), edges=False))
    moved = tree(spark, {"pkg/b.py": b"x = 1\n"}).withColumn("content_hash", F.when(F.col("path") == "pkg/b.py", F.lit("0" * 64)).otherwise(F.col("content_hash")))
    with pytest.raises(Exception, match="changed while"):
        store.publish(snapshot.index_snapshot(moved, stored, store.read("code_units"), parse(seen), edges=False))
    assert store.generation() == 2


def test_of_two_reservations_one_is_refused(spark, tmp_path, monkeypatch):
    jobs = snapshot.Jobs(spark, str(tmp_path / "jobs"))
    ahead = []
    real = jobs._append

    def race(*a):
        if not ahead:
            ahead.append(True)
            ahead.append(jobs.reserve("r"))
        return real(*a)

    with monkeypatch.context() as m:
        m.setattr(jobs, "_append", race)
        with pytest.raises(RuntimeError):
            jobs.reserve("r")
    assert [r.status for r in jobs.log().collect()] == ["pending"]
    claims = []

    def claim_first(*a):
        if not claims:
            claims.append(None)
            claims[0] = jobs.move("r", ahead[1], "running")
        return real(*a)

    with monkeypatch.context() as m:
        m.setattr(jobs, "_append", claim_first)
        assert not jobs.move("r", ahead[1], "running")
    assert claims == [True]


def test_leases(spark, tmp_path):
    now = [100.0]
    lease = shared.Lease(spark, str(tmp_path / "leases"), 5_000, lambda: now[0])
    token = lease.acquire("r")
    assert token and lease.acquire("r") is None and lease.acquire("s")
    assert not lease.release("r", "other") and lease.release("r", token) and not lease.release("r", token)
    held = lease.acquire("r")
    now[0] += 5.0
    assert lease.acquire("r") and not lease.release("r", held)  # who held it too long has lost it
