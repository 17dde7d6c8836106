"""Snapshots of repositories: what changed, what carries over, publishing a generation, jobs that guard it."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable
from .shared import SharedFolder


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes of a content, in hexadecimal."""
    return F.sha2(content, 256)


def classify(current: DataFrame, stored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key..., status): refresh for new, changed and unverified paths, removed, or unchanged.

    Both sides: (key..., content_hash). A null stored hash is not verified and never equal. A rename is a removal and
    an addition; nobody guesses.
    """
    key = key or ["repository_id", "path"]
    c = current.select(*key, F.col("content_hash").alias("now"), F.lit(True).alias("here"))
    s = stored.select(*key, F.col("content_hash").alias("then"), F.lit(True).alias("there"))
    both = c.join(s, key, "full_outer")
    status = (
        F.when(F.col("here").isNull(), "removed")
        .when(F.col("there").isNull() | ~F.col("now").eqNullSafe(F.col("then")) | F.col("then").isNull(), "refresh")
        .otherwise("unchanged")
    )
    return both.select(*key, status.alias("status"))


def generations(classes: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repository_id, changed, next_generation): one more if anything changed, the same if nothing did.

    The next generation is a decimal of 20 digits, so that the one after the greatest long is a number too.
    """
    changed = classes.groupBy("repository_id").agg(F.count_if(F.col("status") != "unchanged").alias("changed"))
    base = repositories.select(F.col("id").alias("repository_id"), "index_generation").join(changed, "repository_id", "left")
    n = F.coalesce("changed", F.lit(0))
    following = F.col("index_generation").cast("decimal(19,0)") + (n > 0).cast("int").cast("decimal(1,0)")
    return base.select("repository_id", n.alias("changed"), following.cast("decimal(20,0)").alias("next_generation"))


def carry_forward(stored_units: DataFrame, classes: DataFrame, parsed_units: DataFrame) -> DataFrame:
    """Units of the next generation: those of unchanged files as they are, ids and vectors included, and the newly
    parsed ones of refreshed files. Units of removed files drop out."""
    keep = classes.where(F.col("status") == "unchanged").select("repository_id", "path")
    fresh = classes.where(F.col("status") == "refresh").select("repository_id", "path")
    kept = stored_units.join(keep, ["repository_id", "path"], "left_semi")
    new = parsed_units.join(fresh, ["repository_id", "path"], "left_semi")
    return kept.unionByName(new, allowMissingColumns=True)


def append_missing(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once: an idempotent insert."""
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c) for c in key]))).where("_n = 1").drop("_n")
    return once.join(stored.select(*key).distinct(), key, "left_anti")


def attach_embeddings(units: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """Units with new vectors where given: (id, embedding). Repeated ids, unknown ids and bad vectors fail the query."""
    from ..functions.vectors import usable

    counted = embeddings.groupBy("id").agg(F.count("*").alias("n"), F.first("embedding").alias("new"))
    zero = F.forall("new", lambda x: x == 0) & (F.size("new") == width)
    bad = (F.col("n") > 1) | ~(usable(F.col("new"), width) | zero)
    checked = counted.withColumn("new", F.when(bad, F.raise_error(F.lit("bad embedding")).cast("array<float>")).otherwise(F.col("new")))
    joined = units.join(checked.select("id", "new", F.lit(True).alias("given")), "id", "full_outer")
    lost = F.col("given").isNotNull() & F.col("file_id").isNull()
    value = F.when(lost, F.raise_error(F.lit("no such unit")).cast("array<float>")).otherwise(F.coalesce("new", "embedding"))
    return joined.withColumn("embedding", value).drop("new", "given")


class SnapshotStore:
    """Tables of generations under one root, or of one repository under it; published by one exclusive record.

    Readers open the last published generation and never see a half-written one. Writers need no lock: of two that
    began from the same generation one publishes, the other is refused and changes nothing; writers of different
    repositories never meet. A writer that dies leaves a folder that nobody opens.
    """

    def __init__(self, spark: SparkSession, root: str, repository: str | None = None):
        self.spark = spark
        self.folder = SharedFolder(spark, root if repository is None else f"{root.rstrip('/')}/repository={repository}")

    def _last(self) -> dict | None:
        records = self.folder.records("generations")
        return records[-1] if records else None

    def generation(self) -> int:
        """The published generation, 0 if there is none."""
        last = self._last()
        return last["sequence"] if last else 0

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A table of a generation."""
        for record in reversed(self.folder.records("generations")):
            if generation in (None, record["sequence"]):
                return self.spark.read.parquet(self.folder.at(f"{record['tables']}/{table}"))
        raise LookupError("no such generation")

    def publish(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Write the tables and make them the generation after ``base`` (the last one if not given).

        On any failure nothing changes. A change that was computed from an older generation than the last is refused.
        """
        known = self.generation()
        base = known if base is None else base
        staged = f"tables/{uuid.uuid4().hex}"
        try:
            if base != known:
                raise RuntimeError("another writer published meanwhile")
            for name, df in tables.items():
                df.write.parquet(self.folder.at(f"{staged}/{name}"))
            if not self.folder.append("generations", {"tables": staged}, base):
                raise RuntimeError("another writer published meanwhile")
        except BaseException:
            self.folder.remove(staged)
            raise
        return base + 1


def derived_id(*parts: str | int) -> str:
    """An id in the form of a UUID that follows from what it names, so a repeated task gives the same."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, "/".join(map(str, parts))))


class Jobs:
    """Indexing jobs as an append-only log of states per repository: pending, running, then completed or failed.

    Every state is one numbered record of the repository's log. It counts only as the one after the state it was
    decided on, so of two reservations, or two claims, at the same time one is refused.
    """

    NEXT = {"pending": {"running", "failed"}, "running": {"completed", "failed"}}
    SCHEMA = "job_id string, repository_id string, status string, at timestamp_ntz, sequence long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, SharedFolder(spark, root)

    def log(self) -> DataFrame:
        """All states of all repositories."""
        parts = [f for f in self.folder.names("") if not f.startswith(".")]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json([self.folder.at(f) for f in parts])

    def current(self) -> DataFrame:
        """The last state of each job."""
        last = F.max_by(F.struct("repository_id", "status", "at", "sequence"), F.col("sequence"))
        return self.log().groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")

    @staticmethod
    def _place(repository_id: str) -> str:
        return hashlib.sha256(repository_id.encode()).hexdigest()[:32]

    def reserve(self, repository_id: str) -> str:
        """A new pending job; refused while one is active."""
        log = self.folder.records(self._place(repository_id))
        last = {r["job_id"]: r["status"] for r in log}
        if any(status in self.NEXT for status in last.values()):
            raise RuntimeError("a job is active")
        after = log[-1]["sequence"] if log else 0
        job = derived_id("job", repository_id, after + 1)
        if not self._append(job, repository_id, "pending", after):
            raise RuntimeError("a job is active")
        return job

    def move(self, repository_id: str, job_id: str, status: str) -> bool:
        """Change the state if the change is allowed and nobody else was faster; a final state is never overwritten."""
        log = self.folder.records(self._place(repository_id))
        states = [r["status"] for r in log if r["job_id"] == job_id]
        if not states or status not in self.NEXT.get(states[-1], set()):
            return False
        return self._append(job_id, repository_id, status, log[-1]["sequence"])

    def _append(self, job: str, repository: str, status: str, after: int) -> bool:
        now = datetime.now(timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds")
        record = {"job_id": job, "repository_id": repository, "status": status, "at": now}
        return self.folder.append(self._place(repository), record, after)


def decoded(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 fail the query."""
    return F.validate_utf8(content.cast("string"))


def unchanged_since(content: Column, content_hash_: Column) -> Column:
    """The bytes if they still have the hash that was taken of them; a file that changed meanwhile fails the query."""
    moved = F.raise_error(F.lit("a file changed while it was indexed")).cast("binary")
    return F.when(F.sha2(content, 256) == content_hash_, content).otherwise(moved)


def index_snapshot(
    current: DataFrame, stored: DataFrame, stored_units: DataFrame, parse, edges: bool = True
) -> dict[str, DataFrame] | None:
    """The tables of the next generation of all repositories: files, code_units, relationships, code_relationships.

    ``current``: (file_id, repository_id, path, content, content_hash); ``stored``: (id, repository_id, path,
    content_hash); ``stored_units``: (code_unit_id, file_id, repository_id, path, ...); ``parse`` maps (file_id,
    repository_id, path, language, content) to units with ids. None if nothing changed: then there is nothing to parse,
    to embed, to resolve or to publish. Only refreshed files are parsed into units; all else carries over with its
    ids and vectors, and a path keeps its file id. Files without a parser keep their hash and are never decoded; texts
    that are no UTF-8, and files whose bytes no longer have their hash, fail the run.

    The graphs are built anew of all files, the unchanged ones included, since what they name may have moved: module
    names come from import units, which for unchanged files are the stored ones; calls come from the texts.
    """
    from ..functions import paths
    from ..parsers import references
    from . import graph

    classes = durable(classify(current, stored))
    if classes.where("status <> 'unchanged'").isEmpty():
        return None
    key = ["repository_id", "path"]
    known = stored.select(*key, F.col("id").alias("known_id"))
    files = current.join(known, key, "left").withColumn("file_id", F.coalesce("known_id", "file_id")).drop("known_id")
    language = paths.parser(F.col("path"))
    texts = files.select(
        "file_id", *key, language.alias("language"),
        decoded(unchanged_since(F.col("content"), F.col("content_hash"))).alias("content"),
    ).where(language.isNotNull())
    fresh = parse(texts.join(classes.where("status = 'refresh'"), key, "left_semi"))
    units = carry_forward(stored_units, classes, fresh)
    tables = {"files": files.select(F.col("file_id").alias("id"), *key, "content_hash"), "code_units": units}
    if not edges:
        return tables
    units = durable(units)
    tables["code_units"] = units
    code = texts.where(F.col("language").isin("python", "javascript", "typescript"))
    analysis = durable(references.analyse_calls(code))
    ends = references.endpoints_with_units(analysis, units)
    calls = graph.resolve_calls(references.call_rows(analysis, ends), references.binding_rows(analysis), ends, files)
    ids = lambda side: files.select("repository_id", F.col("path").alias(f"{side}_path"), F.col("file_id").alias(f"{side}_file_id"))
    imports = graph.import_edges(references.import_modules(units), files)
    imports = imports.join(ids("source"), ["repository_id", "source_path"]).join(ids("target"), ["repository_id", "target_path"])
    place = lambda side: units.select(F.col("code_unit_id").alias(f"{side}_unit_id"), F.col("file_id").alias(f"{side}_file_id"))
    called = calls.join(place("source"), "source_unit_id").join(place("target"), "target_unit_id")
    tables["relationships"] = owned(imports.select("repository_id", "source_file_id", "target_file_id", F.lit("imports").alias("relationship_type")), files)
    tables["code_relationships"] = owned(
        called.select("repository_id", "source_file_id", "source_unit_id", "target_file_id", "target_unit_id", F.lit("calls").alias("relationship_type")), files
    )
    return tables


def owned(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges both ends of which lie in files of their repository, as an edge sink takes them."""
    for side in ("source_file_id", "target_file_id"):
        have = files.select("repository_id", F.col("file_id").alias(side)).distinct()
        edges = edges.join(have, ["repository_id", side], "left_semi")
    return edges
