"""Processing only new or changed records.

The scan log keeps arriving, late and repeated, while a stored state says what the last successful run took. A run

1. rereads the log from the oldest transaction that was still open when the last run ended (here the generation
   stored for the repository: everything above it may be unseen),
2. reduces every key to its newest version, so redelivered and superseded rows fall out,
3. anti-joins (key, version) pairs against the ledger of what was processed, which removes the overlap that the
   generous reread brings in.

A run that fails leaves the ledger as it was, so the next run finds the same pairs again; a run that succeeds adds
its pairs and its output with the exclusive creation of one file, so none is taken twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SharedFolder


def normal_path(path: Column) -> Column:
    """``path`` without leading ``./`` (repeated ones too)."""
    return F.regexp_replace(path, r"^(?:\./+)+", "")


def reread_window(observations: DataFrame, repositories: DataFrame) -> DataFrame:
    """Observations of transactions that were open, or began, after the last successful run.

    A null generation, and one of an unknown repository, is never greater and drops out. A repository listed more
    than once counts with its greatest generation, so no row is multiplied.
    """
    stored = repositories.groupBy(F.col("id").alias("repository_id")).agg(
        F.max("index_generation").alias("stored_generation")
    )
    return (
        observations.join(stored, "repository_id")
        .where(F.col("index_generation") > F.col("stored_generation"))
        .drop("stored_generation")
    )


def newest_versions(observations: DataFrame) -> DataFrame:
    """One row per (repository_id, path): the newest by (index_generation, observed_at, observation_id).

    Spelling variants of a path are one key. ``max_by`` combines on the map side, so a repository that holds a third
    of the rows shuffles one row per path and task. Repeated rows are equal in every ordering column, so either may
    win.
    """
    version = F.struct("index_generation", "observed_at", "observation_id")
    state = F.struct(
        F.lower(F.trim("content_hash")).alias("content_hash"),
        F.col("status"),
        F.col("index_generation"),
        F.col("observed_at"),
        F.col("observation_id"),
    )
    return (
        observations.where(F.col("path").isNotNull())
        .groupBy("repository_id", normal_path(F.col("path")).alias("path"))
        .agg(F.max_by(state, version).alias("state"))
        .select("repository_id", "path", "state.*")
    )


def unprocessed(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Versions whose (repository_id, path, content_hash) the ledger lacks.

    A null hash in the ledger is a version nobody knows: it never matches, so the path is taken again.
    """
    done = ledger.where(F.col("content_hash").isNotNull()).select(
        "repository_id",
        normal_path(F.col("path")).alias("path"),
        F.lower(F.trim("content_hash")).alias("content_hash"),
    )
    return versions.join(done, ["repository_id", "path", "content_hash"], "left_anti")


def changed_paths(observations: DataFrame, repositories: DataFrame, files: DataFrame) -> DataFrame:
    """The added or changed paths of the next run, each once: (repository_id, path, content_hash, ...).

    Removed paths are no work for the run; they shadow older present versions first. Empty inputs give no rows.
    """
    needed = observations.select(
        "repository_id", "path", "content_hash", "status", "index_generation", "observed_at", "observation_id"
    )
    newest = newest_versions(reread_window(needed, repositories))
    return unprocessed(newest.where(F.col("status") == "present"), files)


#: What the ledger keeps of a version; all but the first three may be absent from what it is given.
_LEDGER = (
    "repository_id string, path string, content_hash string, status string, index_generation long, observed_at string, "
    "observation_id long, sequence long, oldest_open long"
)
_VERSION = ("index_generation", "observed_at", "observation_id")


class ProcessedLedger:
    """The versions that all successful runs took, under one root of a shared file system.

    Versions have repository_id, path and content_hash, and may have the status, index_generation, observed_at and
    observation_id of :func:`newest_versions`. A path is taken when its version differs from the newest published one,
    so content that comes back after other content is work again. Removed versions, if they are given, are taken and
    published as well, so a path that comes back with its old hash is work too; without the removal nothing was lost.

    A run writes its versions and its output to folders of its own that readers ignore. It is published by creating one
    small file under ``commits``, numbered, and only the first to take a number succeeds: two writers of one run, or of two runs
    that began from the same state, cannot both publish, and versions and output appear together or not at all. A
    crash at any point before leaves folders that no reader opens (:meth:`sweep` removes them). Work that has effects
    elsewhere may be repeated after a crash; work that returns its output as a DataFrame is published exactly once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, SharedFolder(spark, root)

    def _log(self) -> list[dict]:
        """The published commits in order. Each says which folders it adds, and a compaction which it replaces."""
        return self.folder.records("commits")

    def runs(self) -> list[str]:
        """Names of the published runs, in order."""
        return [c["run"] for c in self._log() if c["run"]]

    def _live(self, log: list[dict]) -> list[str]:
        folders: list[str] = []
        for c in log:
            folders = [f for f in folders if f not in c["replaces"]] + [c["versions"]]
        return folders

    def _rows(self) -> DataFrame:
        found = [self.folder.at(f) for f in self._live(self._log())]
        return self.spark.read.schema(_LEDGER).parquet(*found) if found else self.spark.createDataFrame([], _LEDGER)

    def outputs(self) -> DataFrame | None:
        """What the work of all published runs gave; None if none gave anything."""
        found = [self.folder.at(c["output"]) for c in self._log() if c["output"]]
        return self.spark.read.parquet(*found) if found else None

    def pairs(self) -> DataFrame:
        """All processed pairs."""
        return self._rows().where(F.col("path").isNotNull()).select("repository_id", "path", "content_hash")

    def newest(self) -> DataFrame:
        """(repository_id, path, published): the newest published version of every path, of equal ones the last run's."""
        key = F.struct(*_VERSION, "sequence")
        state = F.struct(F.lower(F.trim("content_hash")).alias("content_hash"), "status", *_VERSION)
        rows = self._rows().where(F.col("path").isNotNull())
        return rows.groupBy("repository_id", normal_path(F.col("path")).alias("path")).agg(F.max_by(state, key).alias("published"))

    def reread(self, observations: DataFrame) -> DataFrame:
        """Observations from the oldest transaction that was open when the last run ended, that one included.

        Repositories of which no run told an open transaction are read in full.
        """
        marks = self._rows().where(F.col("oldest_open").isNotNull())
        marks = marks.groupBy("repository_id").agg(F.max_by("oldest_open", "sequence").alias("oldest_open"))
        seen = observations.join(marks, "repository_id", "left")
        return seen.where(F.col("oldest_open").isNull() | (F.col("index_generation") >= F.col("oldest_open"))).drop("oldest_open")

    def take(self, versions: DataFrame) -> DataFrame:
        """Those of ``versions`` that are not what was published of their path last, and not older than that."""
        given = {c: F.col(f"v.{c}") for c in versions.columns}
        both = versions.alias("v").join(
            self.newest().alias("n"),
            (given["repository_id"] == F.col("n.repository_id")) & (normal_path(given["path"]) == F.col("n.path")),
            "left",
        )
        last, here = F.col("n.published"), lambda c: given.get(c, F.lit(None))
        gone = F.coalesce(here("status").cast("string") == "removed", F.lit(False))
        was_gone = F.coalesce(last["status"] == "removed", F.lit(False))
        same_hash = F.coalesce(F.lower(F.trim(given["content_hash"])) == last["content_hash"], F.lit(False))
        unchanged = F.when(gone, last.isNull() | was_gone).otherwise(same_hash & ~was_gone)
        fresh = F.lit(True)
        if all(c in given for c in _VERSION):
            version = F.struct(given["index_generation"], given["observed_at"].cast("string").alias("observed_at"), given["observation_id"])
            fresh = F.coalesce(version >= F.struct(*[last[c].alias(c) for c in _VERSION]), F.lit(True)) | last.isNull()
        return both.where(~unchanged & fresh).select("v.*")

    def commit(
        self,
        run: str,
        taken: DataFrame,
        work: Callable[[DataFrame], DataFrame | None] | None = None,
        oldest_open: DataFrame | None = None,
    ) -> bool:
        """Do ``work`` on ``taken`` and publish its versions and its output as ``run``.

        False if the run is published already, or if another run was published since this one began: then nothing of
        it is visible, and what it took must be taken again. ``oldest_open`` (repository_id, index_generation) tells
        from which transaction the next run rereads.
        """
        log = self._log()
        if any(c["run"] == run for c in log):
            return False
        sequence = log[-1]["sequence"] + 1 if log else 0
        attempt = uuid.uuid4().hex
        names = [c.split()[0] for c in _LEDGER.split(", ")]
        types = dict(c.split() for c in _LEDGER.split(", "))
        filled = lambda df, **more: df.select(
            [more.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in names]
        )
        rows = filled(taken.where(F.col("path").isNotNull()), sequence=F.lit(sequence), oldest_open=F.lit(None))
        if oldest_open is not None:
            marks = oldest_open.groupBy("repository_id").agg(F.min("index_generation").alias("oldest_open"))
            rows = rows.unionByName(filled(marks, sequence=F.lit(sequence)))
        versions, output = f"attempts/{attempt}/versions", None
        rows.write.parquet(self.folder.at(versions))
        if work is not None:
            staged = self.spark.read.schema(_LEDGER).parquet(self.folder.at(versions))
            made = work(staged.where(F.col("path").isNotNull()).drop("sequence", "oldest_open"))
            if made is not None:
                output = f"attempts/{attempt}/output"
                made.write.parquet(self.folder.at(output))
        return self._publish({"run": run, "sequence": sequence, "versions": versions, "output": output, "replaces": []}, attempt)

    def _publish(self, commit: dict, attempt: str) -> bool:
        if self.folder.append("commits", commit, commit["sequence"] - 1):
            return True
        self.folder.remove(f"attempts/{attempt}")
        return False

    def compact(self) -> bool:
        """Replace the versions of all runs by the newest of every path and the last marks, as one more commit, so that
        reading the ledger does not grow with the number of runs. False if a run was published meanwhile."""
        log = self._log()
        if len(log) < 2:
            return True
        sequence, attempt = log[-1]["sequence"] + 1, uuid.uuid4().hex
        names = [c.split()[0] for c in _LEDGER.split(", ")]
        everything = self._rows()
        rest = [c for c in names if c not in ("repository_id", "path")]
        paths = everything.where(F.col("path").isNotNull()).withColumn("path", normal_path(F.col("path")))
        paths = paths.groupBy("repository_id", "path").agg(F.max_by(F.struct(*rest), F.struct(*_VERSION, "sequence")).alias("s"))
        marks = everything.where(F.col("oldest_open").isNotNull()).groupBy("repository_id").agg(F.max_by(F.struct("path", *rest), "sequence").alias("s"))
        versions = f"attempts/{attempt}/versions"
        kept = paths.select("repository_id", "path", "s.*").select(*names).unionByName(marks.select("repository_id", "s.*").select(*names))
        kept.write.parquet(self.folder.at(versions))
        return self._publish({"run": None, "sequence": sequence, "versions": versions, "output": None, "replaces": self._live(log)}, attempt)

    def sweep(self) -> int:
        """Remove the folders of attempts that nothing published refers to; only while no run is at work."""
        log = self._log()
        known = {f.split("/")[1] for c in log for f in (c["output"], *([c["versions"]] if c["versions"] in self._live(log) else [])) if f}
        lost = [n for n in self.folder.names("attempts") if n not in known]
        for name in lost:
            self.folder.remove(f"attempts/{name}")
        return len(lost)
