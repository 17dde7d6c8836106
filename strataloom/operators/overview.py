"""Overviews, listings and data-quality checks. Only metadata is read: no content, no vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

LANGUAGES = ("python", "javascript", "typescript", "documentation", "config")
KINDS = ("class", "config", "document", "function", "import")
STATUSES = ("pending", "running", "completed", "failed")


def bucketed(language: Column) -> Column:
    """The language, or ``other``; applied before grouping, so the groups are bounded."""
    return F.when(language.isin(*LANGUAGES), language).otherwise("other")


def unit_counts(units: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, code_units, named_code_units)."""
    placed = units.join(files.select(F.col("id").alias("file_id"), "repository_id"), "file_id")
    return placed.groupBy("repository_id").agg(
        F.count("*").alias("code_units"), F.count_if(F.col("symbol_name").isNotNull()).alias("named_code_units")
    )


def counts(repositories: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """(repository_id, index_generation, files, code_units, named_code_units); each side is counted before the join.

    The generation is text: it may exceed what other readers hold exactly.
    """
    file_counts = files.groupBy("repository_id").agg(F.count("*").alias("files"))
    base = repositories.select(F.col("id").alias("repository_id"), F.col("index_generation").cast("string").alias("index_generation"))
    joined = base.join(file_counts, "repository_id", "left").join(unit_counts(units, files), "repository_id", "left")
    return joined.na.fill(0, ["files", "code_units", "named_code_units"])


def by_group(units: DataFrame, files: DataFrame, group: Column, name: str) -> DataFrame:
    """(repository_id, <name>, count)."""
    placed = units.join(files.select(F.col("id").alias("file_id"), "repository_id"), "file_id")
    return placed.groupBy("repository_id", group.alias(name)).agg(F.count("*").alias("count"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """(repository_id, job_id, status, created_at): the last job of each repository by time, then id."""
    latest = F.max_by(F.struct(F.col("id").alias("job_id"), "status", "created_at"), F.struct("created_at", "id"))
    return jobs.groupBy("repository_id").agg(latest.alias("j")).select("repository_id", "j.*")


def summary(repositories: DataFrame, jobs: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """Latest job of every repository, and its counts only if that job was completed."""
    done = counts(repositories, files, units).join(latest_jobs(jobs), "repository_id", "left")
    shown = lambda c: F.when(F.col("status") == "completed", F.col(c)).alias(c)
    return done.select("repository_id", "job_id", "status", "created_at", shown("files"), shown("code_units"))


def overview_json(repositories: DataFrame, jobs: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """One row per repository with its nested overview; lists are ordered and empty rather than null."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(name, "count")))
        return df.groupBy("repository_id").agg(rows.alias(f"by_{name}"))

    languages = listed(by_group(units, files, bucketed(F.col("language")), "language"), "language")
    kinds = listed(by_group(units, files, F.col("kind"), "kind"), "kind")
    base = counts(repositories, files, units).join(latest_jobs(jobs), "repository_id", "left")
    full = base.join(languages, "repository_id", "left").join(kinds, "repository_id", "left")
    empty = lambda c: F.coalesce(F.to_json(c), F.lit("[]")).alias(c)
    return full.select("repository_id", "index_generation", "job_id", "status", "files", "code_units", "named_code_units", empty("by_language"), empty("by_kind"))


def list_units(units: DataFrame, kind: str | None, limit: int, offset: int = 0) -> DataFrame:
    """A page of units in canonical order."""
    pool = units if kind is None else units.where(F.col("kind") == kind)
    return order.page(pool, order.canonical(), limit, offset)


def list_repositories(repositories: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of repositories, newest first."""
    newest = [F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()]
    return order.page(repositories, newest, limit, offset, order.MAX_REPOSITORIES)


def _violations(df: DataFrame, check: str, bad: Column) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("violations")).select(F.lit(check).alias("check"), "violations")


def _repeated(df: DataFrame, check: str, *key: str) -> DataFrame:
    extra = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return extra.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations")


def _orphans(child: DataFrame, column: str, parent: DataFrame, check: str) -> DataFrame:
    lost = child.join(parent.select(F.col("id").alias(column)).distinct(), column, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations")


def unique_checks(repositories: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """(check, violations): keys that occur more than once."""
    return (
        _repeated(repositories, "repositories.id", "id")
        .unionByName(_repeated(repositories, "repositories.source", "source"))
        .unionByName(_repeated(files, "files.id", "id"))
        .unionByName(_repeated(files, "files.repository_path", "repository_id", "path"))
        .unionByName(_repeated(units, "code_units.id", "id"))
    )


def reference_checks(repositories: DataFrame, files: DataFrame, units: DataFrame, jobs: DataFrame) -> DataFrame:
    """(check, violations): rows whose parent is missing."""
    return (
        _orphans(files, "repository_id", repositories, "files.repository_id")
        .unionByName(_orphans(units, "file_id", files, "code_units.file_id"))
        .unionByName(_orphans(jobs, "repository_id", repositories, "indexing_jobs.repository_id"))
    )


def value_checks(repositories: DataFrame, files: DataFrame, units: DataFrame, jobs: DataFrame) -> DataFrame:
    """(check, violations): values outside their domain."""
    return (
        _violations(repositories, "repositories.index_generation", F.col("index_generation") < 0)
        .unionByName(_violations(files, "files.content_hash", ~F.col("content_hash").rlike("^[0-9a-f]{64}$")))
        .unionByName(_violations(units, "code_units.kind", ~F.col("kind").isin(*KINDS)))
        .unionByName(_violations(units, "code_units.lines", (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))))
        .unionByName(_violations(units, "code_units.content", F.col("content") == ""))
        .unionByName(_violations(jobs, "indexing_jobs.status", ~F.col("status").isin(*STATUSES)))
    )


def transition_checks(jobs: DataFrame) -> DataFrame:
    """(repository_id, active, terminal, overlapping): jobs by state, and repositories with more than one active job."""
    return jobs.groupBy("repository_id").agg(
        F.count_if(F.col("status").isin("pending", "running")).alias("active"),
        F.count_if(F.col("status").isin("completed", "failed")).alias("terminal"),
        (F.count_if(F.col("status").isin("pending", "running")) > 1).alias("overlapping"),
    )


def status_history(events: DataFrame) -> DataFrame:
    """A log of states (job_id, status, at, sequence) with ``previous`` and ``valid``: what is final never changes, and
    claiming comes before it."""
    w = Window.partitionBy("job_id").orderBy("at", "sequence")
    previous = F.lag("status").over(w)
    ok = (
        F.when(F.col("previous").isNull(), F.col("status") == "pending")
        .when(F.col("previous") == "pending", F.col("status").isin("running", "failed"))
        .when(F.col("previous") == "running", F.col("status").isin("completed", "failed"))
        .otherwise(False)
    )
    return events.withColumn("previous", previous).withColumn("valid", ok)


def grouped_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, units): the units of every file in canonical order, metadata only; files without units have an empty list."""
    fields = ["start_line", "last", "kind", "id", "symbol_name"]
    slim = units.select("file_id", "start_line", (-F.col("end_line")).alias("last"), "kind", "id", "symbol_name")
    listed = slim.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("u"))
    joined = files.select(F.col("id").alias("file_id")).join(listed, "file_id", "left")
    shaped = F.transform("u", lambda x: F.struct(x["id"].alias("id"), x["kind"].alias("kind"), x["start_line"].alias("start_line"), (-x["last"]).alias("end_line"), x["symbol_name"].alias("symbol_name")))
    none = F.from_json(F.lit("[]"), "array<struct<id:string,kind:string,start_line:int,end_line:int,symbol_name:string>>")
    return joined.select("file_id", F.coalesce(shaped, none).alias("units"))


def consistency_checks(counts_: DataFrame, languages: DataFrame, kinds: DataFrame) -> DataFrame:
    """(check, violations): counts of an overview that contradict each other.

    ``counts_``: what :func:`counts` gives; ``languages`` and ``kinds``: (repository_id, <name>, count). Counts per
    language and per kind add up to the units, no key occurs twice, named units are no more than all, and without files
    there are no units.
    """
    def sums(df: DataFrame, name: str) -> DataFrame:
        total = df.groupBy("repository_id").agg(F.sum("count").alias("n"))
        both = counts_.select("repository_id", "code_units").join(total, "repository_id", "left")
        return _violations(both, f"sum of {name}", F.coalesce("n", F.lit(0)) != F.col("code_units"))

    return (
        sums(languages, "language")
        .unionByName(sums(kinds, "kind"))
        .unionByName(_repeated(languages, "repeated language", "repository_id", "language"))
        .unionByName(_repeated(kinds, "repeated kind", "repository_id", "kind"))
        .unionByName(_violations(counts_, "named above all", F.col("named_code_units") > F.col("code_units")))
        .unionByName(_violations(counts_, "units without files", (F.col("files") == 0) & (F.col("code_units") > 0)))
    )


def row_counts(expected: dict[str, int], tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, expected, as_expected) of tables whose number of rows is known."""
    out = None
    for name, n in expected.items():
        row = tables[name].agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(n).cast("long").alias("expected"), (F.col("rows") == n).alias("as_expected")
        )
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no table was named")
    return out


def requested_summary(requested: DataFrame, repositories: DataFrame, jobs: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """The summary of requested repositories (repository_id, position), in order of first request, each id once.

    ``found`` is false for ids that are no repository. Only the requested repositories' files and units are counted.
    """
    once = requested.groupBy("repository_id").agg(F.min("position").alias("position"))
    ids = once.select("repository_id")
    mine = files.join(ids, "repository_id", "left_semi")
    theirs = units.join(mine.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    known = repositories.join(ids.withColumnRenamed("repository_id", "id"), "id", "left_semi")
    rows = summary(known, jobs.join(ids, "repository_id", "left_semi"), mine, theirs).withColumn("found", F.lit(True))
    return once.join(rows, "repository_id", "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("position")
