"""Import and call graphs: resolution, impact, expansion.

Edges of calls: (repository_id, source_unit_id, target_unit_id). Edges of imports: (repository_id, source_file_id,
target_file_id). Resolution is a join of candidate paths with the inventory of paths, never a lookup in a collected
set, so it runs for all repositories at once.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..session import durable
from . import order
from .search import META

#: Seeds and neighbours of an expansion.
SEEDS, PER_SEED, MOST_ADDED = 3, 2, 4
ECMA_SUFFIXES = (".js", ".jsx", ".ts")


def outside_names() -> list[str]:
    """First parts of absolute Python names that are no file of a repository: the standard library's."""
    return sorted({*sys.stdlib_module_names, *sys.builtin_module_names, "__future__"})


def _prefixes(parts: Column, upto: Column) -> Column:
    """The joined prefixes of length 1..upto of an array of path parts."""
    return F.transform(F.sequence(F.lit(1), upto), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _python_parts(references: DataFrame) -> DataFrame:
    """Path parts that a Python module name stands for, and the packages that must exist on the way.

    Relative: every level of the package must be one, and the name is taken from the level the dots lead to. Absolute
    names start at the repository's root; the standard library is nobody's file.
    """
    module = F.col("module")
    level = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.substring(module, level + 1, F.length(module))
    package = F.slice(F.split("source_path", "/"), 1, F.size(F.split("source_path", "/")) - 1)
    tail = F.when(rest != "", F.split(rest, r"\.")).otherwise(F.array().cast("array<string>"))
    relative = F.concat(F.slice(package, 1, F.greatest(F.size(package) - level + 1, F.lit(0))), tail)
    parts = F.when(level > 0, relative).otherwise(F.split(module, r"\."))
    known = references.withColumn("level", level).withColumn("package", package).withColumn("parts", parts)
    outside = (F.col("level") == 0) & F.element_at("parts", 1).isin(outside_names())
    fits = (F.col("level") == 0) | ((F.size("package") > 0) & (F.col("level") <= F.size("package")))
    spelled = F.forall("parts", lambda p: p.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"))
    own = F.when(F.col("level") > 0, _prefixes(F.col("package"), F.greatest(F.size("package"), F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    inner = F.when(F.size("parts") > 1, _prefixes(F.col("parts"), F.greatest(F.size("parts") - 1, F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    usable = known.where(fits & ~outside & (F.size("parts") > 0) & spelled)
    base = F.array_join("parts", "/")
    return usable.select(
        "repository_id",
        "source_path",
        "language",
        "module",
        F.array_union(own, inner).alias("packages"),
        F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))).alias("candidates"),
    )


def normalise(path: Column) -> Column:
    """A POSIX path without ``.`` and ``..`` parts; null if it leaves its root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda out, p: F.when(
        p == "..",
        F.when((F.size(out) > 0) & (F.element_at(F.concat(F.array(F.lit("x")), out), -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    ).otherwise(F.concat(out, F.array(p)))
    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(done, ".."), F.array_join(done, "/"))


def _ecma_parts(references: DataFrame) -> DataFrame:
    """Candidate paths of a relative ECMAScript module: itself with a known suffix, else each suffix and its index."""
    module = F.col("module")
    folder = F.regexp_replace(F.col("source_path"), r"[^/]*$", "")
    target = normalise(F.concat(folder, module))
    last = F.substring_index(target, "/", -1)
    suffix = F.regexp_extract(last, r"[^.].*?(\.[^.]+)$", 1)
    directory = F.endswith(module, F.lit("/"))
    exact = F.when(suffix.isin(*ECMA_SUFFIXES), F.array(target)).otherwise(F.array().cast("array<string>"))
    stem = F.when(target == "", F.lit("")).otherwise(F.concat(target, F.lit("/")))
    index = F.array(*[F.concat(stem, F.lit("index" + s)) for s in ECMA_SUFFIXES])
    open_ = F.when(directory, index).otherwise(F.concat(F.array(*[F.concat(target, F.lit(s)) for s in ECMA_SUFFIXES]), index))
    wanted = references.where(module.rlike(r"^\.\.?/") & ~module.rlike(r"[\\?#\x00]")).where(target.isNotNull())
    return wanted.select(
        "repository_id", "source_path", "language", "module",
        F.array().cast("array<string>").alias("packages"),
        F.when((suffix != "") & ~directory, exact).otherwise(open_).alias("candidates"),
    )


def resolve_modules(references: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, source_path, module, target_path) of the module names that stand for exactly one file.

    ``references``: (repository_id, source_path, language, module); ``files``: (repository_id, path). Names that are
    ambiguous, leave the repository, or run through something that is no package, resolve to nothing.
    """
    columns = ["repository_id", "source_path", "language", "module"]
    wanted = references.select(*columns).distinct()
    inventory = files.select("repository_id", "path").distinct()
    python = _python_parts(wanted.where(F.col("language") == "python"))
    ecma = _ecma_parts(wanted.where(F.col("language").isin("javascript", "typescript")))
    both = durable(python.unionByName(ecma))  # read several times below; small beside the texts it came from
    key = ["repository_id", "source_path", "module"]
    # the packages on the way: each must have its __init__.py and no module of the same name beside it
    on_way = both.select(*key, F.explode("packages").alias("package")).select(
        *key, F.concat("package", F.lit("/__init__.py")).alias("must"), F.concat("package", F.lit(".py")).alias("not")
    )
    have = inventory.withColumn("have", F.lit(True))
    missing = on_way.join(have.withColumnRenamed("path", "must"), ["repository_id", "must"], "left").where("have is null")
    clash = on_way.join(inventory.withColumnRenamed("path", "not"), ["repository_id", "not"], "left_semi")
    broken = missing.select(*key).unionByName(clash.select(*key)).distinct()
    hits = both.select(*key, F.explode(F.array_distinct("candidates")).alias("path")).join(inventory, ["repository_id", "path"])
    one = hits.groupBy(*key).agg(F.count("*").alias("n"), F.min("path").alias("target_path")).where("n = 1").drop("n")
    return one.join(broken, key, "left_anti")


def import_edges(references: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, source_path, target_path): distinct, never from a file to itself."""
    known = files.select("repository_id", F.col("path").alias("source_path")).distinct()
    edges = resolve_modules(references, files).join(known, ["repository_id", "source_path"], "left_semi")
    return edges.where("source_path <> target_path").select("repository_id", "source_path", "target_path").distinct()


def first_edges(edges: DataFrame, source: str, target: str, position: str, by: str = "repository_id", most: int | None = None) -> DataFrame:
    """Edges without repeats, the first occurrence of each kept: all of them, or ``most`` per repository in order.

    Repeats fall together on the map side. Only where ``most`` is given are the edges of a repository put in order.
    """
    key = list(dict.fromkeys([by, source, target]))
    rest = [c for c in edges.columns if c not in {*key, position}]
    least = F.min(F.struct(position, *rest)).alias("first")
    kept = edges.groupBy(*key).agg(least).select(*key, "first.*").select(*edges.columns)
    if most is None:
        return kept
    ordered = Window.partitionBy(by).orderBy(position, source, target)
    return kept.withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= most).drop("_n")


def resolve_calls(calls: DataFrame, bindings: DataFrame, endpoints: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """(repository_id, source_unit_id, target_unit_id): calls whose target is one known function.

    ``calls``: (repository_id, path, language, caller_id, position, binding, member); ``bindings``: (repository_id,
    path, language, local, module, symbol); ``endpoints``: (repository_id, path, language, unit_id, name, export).
    A plain name is looked up among the file's own functions unless an import binds it; ``a.b()`` needs a module
    bound to ``a``. Python targets go by name, ECMAScript ones by what they export. ``most`` keeps so many edges of a
    repository, in order; else all are kept.
    """
    place = ["repository_id", "path"]
    bound = bindings.select(*place, F.col("local").alias("binding"), "module", "symbol")
    via = calls.join(bound, [*place, "binding"]).where(F.col("symbol").isNull() == F.col("member").isNotNull())
    references = via.select("repository_id", F.col("path").alias("source_path"), "language", "module")
    resolved = resolve_modules(references, files).withColumnRenamed("source_path", "path").where("path <> target_path")
    wanted = via.join(resolved, [*place, "module"]).withColumn("wanted", F.coalesce("symbol", "member"))
    ends = endpoints.select(
        "repository_id",
        F.col("path").alias("target_path"),
        F.col("language").alias("target_language"),
        F.col("unit_id").alias("target_unit_id"),
        F.when(F.col("language") == "python", F.col("name")).otherwise(F.col("export")).alias("wanted"),
    )
    ecma = ("javascript", "typescript")
    alike = (F.col("language") == F.col("target_language")) | (F.col("language").isin(*ecma) & F.col("target_language").isin(*ecma))
    remote = wanted.join(ends, ["repository_id", "target_path", "wanted"]).where(alike)
    call = ["repository_id", "path", "caller_id", "position"]
    remote = remote.groupBy(*call).agg(F.count("*").alias("n"), F.min("target_unit_id").alias("target_unit_id")).where("n = 1").drop("n")
    own = endpoints.select(*place, F.col("name").alias("binding"), F.col("unit_id").alias("target_unit_id"))
    local = calls.where(F.col("member").isNull()).join(bound.select(*place, "binding"), [*place, "binding"], "left_anti")
    local = local.join(own, [*place, "binding"]).select(*call, "target_unit_id")
    edges = remote.unionByName(local).select(
        "repository_id", F.col("caller_id").alias("source_unit_id"), "target_unit_id", F.struct("path", "position").alias("at")
    )
    return first_edges(edges, "source_unit_id", "target_unit_id", "at", most=most).select("repository_id", "source_unit_id", "target_unit_id")


def impact_of_files(targets: DataFrame, edges: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, file_id, path, rank, truncated): files that import the target file, by path and id.

    ``targets``: (query_id, file_id); ``edges``: (source_file_id, target_file_id). Incoming, one hop, never the file
    itself; one more than the limit is looked for to tell whether there are more.
    """
    order.check_limit(limit)
    incoming = targets.withColumnRenamed("file_id", "target_file_id").join(edges, "target_file_id")
    incoming = incoming.where("source_file_id <> target_file_id").select("query_id", F.col("source_file_id").alias("file_id")).distinct()
    rows = incoming.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return order.look_ahead(rows, [F.col("path").asc(), F.col("file_id").asc()], limit, ["query_id"])


def find_symbol(targets: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, matches, code_unit_id): the unit that a path and symbol name, null unless there is exactly one."""
    found = targets.join(units.select("repository_id", "path", "symbol_name", "code_unit_id"), ["repository_id", "path", "symbol_name"], "left")
    grouped = found.groupBy("query_id").agg(F.count("code_unit_id").alias("matches"), F.min("code_unit_id").alias("only"))
    return grouped.select("query_id", "matches", F.when(F.col("matches") == 1, F.col("only")).alias("code_unit_id"))


def impact(
    targets: DataFrame, repositories: DataFrame, files: DataFrame, units: DataFrame, imports: DataFrame, calls: DataFrame, limit: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(heads, items) of targets (query_id, repository_id, path, symbol_name): what depends on a file, or on a symbol.

    A head (query_id, outcome, mode, file_id, code_unit_id) tells what was found: ``ok``, ``bad_path``, ``no_repository``,
    ``no_file``, ``no_symbol``, or ``ambiguous`` where the file has several such symbols. Items (query_id, file_id, path,
    code_unit_id, symbol_name, kind, start_line, end_line, relationship_type, rank, truncated) are there for ``ok`` only.
    """
    order.check_limit(limit)
    asked = targets.select("query_id", "repository_id", "path", "symbol_name")
    known = repositories.select(F.col("id").alias("repository_id"), F.lit(True).alias("known")).distinct()
    placed = files.select("repository_id", "path", F.col("id").alias("file_id"))
    wanted = asked.where(F.col("symbol_name").isNotNull()).select("query_id", "repository_id", "path", "symbol_name")
    found = find_symbol(wanted, units)
    all_ = asked.join(known, "repository_id", "left").join(placed, ["repository_id", "path"], "left").join(found, "query_id", "left")
    symbol_mode = F.col("symbol_name").isNotNull()
    outcome = (
        F.when(~paths.valid_relative(F.col("path")) | (symbol_mode & (F.trim("symbol_name") == "")), "bad_path")
        .when(F.col("known").isNull(), "no_repository")
        .when(F.col("file_id").isNull(), "no_file")
        .when(symbol_mode & (F.col("matches") == 0), "no_symbol")
        .when(symbol_mode & (F.col("matches") > 1), "ambiguous")
        .otherwise("ok")
    )
    heads = durable(all_.select("query_id", outcome.alias("outcome"), F.when(symbol_mode, "symbol").otherwise("file").alias("mode"), "file_id", "code_unit_id"))
    good = heads.where("outcome = 'ok'")
    by_file = impact_of_files(good.where("mode = 'file'").select("query_id", "file_id"), imports, files, limit)
    by_symbol = impact_of_symbols(good.where("mode = 'symbol'").select("query_id", "code_unit_id"), calls, units, limit)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    items = by_file.select(
        "query_id", "file_id", "path", *none("string", "code_unit_id", "symbol_name", "kind"), *none("int", "start_line", "end_line"),
        F.lit("imports").alias("relationship_type"), "rank", "truncated",
    ).unionByName(by_symbol.select(
        "query_id", "file_id", "path", "code_unit_id", "symbol_name", "kind", "start_line", "end_line", F.lit("calls").alias("relationship_type"), "rank", "truncated",
    ))
    return heads, items


def impact_of_symbols(targets: DataFrame, edges: DataFrame, units: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, metadata, rank, truncated): units that call the target unit, in canonical order, recursion aside."""
    order.check_limit(limit)
    incoming = targets.withColumnRenamed("code_unit_id", "target_unit_id").join(edges.select("source_unit_id", "target_unit_id"), "target_unit_id")
    callers = incoming.where("source_unit_id <> target_unit_id").select("query_id", F.col("source_unit_id").alias("code_unit_id")).distinct()
    return order.look_ahead(callers.join(units.select(*META), "code_unit_id"), order.canonical(), limit, ["query_id"])


def expand(direct: DataFrame, edges: DataFrame, units: DataFrame, limit: int = 10) -> DataFrame:
    """Direct results with their callees added: (query_id, metadata, position, added).

    ``direct``: ranked rows with metadata. A third of the limit, at most four, is allowed for additions; the first
    results are seeds, each brings at most two callees that are no direct result, in order of the seeds. What is added
    replaces the last direct results.
    """
    order.check_limit(limit)
    allowance = min(MOST_ADDED, limit // 3)
    w = Window.partitionBy("query_id", "code_unit_id").orderBy("rank")
    rows = direct.select("query_id", *META, "rank").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("position") <= limit)
    rows = durable(rows)  # a few rows a question, needed four times: the search behind them runs once
    if not allowance:
        return rows.select("query_id", *META, "position", F.lit(False).alias("added"))
    seeds = rows.where(F.col("position") <= min(SEEDS, limit - allowance)).select("query_id", F.col("code_unit_id").alias("source_unit_id"), F.col("position").alias("seed"))
    out = seeds.join(edges.select("source_unit_id", "target_unit_id").distinct(), "source_unit_id").where("source_unit_id <> target_unit_id")
    out = out.withColumnRenamed("target_unit_id", "code_unit_id").join(rows.select("query_id", "code_unit_id"), ["query_id", "code_unit_id"], "left_anti")
    out = out.join(units.select(*META), "code_unit_id")
    per_seed = Window.partitionBy("query_id", "seed").orderBy(*order.canonical())
    out = out.withColumn("k", F.row_number().over(per_seed)).where(F.col("k") <= PER_SEED)
    once = Window.partitionBy("query_id", "code_unit_id").orderBy("seed", "k")
    out = out.withColumn("n", F.row_number().over(once)).where("n = 1")
    placed = Window.partitionBy("query_id").orderBy("seed", "k")
    out = out.withColumn("a", F.row_number().over(placed)).where(F.col("a") <= allowance)
    counts = out.groupBy("query_id").agg(F.count("*").alias("added_rows"))
    kept = rows.join(counts, "query_id", "left").withColumn("added_rows", F.coalesce("added_rows", F.lit(0)))
    kept = kept.where(F.col("position") <= limit - F.col("added_rows"))
    last = kept.groupBy("query_id").agg(F.max("position").alias("last"))
    added = out.join(last, "query_id").withColumn("position", (F.col("last") + F.col("a")).cast("int"))
    return kept.select("query_id", *META, "position", F.lit(False).alias("added")).unionByName(
        added.select("query_id", *META, "position", F.lit(True).alias("added"))
    )
