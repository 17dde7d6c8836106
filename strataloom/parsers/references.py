"""What files refer to: imported modules, and calls whose target can be told from the text alone.

Calls are hints: wherever a name might be bound to something else, by assignment, shadowing, deletion or repetition,
it is left out. Python files are read with the compiler's own parser, ECMAScript files with :mod:`.ecma`.
"""

from __future__ import annotations

import ast
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import ecma
from .units import UnparsableFile, _lines, _python_lines, _tree

_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def import_modules(units: DataFrame) -> DataFrame:
    """(repository_id, source_path, language, module) from import units, in built-in expressions.

    Python: the original names of ``import a.b as c, d`` and the module of ``from m import n``, dots kept. ECMAScript:
    the string after ``from`` or of a bare import, unless it has escapes.
    """
    rows = units.where(F.col("kind") == "import")
    flat = F.regexp_replace(F.regexp_replace(F.col("content"), r"#[^\n]*", ""), r"\\\r?\n", " ")
    from_module = F.regexp_extract(flat, r"^\s*from\s+(\.*\s*[\w.]*)\s+import\b", 1)
    listed = F.split(F.regexp_extract(flat, r"^\s*import\s+([\s\S]+)$", 1), ",")
    names = F.transform(listed, lambda n: F.trim(F.regexp_extract(n, r"^\s*([\w.]+)", 1)))
    python = F.when(from_module != "", F.array(F.regexp_replace(from_module, r"\s", ""))).otherwise(F.filter(names, lambda n: n != ""))
    literal = F.regexp_extract(F.col("content"), r"""(?:^\s*import|\bfrom)\s*(["'])((?:(?!\1)[^\\\n])*)\1""", 2)
    ecma = F.when(literal != "", F.array(literal)).otherwise(F.array().cast("array<string>"))
    modules = F.when(F.col("language") == "python", python).when(F.col("language").isin("javascript", "typescript"), ecma)
    return rows.select("repository_id", F.col("path").alias("source_path"), "language", F.explode(modules).alias("module"))


def _targets(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}


def _own(body: list[ast.stmt]):
    """Nodes of a scope without those of inner scopes; the inner scopes themselves are given."""
    todo: list[ast.AST] = list(body)
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, _SCOPES):
            todo.extend(ast.iter_child_nodes(node))


def _bound(body: list[ast.stmt], skip: set[int]) -> set[str]:
    """Names that a scope binds or changes anywhere, in whatever order; statements in ``skip`` do not count."""
    names: set[str] = set()
    for node in _own([s for s in body if id(s) not in skip]):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names.add(node.name)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, (ast.Store, ast.Del)):
            names.add(node.id)
        elif isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.For, ast.AsyncFor, ast.Delete)):
            for target in getattr(node, "targets", None) or [node.target]:
                names |= _targets(target)  # also what an attribute or item is set on
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            names.update(node.names)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names.update((a.asname or a.name).split(".")[0] for a in node.names)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            names.add(node.name)
        elif isinstance(node, (ast.With, ast.AsyncWith, ast.Match)):
            names |= _targets(node)
        elif isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            names.add(node.name)
        elif isinstance(node, ast.MatchMapping) and node.rest:
            names.add(node.rest)
        elif isinstance(node, ast.TypeAlias):
            names.add(node.name.id)
    return names


def _import_bindings(node: ast.Import | ast.ImportFrom) -> list[tuple[str, str, str | None]]:
    """(local name, module, symbol) of an import; the symbol is null if the module itself is bound."""
    if isinstance(node, ast.Import):
        return [(a.asname or a.name, a.name, None) for a in node.names if a.asname or "." not in a.name]
    module = "." * node.level + (node.module or "")
    return [(a.asname or a.name, module, a.name) for a in node.names]


def analyse_python(content: str, most: int | None = None) -> tuple[list, list, list]:
    """(endpoints, bindings, calls) of a file, all empty where it cannot be told.

    Endpoints: (name, start line, end line) of functions at the top. Bindings: (local, module, symbol). Calls: (caller
    name, start line, position, binding, member). A file with more than ``most`` calls gives nothing; without it all do.
    """
    nothing: tuple[list, list, list] = ([], [], [])
    source = content.encode("utf-8", "surrogatepass")
    try:
        tree = _tree(source)
    except UnparsableFile:
        return nothing
    nodes = list(ast.walk(tree))
    if most is not None and sum(isinstance(n, ast.Call) for n in nodes) > most:
        return nothing
    if any(isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names) for n in nodes):
        return nothing
    starts = _python_lines(source)
    functions = [s for s in tree.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef))]
    imports = [s for s in tree.body if isinstance(s, (ast.Import, ast.ImportFrom))]
    bindings = [b for s in imports if not (isinstance(s, ast.ImportFrom) and s.module == "__future__") for b in _import_bindings(s)]
    count = Counter([f.name for f in functions] + [b[0] for b in bindings])
    invalid = {n for n, k in count.items() if k != 1}
    invalid |= _bound(tree.body, {id(s) for s in [*functions, *imports]})
    invalid |= {a.name.split(".")[0] for s in imports for a in s.names if not a.asname and "." in a.name}
    for node in nodes:
        if isinstance(node, (ast.Global, ast.Nonlocal)):
            invalid.update(node.names)
        elif isinstance(node, ast.NamedExpr):
            invalid |= _targets(node.target)
    endpoints, calls = [], []
    for f in functions:
        if f.name in invalid:
            continue
        begin = starts[f.lineno - 1] + f.col_offset
        if f.decorator_list:
            begin = source.rindex(b"@", 0, starts[f.decorator_list[0].lineno - 1] + f.decorator_list[0].col_offset)
        first, last = _lines(source, begin, starts[f.end_lineno - 1] + f.end_col_offset)
        endpoints.append((f.name, first, last))
        own = list(_own(f.body))
        if any(isinstance(n, (*_COMPREHENSIONS, ast.With, ast.AsyncWith)) for n in own):
            continue
        local = invalid | _bound(f.body, set())
        a = f.args
        local |= {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]}
        local |= {p.name for p in getattr(f, "type_params", ())}
        found = []
        for node in own:
            if not isinstance(node, ast.Call):
                continue
            binding, member = "", None
            if isinstance(node.func, ast.Name):
                binding = node.func.id
            elif isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
                binding, member = node.func.value.id, node.func.attr
            if binding and binding not in local:
                found.append((node.lineno, node.col_offset, binding, member))
        for line, column, binding, member in sorted(found, key=lambda x: x[:2]):
            calls.append((f.name, first, line * 1_000_000 + min(column, 999_999), binding, member))
    return endpoints, [b for b in bindings if b[0] not in invalid], calls


def analyse_ecma(content: str, types: bool, jsx: bool, most: int | None = None) -> tuple[list, list, list]:
    """The same of a JavaScript or TypeScript file; endpoints have a fourth part, the name they are exported under.

    Endpoints are function declarations and constants with a function at the top. A name that is assigned to anywhere,
    bound twice at the top, or bound to something else there, is left out, and in a function so is what it binds.
    """
    nothing: tuple[list, list, list] = ([], [], [])
    try:
        found = ecma.parse(content, jsx=jsx, types=types, events=True)
    except ecma.SyntaxFault:
        return nothing
    if most is not None and sum(d.kind == "call" for d in found) > most:
        return nothing
    scopes = sorted((d for d in found if d.kind == "scope"), key=lambda d: d.end - d.start)

    def around(at: int) -> ecma.Definition | None:
        return next((x for x in scopes if x.start <= at < x.end), None)

    imports = [d for d in found if d.kind == "import"]
    bindings = []
    for d in (x for x in found if x.kind == "local"):
        whole = next((x for x in imports if x.start <= d.start < x.end), None)
        if whole is not None and whole.module is not None and "\\" not in whole.module:
            bindings.append((d.name, whole.module, d.module or None))
    functions = [d for d in found if d.kind == "function" or d.kind == "variable" and d.module == "const"]
    functions = [d for d in functions if d.name and d.depth == 0 and around(d.start) is None]
    top = [d.name for d in found if d.kind == "bind" and around(d.start) is None] + [b[0] for b in bindings]
    known = {d.name for d in functions} | {b[0] for b in bindings}
    invalid = {n for n, k in Counter(top).items() if k != 1 or n not in known}
    invalid |= {d.name for d in found if d.kind == "assign"}
    inside: dict[int, list[ecma.Definition]] = {}
    for d in found:
        if d.kind in ("call", "bind") and (scope := around(d.start)) is not None:
            inside.setdefault(id(scope), []).append(d)
    endpoints, calls = [], []
    for d in functions:
        if d.name in invalid:
            continue
        piece = content[d.start : d.end]
        first = content.count("\n", 0, d.start) + 1
        export = ("default" if piece.startswith("export default") else d.name) if piece.startswith("export") else None
        endpoints.append((d.name, first, first + piece.count("\n") - piece.endswith("\n"), export))
        own = next((x for x in reversed(scopes) if d.start <= x.start and x.end <= d.end and x.module != "class"), None)
        if own is None:
            continue
        events = inside.get(id(own), [])
        local = invalid | {x.name for x in events if x.kind == "bind"} | ({"arguments"} if own.module == "function" else set())
        for x in sorted((x for x in events if x.kind == "call"), key=lambda x: x.start):
            if x.name not in local:
                calls.append((d.name, first, x.start, x.name, x.module))
    return endpoints, [b for b in bindings if b[0] not in invalid], calls


_ANALYSIS = (
    "file_id string, repository_id string, path string, language string, role string, name string, start_line int, "
    "end_line int, position long, binding string, member string, module string"
)


def _analyse(language: str | None, path: str | None, content: str, most: int | None) -> tuple[list, list, list]:
    if language == "python":
        endpoints, bindings, calls = analyse_python(content, most)
        return [(*e, None) for e in endpoints], bindings, calls
    if language in ("javascript", "typescript"):
        return analyse_ecma(content, language == "typescript", (path or "").lower().endswith(".jsx"), most)
    return [], [], []


def _run(batches, most: int | None):
    labels = [part.split()[0] for part in _ANALYSIS.split(", ")]
    types = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.int64()] + [pa.string()] * 3
    for batch in batches:
        rows = []
        for item, repo, path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
            head = (item, repo, path, language)
            endpoints, bindings, calls = _analyse(language, path, content or "", most)
            rows.extend((*head, "endpoint", n, a, b, None, None, None, export) for n, a, b, export in endpoints)
            rows.extend((*head, "binding", s, None, None, None, n, None, m) for n, m, s in bindings)
            rows.extend((*head, "call", n, a, None, at, b, m, None) for n, a, at, b, m in calls)
        columns = list(zip(*rows)) if rows else [[]] * 12
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=labels)


def analyse_calls(files: DataFrame, most: int | None = None) -> DataFrame:
    """Endpoints, bindings and calls of files (file_id, repository_id, path, language, content), told apart by ``role``.

    For endpoints ``module`` is the name they are exported under. Files of other languages, and such that do not
    parse, give nothing, and neither do those with more than ``most`` calls if that is given.
    """
    slim = files.select("file_id", "repository_id", "path", "language", "content")
    return spread(slim).mapInArrow(partial(_run, most=most), _ANALYSIS)


def endpoints_with_units(analysis: DataFrame, units: DataFrame) -> DataFrame:
    """Endpoints joined with the one stored unit of the same file, name and lines: adds ``unit_id``."""
    ends = analysis.where(F.col("role") == "endpoint").select("repository_id", "file_id", "path", "language", "name", "start_line", "end_line", F.col("module").alias("export"))
    stored = units.where(F.col("kind") == "function").select(
        "file_id", F.col("symbol_name").alias("name"), "start_line", "end_line", F.col("code_unit_id").alias("unit_id")
    )
    joined = ends.join(stored, ["file_id", "name", "start_line", "end_line"])
    key = ["repository_id", "file_id", "path", "language", "name", "start_line"]
    one = joined.groupBy(*key).agg(F.count("*").alias("n"), F.min("unit_id").alias("unit_id"), F.min("export").alias("export"))
    return one.where("n = 1").drop("n")


def call_rows(analysis: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls with the unit of their caller, as :func:`strataloom.operators.graph.resolve_calls` takes them."""
    calls = analysis.where(F.col("role") == "call").select("file_id", "repository_id", "path", "language", "name", "start_line", "position", "binding", "member")
    callers = endpoints.select("file_id", "name", "start_line", F.col("unit_id").alias("caller_id"))
    return calls.join(callers, ["file_id", "name", "start_line"]).select("repository_id", "path", "language", "caller_id", "position", "binding", "member")


def binding_rows(analysis: DataFrame) -> DataFrame:
    """Import bindings: (repository_id, path, language, local, module, symbol)."""
    rows = analysis.where(F.col("role") == "binding")
    return rows.select("repository_id", "path", "language", F.col("binding").alias("local"), "module", F.col("name").alias("symbol"))


def is_identifier(name: Column) -> Column:
    """Whether a text is a plain identifier."""
    return name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")
