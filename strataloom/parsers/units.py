"""Files to code units: classes, functions and imports of Python, JavaScript and TypeScript.

A unit is an exact slice of its file, with the lines it covers (only line feeds count) and the name it defines.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import valid_relative
from ..session import spread
from . import ecma


class UnparsableFile(ValueError):
    """The file does not follow the grammar of its language."""


def _lines(source: bytes, start: int, end: int) -> tuple[int, int]:
    first = source.count(b"\n", 0, start) + 1
    piece = source[start:end]
    return first, first + piece.count(b"\n") - (1 if piece.endswith(b"\n") else 0)


def _tree(source: bytes) -> ast.Module:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise UnparsableFile(str(e)) from None


def _python_lines(source: bytes) -> list[int]:
    """Starts of lines as the compiler counts them: line feeds, carriage returns and pairs of them."""
    starts, i = [0], 0
    while True:
        n, r = source.find(b"\n", i), source.find(b"\r", i)
        if n < 0 and r < 0:
            return starts
        i = r + 1 if r >= 0 and (n < 0 or r < n) else n + 1
        if r >= 0 and (n < 0 or r < n) and source[i : i + 1] == b"\n":
            i += 1
        starts.append(i)


def python_units(content: str) -> list[tuple[str, str | None, str, int, int]]:
    """(kind, symbol, content, start line, end line) in source order. A decorated definition begins at its first
    decorator; methods and nested definitions are units of their own."""
    source = content.encode("utf-8")
    starts = _python_lines(source)
    found = []
    for node in ast.walk(_tree(source)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start = starts[node.lineno - 1] + node.col_offset
            if node.decorator_list:
                first = node.decorator_list[0]
                start = source.rindex(b"@", 0, starts[first.lineno - 1] + first.col_offset)
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            name = node.name
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            start, kind, name = starts[node.lineno - 1] + node.col_offset, "import", None
        else:
            continue
        end = starts[node.end_lineno - 1] + node.end_col_offset
        found.append((start, end, kind, name))
    found.sort(key=lambda f: f[:2])
    return [(kind, name, source[a:b].decode(), *_lines(source, a, b)) for a, b, kind, name in found]


def ecma_units(content: str, types: bool, jsx: bool) -> list[tuple[str, str | None, str, int, int]]:
    """Units of a JavaScript or TypeScript file. A method with a computed or quoted name is none."""
    try:
        found = ecma.parse(content, jsx=jsx, types=types)
    except ecma.SyntaxFault as e:
        raise UnparsableFile(str(e)) from None
    kinds = {"class": "class", "import": "import"}
    rows = []
    for d in sorted(found, key=lambda d: (d.start, d.end)):
        if d.kind == "method" and (d.name is None or d.name[:1] in "\"'0123456789"):
            continue
        piece = content[d.start : d.end]
        first = content.count("\n", 0, d.start) + 1
        last = first + piece.count("\n") - (1 if piece.endswith("\n") else 0)
        rows.append((kinds.get(d.kind, "function"), d.name, piece, first, last))
    return rows


def units_of(content: str, language: str, path: str) -> list[tuple[str, str | None, str, int, int]]:
    """Units of one file by its language."""
    if language == "python":
        return python_units(content)
    if language in ("javascript", "typescript"):
        return ecma_units(content, language == "typescript", path.lower().endswith(".jsx"))
    return []


_UNITS = "file_id string, repository_id string, path string, kind string, symbol_name string, content string, language string, start_line int, end_line int, error string"


def _run(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for item, repo, path, language, content in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                for kind, name, piece, first, last in units_of(content or "", language or "", path or ""):
                    rows.append((item, repo, path, kind, name, piece, language, first, last, None))
            except UnparsableFile as e:
                rows.append((item, repo, path, None, None, None, language, None, None, str(e)))
        columns = list(zip(*rows)) if rows else [[]] * 10
        types = [pa.string()] * 7 + [pa.int32()] * 2 + [pa.string()]
        labels = [part.split()[0] for part in _UNITS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=labels)


def parse_files(files: DataFrame) -> DataFrame:
    """Units of files (file_id, repository_id, path, language, content), next to the data.

    A file that does not parse gives one row with its error and no unit: no partial output. An empty file gives none.
    """
    slim = files.select("file_id", "repository_id", "path", "language", "content")
    return spread(slim).mapInArrow(_run, _UNITS)


def unit_checks(units: DataFrame) -> DataFrame:
    """Units that break a rule, with the first rule they break as ``problem``."""
    problem = (
        F.when(~F.col("kind").isin("class", "config", "document", "function", "import"), "kind")
        .when(F.col("content").isNull() | (F.col("content") == ""), "content")
        .when(F.col("language") != F.lower("language"), "language")
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "lines")
        .when(F.trim("symbol_name") == "", "symbol")
        .when(~valid_relative(F.col("path")), "path")
    )
    return units.withColumn("problem", problem).where("problem is not null")
