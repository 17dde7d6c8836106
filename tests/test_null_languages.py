"""Files without a language are parsed by their suffix."""

from strataloom.plans import core

PYTHON = "def g():\n    return 1\n\n\ndef f():\n    return g()\n"
SCRIPT = "function g() { return 1; }\nfunction f() { return g(); }\n"
TYPED = "function g(a: number): number { return a; }\nfunction f(): number { return g(1); }\n"


def test_null_languages(spark, tmp_path):
    rows = [("1", "r", "a.py", None, PYTHON), ("2", "r", "b.js", None, SCRIPT), ("3", "r", "c.ts", None, TYPED), ("4", "r", "d.md", None, "# g"), ("5", "r", "e.txt", "python", PYTHON)]
    spark.createDataFrame(rows, "file_id string, repository_id string, relative_path string, language string, content string").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {(r.language, r.kind): r["rows"] for r in core.parse_units(spark, str(tmp_path)).collect()}
    assert got == {("python", "function"): 4, ("javascript", "function"): 2, ("typescript", "function"): 2}
    spark.createDataFrame([(r[0], r[1], r[2], "h") for r in rows], "id string, repository_id string, path string, content_hash string").write.parquet(str(tmp_path / "files.parquet"))
    units = [(f"{n}{i}", n, "function", f"x {n}", lang, line, last, symbol, [1.0]) for n, lang, lines in (("1", "python", ((1, 2), (5, 6))), ("2", "javascript", ((1, 1), (2, 2))), ("3", "typescript", ((1, 1), (2, 2)))) for i, ((line, last), symbol) in enumerate(zip(lines, "gf"))]
    spark.createDataFrame(units, "id string, file_id string, kind string, content string, language string, start_line int, end_line int, symbol_name string, embedding array<float>").write.parquet(str(tmp_path / "code_units.parquet"))
    assert {(r.source_unit_id, r.target_unit_id) for r in core.call_resolve(spark, str(tmp_path)).where("repository_id <> 'planted'").collect()} == {("11", "10"), ("21", "20"), ("31", "30")}
