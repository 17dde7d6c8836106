"""Verdicts and rates."""

import pytest

from strataloom.llm import syntax

CASES = [
    ("x = 1\n", "python", "a.py", "valid"), ("print 'a'\n", "python", "a.py", "corrupt"), ("", "python", "a.py", "valid"), ("# only\n", None, "a.py", "valid"), ("def f(:\n", None, "a.py", "corrupt"),
    ("const x = 1;\nfunction f() { return x }\n", "python", "a.py", "wrong_extension"), ("let x: number = 1;\n", "javascript", "a.js", "wrong_extension"), ("let x: number = 1;\n", "typescript", "a.ts", "valid"),
    ("x = <a>b</a>;\n", "javascript", "a.jsx", "valid"), ("x = <a>b</a>;\n", "javascript", "a.js", "wrong_extension"), ("let a; let a;\n", None, "a.js", "valid"), ("<<<<<<< HEAD\nlet a\n=======\nlet b\n>>>>>>> x\n", None, "a.ts", "corrupt"),
    ('{"a": [1, 2]}', "config", "a.json", "valid"), ('{"a": NaN}', "config", "a.json", "wrong_extension"), ('{"a": [1 2]}', "config", "a.json", "corrupt"), ("", "config", "a.json", "wrong_extension"), ('{"a": 1,}', "config", "a.JSON", "wrong_extension"),
    ("﻿x = 1\r\n", "python", "a.py", "valid"), ("x = 1\x00", "python", "a.py", "corrupt"), (None, "javascript", "a.js", "valid"),
]


@pytest.mark.parametrize(("text", "language", "path", "verdict"), CASES)
def test_verdicts(text, language, path, verdict):
    assert syntax.judge(text, language, path)[2] == verdict


@pytest.mark.parametrize(("language", "path"), [("documentation", "a.md"), (None, "a.yaml"), (None, None), ("config", "a.toml")])
def test_other_files_are_not_judged(language, path):
    assert syntax.judge("{", language, path) is None


def test_reasons():
    assert syntax.judge("def f():\n    x = (1,\n", "python", "a.py")[3].startswith("truncated")
    assert syntax.judge("function f() {\n", "javascript", "a.js")[3].startswith("truncated")
    assert syntax.judge("<<<<<<< HEAD\n", "python", "a.py")[3] == "merge conflict"
    assert syntax.judge("const a = () => 1\n", "python", "a.py")[3] == "reads as javascript"


@pytest.mark.parametrize(("text", "path", "verdict"), [
    ("x = " + "[" * 3_000 + "]" * 3_000 + ";", "a.js", "valid"), ("(" * 30_000 + "1" + ")" * 30_000, "a.ts", "valid"), ("[" * 30_000 + "1" + "]" * 29_999, "a.js", "corrupt"),
    ("[" * 60_000 + "]" * 60_000, "a.json", "valid"), ('{"a":' * 60_000 + "1" + "}" * 60_000, "a.json", "valid"), ("[" * 60_000 + "]" * 59_999, "a.json", "corrupt"), ('{"a":' * 60_000 + "}" * 60_000, "a.json", "corrupt"),
])
def test_deep_texts(text, path, verdict):
    assert syntax.judge(text, None, path)[2] == verdict


def test_deep_json_is_strict_json():
    import json

    for text in ('{"a": [1, -2.5e3, "\\u00e9\\n", true, null, {}], "b": []}', "1", '"x"', "[]", " [1] ", "[1,]", '{"a":1,}', "{1:2}", "[01]", "['a']", '["\t"]', "[1 2]", "", " ", "[", "]", '{"a"}', '{"a":}', "NaN", "[1]]", '"\\x"', "{,}", "[,1]", "tru"):
        def reads(f):
            try:
                f(text)
            except ValueError:
                return False
            return True

        assert reads(syntax._deep_json) == reads(lambda t: json.loads(t, parse_constant=syntax._no_constant)), text


def test_every_grammar_or_enough_of_them():
    for text, language, path, verdict in CASES:
        assert syntax.judge(text, language, path, every=True)[2] == verdict
    assert syntax.judge("x = 1\n", "python", "a.py", every=True)[1] == ["python", "javascript", "jsx", "typescript"]
    assert syntax.judge("x = 1\n", "python", "a.py")[1] == ["python"]


def test_rates_count_repeated_rows_once(spark):
    schema = "file_id string, repository_id string, language string, relative_path string, content string, verdict int"
    rows = [("a", "r", "python", "a.py", "x = (", 0), ("a", "r", "python", "a.py", "x = (", 0), ("b", "r", "python", "b.py", "x = 1", 0), ("c", "r", "documentation", "c.md", "(", 0), ("d", "s", None, "d.js", "x = 1" + " + 1" * 20_000, 0)]
    verdicts = syntax.check(spark.createDataFrame(rows, schema), "file_id", "repository_id", "language", "relative_path", "content")
    got = {(r.repository_id, r.language): (r.files, r.invalid, r.rate) for r in syntax.rates(verdicts).collect()}
    assert got == {("r", "python"): (2, 1, 0.5), ("s", "javascript"): (1, 0, 0.0)}
    none = syntax.check(spark.createDataFrame([], schema), "file_id", "repository_id", "language", "relative_path", "content")
    assert none.count() == 0 and syntax.rates(none).count() == 0
