"""Evidence, and beliefs against enumeration of all labellings."""

import itertools
import math
import random

import pytest

from strataloom.llm import filekinds

CODE = "import a\n\ndef f(x):\n    y = x + 1\n    if y > 3:\n        return g(y)\n    for i in range(y):\n        h(i, x)\n    return None\n"
SCHEMA = "id string, repo string, path string, text string, label string"


def labels(spark, rows):
    df = spark.createDataFrame([(f"f{i}", *r, "") for i, r in enumerate(rows)], SCHEMA)
    return {r.path: r.label for r in filekinds.beliefs(df, "id", "repo", "path", "text").collect()}


def test_kinds(spark):
    rows = [
        ("r", "src/a.py", CODE), ("r", "src/b.py", "# Reads the generated manifest; do not edit that one\n" + CODE.replace("h(", "k(")), ("r", "src/c.py", "# Code generated by x v1. DO NOT EDIT.\n" + CODE.replace("h(", "m(")),
        ("r", "src/d.py", "\n".join(f"class F{i}(M):\n    number = {i}\n    wire = 'x{i}'" for i in range(30))), ("r", "web/e.js", "".join(f"function a{i}(b,c){{return b?c+{i}:c.d({i})}}" for i in range(60))),
        ("r", "src/f.py", "X = [\n" + "\n".join("    " + ", ".join(str(i * 37 % 9973) for i in range(k, k + 12)) + "," for k in range(60)) + "\n]\n"), ("r", "vendor/lib/g.py", CODE.replace("h(", "n(")),
        ("r", "vendor_portal/h.py", CODE.replace("h(", "o(")), ("r", "src/i.py", "# lib 1.2.3\n# Copyright the lib authors. All rights reserved.\n# Released under the Apache License 2.0\n" + CODE.replace("h(", "p(")),
        ("r", "src/j.py", "# Copyright the team, see LICENSE\n" + CODE.replace("h(", "q(")), ("r", "src/k.py", ""), ("r", "src/l.py", None), ("s", "src/same.py", CODE.replace("h(", "shared(")), ("t", "lib/other.py", "# note\n" + CODE.replace("h(", "shared(")),
        ("r", "m.py", "LIMITS = [1, 2, 3]\nNAMES = {'a': 1}\n"), ("r", None, CODE.replace("h(", "z(")),
    ]
    assert labels(spark, rows) == {
        "src/a.py": "handwritten", "src/b.py": "handwritten", "src/c.py": "generated", "src/d.py": "generated", "web/e.js": "minified", "src/f.py": "blob", "vendor/lib/g.py": "vendored", "vendor_portal/h.py": "handwritten",
        "src/i.py": "vendored", "src/j.py": "handwritten", "src/k.py": "handwritten", "src/l.py": "handwritten", "src/same.py": "vendored", "lib/other.py": "vendored", "m.py": "handwritten", "": "handwritten",
    }


LICENCE = [f"Line {i} of the terms under which the team lends this." for i in range(30)]


def test_the_whole_leading_comment_speaks(spark):
    mark, up = "Code generated by x v1. DO NOT EDIT.", "Copyright the lib authors."
    script = "function f(a) {\n  if (a > 3) {\n    return g(a);\n  }\n  for (const b of a) {\n    h(b, a);\n  }\n  return null;\n}\n"
    code = lambda n: CODE.replace("h(", f"n{n}(")
    rows = [
        ("r", "src/a.py", "\n".join("# " + x for x in LICENCE[:8] + [mark]) + "\n" + code(1)), ("r", "src/b.py", "﻿" + "\r\n".join("# " + x for x in LICENCE + [mark]) + "\r\n" + code(2)),
        ("r", "src/c.py", '"""The messages.\n\n' + mark + '\n"""\n' + code(3)), ("r", "src/d.js", "/*\n" + "\n".join(LICENCE + [mark]) + "\n*/\n" + script.replace("h(", "i(")),
        ("r", "src/e.py", "\n".join("# " + x for x in LICENCE + [up]) + "\n" + code(5)), ("r", "src/f.js", "/*\n  A library.\n\n  " + up + "\n*/ " + script.replace("h(", "j(")),
        # no leading comment: strings of an expression, and comments after the first code
        ("s", "src/g.py", '"""\n' + mark + '\n""".join(x)\n' + code(7)), ("s", "src/h.js", "/* The table. */ var a = 1;\n/*\n" + mark + "\n*/\n" + script.replace("h(", "k(")),
        ("s", "src/i.py", "'''Runs it.'''\n" + code(9) + "# " + mark + "\n"),
    ]
    assert labels(spark, rows) == {
        "src/a.py": "generated", "src/b.py": "generated", "src/c.py": "generated", "src/d.js": "generated", "src/e.py": "vendored", "src/f.js": "vendored",
        "src/g.py": "handwritten", "src/h.js": "handwritten", "src/i.py": "handwritten",
    }


def test_directories_of_any_depth_are_told_apart(spark):
    deep = "/".join(f"d{i}" for i in range(13))
    own = [f"{deep}/{d}/{n}.py" for d in ("src", "app") for n in "bcdefg"]
    rows = [("r", f"{deep}/vendor/a.py", CODE.replace("h(", "t("))] + [("r", p, CODE.replace("h(", f"u{i}(")) for i, p in enumerate(own)]
    assert labels(spark, rows) == {f"{deep}/vendor/a.py": "vendored"} | dict.fromkeys(own, "handwritten")


def slow_beliefs(files):
    """Exact posteriors by summing over all labels of all files and directories."""
    dirs = sorted({tuple(p.split("/")[:k]) for p, _ in files for k in range(len(p.split("/")))})
    nodes = dirs + [tuple(p.split("/")) for p, _ in files]
    where = {n: i for i, n in enumerate(nodes)}
    total = [[0.0] * 5 for _ in nodes]
    for combo in itertools.product(range(5), repeat=len(nodes)):
        log = 0.0
        for n, i in where.items():
            if n:
                log += filekinds.COMPATIBLE[combo[where[n[:-1]]]][combo[i]]
            if n in dirs and n:
                kind, strength = filekinds.DIRECTORIES.get(n[-1], (0, 0.0))
                log += strength if combo[i] == kind else 0.0
        for p, e in files:
            log += e[combo[where[tuple(p.split("/"))]]]
        for i, label in enumerate(combo):
            total[i][label] += math.exp(log)
    return {"/".join(n): [x / sum(t) for x in t] for n, t in zip(nodes, total) if n not in dirs}


def test_beliefs_are_exact(spark):
    texts = {"a.py": CODE, "vendor/b.py": CODE.replace("f(", "u("), "gen/c.py": "x = 1", "vendor/d.py": "# nothing"}
    files = [(p, filekinds.evidence(p, t)[0]) for p, t in texts.items()]
    want = slow_beliefs(files)
    df = spark.createDataFrame([(p, "r", p, t, "") for p, t in texts.items()], SCHEMA)
    got = {r.path: [r[f"p_{n}"] for n in filekinds.LABELS] for r in filekinds.beliefs(df, "id", "repo", "path", "text").collect()}
    for p in texts:
        assert got[p] == pytest.approx(want[p], rel=1e-6, abs=1e-9)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert filekinds.beliefs(empty, "id", "repo", "path", "text").count() == 0
    deep = "/".join("d" * 1 for _ in range(40)) + "/x.py"
    rows = [("a", "r", deep, CODE, ""), ("a", "r", deep, CODE, ""), ("b", None, "x.py", "x" * 200_000, "")]
    assert filekinds.beliefs(spark.createDataFrame(rows, SCHEMA), "id", "repo", "path", "text").count() == 2


def test_trees_in_memory_and_by_levels_agree(spark):
    rng = random.Random(3)
    rows = []
    for repo in ("r", "s", None):
        for _ in range(12):
            path = "/".join(rng.choice(["src", "vendor", "gen", "a", "b", ""]) for _ in range(rng.randrange(6))).strip("/")
            rows.append((repo, path, *[rng.uniform(-9, 0) for _ in range(5)]))
    schema = "repository_id string, parent string, m0 double, m1 double, m2 double, m3 double, m4 double"
    said = spark.createDataFrame({r[:2]: r for r in rows}.values(), schema)
    memory = {r[:2]: r[2:] for r in map(tuple, filekinds._directories(said).collect())}
    levels = {r[:2]: r[2:] for r in map(tuple, filekinds._directories(said, most=1).collect())}
    assert len(memory) == said.count()
    for key, belief in memory.items():
        assert levels[key] == pytest.approx(belief, rel=1e-9)
