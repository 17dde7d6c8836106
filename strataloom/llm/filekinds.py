"""Generated, minified or vendored source files, and data saved as code.

Belief propagation over directory trees. Every file has evidence for five labels from its name and text: written by
hand, generated, minified, vendored, data blob. Every directory has a hidden label of what it mostly holds, with
evidence from its name. A table of compatibilities ties the labels of a directory and of what it contains, so that
parents and siblings speak for a file whose own evidence is weak. The tree of a repository has no cycle, hence one
pass of messages up and one down give exact beliefs. The messages of a directory's files are sums, which combine on the
map side however many files there are; what is left, one row a directory, is passed up and down in memory by groups of
repositories, or level by level over all tasks where one repository alone has more directories than a task should hold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
H, G, M, V, B = range(5)
#: Characters without its leading comment that a text needs before an equal one in another repository says anything.
LEAST_BODY = 120
#: Directories of trees that one task passes in memory, at most; some hundred bytes each.
MOST_TOGETHER = 200_000

#: Directory names that say what a directory holds, with the strength in nats.
DIRECTORIES: dict[str, tuple[int, float]] = {
    **dict.fromkeys(
        ("vendor", "vendored", "_vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components")
        + ("site-packages", "dist-packages", "extern", "external", "externals", "deps"),
        (V, 10.0),
    ),
    **dict.fromkeys(("generated", "__generated__", "gen", "autogen", "codegen", "_generated"), (G, 8.0)),
    **dict.fromkeys(("dist", "bundle", "bundles", "minified", "min"), (M, 2.0)),
    **dict.fromkeys(("static", "public", "build"), (M, 0.7)),
    **dict.fromkeys(("data", "assets", "blobs"), (B, 1.0)),
    **dict.fromkeys(("src", "lib", "app", "core", "tests", "test"), (H, 0.7)),
}


def _compatibility() -> list[list[float]]:
    """log P(label of a child | label of its directory). A directory of generated, and more so of vendored files holds
    little else; hand-written files lie beside minified ones and data as often as not."""
    table = []
    for parent, own, by_hand in ((H, 0.955, 0.955), (G, 0.92, 0.05), (M, 0.7, 0.25), (V, 0.97, 0.01), (B, 0.7, 0.25)):
        row = [(1 - own - by_hand * (parent != H)) / (4 if parent == H else 3)] * 5
        row[H], row[parent] = by_hand, own
        table.append([math.log(x / sum(row)) for x in row])
    return table


COMPATIBLE = _compatibility()

_GENERATED = re.compile(
    r"(?i)<auto-?generated\b|@generated\b|\bauto-?generated (?:from|by|file|code|on|using)\b|\bauto-?generated\s*[.;,!-]"
    r"|\bcode generated by\b|\b(?:file|code|module|source) (?:was|is|has been)? ?(?:automatically|auto-?) ?(?:generated|created|produced|built)"
    r"|\b(?:generated|produced|created|built|written) (?:automatically|by the \w+ (?:compiler|generator|tool))|\bgenerated by\b.*\b(?:do not|don't|version|v?\d)"
    r"|\bdo not edit(?:\.|!|$|\s*[-;,]| by hand| manually| this file)|\bchanges will be (?:lost|overwritten)|\bwill be overwritten\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)|\bnicht (?:von hand )?(?:bearbeiten|[äa]ndern)|\bg[ée]n[ée]r[ée] automatiquement|\bne pas modifier"
    r"|\bgenerado autom[áa]ticamente|\bno editar\b|\b(?:built|made|rendered) by make\b|\bedit \S+\.(?:ya?ml|json|proto|idl|toml|xml|graphql|tmpl|j2) instead"
    r"|\b(?:regenerate|re-generate) with\b|\bthe protocol buffer compiler\b"
)
_NOT_THIS = re.compile(r"(?i)\bdo not edit that\b|\breads? the\b|\bstub\b|\bin generated\b|\bkept by hand\b|\bwritten by hand\b|\bhand-?written\b")
_UPSTREAM = re.compile(
    r"(?im)\bupstream\s*:|^[^\w\n]*+(?:\w\S*+ |(?<=\S ))v?\d+\.\d+(?:\.\d+)?\s*\||\((?:c)\)\s*(?:\d{4}\s*)?(?:the )?\S+ (?:contributors|authors)|\b(?:vendored|copied|taken|adapted|imported) from\b"
    r"|\breleased under the (?:mit|apache|bsd|isc|mpl)|\blicensed under the (?:mit|apache|bsd|isc|mozilla)|\bspdx-license-identifier|@license\b"
    r"|\bcopyright (?:\(c\) )?(?:\d{4}[-, \d]* )?the \S+ (?:authors|contributors|developers|project)\b|\ball rights reserved\b"
)
_NAME_GENERATED = re.compile(r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:js|ts|py)|\.g\.(?:ts|js)|\.generated\.\w+|_generated\.\w+|\.gen\.\w+|\.designer\.\w+)$")
_NAME_MINIFIED = re.compile(r"(?i)(?:[.-]min\.js|\.bundle\.js|\.chunk\.js|[.-][0-9a-f]{8}\.js)$")
_NAME_VERSION = re.compile(r"-v?\d+[._]\d+(?:[._]\d+)+\.\w+$")
_COMMENT = re.compile(r"(?s:/\*.*?(?:\*/|\Z))|(?:#|//|<!--)[^\n]*")
_MARKUP_COMMENT = re.compile(r"(?s:<!--.*?(?:-->|\Z))")
_DOCSTRING = re.compile(
    r"(?>[rRuU]?(?s:(?P<q>\"\"\"|''')(?:[^\\]|\\.)*?(?:(?P=q)|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))(?=[^\S\n]*(?:[\n;#]|\Z))"
)
_BLANK = re.compile(r"[\s\ufeff]*")
_CODE = (".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_SHAPE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\d[\w.]*|[A-Za-z_$][\w$]*")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")


def _head(path: str, text: str) -> tuple[str, str]:
    """The comments a file begins with, all of them up to the first code, and the text after them. The docstring of a
    Python module is one of them. A byte order mark, a shebang or blank lines may come first or between."""
    suffix = path.lower()
    end, documented = 0, suffix.endswith(_CODE[2:])
    while True:
        start = _BLANK.match(text, end).end()
        comment = None if suffix.endswith(_CODE) else _MARKUP_COMMENT.match(text, start)
        comment = comment or _COMMENT.match(text, start)
        if not comment and not documented:
            comment, documented = _DOCSTRING.match(text, start), True
        if not comment:
            return text[:end], text[start:]
        end = comment.end()


def evidence(path: str, text: str) -> tuple[list[float], str | None]:
    """(log evidence for the five labels, hash of the text without its leading comment)."""
    score = [0.0] * 5
    name = path.rpartition("/")[2]
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    head, after = _head(path, text)
    rest = [x for x in after.split("\n") if x.strip()] or [x for x in text.split("\n") if x.strip()]
    body = "\n".join(x.rstrip() for x in rest)
    top = [x for x in head.split("\n") if not _NOT_THIS.search(x)]
    if any(_GENERATED.search(x) for x in top):
        score[G] += 9
    if _NAME_GENERATED.search(name):
        score[G] += 5
    if _UPSTREAM.search(head):
        score[V] += 8
    if _NAME_VERSION.search(name):
        score[V] += 4
    size = len(body)
    if size < 24 or not after:
        score[H] += 4
        return score, None
    # minified: long dense lines of short names
    longest, mean = max(map(len, rest)), size / len(rest)
    code = _STRING.sub('""', body)
    spaces = sum(map(code.count, " \n\t")) / max(len(code), 1)
    names = _IDENTIFIER.findall(code)
    ecma = not path.endswith((".py", ".pyi"))
    if ecma and mean > 160 and spaces < 0.12 and len(code) > 400:
        score[M] += 8
    elif ecma and mean > 100 and spaces < 0.16 and len(code) > 400:
        score[M] += 4
    if _NAME_MINIFIED.search(name):
        score[M] += 2 if longest > 200 else 0.5
    # data: literals make up the file and little is done with them
    strings = [len(x) for x in _STRING.findall(body)]
    digits = sum(ch.isdigit() or ch in "., -+eExX" for ch in code) / max(len(code), 1)
    words = len(set(names))
    biggest = max(strings, default=0)
    if size > 1200 and (biggest > 0.7 * size or (sum(strings) > 0.75 * size and words < 24)):
        score[B] += 8
    elif size > 1000 and digits > 0.75 and words < 24:
        score[B] += 8
    shapes = Counter(_SHAPE.sub("x", x.strip()) for x in rest)
    variety = len(shapes) / len(rest)
    common = shapes.most_common(1)[0][1] / len(rest)
    if len(rest) >= 12 and score[B] < 8 and score[M] < 8:
        if common > 0.8 and size > 1200 and re.match(r"\W*x?\W*x", shapes.most_common(1)[0][0]) and words < 40 and _rows(rest):
            score[B] += 6
        elif variety < 0.12 or common > 0.8:
            score[G] += 7
        elif variety < 0.2 and len(rest) >= 24:
            score[G] += 4
        elif variety > 0.35:
            score[H] += 2.5
    elif max(score[G:]) < 4:
        score[H] += 2
    digest = hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if size >= LEAST_BODY else None
    return score, digest


def _rows(lines: list[str]) -> bool:
    """Whether most lines are rows of one literal: they end with a comma and call or assign nothing."""
    rows = sum(x.rstrip().endswith(",") and "(" not in x and not re.match(r"\s*[A-Za-z_]\w*\s*=", x) for x in lines)
    return rows > 0.8 * len(lines)


_EVIDENCE = "file_id string, repository_id string, path string, body string, " + ", ".join(f"e{i} double" for i in range(5))


def _evidence(batches):
    for batch in batches:
        ids, repos, paths, texts = (c.to_pylist() for c in batch.columns)
        rows = []
        for name, repo, path, text in zip(ids, repos, paths, texts):
            path = re.sub(r"^(?:\./+)+|^/+", "", path or "")
            score, digest = evidence(path, text or "")
            rows.append((name, repo, path, digest, *score))
        columns = list(zip(*rows)) if rows else [[]] * 9
        types = [pa.string()] * 4 + [pa.float64()] * 5
        labels = ["file_id", "repository_id", "path", "body"] + [f"e{i}" for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=labels)


def _log_sum(terms: list[Column]) -> Column:
    """log of the sum of exponentials; every term stands once in the expression, so it does not grow when nested."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(a)))
    return F.transform(F.array(F.array(*terms)), lambda a: F.array_max(a) + F.log(total(a)))[0]


def _upward(prefix: str) -> list[Column]:
    """Message of a node to its directory, from its own evidence and what came from below."""
    return [
        _log_sum([F.col(f"{prefix}{child}") + COMPATIBLE[parent][child] for child in range(5)]).alias(f"m{parent}")
        for parent in range(5)
    ]


def _downward(prefix: str) -> list[Column]:
    """Message of a directory to a child: the directory's belief without what the child itself said."""
    return [
        _log_sum([F.col(f"{prefix}{parent}") + COMPATIBLE[parent][child] for parent in range(5)]).alias(f"d{child}")
        for child in range(5)
    ]


def _named(directory: Column, label: int) -> Column:
    """Evidence of the last part of a directory's path for a label."""
    last = F.lower(F.substring_index(directory, "/", -1))
    names = [n for n, (kind, _) in DIRECTORIES.items() if kind == label]
    value = F.lit(0.0)
    for strength in {DIRECTORIES[n][1] for n in names}:
        value = F.when(last.isin([n for n in names if DIRECTORIES[n][1] == strength]), strength).otherwise(value)
    return value


def beliefs(df: DataFrame, item: str, repository: str, path: str, text: str) -> DataFrame:
    """(file_id, repository_id, path, label, p_handwritten, ..., p_blob): one row per file id.

    Rows repeated under one id count once (any of differing ones). A null or empty text is evidence of nothing but a
    hand: there is no tool's work in it. Null paths stand at the root. An empty table gives no rows. Equal texts in
    several repositories are copies of another project, however large such a group is: it is recognised from the
    least and greatest repository of a hash.
    """
    source = df.select(
        F.col(item).cast("string"), F.col(repository).cast("string"), F.col(path).cast("string"), F.col(text)
    )
    files = spread(source).mapInArrow(_evidence, _EVIDENCE).groupBy("file_id").agg(
        F.min_by(F.struct("repository_id", "path", "body", *[f"e{i}" for i in range(5)]), F.struct("path", "body")).alias("f")
    )
    files = durable(files.select("file_id", "f.*"))
    copies = files.where(F.col("body").isNotNull()).groupBy("body").agg(
        (F.min("repository_id") != F.max("repository_id")).alias("copied")
    )
    copies = copies.where("copied").withColumnRenamed("body", "copy")
    # a file without a body looks for its own id, so such files do not fall on one key
    looked = F.coalesce("body", F.concat(F.lit("#"), F.coalesce("file_id", F.lit(""))))
    nodes = (
        files.join(copies, looked == F.col("copy"), "left")
        .withColumn(f"e{V}", F.col(f"e{V}") + F.when(F.coalesce("copied", F.lit(False)), 9.0).otherwise(0.0))
        .withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    )
    leaf = nodes.select("repository_id", "parent", *_upward("e"))
    said = durable(leaf.groupBy("repository_id", "parent").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(5)]))
    heard = nodes.select("file_id", "repository_id", "path", "parent", *[f"e{i}" for i in range(5)], *_upward("e")).join(
        _directories(said), ["repository_id", "parent"], "left"
    )
    own = [f"e{i}" for i in range(5)]
    heard = heard.select(
        "file_id", "repository_id", "path", *own, *[(F.col(f"b{i}") - F.col(f"m{i}")).alias(f"v{i}") for i in range(5)]
    )
    return heard.mapInArrow(_posterior, _BELIEFS)


_TREE = "repository_id string, parent string, " + ", ".join(f"b{i} double" for i in range(5))


def _directories(said: DataFrame, most: int = MOST_TOGETHER) -> DataFrame:
    """(repository_id, parent, b0..b4): what the whole tree says of every directory that has files.

    ``said``: (repository_id, parent, m0..m4), the sums of the messages of the files in a directory. Trees are put
    together by repository into groups of bounded size, each of which one task passes up and down in memory. The tree of
    a repository with more than ``most`` directories is passed level by level over all tasks; both give the same.
    """
    sizes = said.groupBy("repository_id").agg(F.count("*").alias("n"))
    facts = sizes.agg(F.sum("n").alias("all"), F.max("n").alias("largest")).head()
    if not facts["all"]:
        return said.select("repository_id", "parent", *[F.col(f"m{i}").alias(f"b{i}") for i in range(5)])
    small, large = said, None
    if facts["largest"] > most:
        hot = sizes.where(F.col("n") > most).select(F.col("repository_id").alias("hot_id"))
        same = F.col("repository_id").eqNullSafe(F.col("hot_id"))
        small, large = said.join(hot, same, "left_anti"), said.join(hot, same, "left_semi")
    groups = int(max(1, math.ceil(2 * facts["all"] / most)))
    group = F.pmod(F.xxhash64("repository_id"), F.lit(groups))
    together = small.withColumn("g", group).groupBy("g").applyInPandas(lambda pdf: _pass_tree(pdf), _TREE)
    return together if large is None else together.unionByName(_by_levels(large))


def _pass_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact beliefs of the directories of whole trees: messages up, level by level, and down again."""
    place: dict[tuple[str | None, str], int] = {}
    keys: list[tuple[str | None, str]] = []
    above: list[int] = []

    def at(repository: str | None, path: str) -> int:
        todo = []
        while (repository, path) not in place:
            todo.append(path)
            if not path:
                break
            path = path.rpartition("/")[0]
        for p in reversed(todo):
            place[repository, p] = len(keys)
            keys.append((repository, p))
            above.append(place[repository, p.rpartition("/")[0]] if p else -1)
        return place[repository, todo[0] if todo else path]

    rows = np.array([at(r, p) for r, p in zip(pdf["repository_id"], pdf["parent"])], dtype=np.int64)
    over = np.array(above, dtype=np.int64)
    depth = np.zeros(len(keys), dtype=np.int64)
    for i, parent in enumerate(above):  # an ancestor always stands before what is below it
        depth[i] = depth[parent] + 1 if parent >= 0 else 0
    belief = np.zeros((len(keys), 5))
    np.add.at(belief, rows, pdf[[f"m{i}" for i in range(5)]].to_numpy(dtype=float))
    for i, (_, path) in enumerate(keys):
        label, strength = DIRECTORIES.get(path.rpartition("/")[2].lower(), (0, 0.0))
        belief[i, label] += strength
    table = np.array(COMPATIBLE)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    levels = [order[cuts[d] : cuts[d + 1]] for d in range(depth.max() + 1)]
    up = np.zeros_like(belief)
    for here in reversed(levels[1:]):
        up[here] = _soft(belief[here], table.T)
        np.add.at(belief, over[here], up[here])
    for here in levels[1:]:
        belief[here] += _soft(belief[over[here]] - up[here], table)
    out = pdf[["repository_id", "parent"]].reset_index(drop=True)
    return out.assign(**{f"b{i}": belief[rows, i] for i in range(5)})


def _soft(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log sum exp of each row of ``x`` with the columns of a table of logarithms."""
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top) @ np.exp(table)) + top


def _by_levels(said: DataFrame) -> DataFrame:
    """The same as :func:`_pass_tree` for trees of any size: one aggregation and one join a level."""
    up_of = F.regexp_replace("parent", "/?[^/]*$", "")
    depth = F.when(F.col("parent") == "", 0).otherwise(F.length("parent") - F.length(F.replace("parent", F.lit("/"), F.lit(""))) + 1)
    said = durable(said.withColumn("level", depth))
    deepest = said.agg(F.max("level")).head()[0] or 0
    levels: list[DataFrame] = []
    below: DataFrame | None = None
    for level in range(deepest, -1, -1):
        here = said.where(F.col("level") == level).drop("level")
        if below is not None:
            here = here.unionByName(below)
        here = here.groupBy("repository_id", "parent").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(5)])
        here = here.select(
            "repository_id", "parent", *[(F.col(f"m{i}") + _named(F.col("parent"), i)).alias(f"b{i}") for i in range(5)]
        )
        here = durable(here)  # else the plan of a level would hold those of all levels below it
        levels.append(here)
        if level:
            below = here.select("repository_id", up_of.alias("parent"), *_upward("b"))
    levels.reverse()
    full = [levels[0]]
    for level in range(1, deepest + 1):
        child = levels[level]
        child = child.select("repository_id", "parent", up_of.alias("up"), *[F.col(f"b{i}").alias(f"c{i}") for i in range(5)])
        over = full[-1].select(F.col("repository_id").alias("r"), F.col("parent").alias("p"), *[F.col(f"b{i}").alias(f"a{i}") for i in range(5)])
        joined = child.join(over, F.col("repository_id").eqNullSafe(F.col("r")) & (F.col("up") == F.col("p")))
        own = joined.select("*", *_upward("c")).select("*", *[(F.col(f"a{i}") - F.col(f"m{i}")).alias(f"v{i}") for i in range(5)])
        told = own.select("repository_id", "parent", *[f"c{i}" for i in range(5)], *_downward("v"))
        full.append(durable(told.select("repository_id", "parent", *[(F.col(f"c{i}") + F.col(f"d{i}")).alias(f"b{i}") for i in range(5)])))
    return reduce(DataFrame.unionByName, full)


_BELIEFS = "file_id string, repository_id string, path string, label string, " + ", ".join(f"p_{n} double" for n in LABELS)


def _posterior(batches):
    """Beliefs of files: their evidence with what the directory says to each label."""
    table = np.array(COMPATIBLE)
    for batch in batches:
        e = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1)
        v = np.stack([batch.column(8 + i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1).astype(float)
        v = np.nan_to_num(v)  # a file whose directory is unknown hears nothing
        top = v.max(axis=1, initial=0.0, keepdims=True)
        heard = np.log(np.exp(v - top) @ np.exp(table)) + top
        belief = e + heard
        p = np.exp(belief - belief.max(axis=1, initial=-np.inf, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        label = [LABELS[i] for i in p.argmax(axis=1)] if len(p) else []
        arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(label, pa.string())]
        arrays += [pa.array(p[:, i]) for i in range(5)]
        names = ["file_id", "repository_id", "path", "label", *[f"p_{n}" for n in LABELS]]
        yield pa.RecordBatch.from_arrays(arrays, names=names)
