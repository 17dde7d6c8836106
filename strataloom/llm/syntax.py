"""Source files that do not parse.

Every file is parsed against its own grammar and, where that refuses it, against all other supported grammars, in an
order that a count of telling tokens suggests. A file that its own grammar accepts is valid. One that only foreign grammars accept has the wrong extension; one that none
accepts is corrupt, and where its own parser stopped tells how.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parsers import ecma
from ..session import spread

#: Verdicts that say a file is at fault.
FAULTY = ("wrong_extension", "corrupt")
GRAMMARS = ("python", "javascript", "jsx", "typescript", "json")

#: Tokens that tell languages apart, and how much each counts.
_TELLING: dict[str, list[tuple[re.Pattern, float]]] = {
    "python": [
        (re.compile(r"(?m)^\s*(?:async )?def \w+\(.*|^\s*(?:elif|except|from|import|with|class) .*:?\s*$"), 1.0),
        (re.compile(r"(?m):\s*$|^\s*#|\bself\.|\bNone\b|\bTrue\b|\bFalse\b"), 0.5),
    ],
    "javascript": [
        (re.compile(r"\b(?:const|let|var|function)\b|=>|===|!==|\bnew [A-Z]"), 1.0),
        (re.compile(r"(?m);\s*$|^\s*//|^\s*\*"), 0.5),
    ],
    "jsx": [(re.compile(r"</\w+>|/>|return\s*\(?\s*<\w"), 2.0)],
    "typescript": [
        (re.compile(r"\b(?:interface|readonly|implements|enum|namespace)\b|:\s*(?:string|number|boolean|void|any)\b|\bas \w+"), 1.5),
        (re.compile(r"\b(?:const|let|function)\b|=>"), 0.6),
    ],
    "json": [(re.compile(r"(?m)^\s*\"[^\"\n]*\"\s*:|^\s*[\[{\]}],?\s*$"), 1.0)],
}


def ranking(text: str) -> list[str]:
    """The grammars, likeliest first; ties keep the order of GRAMMARS."""
    scores = {
        g: sum(weight * len(p.findall(text)) for p, weight in _TELLING[g]) for g in GRAMMARS
    }
    scores["jsx"] += scores["javascript"] * 0.9 if scores["jsx"] else 0
    return sorted(GRAMMARS, key=lambda g: -scores[g])


def _no_constant(name: str):
    raise ValueError(name)


_JSON_TOKEN = re.compile(
    r"[ \t\n\r]*(?:(?P<mark>[\[\]{},:])|(?P<text>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")"
    r"|(?P<value>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)


def _deep_json(text: str) -> None:
    """Strict JSON of any depth: raises ValueError where the text leaves the grammar."""
    open_: list[str] = []
    state, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unexpected character at {at}")
        kind = m.group("mark") or ("text" if m.group("text") else "value")
        if state in ("value", "first value") and kind in ("text", "value"):
            state = "after"
        elif state in ("value", "first value") and kind in "[{" and kind:
            open_.append(kind)
            state = "first value" if kind == "[" else "first key"
        elif state in ("key", "first key") and kind == "text":
            state = "colon"
        elif state == "colon" and kind == ":":
            state = "value"
        elif state == "after" and kind == "," and open_:
            state = "value" if open_[-1] == "[" else "key"
        elif kind == "]" and open_ and open_[-1] == "[" and state in ("after", "first value"):
            open_.pop()
            state = "after"
        elif kind == "}" and open_ and open_[-1] == "{" and state in ("after", "first key"):
            open_.pop()
            state = "after"
        else:
            raise ValueError(f"unexpected {kind} at {m.end()}")
        at = m.end()
    if state != "after" or open_:
        raise ValueError("the text does not end")


#: What is said of a text that is nested deeper than a parser goes: it is not known to be at fault.
DEEP = "nested too deeply"


def fault(text: str, grammar: str) -> str | None:
    """Why a text does not follow a grammar, or None if it does; DEEP where that cannot be told."""
    try:
        if grammar == "python":
            try:
                source = text.encode("utf-8")
            except UnicodeEncodeError:
                return "a lone surrogate"
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(source)
        elif grammar == "json":
            try:
                json.loads(text, parse_constant=_no_constant)
            except RecursionError:
                _deep_json(text)
        else:
            ecma.parse(text, jsx=grammar == "jsx", types=grammar == "typescript")
    except ecma.TooDeep:
        return DEEP
    except ecma.SyntaxFault as e:
        return str(e)
    except (SyntaxError, ValueError) as e:
        where = getattr(e, "lineno", None)
        return f"{getattr(e, 'msg', str(e))}" + (f" at line {where}" if where else "")
    except (RecursionError, MemoryError):
        return DEEP
    return None


def declared(language: str | None, path: str | None) -> str | None:
    """The grammar a file must follow by its language and suffix; None if it is of no supported kind."""
    suffix = re.search(r"\.\w+$", (path or "").lower())
    suffix = suffix.group() if suffix else ""
    if suffix == ".json":
        return "json"
    if language is None:
        language = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript"}.get(suffix)
    if language == "javascript":
        return "jsx" if suffix == ".jsx" else "javascript"
    if language == "typescript":
        return "typescript" if suffix not in (".js", ".jsx") else "javascript"
    return language if language == "python" else None


_CONFLICT = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)")


def judge(text: str | None, language: str | None, path: str | None, every: bool = False) -> tuple[str, list[str], str, str | None] | None:
    """(own grammar, grammars that accept, verdict, reason) of a file of a supported kind.

    The grammars are tried in the order of the ranking, the own one first, until the verdict is certain: a text that its
    own grammar accepts is valid whatever else accepts it, and one foreign grammar that accepts makes the extension
    wrong. With ``every`` all are tried, so that all that accept are known; the verdict is the same.
    """
    own = declared(language, path)
    if own is None:
        return None
    text = text or ""
    reasons = {own: fault(text, own)}
    if every or reasons[own] is not None:
        for g in ranking(text):
            if g not in reasons:
                reasons[g] = fault(text, g)
                if reasons[g] is None and not every:
                    break
    accepted = [g for g, why in reasons.items() if why is None]
    if own in accepted:
        return own, accepted, "valid", None
    if reasons[own] == DEEP:
        return own, accepted, "undecided", DEEP
    if accepted:
        return own, accepted, "wrong_extension", f"reads as {accepted[0]}"
    if _CONFLICT.search(text):
        return own, accepted, "corrupt", "merge conflict"
    why = reasons[own] or ""
    at = re.search(r"at (\d+)$", why)
    ended = "does not end" in why or at and int(at.group(1)) >= len(text.rstrip()) - 1
    if own == "python":
        ended = bool(re.search(r"never closed|unterminated|unexpected EOF|expected an indented block", why))
    return own, accepted, "corrupt", f"truncated: {why}" if ended else why


_OUT = "file_id string, repository_id string, language string, path string, grammar string, accepted array<string>, verdict string, reason string"


def _run(batches, every: bool):
    for batch in batches:
        rows = []
        for item, repo, language, path, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = judge(text, language, path, every)
            if found:
                rows.append((item, repo, language, path, *found))
        columns = list(zip(*rows)) if rows else [[]] * 8
        types = [pa.string()] * 5 + [pa.list_(pa.string())] + [pa.string()] * 2
        labels = ["file_id", "repository_id", "language", "path", "grammar", "accepted", "verdict", "reason"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=labels)


def check(df: DataFrame, item: str, repository: str, language: str, path: str, text: str, every: bool = False) -> DataFrame:
    """(file_id, repository_id, language, path, grammar, accepted, verdict, reason), one row per row of a supported
    kind: python, javascript, typescript by language or, where that is null, by suffix, and ``.json`` files.

    A null or empty text is valid in every language but JSON. Repeated rows give repeated verdicts; :func:`rates`
    counts them once. Nothing is shuffled; a text of any length is parsed whole. A text nested deeper than a parser goes
    is undecided, not at fault. ``accepted`` has all grammars that accept a text only with ``every``.
    """
    source = df.select(
        *[F.col(c).cast("string").alias(n) for c, n in ((item, "i"), (repository, "r"), (language, "l"), (path, "p"))],
        F.col(text).alias("t"),
    )
    return spread(source).mapInArrow(partial(_run, every=every), _OUT)


def rates(verdicts: DataFrame) -> DataFrame:
    """(repository_id, language, files, invalid, wrong_extension, corrupt, rate) over files, each counted once.

    The language is the one the file was held to. Of differing rows of a file one counts, the same in every run.
    """
    once = verdicts.groupBy("file_id").agg(
        F.min(F.struct("repository_id", "grammar", "verdict")).alias("v")
    ).select("file_id", "v.*")
    bad = F.col("verdict").isin(*FAULTY)
    return once.groupBy("repository_id", F.col("grammar").alias("language")).agg(
        F.count("*").alias("files"),
        F.count_if(bad).alias("invalid"),
        F.count_if(F.col("verdict") == "wrong_extension").alias("wrong_extension"),
        F.count_if(F.col("verdict") == "corrupt").alias("corrupt"),
        F.round(F.count_if(bad) / F.count("*"), 6).alias("rate"),
    )
