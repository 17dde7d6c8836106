"""Credentials embedded in source code.

Detection rules are regexes. From each the trigrams that any match needs are derived; every batch of chunks gets a
trigram index, a rule's postings are intersected, and only the chunks that remain are searched with its regex. What a
regex captures is then judged as a value: placeholders, references and ordinary words are no credentials.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .trigrams import Index, candidates, search_all, terms

_NAME = (
    r"(?P<l>(?:passw(?:or)?d|passphrase|passcode|pwd|[_.-]pw\b|[_.-]pass\b|secret|token|api[_.-]?key"
    r"|(?:access|service|signing|encryption|license|auth|private|master|account|client|session|deploy|webhook)[_.-]?key"
    r"|credential|bearer|service-auth|auth[_.-]?(?:code|string|value))[\w.-]*)"
)
_OPEN = r"(?:\(\s*)?(?:[bruf]{1,2}(?=[\"'`]))?"
_STRING = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"
_STRINGS = rf"(?P<s>{_STRING}(?:\s*\+?\s*{_STRING})*)"

#: How strict the value of a rule is judged: a named value, a value in a place that only holds secrets, any value.
NAMED, PLACE, LOOSE = "named", "place", "loose"

#: Rules: name -> (strictness, pattern). A group v is the value itself, a group s string literals that make it up.
RULES: dict[str, tuple[str, str]] = {
    "named_string": (
        NAMED,
        rf"{_NAME}[\"'`\]]{{0,3}}\s*(?::\s*[\w<>\[\]| ]{{1,30}}\s*=|={{1,3}}|:=|=>|:|,)\s*{_OPEN}{_STRINGS}",
    ),
    "key_argument": (LOOSE, rf"\bkey[\"'`]?\s*[:=]\s*{_OPEN}{_STRINGS}"),
    "fallback": (
        LOOSE,
        rf"(?:environ\.get\(|getenv\(|process\.env[.\[][\w\"'\]]+)\s*(?:{_STRING}\s*,|\|\||\?\?)\s*{_STRINGS}",
    ),
    "named_bare": (NAMED, rf"(?m){_NAME}[\"']?[ \t]*[:=][ \t]*(?P<v>[^\s\"'`#;,(){{}}\[\]<>=][^\s\"'`,;(){{}}\[\]]*)[ \t]*\r?$"),
    "scheme": (PLACE, r"\b(?:bearer|basic)[ \t]+(?P<v>[A-Za-z0-9._~+/:=-]{8,})"),
    "url_login": (PLACE, r"://[^\s/:@\"'`<>]*:(?P<v>[^\s/@\"'`<>]+)@"),
    "hook_address": (PLACE, r"(?P<v>https?://hooks\.[\w.-]+/[\w/-]{16,})"),
    "query_parameter": (PLACE, r"[?&](?:access_token|auth_token|token|key|api_?key|secret|password|sig|signature)=(?P<v>[^\s&\"'`#<>]+)"),
    "curl_login": (PLACE, r"(?:curl\b[^\n]{0,200}?\s-u|--user)[ =]+[^\s:\"'`]+:(?P<v>[^\s\"'`]+)"),
    "password_option": (PLACE, r"--(?:password|passwd|token|api-key|secret)[ =]+[\"']?(?P<v>[^\s\"'`]+)"),
    "header": (PLACE, r"\bx-[a-z-]*(?:key|token|auth|secret)\s*:\s*(?P<v>[^\s\"'`]+)"),
    "login_call": (PLACE, rf"\b(?:login|authenticate|sign_?in)\(\s*{_STRING}\s*,\s*{_STRINGS}"),
    "auth_pair": (PLACE, rf"\bauth\s*=\s*\(\s*{_STRING}\s*,\s*{_STRINGS}"),
    "told": (
        LOOSE,
        r"(?:[ \t]pw|(?<![\w/+\\])(?:passwd|password|pass|key|token|secret|login|credentials?|rotation))(?=[ \t:])"
        r"[^\n\"'`]{0,32}?[ \t](?P<v>[^\s\"'`,;()<>]{8,})",
    ),
    "prefixed": (
        LOOSE,
        r"(?<=[a-z0-9])[_.-](?P<v>[A-Za-z0-9]{16,64})(?![\w/+=-])",
    ),
    "upper_id": (LOOSE, r"(?<![\w/+])(?P<v>[A-Z][A-Z0-9]{19})(?![\w/+=])"),
    "bot": (LOOSE, r"(?<=\d{8}):(?P<v>[A-Za-z0-9_-]{26,})"),
    "signed": (LOOSE, r"(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,})"),
    "private_key": (PLACE, r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?!-----)[\s\S]){40,}(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?)"),
}

_PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|<.*>?|\$.*|%.*|\{\{?.*|#\{.*|your[-_ ].*|.*changeme.*|change[-_]me.*|.*[-_]here|insert[-_].*"
    r"|replace[-_]?.*|not[-_]a[-_].*|dummy.*|fake.*|example.*|sample.*|test(?:ing)?|todo|tbd|none|null|nil|true|false"
    r"|undefined|redacted.*|placeholder.*|masked.*|(?:vault|env|ref|secret|arn|ssm|kms|file|op|sops|gsm|keyring):.*"
    r"|process\.env.*|os\.environ.*|env\..*|secrets?\..*|config\..*|self\..*|this\..*)$"
)
_MASK = re.compile(r"[*x•]{4,}|\.{3}|…")
_WORDS = re.compile(r"[a-z]+(?:[ _./-][a-z]+)*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+(?:[_-][A-Z]+)*")
_CODE = re.compile(r"[a-zA-Z_$][\w$]*(?:\??\.[a-zA-Z_$][\w$]*)+|[a-zA-Z_$][\w$]*\(.*")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_HARMLESS = re.compile(r"(?i)(?:sha(?:1|256|384|512)|md5)[-:]|data:|https?://(?!hooks\.)|-----BEGIN (?:[A-Z]+ )*(?:PUBLIC|CERT)")
#: Names of things that are about a secret without being one.
_ABOUT = re.compile(
    r"(?i)(?:_|-|\.|(?<=[a-z]))(?:ref|refs|field|fields|name|names|path|file|url|uri|type|count|id|ids|len|length|limit|ttl"
    r"|header|label|param|prefix|suffix|env|hash|digest|regex|pattern|policy|store|expiry|hint|prompt)$"
)


def _gibberish(v: str) -> bool:
    """Whether lower-case letters are no word of a language: hardly a vowel, or five consonants in a row."""
    vowels = sum(ch in "aeiou" for ch in v)
    return v.isalpha() and (vowels * 5 <= len(v) or re.search(r"[b-df-hj-np-tv-z]{5}", v) is not None)


def _mixed(v: str) -> bool:
    """Whether a value looks random: letters with digits, or case that no words have."""
    letters = sum(ch.isalpha() for ch in v)
    digits = sum(ch.isdigit() for ch in v)
    return letters >= 2 and digits >= 2 or bool(letters >= 8 and not _WORDS.fullmatch(v))


def _random(part: str) -> bool:
    """Whether a part of a dotted value is no name: long, with digits among its letters or changes of case that names lack."""
    digits = [i for i, ch in enumerate(part.rstrip("0123456789")) if ch.isdigit()]
    return len(part) >= 16 and part.isalnum() or len(part) >= 12 and len(digits) >= 2 and any(ch.isupper() for ch in part)


def is_credential(value: str, how: str) -> bool:
    """Whether the value of a rule of strictness ``how`` would grant access."""
    v = value.strip()
    if how == PLACE and v.startswith(("-----BEGIN", "http")):
        return v.startswith("-----") or any(ch.isdigit() for ch in v.rpartition("/")[2])
    if len(v) < 8 or any(ch.isspace() for ch in v) or _PLACEHOLDER.match(v) or _HARMLESS.match(v) or _UUID.fullmatch(v):
        return False
    if _MASK.search(v) or "${" in v or "{{" in v:
        return False
    if _WORDS.fullmatch(v):
        return how != LOOSE and v.islower() and _gibberish(v)
    if how != PLACE and _CODE.fullmatch(v) and not v.startswith("eyJ") and not any(map(_random, v.split("."))):
        return False
    if v.replace(".", "").replace("-", "").replace(":", "").isdigit():
        return False
    if how == LOOSE:
        digits, upper = sum(c.isdigit() for c in v), sum(c.isupper() for c in v)
        special = sum(not c.isalnum() for c in v)
        return digits >= 1 and (len(v) >= 16 and (digits >= 2 or upper >= 2) or upper >= 1 and special >= 1 and len(v) >= 9 or len(v) >= 10 and digits >= 2)
    return _mixed(v) or any(c.isdigit() for c in v) or bool(re.search(r"[^\w.\-/]", v))


_PASSWORD = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|passcode|pwd|[_.-]pw|[_.-]pass)$")


def is_password(value: str, label: str) -> bool:
    """Whether what a password's own name is set to is one though it does not look random: six characters or more with
    letters and digits, or a passphrase of three plain words or more. A single word of a language is none."""
    v = value.strip()
    if not _PASSWORD.search(label) or _PLACEHOLDER.match(v) or _HARMLESS.match(v) or _MASK.search(v) or "${" in v or "{{" in v:
        return False
    if label.lower().endswith("passphrase") and re.fullmatch(r"[a-z]+(?: [a-z]+){2,}", v):
        return True
    return re.fullmatch(r"(?=\D*\d)(?=[^A-Za-z]*[A-Za-z])[\w!#%&*+.?@^-]{6,7}", v) is not None and not _CODE.fullmatch(v)


@lru_cache(maxsize=1)
def _rules():
    found = search_all({name: p for name, (_, p) in RULES.items()})
    return found, Index(set().union(*(terms(k) for _, k in found.values())))


_LITERAL = re.compile(_STRING)
_LABEL = re.compile(r"[\w.-]*$")
_BEFORE = {
    "prefixed": re.compile(r"(?<![\w./+-])[a-z]{2,4}\d?(?:_live)?[_.-]$"),
    "bot": re.compile(r"(?<![\w:])\d{8,10}:$"),
}


#: Rules whose case matters; the others run on text with letters folded, which has the same length.
_CASED = {"prefixed", "upper_id", "signed", "private_key"}
_UPPER = {i: i + 32 for i in range(65, 91)}


def _spans(name: str, text: str, pattern: re.Pattern) -> Iterator[list[tuple[int, int]]]:
    """The parts of ``text`` that make up each credential a rule finds; the first part is where it begins."""
    how = RULES[name][0]
    for m in pattern.finditer(text if name in _CASED else text.translate(_UPPER)):
        if "s" in pattern.groupindex:
            at = m.start("s")
            parts = [(at + x.start() + 1, at + x.end() - 1) for x in _LITERAL.finditer(m.group("s"))]
            if name == "fallback" or name == "login_call":
                parts = parts[:1]
        else:
            parts = [m.span("v")]
        if name in _BEFORE:  # these are found by their middle; their beginning is looked up
            start = parts[0][0]
            head = _BEFORE[name].search(text[max(0, start - 16) : start])
            if head is None:
                continue
            parts = [(start - len(head.group()), parts[0][1])]
        value, label = "".join(text[a:b] for a, b in parts), ""
        if name in ("named_string", "named_bare"):
            label = _LABEL.search(text[max(0, m.start() - 64) : m.start()]).group() + text[m.start() : m.end("l")]
            if _ABOUT.search(label) or "public" in label.lower():
                continue
        scheme = re.match(r"(?i)(?:bearer|basic|token)\s+", value)
        if scheme and len(parts) == 1:
            parts = [(parts[0][0] + scheme.end(), parts[0][1])]
            value = value[scheme.end() :]
        if "PRIVATE KEY-----" in value:
            continue
        if is_credential(value.rstrip(".") if name == "told" else value, how) or label and is_password(value, label):
            yield parts
        elif len(parts) > 1 and is_credential(text[slice(*parts[0])], how):
            yield parts[:1]


def _private(text: str, pattern: re.Pattern) -> Iterator[list[tuple[int, int]]]:
    for m in pattern.finditer(text):
        body = m.group("v")
        inner = re.sub(r"-----[A-Z ]+-----|\\[nr]|\s|[\"'`+,]", "", body)
        if len(inner) >= 40 and not _MASK.search(inner) and re.search(r"[A-Za-z]\d|\d[A-Za-z]", inner):
            yield [m.span("v")]


def find_in(chunks: list[str]) -> list[list[tuple[str, list[tuple[int, int]]]]]:
    """Per chunk the credentials: (rule, parts), ordered by where they begin; overlapping finds are merged."""
    rules, index = _rules()
    postings = index.postings([x.encode("utf-8", "surrogatepass") for x in chunks])
    found: list[list] = [[] for _ in chunks]
    for name, (pattern, condition) in rules.items():
        for i in candidates(condition, postings, len(chunks)):
            text = chunks[i]
            spans = _private(text, pattern) if name == "private_key" else _spans(name, text, pattern)
            found[i].extend((name, parts) for parts in spans)
    for i, each in enumerate(found):
        each.sort(key=lambda f: (f[1][0][0], -f[1][-1][1]))
        kept: list = []
        for name, parts in each:
            if kept and parts[0][0] < kept[-1][1][-1][1]:
                continue  # inside one that is known
            kept.append((name, parts))
        found[i] = kept
    return found


_LINE_END = re.compile(r"\r\n|\n|\r")


def blank(text: str, found: list[tuple[str, list[tuple[int, int]]]]) -> str:
    """``text`` with the credentials starred out, every line end and all else in place."""
    out, at = [], 0
    for _, parts in found:
        for start, end in parts:
            if start < at:
                continue
            out.append(text[at:start])
            out.append(re.sub(r"[^\r\n]", "*", text[start:end]))
            at = end
    return "".join(out) + text[at:]


_FOUND = "id string, rule string, line_no int, char_start int, char_end int"


def _find(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        rows = []
        for name, text, found in zip(ids, texts, find_in(texts)):
            for rule, parts in found:
                start = parts[0][0]
                rows.append((name, rule, len(_LINE_END.findall(text, 0, start)) + 1, start, parts[-1][1]))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        labels = ["id", "rule", "line_no", "char_start", "char_end"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=labels)


def find(df: DataFrame, item: str, text: str) -> DataFrame:
    """(id, rule, line_no, char_start, char_end): every credential, at the line on which its value begins.

    Lines count from 1; a CRLF is one line end. A null or empty text has none; repeated rows give repeated finds.
    Nothing is shuffled: the index is built per batch of chunks, next to the data.
    """
    source = df.select(F.col(item).cast("string").alias("id"), F.col(text).alias("t"))
    return spread(source).mapInArrow(_find, _FOUND)


def _redact(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        found = find_in([t or "" for t in texts])
        out = [None if t is None else blank(t, f) for t, f in zip(texts, found)]
        counts = [len(f) for f in found]
        arrays = [batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "content", "redacted"])


def redact(df: DataFrame, item: str, text: str) -> DataFrame:
    """(id, content, redacted): every text with its credentials starred out, and how many there were.

    A starred value has as many characters as before, so offsets, quotes and line ends stay; null stays null.
    """
    source = df.select(F.col(item).cast("string").alias("id"), F.col(text).alias("t"))
    return spread(source).mapInArrow(_redact, "id string, content string, redacted int")
