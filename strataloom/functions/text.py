"""Expressions over texts: tokens, lines, chunks, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line in documentation and configuration (code counts only line feeds).
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


#: White space as a class of Java regexes: also what only Unicode calls so.
BLANK = r"[\s\x1C-\x1F\x85\p{Z}]"


def has_content(text: Column) -> Column:
    """Whether a text has more than white space."""
    return text.isNotNull() & (F.regexp_replace(text, BLANK, "") != "")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def has_all_tokens(document: Column, query: Column) -> Column:
    """Whether every token of the query occurs in the document; false for a query without tokens."""
    wanted = tokens(query)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(document))) == 0)


def newlines(text: Column) -> Column:
    """Line feeds in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def inclusive_end_line(start_line: Column, content: Column) -> Column:
    """Last line of a slice that begins on ``start_line``; a final line feed ends the line it is on."""
    return start_line + newlines(content) - F.endswith(content, F.lit("\n")).cast("int")


def lines(text: Column) -> Column:
    """The lines of a text without their ends; an end at the very end starts no further line."""
    parts = F.split(text, LINE_END)
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ).otherwise(parts)


def whole_lines(text: Column) -> Column:
    """The lines of a text with their ends: put together they are the text."""
    inner = LINE_END[LINE_END.index("[") + 1 : -1]
    return F.regexp_extract_all(text, F.lit(f"([^{inner}]*+(?:{LINE_END})|[^{inner}]++)"), 1)


def chunk_starts(text: Column, size: int) -> Column:
    """0-based numbers of the fixed-width chunks of a text; none for a blank text."""
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")
    return F.when(has_content(text), F.sequence(F.lit(0), last)).otherwise(
        F.array().cast("array<int>")
    )


def chunk(text: Column, number: Column, size: int) -> Column:
    """Chunk ``number`` (0-based) of a text."""
    return F.substring(text, number * size + 1, F.lit(size))


def lines_before(text: Column, offset: Column) -> Column:
    """1-based line on which the character at the 0-based ``offset`` stands."""
    head = F.substring(text, F.lit(1), offset)
    return F.regexp_count(head, F.lit(LINE_END)) + 1


def heading_level(line: Column) -> Column:
    """Level of a Markdown heading line, 0 if it is none: up to three spaces, 1-6 marks, then space or the end."""
    return F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:\s|$)", 1))


def heading_text(line: Column) -> Column:
    """Text of a heading line; closing marks go only after a space, an empty text is null."""
    body = F.trim(F.regexp_extract(line, r"^ {0,3}#{1,6}(?:\s+(.*))?$", 1))
    closed = F.regexp_replace(body, r"(?:^|[ \t]+)#+$", "")
    return F.nullif(F.trim(closed), F.lit(""))


def status_class(status: Column) -> Column:
    """HTTP status as its class: 503 becomes 5xx; outside 200-599 nothing was completed."""
    return F.when(status.between(200, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise(
        "incomplete"
    )


def preview(content: Column, characters: int = 4000, most_lines: int = 100) -> Column:
    """Beginning of a content: at most so many characters, then at most so many lines."""
    head = F.substring(content, 1, characters)
    full = newlines(head) >= most_lines
    return F.when(full, F.concat(F.substring_index(head, "\n", most_lines), F.lit("\n"))).otherwise(head)
