"""Documentation and configuration as units: sections and fixed-width chunks, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

CHUNK = 2_000


def fixed(df: DataFrame, content: str = "content", size: int = CHUNK, carry: list[str] | None = None) -> DataFrame:
    """Slices of at most ``size`` characters with their lines: (carry..., chunk_no, chunk, start_line, end_line).

    The slices concatenate to the content; a blank one gives none. A slice may split a line; the line of its first
    and of its last character are its range. Null contents give no rows.
    """
    keep = carry or [c for c in df.columns if c != content]
    body = F.col(content)
    rows = df.where(body.isNotNull()).select(*keep, body.alias("_c"), F.explode(text.chunk_starts(body, size)).alias("chunk_no"))
    rows = rows.withColumn("chunk", text.chunk(F.col("_c"), F.col("chunk_no"), size))
    start = text.lines_before(F.col("_c"), F.col("chunk_no") * size)
    # a slice may begin inside a CRLF: its line feed still belongs to the line before
    torn = F.startswith("chunk", F.lit("\n")) & (F.col("chunk_no") > 0) & (F.substring(F.col("_c"), F.col("chunk_no") * size, F.lit(1)) == "\r")
    start = start - F.coalesce(torn, F.lit(False)).cast("int")
    # the last character's line: its own line end does not begin the next
    inside = F.substring(F.col("chunk"), F.lit(1), F.length("chunk") - 1)
    pair = F.endswith(F.col("chunk"), F.lit("\r\n"))
    inside = F.when(pair, F.substring(F.col("chunk"), F.lit(1), F.length("chunk") - 2)).otherwise(inside)
    end = F.col("start_line") + F.regexp_count(inside, F.lit(text.LINE_END))
    return rows.withColumn("start_line", start).withColumn("end_line", end).drop("_c")


def _fence_open(line: Column) -> Column:
    """The run of marks that opens a fence on a line, or an empty string; backtick fences take no backtick after."""
    ticks = F.regexp_extract(line, r"^ {0,3}(`{3,})[^`]*$", 1)
    return F.when(ticks != "", ticks).otherwise(F.regexp_extract(line, r"^ {0,3}(~{3,}).*$", 1))


def _fold(lines: Column) -> Column:
    """Per line whether it is a heading outside fences, by one pass with the open fence as state."""
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<boolean>").alias("heads"))

    def step(state: Column, line: Column) -> Column:
        fence = state["fence"]
        inside = fence != ""
        closing = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})[ \t]*$", 1)
        closes = inside & (closing != "") & (F.substring(closing, 1, 1) == F.substring(fence, 1, 1)) & (F.length(closing) >= F.length(fence))
        opened = _fence_open(line)
        after = F.when(closes, F.lit("")).when(inside, fence).otherwise(opened)
        head = ~inside & (opened == "") & (text.heading_level(line) > 0)
        return F.struct(after.alias("fence"), F.concat(state["heads"], F.array(head)).alias("heads"))

    return F.aggregate(lines, start, step, lambda state: state["heads"])


def markdown_sections(df: DataFrame, content: str = "content", carry: list[str] | None = None) -> DataFrame:
    """Flat sections of Markdown: (carry..., section_no, symbol_name, start_line, end_line, section).

    A section begins at a heading outside fences and ends before the next; what precedes the first heading is a
    section without a name. Blank sections are dropped. Section texts are exact slices, with their line ends. The heading
    of a section names it; an empty heading is null.
    """
    keep = carry or [c for c in df.columns if c != content]
    rows = df.where(F.col(content).isNotNull()).select(*keep, text.lines(F.col(content)).alias("_l"), text.whole_lines(F.col(content)).alias("_k"))
    rows = rows.where(F.size("_l") > 0).withColumn("_h", _fold(F.col("_l")))
    numbers = F.sequence(F.lit(1), F.greatest(F.size("_l"), F.lit(1)))
    starts = F.array_union(F.array(F.lit(1)), F.filter(numbers, lambda i: F.get(F.col("_h"), i - 1)))
    rows = rows.withColumn("_s", starts).select("*", F.posexplode("_s").alias("section_no", "start_line"))
    end = F.coalesce(F.get(F.col("_s"), F.col("section_no") + 1) - 1, F.size("_l"))
    rows = rows.withColumn("end_line", end)
    body = F.slice("_k", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    first = F.get(F.col("_l"), F.col("start_line") - 1)
    name = F.when(F.get(F.col("_h"), F.col("start_line") - 1), text.heading_text(first))
    rows = rows.withColumn("section", F.array_join(body, "")).withColumn("symbol_name", name)
    return rows.where(text.has_content(F.col("section"))).select(
        *keep, "section_no", "symbol_name", "start_line", "end_line", "section"
    )
