"""Chunks, sections, lines and previews against plain Python."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import chunks

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def slow_lines(content, start, end):
    """Line of the first and the last character, by the line ends of str.splitlines."""
    at, out = 0, []
    for number, line in enumerate(content.splitlines(keepends=True), 1):
        for pos in (start, end - 1):
            if at <= pos < at + len(line):
                out.append(number)
        at += len(line)
    return tuple(out)


@SETTINGS
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x85\u2028é", max_size=40), min_size=1, max_size=12))
def test_chunks_are_lossless_with_exact_lines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    rows = chunks.fixed(df, size=5).orderBy("id", "chunk_no").collect()
    for i, content in enumerate(texts):
        mine = [r for r in rows if r.id == i]
        if not content.strip():
            assert not mine
            continue
        assert "".join(r.chunk for r in mine) == content
        for r in mine:
            a = r.chunk_no * 5
            assert (r.start_line, r.end_line) == slow_lines(content, a, a + len(r.chunk))


def test_lines_split_like_python(spark):
    samples = ["", "a", "a\n", "a\r\nb", "\n\n", "a\u2028b\x1cc", "a\r"]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select(text.lines(F.col("s")).alias("l")).collect()
    assert [r.l for r in got] == [s.splitlines() for s in samples]


def test_markdown_sections_and_fences(spark):
    doc = "intro\n# One #\ntext\n```py\n# no heading\n```\n## Two C#\n~~~\n# still code\n```\n~~~~\n####### seven\n#\nlast"
    rows = chunks.markdown_sections(spark.createDataFrame([(1, doc)], "id int, content string")).orderBy("section_no").collect()
    assert [(r.symbol_name, r.start_line, r.end_line) for r in rows] == [(None, 1, 1), ("One", 2, 6), ("Two C#", 7, 12), (None, 13, 14)]
    assert "".join(r.section for r in rows) == doc
    mixed = "# A\r\nx\r\r\n# B\x0by\u2028\x85z\n\n"
    rows = chunks.markdown_sections(spark.createDataFrame([(1, mixed)], "id int, content string")).orderBy("section_no").collect()
    assert [r.section for r in rows] == ["# A\r\nx\r\r\n", "# B\x0by\u2028\x85z\n\n"] and [r.end_line for r in rows] == [3, len(mixed.splitlines())]
    blank = chunks.markdown_sections(spark.createDataFrame([(1, " \n"), (2, ""), (3, None)], "id int, content string"))
    assert blank.count() == 0


def test_unclosed_fence_runs_to_the_end(spark):
    rows = chunks.markdown_sections(spark.createDataFrame([(1, "# A\n````\n# B\n```\n# C")], "id int, content string")).collect()
    assert [(r.symbol_name, r.end_line) for r in rows] == [("A", 5)]


def test_preview_limits(spark):
    samples = ["x" * 5000, "a\n" * 150, "short", "b\n" * 99 + "c" * 10]
    got = spark.createDataFrame([(s,) for s in samples], "s string").select(text.preview(F.col("s")).alias("p")).collect()
    for s, r in zip(samples, got):
        head = s[:4000]
        cut = "".join(head.split("\n")[i] + "\n" for i in range(100)) if head.count("\n") >= 100 else head
        assert r.p == cut


def test_tokens_and_full_text_match(spark):
    row = spark.createDataFrame([("Größe_1 größe naïve-Test",)], "s string").select(text.tokens(F.col("s")).alias("t"), text.has_all_tokens(F.col("s"), F.lit("TEST naïve")).alias("y"), text.has_all_tokens(F.col("s"), F.lit("--")).alias("n")).head()
    assert row.t == ["größe", "1", "naïve", "test"]
    assert row.y and not row.n


def test_end_lines_count_line_feeds_only(spark):
    samples = [("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r\n", 2), ("a\rb", 1)]
    got = spark.createDataFrame(samples, "s string, want int").select("want", text.inclusive_end_line(F.lit(1), F.col("s")).alias("e")).collect()
    assert all(r.e == r.want for r in got)
    assert re.split(r"\r\n|\n", "a\r\nb") == ["a", "b"]
