"""Headings of documentation units, whatever ends their first line."""

from strataloom.plans import core


def test_headings_before_any_line_end(spark, tmp_path):
    rows = [("a", "document", "# One\r\ntext"), ("b", "document", "## Two ##\rtext"), ("c", "document", "# Three\ntext"), ("d", "document", "text\r\n# No"), ("e", "document", ""), ("f", "document", None), ("g", "class", "# No\r\n"), ("h", "document", "#\r\n"), ("i", "document", "# Nine")]
    spark.createDataFrame(rows, "id string, kind string, content string").write.parquet(str(tmp_path / "code_units.parquet"))
    got = {r.id: r.heading for r in core.QUERIES["heading_text"](spark, str(tmp_path)).collect()}
    assert got == {"a": "One", "b": "Two", "c": "Three", "h": None, "i": "Nine"}
