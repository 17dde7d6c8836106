"""What the plans must look like: pruned scans, pushed filters, early limits, no Python where none is needed."""

import os

import pytest

from strataloom.plans import core

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def plan(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return core.QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(mode)


def test_literal_filters_reach_the_scan(spark):
    text = plan(spark, "filter_path_literal")
    assert "StringContains(path,src/)" in text and "content" not in text and "embedding" not in text


@pytest.mark.parametrize("name", ["overview_counts", "overview_by_kind", "impact_file", "impact_symbol", "summary_conditional_counts"])
def test_metadata_queries_read_no_content(spark, name):
    schemas = [line for line in plan(spark, name).splitlines() if "ReadSchema" in line]
    assert schemas and not any("content:" in s or "embedding" in s for s in schemas)


@pytest.mark.parametrize("name", ["lexical_top10", "semantic_top10", "hybrid_rrf", "impact_symbol"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["lexical_top10", "semantic_top10", "chunk_fixed", "context_pack", "snapshot_classify", "p4_found", "counter_rate_5m"])
def test_no_python_in_relational_queries(spark, name):
    text = plan(spark, name)
    assert not any(word in text for word in ("ArrowEvalPython", "MapInArrow", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
