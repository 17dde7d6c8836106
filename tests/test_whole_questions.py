"""Questions of several words are searched for as they are asked."""

import os

import pytest
from pyspark.sql import functions as F

from strataloom.operators import search
from strataloom.plans import core

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_questions_are_searched_whole(spark, monkeypatch):
    asked = {}
    keep = lambda name, at: lambda *a, **k: asked.__setitem__(name, {r.question for r in a[at].collect()})
    with monkeypatch.context() as m:
        m.setattr(search, "reranked", keep("flagship", 1))
        m.setattr(core.evaluation, "by_mode", keep("modes", 1))
        m.setattr(core.graph, "expand", lambda *a: spark.range(0).selectExpr("id AS query_id", "id AS position"))
        core.flagship(spark, FOLDER)
        core.eval_modes(spark, FOLDER)
    given = spark.read.parquet(f"{FOLDER}/search_queries.parquet")
    assert asked["flagship"] == {r.question for r in given.collect()}
    stated = {r.question for r in given.where("query_id % 20 = 0").collect()}
    assert asked["modes"] >= stated and len(asked["modes"] - stated) <= len(stated)


def test_every_tier_of_a_question_of_several_words(spark):
    asked = "Load Config"
    rows = [("Load Config", "p", "c", 9), ("load config", "p", "c", 8), ("a Load Config", "p", "c", 7), ("a load config", "p", "c", 6), (None, "Load Config.md", "c", 5), (None, "load config.md", "c", 4)]
    rows += [(None, "p", "a Load Config", 3), (None, "p", "a load config", 2), ("config", "p", "we load", 1), (None, "p", "the config", 0), (None, "load", "c", 0)]
    df = spark.createDataFrame(rows, "symbol_name string, path string, content string, want int")
    got = df.select("want", search.lexical_score(F.lit(asked)).alias("got"), search.overlap_score(F.lit(asked), F.col("content")).alias("share")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert {r.share for r in got} == {0.0, 0.5, 1.0}
