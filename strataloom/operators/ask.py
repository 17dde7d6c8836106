"""Questions to answers with citations: search, expansion, packing, a model, citations, previews, in one plan.

Any number of questions goes through at once. The model is called once per question that has evidence, on the
executors; a question whose call fails gets an outcome instead of an answer, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..providers import AnswerProvider, ProviderResponseError, ProviderTimeout, ProviderUnavailable
from ..session import durable
from . import context, graph, search

MOST_QUESTION = 2_000
#: Outcomes of a question and the HTTP status that stands for each.
STATUS = {"answered": 200, "not_found": 404, "bad_question": 422, "response_error": 502, "error": 502, "unavailable": 503, "timeout": 504}


def chat(make: Callable[[], AnswerProvider]) -> Callable[[Column], Column]:
    """A column of (outcome, answer) from a column of messages; the model is made once per Python worker."""

    @F.pandas_udf("outcome string, answer string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in parts:
            rows = []
            for sent in batch:
                if sent is None:
                    rows.append((None, None))
                    continue
                try:
                    said = provider.chat([(m["role"], m["content"]) for m in sent])
                    rows.append(("answered", said) if isinstance(said, str) and said.strip() else ("response_error", None))
                except ProviderTimeout:
                    rows.append(("timeout", None))
                except ProviderUnavailable:
                    rows.append(("unavailable", None))
                except ProviderResponseError:
                    rows.append(("response_error", None))
                except Exception:  # noqa: BLE001 - one failed call must not end the others
                    rows.append(("error", None))
            yield pd.DataFrame(rows, columns=["outcome", "answer"])

    return run


def evidence_of(direct: DataFrame, units: DataFrame, repositories: DataFrame) -> DataFrame:
    """Results (query_id, code_unit_id, position) as evidence, with the whole stored contents."""
    slim = direct.select("query_id", "code_unit_id", F.col("position").alias("idx"))
    names = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repository_name"))
    full = slim.join(units, "code_unit_id").join(names, "repository_id")
    return full.select("query_id", "idx", "repository_name", "path", "symbol_name", "start_line", "end_line", "content")


def ask(
    questions: DataFrame,
    repositories: DataFrame,
    units: DataFrame,
    edges: DataFrame,
    make: Callable[[], AnswerProvider],
    limit: int = 10,
    score=search.overlap_score,
    budget: int = context.BUDGET,
    width: int | None = None,
) -> DataFrame:
    """(query_id, outcome, status, answer, included, truncated, citations), one row per question.

    ``questions``: (query_id, repository_id, question, query_vector). A blank or too long question is refused, one to an
    unknown repository is not found; without evidence the fixed sentence is the answer and no model is called.
    ``citations`` are (evidence_id, repository_name, path, symbol_name, start_line, end_line, source_preview,
    source_preview_truncated) in the order of the answer, each id once, of blocks that were in the prompt.
    """
    length = F.length("question")
    sound = F.coalesce(length.between(1, MOST_QUESTION) & (F.trim("question") != ""), F.lit(False))
    known = repositories.select(F.col("id").alias("repository_id"), F.lit(True).alias("known")).distinct()
    asked = questions.join(known, "repository_id", "left")
    asked = asked.withColumn("refused", F.when(~sound, "bad_question").when(F.col("known").isNull(), "not_found"))
    good = asked.where(F.col("refused").isNull())
    direct = search.reranked(units, good, limit, width=width, score=score)
    evidence = durable(evidence_of(graph.expand(direct, edges, units, limit), units, repositories))
    packed = context.assemble(evidence, budget)
    full = asked.select("query_id", "question", "refused").join(packed, "query_id", "left")
    full = full.select(
        "query_id", "question", "refused", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("included", F.lit(0)).alias("included"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
    sent = F.when(F.col("refused").isNull() & (F.col("text") != ""), context.messages(F.col("question"), F.col("text"), F.col("included"), F.col("truncated")))
    replied = full.withColumn("r", chat(make)(sent))
    outcome = F.coalesce("refused", "r.outcome", F.lit("answered"))
    empty = F.col("refused").isNull() & (F.col("text") == "")
    answers = durable(replied.select(
        "query_id", outcome.alias("outcome"), "included", "truncated",
        F.when(empty, context.INSUFFICIENT).otherwise(F.col("r.answer")).alias("answer"),
    ))  # fmt: skip  # the model is called once, though what it says is read twice
    cited = context.citations(answers.where("answer is not null")).withColumnRenamed("evidence_id", "idx")
    preview = text.preview(F.col("content"))
    shown = cited.join(evidence, ["query_id", "idx"]).select(
        "query_id", "citation_order", F.col("idx").cast("long").alias("evidence_id"), "repository_name", "path", "symbol_name", "start_line", "end_line",
        preview.alias("source_preview"), (F.length(preview) < F.length("content")).alias("source_preview_truncated"),
    )
    listed = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in shown.columns if c != "query_id"]))).alias("c"))
    citations = F.transform("c", lambda x: x.dropFields("citation_order"))
    status = F.create_map(*[F.lit(v) for pair in STATUS.items() for v in pair])[F.col("outcome")]
    none = F.from_json(F.lit("[]"), "array<struct<evidence_id:bigint,repository_name:string,path:string,symbol_name:string,start_line:int,end_line:int,source_preview:string,source_preview_truncated:boolean>>")
    return answers.join(listed, "query_id", "left").select(
        "query_id", "outcome", status.alias("status"), "answer", "included", "truncated", F.coalesce(citations, none).alias("citations")
    )
