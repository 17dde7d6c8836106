"""Memo table of search results, keyed by repository, generation and request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS, MAX_BYTES = 300, 512 * 1024


def request(question: Column, limit: Column, model: str, width: int, operation: str = "semantic_search") -> Column:
    """A request as JSON with sorted keys and no spaces."""
    fields = F.struct(
        F.lit(width).alias("embedding_dimension"), F.lit(model).alias("embedding_model"), limit.alias("limit"),
        F.lit(operation).alias("operation"), question.alias("q"),
    )
    return F.to_json(fields)


def key(repository_id: Column, generation: Column, asked: Column, version: str = "v1") -> Column:
    """The key of a request against one generation of a repository."""
    return F.concat(
        F.lit(f"strataloom:{version}:repo:"), repository_id, F.lit(":snapshot:"), generation.cast("string"),
        F.lit(":search:"), F.sha2(asked, 256),
    )


def hits(cache: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Cached payloads that are valid for a request: (query_id, payload).

    ``cache``: (key, repository_id, generation, payload, created_at); ``requests``: (query_id, key, repository_id,
    generation). Anything too old, too large, not JSON, or of another generation is a miss.
    """
    young = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) < TTL_SECONDS * 1_000_000
    fit = F.octet_length("payload") <= MAX_BYTES
    readable = F.try_parse_json("payload").isNotNull()
    good = cache.where(young & fit & readable)
    newest = good.groupBy("key", "repository_id", "generation").agg(F.max_by("payload", "created_at").alias("payload"))
    return requests.join(newest, ["key", "repository_id", "generation"]).select("query_id", "payload")


def storable(results: DataFrame) -> DataFrame:
    """Rows to cache: payloads within the size limit whose generation is still the current one.

    ``results``: (key, repository_id, generation, current_generation, payload).
    """
    return results.where((F.octet_length("payload") <= MAX_BYTES) & (F.col("generation") == F.col("current_generation")))


#: The form of a cached response; all but the symbol must be there.
ITEM = (
    "code_unit_id string, file_id string, path string, kind string, content string, language string, start_line int, end_line int, "
    "symbol_name string, cosine_distance double"
)
RESPONSE = f"items array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>, limit int"


def envelope(key_: Column, response: Column, version: str = "v1") -> Column:
    """A response as it is stored: with the version of its form and the key it belongs to."""
    return F.to_json(F.struct(key_.alias("key"), response.alias("response"), F.lit(version).alias("schema")), {"ignoreNullFields": "false"})


def responses(found: DataFrame, requests: DataFrame, version: str = "v1") -> DataFrame:
    """(query_id, response) of cached payloads (query_id, payload) that are what the request asked for; all else is a
    miss.

    ``requests``: (query_id, key, limit). An envelope has exactly its three parts, the version and the key of the
    request. Its response has exactly items and limit, the limit that was asked for, and at most so many items, with
    different ids, finite distances, lines in order, and every part of the right type.
    """
    both = found.join(requests.select("query_id", F.col("key").alias("_key"), F.col("limit").alias("_limit")), "query_id")
    keys = lambda text: F.array_sort(F.json_object_keys(text))
    names = lambda *n: F.array(*[F.lit(x) for x in sorted(n)])
    inner = F.get_json_object("payload", "$.response")
    parsed = both.withColumn("_r", F.from_json(inner, RESPONSE)).withColumn("_raw", F.from_json(F.get_json_object(inner, "$.items"), "array<string>"))
    items, wanted = F.col("_r.items"), names(*[f.split()[0] for f in ITEM.split(", ")])
    whole = F.forall(
        items,
        lambda x: x["code_unit_id"].isNotNull() & x["file_id"].isNotNull() & x["path"].isNotNull() & x["kind"].isNotNull() & x["content"].isNotNull()
        & x["language"].isNotNull() & x["start_line"].isNotNull() & x["end_line"].isNotNull() & x["cosine_distance"].isNotNull()
        & ~F.isnan(x["cosine_distance"]) & (F.abs(x["cosine_distance"]) < float("inf")) & (x["start_line"] >= 1) & (x["end_line"] >= x["start_line"]),
    )
    ids = F.transform(items, lambda x: x["code_unit_id"])
    good = (
        (keys(F.col("payload")) == names("key", "response", "schema"))
        & (F.get_json_object("payload", "$.schema") == version)
        & (F.get_json_object("payload", "$.key") == F.col("_key"))
        & (keys(inner) == names("items", "limit"))
        & (F.col("_r.limit") == F.col("_limit"))
        & (F.size(items) <= F.col("_limit"))
        & F.forall("_raw", lambda x: F.array_sort(F.json_object_keys(x)) == wanted)
        & whole
        & (F.size(F.array_distinct(ids)) == F.size(ids))
    )
    return parsed.where(F.coalesce(good, F.lit(False))).select("query_id", F.col("_r").alias("response"))


def read_through(
    units: DataFrame, questions: DataFrame, repositories: DataFrame, cache: DataFrame, now: Column, limit: int = 10, model: str = "digest", width: int = 384
) -> tuple[DataFrame, DataFrame]:
    """(results, rows to store) of semantic search behind the cache: only misses are searched for.

    Results: (query_id, cached, response). Questions to unknown repositories have no row. What is stored was computed
    from the generation that its key names; :func:`storable` drops it if that is no longer the current one.
    """
    from . import search

    current = repositories.select(F.col("id").alias("repository_id"), F.col("index_generation").alias("generation"))
    asked = questions.join(current, "repository_id")
    asked = asked.withColumn("key", key(F.col("repository_id"), F.col("generation"), request(F.col("question"), F.lit(limit), model, width))).withColumn("limit", F.lit(limit))
    known = responses(hits(cache, asked, now), asked)
    missed = asked.join(known.select("query_id"), "query_id", "left_anti")
    found = search.semantic(units, missed, limit, width=width).join(units.select("code_unit_id", "content"), "code_unit_id")
    fields = [f.split()[0] for f in ITEM.split(", ")]
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("i"))
    kind = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>"
    items = F.coalesce(F.transform("i", lambda x: x.dropFields("rank")).cast(kind), F.from_json(F.lit("[]"), kind))
    fresh = missed.join(listed, "query_id", "left").select(
        "query_id", "key", "repository_id", "generation", F.struct(items.alias("items"), F.lit(limit).alias("limit")).alias("response")
    )
    results = known.select("query_id", F.lit(True).alias("cached"), "response").unionByName(fresh.select("query_id", F.lit(False).alias("cached"), "response"))
    rows = fresh.select("key", "repository_id", "generation", envelope(F.col("key"), F.col("response")).alias("payload"), now.alias("created_at"))
    return results, rows
