"""Contexts, prompts and answers behind providers that need no network."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import leaks, word_tokens
from tessera.functions.vector import hashed_embedding
from tessera.operators.providers import generation_key


class ContextOverflowError(ValueError):
    """A rendered context exceeds its token budget."""


class Provider(Protocol):
    """Answers, embeddings or rewrites as a Column of the request."""

    def __call__(self, request: Column) -> Column: ...


def render_contexts(hits: DataFrame, budget: int | None = None) -> DataFrame:
    """(query_id, strategy, context, pieces, tokens): numbered texts in rank order; ranks may keep gaps.

    hits: (query_id, strategy, rank, chunk_id, text), as many for each query as a selection took. Nothing is trimmed: over
    the budget the query fails.
    """
    rows = hits.groupBy("query_id", "strategy").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("h"))
    numbered = F.transform("h", lambda h, i: F.concat(F.lit("[CONTEXT "), (i + 1).cast("string"), F.lit("]\n"), h["text"]))
    out = rows.select("query_id", "strategy", F.array_join(numbered, "\n\n").alias("context"), F.size("h").alias("pieces"))
    out = out.withColumn("tokens", F.size(word_tokens(F.col("context"))))
    if budget is None:
        return out
    return out.withColumn("tokens", F.when(F.col("tokens") > budget, F.raise_error(F.lit("a context exceeds its budget")).cast("int")).otherwise(F.col("tokens")))


def prompts(contexts: DataFrame, questions: DataFrame, system: str, window: int, answer_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(prompts, failures): requests with their token account, and those that do not fit the model's window.

    Each message costs 3 tokens and its role, the reply 3 more. Only ids and questions are read of the questions.
    """
    met = contexts.join(questions.select("query_id", "question"), "query_id")
    user = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    rows = met.select("query_id", "strategy", F.lit(system).alias("system"), user.alias("user"))
    count = lambda c: F.size(word_tokens(c))
    rows = rows.withColumn("input_tokens", count(F.col("system")) + count(F.col("user")) + 2 * (3 + 1) + 3)
    fits = F.col("input_tokens") + answer_tokens <= window
    return rows.where(fits), rows.where(~fits).select("query_id", "strategy", "input_tokens", F.lit("input overflow").alias("failure"))


def hashed_answer(request: Column) -> Column:
    """The offline provider of answers."""
    return F.concat(F.lit("Deterministic answer "), F.substring(F.sha2(request, 256), 1, 16))


def keyed_requests(requests: DataFrame, settings: dict[str, Any] | None = None) -> DataFrame:
    """(query_id, strategy, key, request) of prompts: system and user text with a separator; the key is of the request and,
    where they are given, of the settings it is answered with.

    A request that would leak a secret is an error, before any provider sees it.
    """
    text = F.concat_ws("\x1e", "system", "user")
    checked = F.when(F.size(leaks(text)) > 0, F.raise_error(F.lit("a request holds a secret")).cast("string")).otherwise(text)
    rows = requests.select("query_id", "strategy", checked.alias("request"))
    return rows.select("query_id", "strategy", (F.sha2("request", 256) if settings is None else generation_key(F.col("request"), settings)).alias("key"), "request")


def generate(requests: DataFrame, provider: Provider = hashed_answer, cache: DataFrame | None = None, settings: dict[str, Any] | None = None) -> DataFrame:
    """(query_id, strategy, key, answer, cached): equal requests are asked once; what a cache (key, answer) holds is not."""
    keyed = keyed_requests(requests, settings)
    unique = keyed.select("key", "request").dropDuplicates(["key"])
    known = cache.select("key", "answer") if cache is not None else unique.where(F.lit(False)).select("key", F.col("request").alias("answer"))
    fresh = unique.join(known, "key", "left_anti").select("key", provider(F.col("request")).alias("answer"), F.lit(False).alias("cached"))
    answers = fresh.unionByName(known.withColumn("cached", F.lit(True)))
    return keyed.drop("request").join(answers, "key")


def embed(rows: DataFrame, dimension: int, text_col: str = "text", cache: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """rows with vector and text_sha256. Equal texts are embedded once; a cache is (text_sha256, vector)."""
    provider = provider or (lambda text: hashed_embedding(text, dimension))
    keyed = rows.withColumn("text_sha256", F.sha2(F.col(text_col), 256))
    unique = keyed.select("text_sha256", F.col(text_col).alias("__text")).dropDuplicates(["text_sha256"])
    if cache is None:
        vectors = unique.select("text_sha256", provider(F.col("__text")).alias("vector"))
    else:
        fresh = unique.join(cache, "text_sha256", "left_anti").select("text_sha256", provider(F.col("__text")).alias("vector"))
        vectors = fresh.unionByName(cache.select("text_sha256", "vector"))
    return keyed.join(vectors, "text_sha256")


def cache_misses(rows: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts a cache-only run would lack."""
    return rows.select(F.sha2(F.col(text_col), 256).alias("text_sha256")).distinct().join(cache, "text_sha256", "left_anti")
