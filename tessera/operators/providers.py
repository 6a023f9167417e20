"""Providers behind a network, and the caches before them.

A transport is a function (url, headers, body) -> (status, headers, body); the standard library's is the default. Retries,
order and integrity are decided here, so that any transport behaves alike. Nothing in the engine needs a network: the
offline providers are Columns (`tessera.operators.context`, `tessera.functions.vector`).
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stripped
from tessera.operators.chunking import PLAN_SCHEMA, batched, check_outbound
from tessera.sources.answered import Solver, each
from tessera.sources.artifacts import fingerprint

Transport = Callable[[str, dict[str, str], bytes], tuple[int, dict[str, str], bytes]]
#: The status of a request that reached nobody.
NO_CONNECTION = 599


class ProviderError(RuntimeError):
    """A provider that does not answer, after all tries."""


class IntegrityError(ValueError):
    """An answer that is not what was asked for."""


class CacheMissError(LookupError):
    """A run that may ask nobody lacks an answer."""


def http(url: str, headers: dict[str, str], body: bytes, timeout: float = 60.0) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


@dataclass(frozen=True)
class Endpoint:
    """Where and how to ask. key is a secret: it is in no fingerprint and in no message."""

    url: str
    model: str
    key: str = ""
    tries: int = 4
    wait: float = 1.0
    transport: Transport = http
    sleep: Callable[[float], None] = time.sleep

    def identity(self) -> dict[str, Any]:
        return {"url": self.url, "model": self.model}

    def ask(self, payload: dict[str, Any]) -> dict[str, Any]:
        """The answer's JSON. 429 and 5xx are tried again, after what Retry-After says, else after growing waits."""
        body = json.dumps({"model": self.model} | payload, ensure_ascii=False, allow_nan=False)
        check_outbound(body, (self.key,))
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        status = 0
        for attempt in range(self.tries):
            try:
                status, got, raw = self.transport(self.url, headers, body.encode())
            except OSError:  # no connection, or none in time: as a server that fails
                status, got, raw = NO_CONNECTION, {}, b""
            if status == 200:
                try:
                    return json.loads(raw)
                except ValueError as e:
                    raise IntegrityError("the answer is not JSON") from e
            if status != 429 and status < 500:
                break
            if attempt + 1 < self.tries:
                asked = {k.lower(): v for k, v in got.items()}.get("retry-after", "")
                self.sleep(float(asked) if asked.replace(".", "", 1).isdigit() else self.wait * 2**attempt)
        raise ProviderError(f"{self.url} answered {status}")


# --- embeddings ------------------------------------------------------------------------------------------------------


def checked_vectors(vectors: list[Any], count: int, dimension: int) -> list[list[float]]:
    """As many vectors as texts, each of the dimension and of finite numbers; true and false are no numbers."""
    if len(vectors) != count:
        raise IntegrityError(f"{len(vectors)} vectors for {count} texts")
    for v in vectors:
        if not isinstance(v, list) or len(v) != dimension or not all(type(x) in (int, float) and math.isfinite(x) for x in v):
            raise IntegrityError("not a vector of finite numbers")
    return [[float(x) for x in v] for v in vectors]


def http_vectors(endpoint: Endpoint, texts: list[str], dimension: int) -> list[list[float]]:
    """Vectors in the order of the texts, whatever order the answer has."""
    data = endpoint.ask({"input": texts, "encoding_format": "float"}).get("data", [])
    if sorted(d.get("index", -1) for d in data) != list(range(len(texts))):
        raise IntegrityError("the answer's indices are not those of the texts")
    return checked_vectors([d["embedding"] for d in sorted(data, key=lambda d: d["index"])], len(texts), dimension)


def embed_missing(texts: DataFrame, endpoint: Endpoint, dimension: int, max_items: int = 64, max_tokens: int = 8192, count_tokens: Callable[[str], int] = lambda t: len(t.split())) -> DataFrame:
    """(text_sha256, vector) of (text_sha256, text): requests of bounded items and tokens; a longer text is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for part in batched(rows, lambda r: count_tokens(r[1]), max_tokens, max_items):
                vectors = http_vectors(endpoint, [t for _, t in part], dimension)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array(vectors, pa.list_(pa.float64()))], ["text_sha256", "vector"])

    return texts.select("text_sha256", "text").mapInArrow(run, "text_sha256 string, vector array<double>")


def embedding_key(text: Column, settings: dict[str, Any]) -> Column:
    """Key of a text's vector: the text's hash with the settings it was made with."""
    return F.sha2(F.concat_ws("|", F.lit("document"), F.lit(fingerprint(settings)), F.sha2(text, 256)), 256)


def query_key(query: Column, settings: dict[str, Any]) -> Column:
    """Key of a query's vector: a space of its own, by the query without blanks at its ends."""
    return F.sha2(F.concat_ws("|", F.lit("query"), F.lit(fingerprint(settings)), F.sha2(stripped(query), 256)), 256)


def embed_queries(queries: DataFrame, settings: dict[str, Any], provider: Callable[[Column], Column], cache: DataFrame | None = None, only_cache: bool = False) -> DataFrame:
    """queries (query_id, query) with key, vector and cached. cache: (key, vector); only_cache asks nobody.

    Each distinct query that the cache lacks is asked once.
    """
    keyed = queries.withColumn("key", query_key(F.col("query"), settings))
    unique = keyed.groupBy("key").agg(F.min("query").alias("query"))
    known = unique.select("key", provider(F.col("query")).alias("vector")).where(F.lit(False)) if cache is None else cache.select("key", "vector")
    missing = unique.join(known, "key", "left_anti")
    if only_cache and not missing.isEmpty():
        raise CacheMissError("a query has no vector in the cache")
    fresh = missing.select("key", provider(stripped(F.col("query"))).alias("vector"), F.lit(False).alias("cached"))
    return keyed.join(fresh.unionByName(known.withColumn("cached", F.lit(True))), "key")


def missing_queries(queries: DataFrame, settings: dict[str, Any], cache: DataFrame) -> DataFrame:
    """(key, query): what a fill of the query cache has to ask, each once, in order."""
    keyed = queries.select(query_key(F.col("query"), settings).alias("key"), stripped(F.col("query")).alias("query"))
    return keyed.join(cache, "key", "left_anti").groupBy("key").agg(F.min("query").alias("query")).orderBy("query")


# --- answers and plans -----------------------------------------------------------------------------------------------


def http_answer(endpoint: Endpoint, system: str, user: str, max_tokens: int) -> str:
    """A finished answer; one that was cut off, or is empty, is an error."""
    got = endpoint.ask({"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "max_tokens": max_tokens})
    choice = (got.get("choices") or [{}])[0]
    if choice.get("finish_reason") != "stop":
        raise IntegrityError(f"the answer ended with {choice.get('finish_reason')}")
    text = (choice.get("message") or {}).get("content") or ""
    if not text.strip():
        raise IntegrityError("the answer is empty")
    return text


def http_answers(endpoint: Endpoint, max_tokens: int) -> Solver:
    """A solver of requests (system and user text with "\\x1e" between them): a request that gets no finished answer fails alone."""
    return each(lambda request: http_answer(endpoint, *request.split("\x1e", 1), max_tokens))


def http_planner(endpoint: Endpoint, budget: int = 2048, doublings: int = 2) -> Callable[[list[dict[str, Any]]], str]:
    """A planner: asked for JSON of the plan's schema, or in plain words where the endpoint refuses schemas; an empty answer
    that ran out of budget is asked for again with twice as much."""

    def plan(request: list[dict[str, Any]]) -> str:
        messages = [{"role": "user", "content": json.dumps({"task": "group the blocks into chunks", "blocks": request}, ensure_ascii=False)}]
        form: dict[str, Any] = {"response_format": {"type": "json_schema", "json_schema": {"name": "plan", "strict": True, "schema": PLAN_SCHEMA}}}
        room = budget
        for _ in range(doublings + 2):
            try:
                got = endpoint.ask({"messages": messages, "max_tokens": room} | form)
            except ProviderError:
                if not form:
                    raise
                form, messages = {}, [*messages, {"role": "user", "content": "Answer with JSON of this schema only: " + json.dumps(PLAN_SCHEMA)}]
                continue
            choice = (got.get("choices") or [{}])[0]
            text = (choice.get("message") or {}).get("content") or ""
            if text.strip() or choice.get("finish_reason") != "length" or room >= budget * 2**doublings:
                return text
            room *= 2
        return ""

    return plan


def generation_key(prompt: Column, settings: dict[str, Any]) -> Column:
    """Key of an answer: the prompt's hash with the settings it was generated with."""
    return F.sha2(F.concat_ws("|", F.lit(fingerprint(settings)), F.sha2(prompt, 256)), 256)


REWRITE_LIMIT = 1000


def parse_rewrite(raw: str) -> str:
    """The one field of a rewrite's JSON: a text that is not blank and not too long; it may equal the query."""
    try:
        value = json.loads(raw)
    except ValueError as e:
        raise IntegrityError("a rewrite is not JSON") from e
    if not isinstance(value, dict) or value.keys() != {"rewritten_query"} or not isinstance(value["rewritten_query"], str):
        raise IntegrityError("a rewrite has one text, rewritten_query")
    text = value["rewritten_query"].strip()
    if not text or len(text) > REWRITE_LIMIT:
        raise IntegrityError("a rewrite is blank or too long")
    return text
