"""Text as Columns: normal forms, tokenizers, sentences.

Unicode normalisation and case folding have no JVM function, so they are vectorised UDFs; `plain_form` is the normal form's
JVM-side stand-in for text that is known to be ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Token patterns. A word character is a letter, a number or the underscore, of any script.
LEXICAL_TOKEN = r"[\p{L}\p{N}_]+|[@#$][\p{L}\p{N}_]+|===|!==|=>|\[\(|\)\]|[.():{}\[\]<>/+*-]"
ANSWER_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TOKEN_PIECE = r"(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D])[\x20\x09-\x0D]*"
SENTENCE_GAP = r"""(?<=[.!?])[ \t]+(?=(?:["'`(\[]*[A-Z0-9]))"""
#: What a rewritten query must keep (names with brackets, decorators, error codes, calls, mixed case, files).
PROTECTED = (
    r"\[\([^\]]+\)\]",
    r"@[A-Za-z_$][\w$]*",
    r"\bNG\d+\b",
    r"\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?\(\)",
    r"\b(?:[A-Z]{2,}[A-Za-z0-9_$]*|[A-Z][a-z0-9_$]+[A-Z][\w$]*|[a-z_$][\w$]*[A-Z][\w$]*)\b",
    r"\b[\w-]+\.(?:json|md|ts|html|css)\b",
)
#: Signs of secrets and private paths in an outgoing text.
LEAKS = {
    "private key": r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "credential": r"(?i)(?:api[_-]?key|client[_-]?secret|password)\s*[:=]\s*[\"']?(?:sk-(?:or-v1-)?[A-Za-z0-9_-]{16,}|[A-Za-z0-9_./+\-=]{32,})",
    "token": r"\b(?:sk-(?:or-v1-)?[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|AKIA[A-Z0-9]{16})\b",
    "Windows path": r"(?i)\b[A-Z]:\\Users\\",
    "Unix path": r"(?<!\w)/(?:home|Users)/[^/\s\"']+/[^\s\"']+",
    "file URI": r"(?i)\bfile://(?:/[A-Za-z]:|/(?:home|Users)/)",
    "environment key": r"(?m)^\s*(?:OPENROUTER_API_KEY|OPENAI_API_KEY)\s*=",
}


def canonical(text: str | None) -> str | None:
    """NFKC, case folded, white space collapsed."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def canonical_form(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def plain_form(text: Column) -> Column:
    """canonical_form of ASCII text."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def raw_lexical_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEXICAL_TOKEN), F.lit(0))


def mapped_lists(lists: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """A list array with a function of its strings applied, to each distinct value once."""
    coded = lists.flatten().dictionary_encode()
    values = pa.DictionaryArray.from_arrays(coded.indices, pa.array([change(t) for t in coded.dictionary.to_pylist()], pa.string())).dictionary_decode()
    offsets = pa.array([0, *lists.value_lengths().fill_null(0).to_numpy().cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())


def folded(tokens: pa.Array) -> pa.DictionaryArray:
    """A string array with its cases folded: each distinct value once."""
    coded = tokens.dictionary_encode()
    return pa.DictionaryArray.from_arrays(coded.indices, pa.array([t.casefold() for t in coded.dictionary.to_pylist()], pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def folded_tokens(lists: pa.Array) -> pa.Array:
    return mapped_lists(lists, str.casefold)


def lexical_tokens(text: Column) -> Column:
    """Tokens for lexical search, their cases folded after matching."""
    return folded_tokens(raw_lexical_tokens(text))


def answer_tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(ANSWER_TOKEN), F.lit(0))


def word_tokens(text: Column) -> Column:
    """The portable tokenizer: words, or single symbols."""
    return F.regexp_extract_all(text, F.lit(ANSWER_TOKEN), F.lit(0))


def token_pieces(text: Column) -> Column:
    """The portable tokenizer's tokens, each with the blanks behind it."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PIECE), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences of prose, line by line, trimmed, without empty ones."""
    split = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, SENTENCE_GAP)))
    return F.filter(F.transform(split, lambda s: F.trim(s)), lambda s: s != "")  # a bare F.trim would take the place as what to trim


def protected_tokens(query: Column) -> Column:
    """What a rewrite must keep; letters of any script are letters."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(query, F.lit(f"(?U){p}"), F.lit(0)) for p in PROTECTED])))


def rewrite_verdict(original: Column, rewritten: Column, slack: int = 5) -> Column:
    """'ok', or why a rewritten query is refused: protected tokens missing or added, or too many more words."""
    kept = F.forall(protected_tokens(original), lambda t: F.contains(rewritten, t))
    added = F.size(F.array_except(protected_tokens(rewritten), protected_tokens(original))) > 0
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    return F.when(~kept, "missing").when(added, "added").when(words(rewritten) > words(original) + slack, "too long").otherwise("ok")


def leaks(payload: Column) -> Column:
    """Names of the leaks found in an outgoing text."""
    return F.filter(F.array(*[F.when(F.rlike(payload, F.lit(p)), F.lit(name)) for name, p in LEAKS.items()]), lambda x: x.isNotNull())


def excerpt(text: Column, limit: int = 500) -> Column:
    """White space collapsed, cut to the limit with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of all non-overlapping occurrences, left to right; none for an empty needle."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), F.regexp_replace(needle, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E")), -1)
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p))
    found = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, n: F.struct((acc["at"] + n + F.length(needle)).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + n)).alias("starts")),
        lambda acc: acc["starts"],
    )
    return F.when(needle == "", F.array().cast("array<int>")).otherwise(found)
