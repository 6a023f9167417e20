"""Reading Markdown trees and strict JSON, with Spark's own readers, and small settings files on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import fields
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaVersionError(ValueError):
    """A file of another schema version."""


class DatasetError(ValueError):
    """Questions that are not what their contract says."""


def markdown_files(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """(doc_id, source, relative_path, filename, source_sha256, text) of every *.md below a folder, byte order mark dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    inside = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    rows = raw.select(inside.alias("relative_path"), F.sha2("content", 256).alias("source_sha256"), text.alias("text"))
    return rows.select(F.concat(F.lit(f"{source}:"), "relative_path").alias("doc_id"), F.lit(source).alias("source"), "relative_path", F.element_at(F.split("relative_path", "/"), -1).alias("filename"), "source_sha256", "text")


def strict(text: str) -> Any:
    """JSON without keys that stand twice, NaN or Infinity."""

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    def constant(name: str):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=unique, parse_constant=constant)


def checked_object(text: str, known: set[str] | None, version: str | None) -> dict[str, Any]:
    value = strict(text)
    if not isinstance(value, dict):
        raise ValueError(f"not an object: {text[:40]}")
    if known is not None and not value.keys() <= known | {"schema_version"}:
        raise ValueError(f"unknown fields: {sorted(value.keys() - known)[:3]}")
    if version is not None and value.get("schema_version") != version:
        raise SchemaVersionError(f"expected {version}, found {value.get('schema_version')}")
    return value


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, version: str | None = None) -> DataFrame:
    """Rows of a JSON lines file. Malformed lines, unknown fields, keys that stand twice, NaN and Infinity are errors, which
    name the file and the line (counted from where the file's split starts, which is named if it is not the file's start)."""
    form = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    known = {f.name for f in form}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        number = 0
        for batch in batches:
            kept = []
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = number + 1 if (file, start) == at else 1
                at = file, start
                if not line.strip():
                    continue
                try:
                    checked_object(line, known, version)
                except ValueError as e:
                    kind = SchemaVersionError if isinstance(e, SchemaVersionError) else ValueError
                    raise kind(f"{file}{f'@{start}' if start else ''}:{number}: {e}") from e
                kept.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["value"])

    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return text.mapInArrow(check, "value string").select(F.from_json("value", form, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of a JSON array in each file, or of JSON lines if the path ends so; as strict in either form."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    known = {f.name for f in kind}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                values = strict(text)
                if not isinstance(values, list):
                    raise ValueError("expected an array")
                found = [json.dumps(v) for v in values]
                for v in found:
                    checked_object(v, known, None)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])

    rows = spark.read.text(path, wholetext=True).mapInArrow(records, "value string")
    return rows.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(value, fields): the objects of a JSON lines file as they stand, for inspection; blank lines are passed over."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [x for x in batch.column(0).to_pylist() if x.strip()]
            names = [sorted(checked_object(x, None, None)) for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(names, pa.list_(pa.string()))], ["value", "fields"])

    return spark.read.text(path).mapInArrow(check, "value string, fields array<string>")


# --- questions -------------------------------------------------------------------------------------------------------

#: Fields of the two contracts of question records.
LEGACY = "id string, doc_id string, question string, answer string, evidence_sentences array<struct<text: string, block_index: int, char_start: int, char_end: int>>, evidence_sections array<string>, question_type string, difficulty string, notes string"
TEAM = "question_id string, question string, reference_answer string, difficulty string, question_type string, reasoning_type string, evidence array<struct<evidence_id: string, doc_id: string, section_path: array<string>, evidence_sentences: array<string>>>, metadata struct<evidence_scope: string, num_evidence: int, semantic_competition: boolean, content_type: string, answerable_from_evidence: boolean>"


def refuse(problems: DataFrame, message: str) -> None:
    """Raise if there is any problem, naming a few."""
    some = [r[0] for r in problems.limit(3).collect()]
    if some:
        raise DatasetError(f"{message}: {', '.join(map(str, some))}")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1").select(F.concat_ws("/", *keys))


def load_questions(spark: SparkSession, path: str, documents: DataFrame, require_answer: bool = True) -> DataFrame:
    """Questions of the older contract, by id: ids told apart, documents of the corpus (doc_id), answers if required."""
    rows = json_records(spark, path, LEGACY)
    refuse(rows.where(F.col("id").isNull() | (F.trim("id") == "") | F.col("question").isNull() | (F.trim("question") == "")).select(F.coalesce("id", F.lit("?"))), "questions without id or text")
    refuse(repeated(rows, ["id"]), "ids that stand twice")
    refuse(rows.join(documents.select("doc_id").distinct(), "doc_id", "left_anti").select("id"), "questions on unknown documents")
    if require_answer:
        refuse(rows.where(F.trim(F.coalesce("answer", F.lit(""))) == "").select("id"), "questions without an answer")
    return rows.orderBy("id")


def load_team_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of the team's contract, adapted, by id."""
    rows = json_records(spark, path, TEAM)
    refuse(repeated(rows, ["question_id"]), "ids that stand twice")
    return adapt_team_questions(rows).orderBy("question_id")


def is_team_dataset(rows: DataFrame) -> bool:
    """By its fields, never by the file's name."""
    return "question_id" in rows.columns


def adapt_team_questions(rows: DataFrame) -> DataFrame:
    """The team's question records as (question_id, question, answer, difficulty, question_type, evidence...)."""
    declared = F.col("metadata.num_evidence")
    checked = F.when(declared != F.size("evidence"), F.raise_error(F.lit("num_evidence does not fit")).cast("string")).otherwise(F.col("question_id"))
    return rows.select(checked.alias("question_id"), "question", F.col("reference_answer").alias("answer"), "difficulty", "question_type", "reasoning_type", F.col("metadata.evidence_scope").alias("scope"), "evidence")


def evidence_units(questions: DataFrame) -> DataFrame:
    """(question_id, evidence_id, doc_id, text): one row for each evidence sentence."""
    items = questions.select("question_id", F.explode("evidence").alias("e"))
    sentences = items.select("question_id", "e.evidence_id", "e.doc_id", F.posexplode("e.evidence_sentences").alias("i", "text"))
    return sentences.select("question_id", F.format_string("%s:sentence:%d", "evidence_id", "i").alias("evidence_id"), "doc_id", "text")


def missing_sources(relevance: DataFrame, documents: DataFrame) -> DataFrame:
    """Relevant sources that the corpus lacks."""
    return relevance.select("source").distinct().join(documents.select("source").distinct(), "source", "left_anti")


def load_retrieval_dataset(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """(query_id, query, category, relevant_sources, notes, difficulty) by id; sources must be in the corpus (source)."""
    rows = json_lines(spark, path, "query_id string, query string, category string, relevant_sources array<string>, notes string, difficulty string")
    refuse(rows.where(F.col("query_id").isNull() | F.col("query_id").rlike(r"\s") | (F.col("query_id") == "")).select(F.coalesce("query_id", F.lit("?"))), "ids with blanks")
    refuse(repeated(rows, ["query_id"]), "ids that stand twice")
    refuse(missing_sources(rows.select(F.explode("relevant_sources").alias("source")), documents), "sources that the corpus lacks")
    return rows.withColumn("relevant_sources", F.array_sort(F.array_distinct("relevant_sources"))).orderBy("query_id")


# --- rows of experiments ---------------------------------------------------------------------------------------------


def load_ranked_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an experiment, keyed by query and strategy."""
    rows = json_lines(spark, path, schema)
    refuse(repeated(rows, ["query_id", "strategy"]), "rows of one query and strategy")
    return rows


def load_rewrites(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, query, rewrite, status): every query (query_id, query) once, with the text it has now."""
    rows = json_lines(spark, path, "query_id string, query string, rewrite string, status string")
    refuse(repeated(rows, ["query_id"]), "rewrites of one query")
    met = rows.select("query_id", F.col("query").alias("was")).join(queries.select("query_id", F.col("query").alias("now")), "query_id", "full")
    refuse(met.where(~F.col("was").eqNullSafe(F.col("now"))).select("query_id"), "queries whose rewrite is missing or stale")
    return rows


def load_generation_inputs(spark: SparkSession, path: str) -> DataFrame:
    rows = json_lines(spark, path, "query_id string, question string, context string")
    refuse(repeated(rows, ["query_id"]), "inputs of one query")
    return rows


# --- settings on the driver ------------------------------------------------------------------------------------------


def plain_yaml(text: str) -> dict[str, Any]:
    """Nested mappings of scalars, by indentation; lists in brackets. What else YAML has is refused."""
    out: dict[str, Any] = {}
    open_: list[tuple[int, dict[str, Any]]] = [(-1, out)]
    for number, line in enumerate(text.split("\n"), 1):
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not bare.strip() or bare.strip() == "---":
            continue
        depth = len(bare) - len(bare.lstrip())
        key, colon, value = bare.strip().partition(":")
        if not colon or bare.strip().startswith("- "):
            raise ValueError(f"line {number} is no 'key: value'")
        while open_[-1][0] >= depth:
            open_.pop()
        if key in open_[-1][1]:
            raise ValueError(f"line {number}: {key} stands twice")
        if value.strip():
            open_[-1][1][key] = yaml_scalar(value.strip())
        else:
            open_[-1][1][key] = {}
            open_.append((depth, open_[-1][1][key]))
    return out


def yaml_scalar(text: str) -> Any:
    words = {"true": True, "false": False, "null": None, "~": None}
    if text.lower() in words:
        return words[text.lower()]
    try:
        return json.loads(text)
    except ValueError:
        return [yaml_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()] if text[:1] == "[" and text[-1:] == "]" else text.strip("'\"")


def load_config(path: str, kind: type, aliases: dict[str, str] | None = None) -> Any:
    """A dataclass from a JSON or YAML file; unknown keys are refused, aliases name fields differently."""
    text = Path(path).read_text("utf-8")
    values = strict(text) if path.endswith(".json") else plain_yaml(text)
    if not isinstance(values, dict):
        raise ValueError(f"{path} is no mapping")
    values = {(aliases or {}).get(k, k): v for k, v in values.items()}
    unknown = values.keys() - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**values)


def load_dotenv(start: str, root: str) -> dict[str, str]:
    """Settings of the nearest .env from start up to root; what the environment has already is left as it is."""
    at, top = Path(start).resolve(), Path(root).resolve()
    for folder in (at, *at.parents):
        if (folder / ".env").is_file():
            found = {}
            for line in (folder / ".env").read_text("utf-8").splitlines():
                name, equals, value = line.strip().removeprefix("export ").partition("=")
                if equals and name.strip().isidentifier():
                    found[name.strip()] = value.strip().strip("'\"")
            for name, value in found.items():
                os.environ.setdefault(name, value)
            return found
        if folder == top:
            break
    return {}


def parse_filters(arguments: list[str], allowed: tuple[str, ...]) -> dict[str, str]:
    """FIELD=VALUE arguments; a field may stand once."""
    out: dict[str, str] = {}
    for a in arguments:
        name, equals, value = a.partition("=")
        if not equals or not name or not value:
            raise ValueError(f"not FIELD=VALUE: {a}")
        if name in out:
            raise ValueError(f"{name} stands twice")
        if name not in allowed:
            raise ValueError(f"no filter on {name}")
        out[name] = value
    return out


def sliced(rows: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows offset to offset + limit of a total order, for runs in parts."""
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def build_scope(limit: int | None) -> str:
    """What a manifest says of a build that took only the first rows."""
    return "full" if limit is None else "sample"


def resolve_strategies(wanted: str, enabled: list[str]) -> list[str]:
    """'all', or names with commas, each enabled and named once."""
    names = list(enabled) if wanted == "all" else [x.strip() for x in wanted.split(",")]
    if not names or len(set(names)) != len(names) or set(names) - set(enabled):
        raise ValueError(f"not a choice of {enabled}: {wanted}")
    return names
