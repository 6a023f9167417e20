"""Gates over datasets: resolution of documents, sections and sentences, candidates for repair, readiness checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import canonical, canonical_form, mapped_lists
from tessera.sources import artifacts

UNRESOLVED, AMBIGUOUS = "unresolved", "ambiguous"


def canonical_heading(text: str) -> str:
    """Without anchors and marks of emphasis or code, in normal form."""
    return canonical(re.sub(r"\{#[^}]*\}|`|\*\*|__", "", text)) or ""


@F.arrow_udf(T.ArrayType(T.StringType()))
def canonical_headings(paths: pa.Array) -> pa.Array:
    return mapped_lists(paths, canonical_heading)


def with_places(text: str) -> tuple[str, list[int]]:
    """The normal form, and for each of its characters where it comes from."""
    out: list[str] = []
    places: list[int] = []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).casefold():
            blank = x.isspace()
            if blank and (not out or out[-1] == " "):
                continue
            out.append(" " if blank else x)
            places.append(i)
    if out and out[-1] == " ":
        out.pop(), places.pop()
    return "".join(out), places


MARKUP = re.compile(r"!?\[([^\]]*)\]\([^)]*\)|^[ \t]*(?:[-+*]|\d+[.)])[ \t]+|[`*_]", re.M)


def rendered_with_places(text: str) -> tuple[str, list[int]]:
    """with_places of what a reader sees: link targets, list marks and emphasis dropped."""
    keep: list[int] = []
    at = 0
    for m in MARKUP.finditer(text):
        keep += range(at, m.start())
        if m[1] is not None:
            keep += range(m.start(1), m.end(1))
        at = m.end()
    keep += range(at, len(text))
    normal, places = with_places("".join(text[i] for i in keep))
    return normal, [keep[p] for p in places]


def resolve_documents(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted (evidence_id, ref) with doc_id and method: the id itself, else the one id that is ref behind a namespace."""
    ids = docs.select("doc_id").distinct()
    exact = wanted.join(ids.withColumn("ref", F.col("doc_id")), "ref").select("evidence_id", "ref", "doc_id", F.lit("exact").alias("method"))
    rest = wanted.join(exact.select("evidence_id"), "evidence_id", "left_anti")
    spaced = ids.where(F.contains("doc_id", F.lit(":"))).withColumn("ref", F.expr("substring(doc_id, instr(doc_id, ':') + 1)"))
    met = rest.join(spaced, "ref", "left").groupBy("evidence_id", "ref").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("d"))
    method = F.when(F.col("n") == 1, "namespace").when(F.col("n") > 1, AMBIGUOUS).otherwise(UNRESOLVED)
    return exact.unionByName(met.select("evidence_id", "ref", F.when(F.col("n") == 1, F.col("d")).alias("doc_id"), method.alias("method")))


def resolve_sections(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """(evidence_id, section, tier): the first tier with a match: exact path, path's end, then both in normal form.

    wanted: (evidence_id, doc_id, path array); sections: (doc_id, section, path array). More than one match at the tier is
    ambiguous.
    """
    a = wanted.select("evidence_id", "doc_id", F.col("path").alias("want")).withColumn("want_n", canonical_headings("want"))
    b = sections.select("doc_id", "section", F.col("path").alias("have")).withColumn("have_n", canonical_headings("have"))
    met = a.join(b, "doc_id")
    tail = lambda have, want: (F.size(have) >= F.size(want)) & (F.slice(have, F.greatest(F.size(have) - F.size(want) + 1, F.lit(1)), F.greatest(F.size(want), F.lit(1))) == want)
    c = F.col
    tier = F.when(c("have") == c("want"), 1).when(tail(c("have"), c("want")), 2).when(c("have_n") == c("want_n"), 3).when(tail(c("have_n"), c("want_n")), 4)
    tiered = met.withColumn("tier", tier).where("tier is not null")
    best = tiered.withColumn("least", F.min("tier").over(Window.partitionBy("evidence_id"))).where("tier = least")
    out = best.groupBy("evidence_id").agg(F.min("tier").alias("tier"), F.count("*").alias("n"), F.min("section").alias("section"))
    return wanted.select("evidence_id").join(out, "evidence_id", "left").select("evidence_id", F.when(F.col("n") == 1, F.col("section")).alias("section"), "tier", F.when(F.col("n") > 1, AMBIGUOUS).when(F.col("n") == 1, "resolved").otherwise(UNRESOLVED).alias("status"))


class Searched:
    """A text in its three forms, each made once, when a search first needs it."""

    def __init__(self, text: str):
        self.text = text
        self.forms: dict[str, tuple[str, list[int]]] = {}

    def find(self, needle: str, low: int = 0, high: int | None = None) -> tuple[str, list[tuple[int, int]]]:
        """How a sentence is found between two places (exact, normalized, rendered), and where, in characters of the text."""
        high = len(self.text) if high is None else high
        places = [(m.start(), m.end()) for m in re.compile(re.escape(needle)).finditer(self.text, low, high)] if needle else []
        if places:
            return "exact", places
        for name, form in (("normalized", with_places), ("rendered", rendered_with_places)):
            if name not in self.forms:
                self.forms[name] = form(self.text)
            body, source = self.forms[name]
            want = form(needle)[0]
            found = [(source[m.start()], source[m.end() - 1] + 1) for m in re.finditer(re.escape(want), body)] if want else []
            found = [(a, b) for a, b in found if low <= a and b <= high]
            if found:
                return name, found
        return UNRESOLVED, []


def find_in(text: str, needle: str) -> tuple[str, list[tuple[int, int]]]:
    return Searched(text).find(needle)


def resolve_sentences(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(evidence_id, method, start, end, n) of sentences (evidence_id, doc_id, sentence) in texts (doc_id, text).

    With columns section_start and section_end (characters; null for the whole document) a sentence is looked for within its
    section. The sentences of a document are looked up one after the other, in forms of it that are made once.
    """
    bounds = ["section_start", "section_end"] if {"section_start", "section_end"} <= set(wanted.columns) else []
    met = wanted.select("evidence_id", "doc_id", "sentence", *bounds).join(texts.select("doc_id", "text"), "doc_id")
    met = met.sortWithinPartitions("doc_id").select("evidence_id", "sentence", "text", *bounds)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Searched("")
        for f in frames:
            rows = []
            low = f["section_start"] if bounds else [None] * len(f)
            high = f["section_end"] if bounds else [None] * len(f)
            for e, s, t, a, b in zip(f["evidence_id"], f["sentence"], f["text"], low, high, strict=True):
                held = held if held.text == (t or "") else Searched(t or "")
                method, found = held.find(s or "", 0 if pd.isna(a) else int(a), None if pd.isna(b) else int(b))
                rows.append((e, AMBIGUOUS if len(found) > 1 else method, found[0][0] if found else None, found[0][1] if found else None, len(found)))
            out = pd.DataFrame(rows, columns=["evidence_id", "method", "start", "end", "n"])
            yield out.astype({"start": "Int64", "end": "Int64"})

    kind = wanted.schema["evidence_id"].dataType.simpleString()
    return met.mapInPandas(run, f"evidence_id {kind}, method string, start long, end long, n long")


def compatibility_gate(documents: DataFrame, sections: DataFrame, sentences: DataFrame) -> DataFrame:
    """(evidence_id, stage, problem) of all evidence that does not resolve; the gate passes if there is none."""
    bad = lambda df, c, stage: df.where(F.col(c).isin(UNRESOLVED, AMBIGUOUS)).select("evidence_id", F.lit(stage).alias("stage"), F.col(c).alias("problem"))
    return bad(documents, "method", "document").union(bad(sections, "status", "section")).union(bad(sentences, "method", "sentence"))


def gate_verdict(evidence: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: how much evidence there is, how much of it has a problem (compatibility_gate), and PASS or FAIL."""
    total = evidence.select("evidence_id").distinct().agg(F.count("*").alias("evidence"))
    failed = problems.select("evidence_id").distinct().agg(F.count("*").alias("failed"))
    return total.crossJoin(failed).withColumn("verdict", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def dataset_fingerprint(questions: DataFrame) -> str:
    """Of the records, whatever their order."""
    return artifacts.contents_sha256(questions)


def dataset_problems(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """(evidence_id, severity, problem): declared spans that hold another text are errors, texts that the document does not
    hold in any form of writing are warnings. evidence: (evidence_id, doc_id, text, char_start, char_end)."""
    wrong = provenance_errors(evidence, texts).select("evidence_id", F.lit("ERROR").alias("severity"), F.lit("provenance").alias("problem"))
    return wrong.unionByName(semantic_warnings(evidence, texts).select("evidence_id", F.lit("WARNING").alias("severity"), F.lit("text").alias("problem")))


def value_distribution(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, rows) of each field's values, nulls among them."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("rows"))


def breakdown(questions: DataFrame, failures: DataFrame, dimensions: list[str]) -> DataFrame:
    """Compatible and total questions by each dimension for itself. questions: (question_id, dimensions...)."""
    failed = failures.select("question_id").distinct().withColumn("failed", F.lit(1))
    rows = questions.join(failed, "question_id", "left")
    sets = rows.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    out = sets.agg(F.count("*").alias("total"), F.sum(F.when(F.col("failed").isNull(), 1).otherwise(0)).alias("compatible"), F.grouping_id().alias("g"))
    name = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        mask = (1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i))
        name = F.when(F.col("g") == mask, F.lit(d)).otherwise(name)
    return out.select(name.alias("dimension"), F.coalesce(*dimensions).alias("value"), "total", "compatible")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of what only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").orderBy(key)


def dataset_profile(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, empty, distinct) of string fields."""
    out = None
    for f in fields:
        part = rows.agg(F.lit(f).alias("field"), F.count(f).alias("present"), F.sum(F.when(F.trim(F.col(f).cast("string")) == "", 1).otherwise(0)).alias("empty"), F.count_distinct(f).alias("distinct"))
        out = part if out is None else out.union(part)
    return out


def semantic_warnings(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """(evidence_id) of evidence whose normal form its document does not hold."""
    met = evidence.select("evidence_id", "doc_id", canonical_form("text").alias("n")).join(texts.select("doc_id", canonical_form("text").alias("body")), "doc_id")
    return met.where(~F.contains("body", "n")).select("evidence_id")


def provenance_errors(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """(evidence_id) of evidence whose declared span holds another text."""
    met = evidence.where(F.col("char_start").isNotNull()).join(texts.select("doc_id", F.col("text").alias("body")), "doc_id")
    return met.where(F.expr("substring(body, char_start + 1, char_end - char_start)") != F.col("text")).select("evidence_id")


def readiness(checks: dict[str, tuple[DataFrame, str]], spark) -> DataFrame:
    """(check, status): PASS where a frame of problems is empty, else its severity (WARNING or BLOCKED)."""
    rows = [(name, "PASS" if problems.isEmpty() else severity) for name, (problems, severity) in checks.items()]
    return spark.createDataFrame(rows, "check string, status string")


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance
