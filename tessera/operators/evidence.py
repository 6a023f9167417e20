"""Evidence and chunks as intervals of a document: spans, the chunks that hold them, and how much of them is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import canonical_form, occurrences


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def coverage(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by..., covered): length of the union of (start, end) clipped to (low, high), by a running maximum of the ends."""
    clipped = intervals.withColumn("s", F.greatest("start", "low")).withColumn("e", F.least("end", "high")).where(F.col("e") > F.col("s"))
    before = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = clipped.withColumn("reached", F.coalesce(F.max("e").over(before), F.col("low")))
    return fresh.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached"))).alias("covered"))


def evidence_spans(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """(evidence_id, doc_id, span, start, end): where a text is found in its document, all non-overlapping places.

    evidence: (evidence_id, doc_id, text, char_start?, char_end?): declared offsets are taken as they are.
    """
    declared = {"char_start", "char_end"} <= set(evidence.columns)
    met = evidence.select("evidence_id", "doc_id", F.col("text").alias("needle"), *(("char_start", "char_end") if declared else ())).join(texts.select("doc_id", F.col("text").alias("body")), "doc_id")
    found = F.transform(occurrences(F.col("body"), F.col("needle")), lambda s: F.struct(s.alias("start"), (s + F.length("needle")).alias("end")))
    if declared:
        found = F.when(F.col("char_start").isNotNull(), F.array(F.struct(F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("end")))).otherwise(found)
    return met.select("evidence_id", "doc_id", F.posexplode(found).alias("span", "s")).select("evidence_id", "doc_id", "span", "s.start", "s.end")


#: Anchors that are broadcast to filter the corpus before its grams are shuffled.
ANCHORS = 100_000


def find_everywhere(evidence: DataFrame, texts: DataFrame, anchor_words: int = 3) -> DataFrame:
    """(evidence_id, doc_id): documents that hold a passage verbatim, whichever they are.

    A passage and a document can only match if they share the passage's first inner words, so both meet in an equi-join on
    a hash of so many words; the containment is then tested on the pairs that met. The distinct anchors are counted and,
    while they are few, broadcast, so that only grams that can match leave their task. A passage of fewer words may lie
    inside a word, so short ones meet every text, in blocks that a task holds at once.
    """
    split = lambda c: F.split(c, r"\s+")
    words = evidence.select("evidence_id", F.col("text").alias("needle"), split(F.col("text")).alias("w"))
    anchored = words.where(F.size("w") >= anchor_words + 2).select("evidence_id", "needle", F.xxhash64(F.array_join(F.slice("w", 2, anchor_words), " ")).alias("anchor"))
    known = anchored.select("anchor").distinct()
    known = F.broadcast(known) if known.limit(ANCHORS + 1).count() <= ANCHORS else known
    tokens = texts.select("doc_id", split(F.col("text")).alias("w"))
    grams = tokens.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - anchor_words + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, anchor_words), " ")))).alias("anchor"))
    pairs = anchored.join(grams.join(known, "anchor", "left_semi").distinct(), "anchor").select("evidence_id", "needle", "doc_id").distinct()
    held = pairs.join(texts.select("doc_id", F.col("text").alias("body")), "doc_id").where(F.contains("body", "needle")).select("evidence_id", "doc_id")
    short = words.where((F.size("w") < anchor_words + 2) & (F.col("needle") != "")).select("evidence_id", "needle")
    return held.union(find_short(short, texts)).distinct()


#: Short passages that a task holds at once.
SHORT_BLOCK = 4096


def find_short(short: DataFrame, texts: DataFrame) -> DataFrame:
    """(evidence_id, doc_id) of passages (evidence_id, needle) anywhere in a text, block by block of passages."""
    blocks = -(-short.count() // SHORT_BLOCK)
    found = short.where(F.lit(False)).select("evidence_id").crossJoin(texts.where(F.lit(False)).select("doc_id"))
    for b in range(blocks):
        own = short.where(F.pmod(F.xxhash64("evidence_id"), F.lit(blocks)) == b).groupBy(F.lit(0).alias("k")).agg(F.collect_list(F.struct("evidence_id", "needle")).alias("all"))
        met = texts.select("doc_id", F.col("text").alias("body"), F.lit(0).alias("k")).join(F.broadcast(own), "k")  # one row
        hit = met.select("doc_id", F.explode(F.filter("all", lambda x: F.contains(F.col("body"), x["needle"]))).alias("x"))
        found = found.unionByName(hit.select("x.evidence_id", "doc_id"))
    return found


def chunk_matches(spans: DataFrame, chunk_spans: DataFrame) -> DataFrame:
    """(evidence_id, span, chunk_id, coverage, start, end): chunks that overlap a span, with the covered hull in it.

    chunk_spans: (chunk_id, doc_id, c_start, c_end), one row for each fragment. A chunk's fragments count by their hull.
    """
    met = spans.join(chunk_spans, "doc_id").where((F.col("c_start") < F.col("end")) & (F.col("start") < F.col("c_end")))
    lo, hi = F.greatest("c_start", "start") - F.col("start"), F.least("c_end", "end") - F.col("start")
    parts = met.select("evidence_id", "doc_id", "span", "chunk_id", F.col("start").alias("from"), F.col("end").alias("to"), lo.alias("start"), hi.alias("end"), F.lit(0).alias("low"), (F.col("end") - F.col("start")).alias("high"))
    covered = coverage(parts, ["evidence_id", "span", "chunk_id"])
    hull = parts.groupBy("evidence_id", "span", "chunk_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("high").alias("length"))
    return hull.join(covered, ["evidence_id", "span", "chunk_id"]).select("evidence_id", "span", "chunk_id", F.least(F.lit(1.0), F.col("covered") / F.col("length")).alias("coverage"), "start", "end", "length")


def best_matches(matches: DataFrame) -> DataFrame:
    """For each evidence and chunk its best place: the largest coverage, the first among equals."""
    key = F.struct(F.col("coverage"), (-F.col("span")).alias("first"))
    return matches.groupBy("evidence_id", "chunk_id").agg(F.max_by(F.struct("coverage", "start", "end", "length"), key).alias("m")).select("evidence_id", "chunk_id", "m.*")


def text_matches(evidence: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Second chance: chunks of the document whose normal form holds that of an evidence without any match."""
    missing = evidence.join(found.select("evidence_id").distinct(), "evidence_id", "left_anti")
    met = missing.select("evidence_id", "doc_id", canonical_form("text").alias("needle")).join(chunks.select("doc_id", "chunk_id", canonical_form("text").alias("body")), "doc_id")
    return met.where(F.contains("body", "needle") & (F.col("needle") != "")).select("evidence_id", "chunk_id", F.lit(1.0).alias("coverage"), F.lit("normalized_text").alias("method"))


def unit_coverage(matches: DataFrame) -> DataFrame:
    """(evidence_id, coverage): the best place's union over all chunks, or the best single chunk if that is more."""
    parts = matches.select("evidence_id", "span", "start", "end", F.lit(0).alias("low"), F.col("length").alias("high"))
    joined = coverage(parts, ["evidence_id", "span"]).join(matches.select("evidence_id", "span", "length").distinct(), ["evidence_id", "span"])
    union = joined.groupBy("evidence_id").agg(F.max(F.col("covered") / F.col("length")).alias("u"))
    single = matches.groupBy("evidence_id").agg(F.max("coverage").alias("c"))
    return union.join(single, "evidence_id").select("evidence_id", F.least(F.lit(1.0), F.greatest("u", "c")).alias("coverage"))


def retrieved_coverage(matches: DataFrame, selected: DataFrame, strict: bool = False) -> DataFrame:
    """(query_id, evidence_id, coverage) of the chunks a query selected.

    matches: best_matches; selected: (query_id, chunk_id). The whole is the furthest end any match reaches, not the
    evidence's length, so it reads high where no chunk holds the tail; strict takes the length.
    """
    whole = matches.groupBy("evidence_id").agg(F.max("length" if strict else "end").alias("high"))
    met = matches.join(selected.select("query_id", "chunk_id").distinct(), "chunk_id").join(whole, "evidence_id")
    parts = met.select("query_id", "evidence_id", "start", "end", F.lit(0).alias("low"), "high")
    done = coverage(parts, ["query_id", "evidence_id"]).join(whole, "evidence_id")
    return done.select("query_id", "evidence_id", F.least(F.lit(1.0), F.col("covered") / F.col("high")).alias("coverage"))


def evidence_metrics(coverages: DataFrame, by: list[str]) -> DataFrame:
    """Units, covered units, mean coverage, and whether all are covered; coverages lie in [0, 1]."""
    return coverages.groupBy(*by).agg(
        F.count("*").alias("units"),
        F.sum(F.when(F.col("coverage") >= 1.0, 1).otherwise(0)).alias("covered_units"),
        F.avg("coverage").alias("evidence_coverage"),
        F.min(F.when(F.col("coverage") >= 1.0, 1).otherwise(0)).alias("all_covered"),
    )


def evidence_macro(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("evidence_coverage").alias("evidence_coverage"), F.avg("all_covered").alias("all_evidence_rate"))


def fixed_chunk_spans(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, c_start, c_end): character spans of token windows, which carry them."""
    return chunks.select("chunk_id", "doc_id", F.col("char_start").alias("c_start"), F.col("char_end").alias("c_end"))


def fragment_spans(chunks: DataFrame, block_rows: DataFrame) -> DataFrame:
    """Character spans of chunks made of block fragments, in the document's linear text."""
    f = chunks.select("chunk_id", "doc_id", F.explode("fragments").alias("f")).select("chunk_id", "doc_id", "f.block_index", "f.char_start", "f.char_end")
    offsets = block_rows.select(F.col("doc_id").cast("string").alias("doc_id"), "block_index", "char_offset")
    return f.join(offsets, ["doc_id", "block_index"]).select("chunk_id", "doc_id", (F.col("char_offset") + F.col("char_start")).alias("c_start"), (F.col("char_offset") + F.col("char_end")).alias("c_end"))


def section_matches(evidence: DataFrame, chunks: DataFrame, joiner: str = " > ") -> DataFrame:
    """Evidence named by a section path: chunks whose path equals it or ends with it. evidence: (evidence_id, doc_id, path)."""
    met = evidence.join(chunks.select("doc_id", "chunk_id", F.array_join("title_path", joiner).alias("own")), "doc_id")
    return met.where((F.col("own") == F.col("path")) | F.endswith("own", F.concat(F.lit(joiner), F.col("path")))).select("evidence_id", "chunk_id", F.lit(1.0).alias("coverage"), F.lit("section_path").alias("method"))
