"""Queries of question datasets, their resolution and repair, of caches, contexts and answers, and of whole benchmarks.

As in `markdown_queries`, what the tables do not hold is set up from their words, and the SQL states what must come of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vector import hashed_embedding, is_valid
from tessera.operators import answers, audit, chunking, context, evidence, metrics, parsing, providers, reconciliation, retrieval, statistics
from tessera.plans import benchmarks, experiments
from tessera.plans.catalog import BM25, DENSE, HITS, PAIRED, RANKS, SPANS, TURNS, WORD, char_windows, corpus, deltas, dense, evaluated, hits, passage_evidence, passages, query, r6, relevance, rounded, spans, table, texts, turns
from tessera.plans.markdown_queries import BLOCKS, FIXED, LINEAR, NAME, PATHS, TITLES, WORDS, filled, fixed, page_words, parsed, sql
from tessera.session import scratch_folder
from tessera.sources import artifacts, files
from tessera.sources.answered import AnswerStore

# --- question datasets, written and read again -----------------------------------------------------------------------


def written(spark, rows: DataFrame) -> str:
    """rows as JSON lines in a new folder, whose name ends as such."""
    path = scratch_folder(spark) + ".jsonl"
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


def team_records(spark, sf_dir) -> DataFrame:
    """A question for every document, with one or two items of evidence."""
    item = lambda n, *s: F.struct(F.concat(F.lit(f"e{n}-"), "id").alias("evidence_id"), F.concat(F.lit("corpus:"), "id").alias("doc_id"), F.array(F.lit("A"), F.col("w1")).alias("section_path"), F.array(*map(filled, s)).alias("evidence_sentences"))
    two = F.col("doc_id") % 2 == 0
    items = F.when(two, F.array(item(1, "{w1} {w2}", "{w3}"), item(2, "{w4} {w5}"))).otherwise(F.array(item(1, "{w1} {w2}", "{w3}")))
    meta = F.struct(F.lit("local").alias("evidence_scope"), F.size(items).alias("num_evidence"), F.lit(False).alias("semantic_competition"), F.lit("prose").alias("content_type"), F.lit(True).alias("answerable_from_evidence"))
    return page_words(spark, sf_dir).select(
        F.concat(F.lit("q"), "id").alias("question_id"), filled("What of {w1}?").alias("question"), filled("{w2} \"it\" é").alias("reference_answer"),
        F.lit("easy").alias("difficulty"), F.col("lang").alias("question_type"), F.lit("single").alias("reasoning_type"), items.alias("evidence"), meta.alias("metadata"),
    )


@query(f"""WITH {WORDS} SELECT 'q' || id AS question_id, 'What of ' || w1 || '?' AS question, w2 || ' "it" é' AS answer, lang AS question_type, 'local' AS scope, 2 - (doc_id % 2)::INT AS items FROM w""")
def qa_team_questions(spark, sf_dir):
    rows = files.load_team_questions(spark, written(spark, team_records(spark, sf_dir)))
    return rows.select("question_id", "question", "answer", "question_type", "scope", F.size("evidence").alias("items"))


@query(f"""WITH {WORDS} SELECT 'q' || id AS question_id, 'e1-' || id || ':sentence:0' AS evidence_id, 'corpus:' || id AS doc_id, w1 || ' ' || w2 AS text FROM w
UNION ALL SELECT 'q' || id, 'e1-' || id || ':sentence:1', 'corpus:' || id, w3 FROM w
UNION ALL SELECT 'q' || id, 'e2-' || id || ':sentence:0', 'corpus:' || id, w4 || ' ' || w5 FROM w WHERE doc_id % 2 = 0""")
def qa_evidence_units(spark, sf_dir):
    return files.evidence_units(files.load_team_questions(spark, written(spark, team_records(spark, sf_dir))))


def legacy_records(spark, sf_dir) -> DataFrame:
    spec = F.array(F.struct(filled("{w1} {w2}").alias("text"), F.lit(0).alias("block_index")))
    return page_words(spark, sf_dir).select(F.concat(F.lit("l"), "id").alias("id"), F.concat(F.lit("corpus:"), "id").alias("doc_id"), filled("Where is {w3}?").alias("question"), F.col("w4").alias("answer"), spec.alias("evidence_sentences"), F.array().cast("array<string>").alias("evidence_sections"), F.lit("fact").alias("question_type"), F.lit("easy").alias("difficulty"))


@query(f"""WITH {WORDS} SELECT 'l' || id AS id, 'corpus:' || id AS doc_id, 'Where is ' || w3 || '?' AS question, w4 AS answer, w1 || ' ' || w2 AS text, 0 AS block_index, NULL::INT AS char_start FROM w""")
def qa_legacy_questions(spark, sf_dir):
    known = table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus:"), F.col("doc_id").cast("string")).alias("doc_id"))
    rows = files.load_questions(spark, written(spark, legacy_records(spark, sf_dir)), known)
    return rows.select("id", "doc_id", "question", "answer", F.explode("evidence_sentences").alias("e")).select("id", "doc_id", "question", "answer", "e.text", "e.block_index", "e.char_start")


@query("SELECT 'q' || item_id AS query_id, text AS query, ['s' || (item_id % 3), 't'] AS relevant_sources FROM benchmark")
def qa_retrieval_dataset(spark, sf_dir):
    known = spark.createDataFrame([("s0",), ("s1",), ("s2",), ("t",)], "source string")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"), F.lit("c").alias("category"), F.array(F.lit("t"), F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string")), F.lit("t")).alias("relevant_sources"))
    return files.load_retrieval_dataset(spark, written(spark, rows), known).select("query_id", "query", "relevant_sources")


@query("SELECT item_id::VARCHAR AS query_id, text AS query, CASE WHEN item_id % 2 = 0 THEN text ELSE 'short ' || item_id END AS rewrite FROM benchmark")
def qa_rewrites(spark, sf_dir):
    rows = passages(spark, sf_dir).select(F.col("query_id").cast("string").alias("query_id"), "query")
    made = rows.select("query_id", "query", F.when(F.col("query_id").cast("int") % 2 == 0, F.col("query")).otherwise(F.concat(F.lit("short "), "query_id")).alias("rewrite"), F.lit("rewritten").alias("status"))
    return files.load_rewrites(spark, written(spark, made), rows).select("query_id", "query", "rewrite")


@query("SELECT conv_id, turn, 3 AS fields, md5(text) AS text_md5 FROM conversations")
def qa_raw_records(spark, sf_dir):
    rows = files.raw_records(spark, written(spark, table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")))
    return rows.select(F.get_json_object("value", "$.conv_id").cast("long").alias("conv_id"), F.get_json_object("value", "$.turn").cast("long").alias("turn"), F.size("fields").alias("fields"), F.md5(F.get_json_object("value", "$.text")).alias("text_md5"))


@query("SELECT lang AS value, 'lang' AS field, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT source, 'source', count(*) FROM documents GROUP BY source")
def value_distribution(spark, sf_dir):
    return audit.value_distribution(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def sliced_run(spark, sf_dir):
    """The part of a run in parts that takes a hundred documents behind the first fifty."""
    return files.sliced(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50, 100)


# --- artifact sets ---------------------------------------------------------------------------------------------------


@query(f"WITH {FIXED} SELECT {NAME}, token_end - token_start AS token_count, md5(substr(body, char_start + 1, char_end - char_start)) AS text_md5 FROM chunks")
def published_chunks(spark, sf_dir):
    """Chunks published as a set, replaced by a second publication of the same identity, and read back with its checks."""
    path, identity = scratch_folder(spark), {"strategy": "fixed", "size": 128, "overlap": 16}
    rows = fixed(spark, sf_dir).withColumn("strategy", F.lit("fixed"))
    artifacts.publish(spark, path, {"chunks": rows.where("chunk_index = 0")}, identity)
    artifacts.publish(spark, path, {"chunks": rows}, identity)
    got = artifacts.load(spark, path, "chunks", identity, unique=["chunk_id"], single="strategy")
    return got.select("chunk_id", "token_count", F.md5("text").alias("text_md5"))


@query("SELECT vec_id AS chunk_id, label::VARCHAR AS source, 64 AS dimension FROM embeddings")
def published_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), F.lit("full").alias("strategy"), F.col("vec_id").cast("string").alias("doc_id"), F.col("label").cast("string").alias("source"), F.lit(40).alias("token_count"))
    path, settings = scratch_folder(spark), {"model": "given"}
    benchmarks.build_index(spark, path, chunks, rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), settings, 64)
    return benchmarks.load_index(spark, path, settings, 64).select("chunk_id", "source", F.size("vector").alias("dimension"))


@query("SELECT '{\"doc_id\":' || doc_id || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"n_chars\":' || n_chars || '}' AS value FROM documents")
def canonical_lines(spark, sf_dir):
    return artifacts.json_lines_of(table(spark, sf_dir, "documents").select("n_chars", "lang", "doc_id"), ["doc_id"])


# --- resolution ------------------------------------------------------------------------------------------------------


def references(spark, sf_dir) -> DataFrame:
    """How evidence names its document: by its id, without its namespace, by no known name, by one that two namespaces have."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    kind = F.col("doc_id") % 4
    ref = F.when(kind == 0, F.concat(F.lit("corpus:"), "id")).when(kind == 1, F.col("id")).when(kind == 2, F.concat(F.lit("none/"), "id")).otherwise(F.concat(F.lit("both/"), "id"))
    return rows.select("id", ref.alias("ref"))


def named_documents(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return rows.select(F.explode(F.array(F.concat(F.lit("corpus:"), "id"), F.concat(F.lit("a:both/"), "id"), F.concat(F.lit("b:both/"), "id"))).alias("doc_id"))


@query("""SELECT doc_id::VARCHAR AS evidence_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'corpus:' || doc_id END AS doc_id, CASE doc_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'namespace' WHEN 2 THEN 'unresolved' ELSE 'ambiguous' END AS method FROM documents""")
def document_resolution(spark, sf_dir):
    wanted = references(spark, sf_dir).select(F.col("id").alias("evidence_id"), "ref")
    return audit.resolve_documents(wanted, named_documents(spark, sf_dir)).select("evidence_id", "doc_id", "method")


def section_rows(spark, sf_dir) -> DataFrame:
    """(doc_id, section, path) of the pages' headings, and one path that two sections have."""
    rows = page_words(spark, sf_dir)
    paths = [(i, F.array(*[filled(TITLES[k]) for k in p])) for i, p in enumerate(PATHS)] + [(9, F.array(F.lit("Twice"))), (10, F.array(F.lit("Twice")))]
    return rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("section"), p.alias("path")) for i, p in paths])).alias("s")).select("doc_id", "s.*")


def section_wishes(spark, sf_dir) -> DataFrame:
    kind = F.col("doc_id") % 6
    full = F.array(filled(TITLES[0]), filled(TITLES[1]))
    shouted = F.array(F.concat(F.lit("**"), F.upper("w1"), F.lit("  GUIDE** {#x}")), F.concat(F.lit("PART "), F.upper("w5"), F.lit(" "), F.col("w6")))
    path = F.when(kind == 0, full).when(kind == 1, F.array(filled(TITLES[1]))).when(kind == 2, shouted).when(kind == 3, F.array(F.concat(F.lit("part "), "w5", F.lit(" "), "w6"))).when(kind == 4, F.array(F.lit("Twice"))).otherwise(F.array(F.lit("Nowhere 0")))
    return page_words(spark, sf_dir).select(F.col("id").alias("evidence_id"), "doc_id", path.alias("path"))


@query("""SELECT doc_id::VARCHAR AS evidence_id, CASE WHEN doc_id % 6 < 4 THEN 1 END AS section, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 1 END AS tier, CASE doc_id % 6 WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'unresolved' ELSE 'resolved' END AS status FROM documents""")
def section_resolution(spark, sf_dir):
    return audit.resolve_sections(section_wishes(spark, sf_dir), section_rows(spark, sf_dir))


def linear_pages(spark, sf_dir) -> DataFrame:
    return parsed(spark, sf_dir).select("doc_id", parsing.linear_text(F.col("blocks")).alias("text"))


def sentence_wishes(spark, sf_dir) -> DataFrame:
    kind = F.col("doc_id") % 5
    said = F.when(kind == 0, filled("Inside {w4} step.")).when(kind == 1, F.upper(filled("Inside {w4}  step."))).when(kind == 2, filled("{w2} {w3} {w4} ends.")).when(kind == 3, F.lit(" | ")).otherwise(F.lit("0 stands nowhere 0"))
    return page_words(spark, sf_dir).select(F.col("id").alias("evidence_id"), "doc_id", said.alias("sentence"))


SENTENCES = f"""{LINEAR}, wishes AS (SELECT doc_id, text, w4, CASE doc_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' WHEN 2 THEN 'rendered' WHEN 3 THEN 'ambiguous' ELSE 'unresolved' END AS method,
  CASE doc_id % 5 WHEN 0 THEN instr(text, 'Inside ' || w4 || ' step.') - 1 WHEN 1 THEN instr(text, 'Inside ' || w4 || ' step.') - 1 WHEN 2 THEN instr(text, w2 || ' ' || w3 || ' [') - 1 WHEN 3 THEN instr(text, ' | ') - 1 END AS start FROM linear JOIN w USING (doc_id))"""


@query(f"WITH {SENTENCES} SELECT doc_id::VARCHAR AS evidence_id, method, start FROM wishes")
def md_sentence_resolution(spark, sf_dir):
    """Sentences as they stand, in other letters and blanks, as a reader sees them, found twice, and not at all."""
    return audit.resolve_sentences(sentence_wishes(spark, sf_dir), linear_pages(spark, sf_dir)).select("evidence_id", "method", "start")


@query(f"WITH {LINEAR} SELECT doc_id::VARCHAR AS evidence_id, CASE WHEN doc_id % 2 = 0 THEN 'exact' ELSE 'unresolved' END AS method FROM linear")
def sentence_in_section(spark, sf_dir):
    """A sentence is looked for in its section only: half of the sections end before it."""
    rows = linear_pages(spark, sf_dir).join(page_words(spark, sf_dir), "doc_id")
    at = F.instr(F.col("text"), filled("Inside {w4} step.")) - 1
    end = F.when(F.col("doc_id") % 2 == 0, F.length("text")).otherwise(at + 3)
    wanted = rows.select(F.col("id").alias("evidence_id"), "doc_id", filled("Inside {w4} step.").alias("sentence"), F.greatest(at - 2, F.lit(0)).alias("section_start"), end.alias("section_end"))
    return audit.resolve_sentences(wanted, rows.select("doc_id", "text")).select("evidence_id", "method")


@query(f"""WITH {SPANS}, n AS (SELECT evidence_id, doc_id, count(*) AS n, min("start") AS "start", min("end") AS "end" FROM spans GROUP BY ALL)
SELECT evidence_id, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'exact' END AS method, "start"::BIGINT AS "start", "end"::BIGINT AS "end", n FROM n""")
def sentence_resolution(spark, sf_dir):
    """How benchmark passages are found in the documents that hold them."""
    places = evidence.find_everywhere(passage_evidence(spark, sf_dir), texts(spark, sf_dir))
    wanted = places.join(passage_evidence(spark, sf_dir).withColumnRenamed("text", "sentence"), "evidence_id")
    return audit.resolve_sentences(wanted, texts(spark, sf_dir))


GATE = """problems AS (SELECT doc_id::VARCHAR AS evidence_id, 'document' AS stage, CASE doc_id % 4 WHEN 2 THEN 'unresolved' ELSE 'ambiguous' END AS problem FROM documents WHERE doc_id % 4 > 1
UNION ALL SELECT doc_id::VARCHAR, 'section', CASE doc_id % 6 WHEN 4 THEN 'ambiguous' ELSE 'unresolved' END FROM documents WHERE doc_id % 6 > 3
UNION ALL SELECT doc_id::VARCHAR, 'sentence', CASE doc_id % 5 WHEN 3 THEN 'ambiguous' ELSE 'unresolved' END FROM documents WHERE doc_id % 5 > 2)"""


def gate(spark, sf_dir) -> DataFrame:
    wanted = references(spark, sf_dir).select(F.col("id").alias("evidence_id"), "ref")
    documents = audit.resolve_documents(wanted, named_documents(spark, sf_dir))
    sections = audit.resolve_sections(section_wishes(spark, sf_dir), section_rows(spark, sf_dir))
    return audit.compatibility_gate(documents, sections, audit.resolve_sentences(sentence_wishes(spark, sf_dir), linear_pages(spark, sf_dir)))


@query(f"WITH {GATE} SELECT * FROM problems")
def compatibility_gate(spark, sf_dir):
    return gate(spark, sf_dir)


@query(f"WITH {GATE} SELECT (SELECT count(*) FROM documents) AS evidence, count(DISTINCT evidence_id) AS failed, 'FAIL' AS verdict FROM problems")
def compatibility_verdict(spark, sf_dir):
    return audit.gate_verdict(references(spark, sf_dir).withColumnRenamed("id", "evidence_id"), gate(spark, sf_dir))


@query("""SELECT doc_id::VARCHAR AS evidence_id, 'ERROR' AS severity, 'provenance' AS problem FROM documents WHERE doc_id % 3 = 0 AND length(text) >= 20
UNION ALL SELECT doc_id::VARCHAR, 'WARNING', 'text' FROM documents WHERE doc_id % 7 = 0 AND length(text) >= 20""")
def dataset_problems(spark, sf_dir):
    """Evidence cut from its document: some with a span one off, some with a text that the document has not."""
    docs = texts(spark, sf_dir)
    long = docs.where(F.length("text") >= 20)
    wrong = F.col("doc_id") % 7 == 0
    body = F.when(wrong, F.lit("0 stands nowhere 0")).otherwise(F.substring("text", 1, 12))
    shift = F.when((F.col("doc_id") % 3 == 0), 30_000_000).otherwise(0)
    start = F.when(wrong & (shift == 0), F.lit(None).cast("int")).otherwise(shift)
    rows = long.select(F.col("doc_id").cast("string").alias("evidence_id"), "doc_id", body.alias("text"), start.cast("int").alias("char_start"), (start + 12).cast("int").alias("char_end"))
    return audit.dataset_problems(rows, docs)


# --- repair ----------------------------------------------------------------------------------------------------------

#: What a page's blocks are cut into, besides their text as a whole.
UNITS = {1: ['{w2} {w3} [{w4}](http://x/{w5} "{w6}") ends.', "The {w4} line two."], 3: ["- {w6} one", "- {w7} two", "1. nested {w8}"], 4: ["| Name | Value |", "|:---|---:|", "| {w9} | a \\| b |", "| {w10} |"], 7: ["{w13} quoted.", "Again.", "And more."]}
PATH_OF = [[0]] * 2 + [[0, 1]] * 8 + [[0, 1, 2]] * 2 + [[0, 1, 2, 3]] * 2


@query(f"WITH {WORDS}, u AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS block_index, {sql(u)} AS text, {f"length({sql(b[1][: b[1].index(u)])})" if b[1].index(u) else 0} AS char_start, {sql(' > '.join(TITLES[k] for k in PATH_OF[i]))} AS path FROM w" for i, b in enumerate(BLOCKS) for u in [*UNITS.get(i, []), b[1]]) + ") SELECT DISTINCT doc_id, block_index, char_start::INT AS char_start, text, path FROM u")
def source_units(spark, sf_dir):
    rows = reconciliation.source_units(parsed(spark, sf_dir))
    return rows.select("doc_id", "block_index", "char_start", "text", F.array_join("section_path", " > ").alias("path"))


def near_sentences(spark, sf_dir) -> DataFrame:
    """A sentence of the page with one letter more."""
    return page_words(spark, sf_dir).select(F.col("id").alias("evidence_id"), "doc_id", filled("Inside {w4} steps.").alias("sentence"))


@query(f"""WITH {WORDS}, s AS (SELECT doc_id, 13 + length(w4) AS n FROM w) SELECT doc_id::VARCHAR AS evidence_id, round(2 * n / (2 * n + 1), 6) AS ratio, CASE WHEN 2 * n / (2 * n + 1) >= 0.95 THEN 'evidence_text_normalization_issue' ELSE 'evidence_sentence_missing' END AS root_cause FROM s""")
def root_causes(spark, sf_dir):
    units = reconciliation.source_units(parsed(spark, sf_dir)).select("doc_id", "text")
    return rounded(reconciliation.root_causes(near_sentences(spark, sf_dir), units))


@query(f"""WITH {WORDS}, s AS (SELECT w.*, 13 + length(w4) AS n FROM w)
SELECT doc_id::VARCHAR AS evidence_id, 9 AS block_index, 'Inside ' || w4 || ' step.' AS text, round(0.55 * (2 * n / (2 * n + 1)) + 0.35 * (4 / 6), 6) AS score, 'Referenced code: ' || w2 AS previous_block, 'Deep ' || w14 AS next_block,
  CASE WHEN round(0.55 * (2 * n / (2 * n + 1)) + 0.35 * (4 / 6), 6) >= 0.68 THEN 'medium' ELSE 'none' END AS confidence FROM s""")
def text_candidates(spark, sf_dir):
    found = reconciliation.text_candidates(near_sentences(spark, sf_dir), reconciliation.source_units(parsed(spark, sf_dir)))
    best = F.first(F.when(F.col("rank") == 1, F.struct("block_index", "text", "score", "previous_block", "next_block")), ignorenulls=True)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    lead = found.groupBy("evidence_id").agg(best.alias("b"), at(1).alias("first"), at(2).alias("second"))  # read once
    return lead.select("evidence_id", "b.*", reconciliation.text_confidence(F.col("first"), F.col("second")).alias("confidence"))


@query(f"""WITH {WORDS} SELECT doc_id::VARCHAR AS evidence_id, 2 AS heading_block_index, 14 AS section_block_end, 1 AS evidence_hits FROM w""")
def section_candidates(spark, sf_dir):
    """The section that holds the sentence and whose title is the path; the page's first section holds it too."""
    wanted = page_words(spark, sf_dir).select(F.col("id").alias("evidence_id"), "doc_id", F.array(filled(TITLES[1])).alias("path"), F.array(filled("Inside {w4} step.")).alias("sentences"))
    found = reconciliation.section_candidates(wanted, reconciliation.source_sections(parsed(spark, sf_dir)))
    return found.where("rank = 1").select("evidence_id", "heading_block_index", "section_block_end", "evidence_hits")


CASES = """
c AS (SELECT doc_id, doc_id::VARCHAR AS id, doc_id % 6 AS kind, (doc_id * 37 % 101) / 100 AS first, (doc_id * 53 % 101) / 100 * ((doc_id * 37 % 101) / 100) AS second, doc_id % 3 AS hits, doc_id % 2 AS other FROM documents),
t AS (SELECT *, CASE WHEN first - second >= 0.03 AND first >= 0.95 THEN 'high' WHEN first - second >= 0.03 AND first >= 0.68 THEN 'medium' ELSE 'none' END AS sure, first >= 0.88 AND first - second >= 0.03 AS exact,
  CASE WHEN hits > other THEN 'high' WHEN first >= 0.72 AND first - second >= 0.08 THEN 'medium' ELSE 'none' END AS section FROM c),
cases AS (SELECT *, CASE WHEN kind = 0 AND section = 'high' THEN 'dataset_section_path_error' WHEN kind = 0 THEN 'ambiguous_source_content' WHEN kind = 1 AND section <> 'none' THEN 'dataset_section_path_error' WHEN kind = 1 THEN 'dataset_from_different_corpus_version'
    WHEN kind IN (2, 3) AND exact THEN 'dataset_evidence_not_source_exact' WHEN kind > 1 AND sure <> 'none' THEN 'dataset_evidence_paraphrase' ELSE 'dataset_from_different_corpus_version' END AS classification,
  CASE WHEN kind = 0 AND section = 'high' THEN 'high' WHEN kind = 0 THEN 'none' WHEN kind = 1 THEN section WHEN kind IN (2, 3) AND exact THEN 'high' WHEN kind > 1 AND sure <> 'none' THEN 'medium' ELSE 'none' END AS confidence,
  CASE WHEN kind = 0 AND section = 'high' THEN 'P1' WHEN kind = 0 THEN 'P4' WHEN kind = 1 AND section = 'high' THEN 'P1' WHEN kind IN (2, 3) AND exact THEN 'P1' ELSE 'P3' END AS priority,
  CASE WHEN kind < 2 THEN 'support_unclear' WHEN first >= 0.8 THEN 'support_likely_unchanged' WHEN first < 0.35 THEN 'possible_answer_drift' ELSE 'support_unclear' END AS support FROM t)"""


def repair(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failures, text candidates, section candidates) with one failure for each document, scores made from its id."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), (F.col("doc_id") % 6).alias("kind"), (F.col("doc_id") * 37 % 101 / 100).alias("first"), (F.col("doc_id") * 53 % 101 / 100).alias("part"), (F.col("doc_id") % 3).cast("int").alias("hits"), (F.col("doc_id") % 2).cast("int").alias("other"))
    root = F.when(F.col("kind") == 0, reconciliation.AMBIGUOUS_SECTION).when(F.col("kind") == 1, reconciliation.SECTION_MISMATCH).when(F.col("kind") < 4, reconciliation.NORMALIZATION).otherwise(reconciliation.MISSING)
    failures = rows.select(F.concat(F.lit("q"), "evidence_id").alias("question_id"), F.col("evidence_id").alias("item_id"), "evidence_id", root.alias("root_cause"))
    second = F.col("part") * F.col("first")
    ranked = lambda *v: F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), *x) for r, x in enumerate(v, 1)]))
    found = rows.select("evidence_id", ranked([F.col("first").alias("score"), F.concat(F.lit("text "), "evidence_id").alias("text")], [second.alias("score"), F.lit("other").alias("text")]).alias("c")).select("evidence_id", "c.*")
    path = lambda x: F.array(F.lit("A"), x).alias("section_path")
    sections = rows.select("evidence_id", ranked([F.col("hits").alias("evidence_hits"), F.col("first").alias("path_score"), path(F.col("evidence_id"))], [F.col("other").alias("evidence_hits"), second.alias("path_score"), path(F.lit("x"))]).alias("c")).select("evidence_id", "c.*")
    return failures, found, sections


@query(f"WITH {CASES} SELECT 'q' || id AS question_id, id AS item_id, classification, confidence, priority, support, (kind > 1)::INT AS sentences FROM cases")
def reconciled_cases(spark, sf_dir):
    return reconciliation.reconcile(*repair(spark, sf_dir)).drop("roots")


@query(f"""WITH {CASES} SELECT 'q' || id AS question_id, id AS evidence_id, CASE WHEN classification = 'dataset_section_path_error' THEN 'section_path' ELSE 'evidence_sentences' END AS field, CASE WHEN classification = 'dataset_section_path_error' THEN 'A > ' || id ELSE 'text ' || id END AS proposed_value, confidence, true AS human_review_required, false AS auto_apply
FROM cases WHERE classification IN ('dataset_section_path_error', 'dataset_evidence_not_source_exact', 'dataset_evidence_paraphrase') AND confidence <> 'none'""")
def correction_proposals(spark, sf_dir):
    failures, found, sections = repair(spark, sf_dir)
    cases = reconciliation.reconcile(failures, found, sections)
    return reconciliation.proposals(cases, failures, found, sections).drop("item_id", "classification")


def page_evidence(spark, sf_dir) -> DataFrame:
    """(question_id, item_id, doc_id, path, sentences): a question for each page, whose sentence has a letter more, whose
    path begins with a title the page does not have, whose sentence is of another text, or which is right."""
    kind = F.col("doc_id") % 5
    path = F.when(kind == 1, F.array(F.lit("Elsewhere"), filled(TITLES[1]))).otherwise(F.array(filled(TITLES[0]), filled(TITLES[1])))
    said = F.when(kind == 0, filled("Inside {w4} steps.")).when(kind == 2, F.lit("§§§ ¶¶¶ ¤¤¤")).when(kind == 3, F.upper(filled("Inside {w4}  step."))).otherwise(filled("Inside {w4} step."))
    return page_words(spark, sf_dir).select(F.concat(F.lit("q"), "id").alias("question_id"), F.col("id").alias("item_id"), "doc_id", path.alias("path"), F.array(said).alias("sentences"))


@query("""SELECT 'q' || doc_id AS question_id, CASE doc_id % 5 WHEN 0 THEN 'dataset_evidence_paraphrase' WHEN 1 THEN 'dataset_section_path_error' ELSE 'dataset_from_different_corpus_version' END AS classification, CASE doc_id % 5 WHEN 2 THEN 'none' ELSE 'medium' END AS confidence, 'P3' AS priority,
CASE doc_id % 5 WHEN 2 THEN 'possible_answer_drift' ELSE 'support_unclear' END AS support, [CASE doc_id % 5 WHEN 0 THEN 'evidence_text_normalization_issue' WHEN 1 THEN 'section_path_mismatch' ELSE 'evidence_sentence_missing' END] AS roots FROM documents WHERE doc_id % 5 < 3""")
def reconciliation_chain(spark, sf_dir):
    """Evidence against pages, from resolution through candidates to cases."""
    found = reconciliation.failures_of(page_evidence(spark, sf_dir), parsed(spark, sf_dir))
    return reconciliation.reconcile(*found).select("question_id", "classification", "confidence", "priority", "support", "roots")


@query(f"""WITH {WORDS} SELECT doc_id::VARCHAR || CASE doc_id % 5 WHEN 0 THEN '#0' ELSE '#path' END AS evidence_id, CASE doc_id % 5 WHEN 0 THEN 'Inside ' || w4 || ' step.' ELSE {sql(TITLES[0] + " > " + TITLES[1])} END AS proposed_value FROM w WHERE doc_id % 5 < 2""")
def chained_proposals(spark, sf_dir):
    """What the chain proposes: the page's own sentence, and the path of the section that holds it."""
    failures, found, sections = reconciliation.failures_of(page_evidence(spark, sf_dir), parsed(spark, sf_dir))
    return reconciliation.proposals(reconciliation.reconcile(failures, found, sections), failures, found, sections).select("evidence_id", "proposed_value")


@query(f"WITH {CASES} SELECT 'q' || id AS question_id, 1::BIGINT AS failed, confidence = 'high' AS fixable FROM cases UNION ALL SELECT 'p' || id, 0::BIGINT, false FROM cases")
def fixable_questions(spark, sf_dir):
    failures, found, sections = repair(spark, sf_dir)
    more = failures.select(F.concat(F.lit("p"), "evidence_id").alias("question_id"))
    return reconciliation.fixable_questions(failures.select("question_id").unionByName(more), reconciliation.reconcile(failures, found, sections))


# --- embeddings, caches, generation ----------------------------------------------------------------------------------

UNIT = "list_transform(e, lambda x: round(x / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6))"


def embedded(column: str, dimension: int) -> str:
    return f"list_transform(range(0, {dimension}), lambda i: (('0x' || substr(sha256({column}), (2 * (i % 32) + 1)::INT, 2))::INT / 255.0::DOUBLE * 2 - 1))"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [0.5, 0.5] ELSE {UNIT} END AS vector FROM (SELECT doc_id, {embedded('text', 2)} AS e, text FROM documents) WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) OR doc_id % 3 = 0")
def cached_embeddings(spark, sf_dir):
    """A cache holds the vectors of every third document's text; documents that share such a text are left to it."""
    docs = texts(spark, sf_dir)
    third = docs.where("doc_id % 3 = 0")
    cache = third.select(F.sha2("text", 256).alias("text_sha256")).distinct().withColumn("vector", F.array(F.lit(0.5), F.lit(0.5)))
    rows = context.embed(docs.join(third.select("text").distinct(), "text", "left_anti").unionByName(third.select("text", "doc_id")), 2, cache=cache)
    return rows.select("doc_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(f"SELECT query_id, cached, CASE WHEN cached THEN [1.0, 0.0] ELSE {UNIT} END AS vector FROM (SELECT item_id AS query_id, item_id % 2 = 0 AS cached, {embedded('trim(text)', 2)} AS e FROM benchmark)")
def cached_queries(spark, sf_dir):
    """Queries with blanks around them; every other one's vector is in the cache, whose keys are apart from the documents'."""
    asked = passages(spark, sf_dir).select("query_id", F.concat(F.lit("  "), F.trim("query"), F.lit("\n")).alias("query"))
    settings = {"model": "hashed", "dimension": 2}
    key = providers.query_key(F.col("query"), settings)
    cache = asked.where("query_id % 2 = 0").select(key.alias("key"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")).dropDuplicates(["key"])
    rows = providers.embed_queries(asked, settings, lambda q: hashed_embedding(q, 2), cache)
    return rows.select("query_id", "cached", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS valid FROM embeddings")
def vector_validation(spark, sf_dir):
    """Vectors as they are, and some too short, with a null, or with what is no number."""
    v, kind = F.col("embedding"), F.col("vec_id") % 5
    bad = F.when(kind == 0, F.slice(v, 1, 63)).when(kind == 1, F.transform(v, lambda x, i: F.when(i != 7, x))).when(kind == 2, F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", is_valid(bad, 64).alias("valid"))


@query(f"""WITH RECURSIVE p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, len(regexp_extract_all(text, '{WORD}')) AS n FROM conversations WHERE text IS NOT NULL AND len(regexp_extract_all(text, '{WORD}')) <= 200),
r AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS batch, n::BIGINT AS used, 1 AS items FROM p WHERE i = 0
  UNION ALL SELECT r.conv_id, p.i, CASE WHEN r.used + p.n <= 200 AND r.items < 5 THEN r.batch ELSE r.batch + 1 END, CASE WHEN r.used + p.n <= 200 AND r.items < 5 THEN r.used + p.n ELSE p.n END, CASE WHEN r.used + p.n <= 200 AND r.items < 5 THEN r.items + 1 ELSE 1 END FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1)
SELECT conv_id, batch, count(*) AS items, max(used) AS tokens FROM r GROUP BY ALL""")
def batch_plan(spark, sf_dir):
    """Turns of a conversation in greedy batches of at most five items and 200 tokens."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").where("text is not null").withColumn("n", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).where("n <= 200").withColumn("i", F.row_number().over(w))
    lists = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("sizes"))
    plan = F.udf(lambda sizes: [{"batch": b, "items": len(x), "tokens": sum(x)} for b, x in enumerate(chunking.batched(sizes, lambda n: n, 200, 5))], "array<struct<batch: bigint, items: bigint, tokens: bigint>>")
    return lists.select("conv_id", F.explode(plan("sizes")).alias("b")).select("conv_id", "b.*")


GENERATED = f"""{HITS},
c AS (SELECT query_id, strategy, string_agg(piece, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT query_id, strategy, rank, '[CONTEXT ' || row_number() OVER (PARTITION BY query_id, strategy ORDER BY rank) || ']' || chr(10) || 'vector ' || chunk_id || ' of class ' || source AS piece FROM hits WHERE rank <= 3) GROUP BY ALL),
p AS (SELECT query_id, strategy, 'Answer from the context.' AS system, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: Which class is vector ' || query_id || '?' || CASE WHEN query_id % 100 = 0 THEN ' Answer in full, and say why.' ELSE '' END AS user FROM c)"""


def generated_prompts(spark, sf_dir):
    some = retrieval.same_top_k(hits(spark, sf_dir), 3, 20).withColumn("text", F.format_string("vector %d of class %s", "chunk_id", "source"))
    asked = relevance(spark, sf_dir).select("query_id", F.concat(F.lit("Which class is vector "), F.col("query_id"), F.when(F.col("query_id") % 100 == 0, F.lit("? Answer in full, and say why.")).otherwise(F.lit("?"))).alias("question"))
    return context.render_contexts(some, 2048), asked


@query(f"WITH {GENERATED} SELECT query_id, strategy, sha256(system || chr(30) || user) AS key, 'Deterministic answer ' || substr(sha256(system || chr(30) || user), 1, 16) AS answer, false AS cached FROM p")
def generated_answers(spark, sf_dir):
    """Contexts of the top three hits, prompts within a window, and the offline provider's answers."""
    contexts, asked = generated_prompts(spark, sf_dir)
    ready, _ = context.prompts(contexts, asked, "Answer from the context.", 8192, 512)
    return context.generate(ready)


@query(f"""WITH {GENERATED}, k AS (SELECT query_id, strategy, sha256(system || chr(30) || user) AS h FROM p)
SELECT query_id, strategy, CASE WHEN h < '8' THEN 'Deterministic answer ' ELSE 'Second run ' END || substr(h, 1, 16) AS answer, 'StaleArtifactError BusyError' AS refused FROM k""")
def generation_resume(spark, sf_dir):
    """A run whose provider fails for half of the requests, taken up by a second one that asks only these; in between, a run
    of other settings and one beside a writer that holds the folder are refused."""
    contexts, asked = generated_prompts(spark, sf_dir)
    ready, _ = context.prompts(contexts, asked, "Answer from the context.", 8192, 512)
    path, settings = f"{scratch_folder(spark)}/generation", {"model": "offline"}
    sometimes = lambda request: F.when(F.sha2(request, 256) < "8", context.hashed_answer(request))
    experiments.run_generation(spark, path, ready, settings, sometimes, batch_requests=100)
    refused = []
    try:
        experiments.run_generation(spark, path, ready, {"model": "other"})
    except ValueError as e:
        refused.append(type(e).__name__)
    holder = AnswerStore(spark, f"{path}/asked", artifacts.read_json(spark, f"{path}/asked", "identity.json")["identity"])
    with holder.lease():
        try:
            experiments.run_generation(spark, path, ready, settings)
        except RuntimeError as e:
            refused.append(type(e).__name__)
    experiments.run_generation(spark, path, ready, settings, lambda request: F.concat(F.lit("Second run "), F.substring(F.sha2(request, 256), 1, 16)))
    return artifacts.load(spark, path, "answers", settings).select("query_id", "strategy", "answer", F.lit(" ".join(refused)).alias("refused"))


@query(f"WITH {GENERATED} SELECT query_id, strategy, len(regexp_extract_all(system, '{WORD}')) + len(regexp_extract_all(user, '{WORD}')) + 11 AS input_tokens, 'input overflow' AS failure FROM p WHERE len(regexp_extract_all(system, '{WORD}')) + len(regexp_extract_all(user, '{WORD}')) + 11 + 20 > 77")
def prompt_overflows(spark, sf_dir):
    """Prompts that a window of 77 tokens, 20 of them for the answer, does not hold."""
    contexts, asked = generated_prompts(spark, sf_dir)
    return context.prompts(contexts, asked, "Answer from the context.", 77, 20)[1]


@query(f"WITH {HITS} SELECT query_id, strategy, 'count' AS problem FROM (SELECT DISTINCT query_id, strategy FROM hits) WHERE query_id % 100 = 0 AND strategy = 'full'")
def handoff_errors(spark, sf_dir):
    """Selections against their candidates and accounts, after one hit of some is lost."""
    pool = hits(spark, sf_dir)
    folded = retrieval.same_token_budget(pool, 1024, 20)
    chosen = folded.select("query_id", "strategy", F.explode("selected").alias("s")).select("query_id", "strategy", "s.*")
    lost = (F.col("query_id") % 100 == 0) & (F.col("strategy") == "full") & (F.col("rank") == 1)
    return benchmarks.handoff_errors(chosen.where(~lost), pool, folded)


@query(f"WITH {HITS} SELECT query_id, strategy, sha256('[' || string_agg('{{\"rank\":' || rank || ',\"chunk_id\":\"' || chunk_id || '\",\"text_sha256\":\"' || sha256('vector ' || chunk_id) || '\"}}', ',' ORDER BY rank) || ']') AS fingerprint FROM hits WHERE rank <= 3 GROUP BY ALL")
def context_fingerprints(spark, sf_dir):
    some = retrieval.same_top_k(hits(spark, sf_dir), 3, 20).withColumn("text", F.format_string("vector %d", "chunk_id"))
    return benchmarks.context_fingerprints(some)


# --- rankings --------------------------------------------------------------------------------------------------------

SPARSE = f"""{HITS}, sparse AS (SELECT * FROM hits WHERE score >= CASE WHEN strategy = 'full' THEN 0.3 ELSE 0.45 END),
asked AS (SELECT query_id, strategy, source AS wanted FROM relevance, (SELECT unnest(['full', 'half']) AS strategy)),
found AS (SELECT a.query_id, a.strategy, min(h.rank) FILTER (h.source = a.wanted) AS first_rank, coalesce(max((h.source = a.wanted AND h.rank <= 5)::INT), 0) AS hit_5, count(h.rank) AS n FROM asked a LEFT JOIN sparse h USING (query_id, strategy) GROUP BY ALL)"""


def sparse(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Hits of some score only, so that some queries find nothing; and everything that was asked."""
    rows = hits(spark, sf_dir).where(F.col("score") >= F.when(F.col("strategy") == "full", 0.3).otherwise(0.45))
    return rows, metrics.asked_of(relevance(spark, sf_dir).select("query_id"), ["full", "half"])


@query(f"WITH {SPARSE} SELECT query_id, strategy, first_rank, hit_5, hit_5::DOUBLE AS recall_5, round(coalesce(1.0 / first_rank, 0), 6) AS reciprocal_rank FROM found")
def sparse_ranking_metrics(spark, sf_dir):
    rows, asked = sparse(spark, sf_dir)
    return rounded(metrics.per_query(rows, relevance(spark, sf_dir), asked=asked).select("query_id", "strategy", "first_rank", "hit_5", "recall_5", "reciprocal_rank"))


@query(f"WITH {SPARSE} SELECT strategy, count(*) AS queries, round(avg(hit_5), 6) AS hit_5, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM found GROUP BY 1")
def sparse_means(spark, sf_dir):
    rows, asked = sparse(spark, sf_dir)
    return rounded(metrics.macro(metrics.per_query(rows, relevance(spark, sf_dir), asked=asked), ["strategy"]).select("strategy", "queries", "hit_5", "mrr"))


@query(f"WITH {SPARSE}, u AS (SELECT a.query_id, a.strategy, count(DISTINCT h.source) AS unique_sources, count(h.rank) - count(DISTINCT h.source) AS duplicates FROM asked a LEFT JOIN (SELECT * FROM sparse WHERE rank <= 10) h USING (query_id, strategy) GROUP BY ALL) SELECT * FROM u")
def sparse_depth_metrics(spark, sf_dir):
    rows, asked = sparse(spark, sf_dir)
    return metrics.depth_metrics(rows, relevance(spark, sf_dir), 10, asked=asked).select("query_id", "strategy", "unique_sources", "duplicates")


@query(f"""WITH {SPARSE}, r AS (SELECT query_id, strategy, min(first_rank) AS r FROM found WHERE n > 0 GROUP BY ALL), q AS (SELECT a.query_id, coalesce(f.r, 1000000000) AS l, coalesce(h.r, 1000000000) AS r FROM (SELECT DISTINCT query_id FROM r) a LEFT JOIN r f ON f.query_id = a.query_id AND f.strategy = 'full' LEFT JOIN r h ON h.query_id = a.query_id AND h.strategy = 'half')
SELECT 'full' AS "left", 'half' AS "right", sum((l < r)::INT)::BIGINT AS wins, sum((l = r)::INT)::BIGINT AS ties, sum((l > r)::INT)::BIGINT AS losses FROM q""")
def sparse_pairwise(spark, sf_dir):
    rows, _ = sparse(spark, sf_dir)
    return metrics.pairwise(metrics.per_query(rows, relevance(spark, sf_dir)), ["full", "half"])


@query(f"""WITH {HITS}, d AS (SELECT query_id, source, CASE WHEN query_id % 3 = 0 THEN 'remove' END AS action FROM relevance UNION ALL SELECT query_id, source || 'x', 'add' FROM relevance WHERE query_id % 2 = 0)
SELECT query_id, source FROM d WHERE action IS DISTINCT FROM 'remove'""")
def revised_relevance(spark, sf_dir):
    rel = relevance(spark, sf_dir)
    decisions = rel.where("query_id % 3 = 0").withColumn("action", F.lit("remove")).unionByName(rel.where("query_id % 2 = 0").select("query_id", F.concat("source", F.lit("x")).alias("source"), F.lit("add").alias("action")))
    return metrics.revised_relevance(rel, decisions)


SPOT = f"""{TURNS}, p AS (SELECT question_id, round(max(f1) FILTER (strategy = 'next'), 6) AS a, round(max(f1) FILTER (strategy = 'after'), 6) AS b FROM evaluated GROUP BY 1 HAVING count(*) = 2)"""


@query(f"""WITH {SPOT} SELECT * FROM (SELECT 'next' AS kind, question_id, round(a - b, 6) AS margin FROM p WHERE a > b ORDER BY a - b DESC, question_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'after', question_id, round(b - a, 6) FROM p WHERE b > a ORDER BY b - a DESC, question_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'tie', question_id, round(abs(a - b), 6) FROM p ORDER BY abs(a - b), question_id LIMIT 5)""")
def spot_checks(spark, sf_dir):
    wide = answers.paired(evaluated(spark, sf_dir), ["next", "after"]).dropna()
    return rounded(metrics.spot_checks(wide.select("question_id", r6("next").alias("next"), r6("after").alias("after")), ["next", "after"]))


@query(rf"""WITH p AS (SELECT conv_id || ':' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS question_id, regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') AS a, regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '[^\x00-\x7f]', ' ', 'g') AS b FROM conversations),
t AS (SELECT a, b, list_distinct(regexp_extract_all(a, '\[\([^\]]+\)\]') || regexp_extract_all(a, '@[A-Za-z_$][\w$]*') || regexp_extract_all(a, '\bNG\d+\b') || regexp_extract_all(a, '\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?\(\)') || regexp_extract_all(a, '\b(?:[A-Z]{{2,}}[A-Za-z0-9_$]*|[A-Z][a-z0-9_$]+[A-Z][\w$]*|[a-z_$][\w$]*[A-Z][\w$]*)\b') || regexp_extract_all(a, '\b[\w-]+\.(?:json|md|ts|html|css)\b')) AS pa,
  list_distinct(regexp_extract_all(b, '\[\([^\]]+\)\]') || regexp_extract_all(b, '@[A-Za-z_$][\w$]*') || regexp_extract_all(b, '\bNG\d+\b') || regexp_extract_all(b, '\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?\(\)') || regexp_extract_all(b, '\b(?:[A-Z]{{2,}}[A-Za-z0-9_$]*|[A-Z][a-z0-9_$]+[A-Z][\w$]*|[a-z_$][\w$]*[A-Z][\w$]*)\b') || regexp_extract_all(b, '\b[\w-]+\.(?:json|md|ts|html|css)\b')) AS pb FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT CASE WHEN len(list_filter(pa, lambda x: NOT contains(b, x))) > 0 THEN 'missing' WHEN len(list_filter(pb, lambda x: NOT list_contains(pa, x))) > 0 THEN 'added' WHEN len(regexp_extract_all(b, '\S+')) > len(regexp_extract_all(a, '\S+')) + 5 THEN 'too long' ELSE 'ok' END AS verdict, count(*) AS pairs FROM t GROUP BY 1""")
def rewrite_fidelity(spark, sf_dir):
    """The next turn as a rewrite of a turn, letters outside ASCII left blank: SQL has other borders of words there."""
    rows = turns(spark, sf_dir).where("strategy = 'next'")
    rows = rows.select(*[F.regexp_replace(c, r"[^\x00-\x7f]", " ").alias(c) for c in ("prediction", "reference")])
    return rows.groupBy(tx.rewrite_verdict(F.col("prediction"), F.col("reference")).alias("verdict")).agg(F.count("*").alias("pairs"))


@query("SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'rejected_fidelity' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'rewritten' ELSE 'rewritten' END AS status, CASE item_id % 4 WHEN 2 THEN trim(text) || ' now' WHEN 3 THEN 'cached ' || trim(text) ELSE trim(text) END AS rewrite FROM benchmark")
def prepared_rewrites(spark, sf_dir):
    """A provider that adds an API name to some queries, leaves some, lengthens some; a cache holds proposals for the rest."""
    asked = passages(spark, sf_dir).select("query_id", F.concat(F.trim("query"), F.lit("  ")).alias("query"))
    kinds = asked.select(F.trim("query").alias("q"), (F.col("query_id") % 4).alias("kind")).dropDuplicates(["q"])
    mapped = {r["q"]: r["kind"] for r in kinds.collect()}  # the benchmark's items: a question set
    kind = F.udf(lambda q: int(mapped[q]), "int")
    provider = lambda q: F.when(kind(q) == 0, F.concat(q, F.lit(" useApiName()"))).when(kind(q) == 1, q).otherwise(F.concat(q, F.lit(" now")))
    cache = asked.where("query_id % 4 = 3").select(F.trim("query").alias("query"), F.concat(F.lit("cached "), F.trim("query")).alias("proposal")).dropDuplicates(["query"])
    return experiments.prepare_rewrites(asked, provider, cache).select("query_id", "status", "rewrite")


@query(f"""WITH {BM25}, q1 AS (SELECT query_id, chunk_id, rank FROM lexical WHERE rank <= 10), other AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM lexical),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank FROM lexical UNION ALL SELECT query_id, chunk_id, rank FROM other) GROUP BY ALL)
SELECT 'Q1' AS variant, query_id, chunk_id FROM q1 UNION ALL SELECT 'Q2', query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM f) WHERE r <= 10""")
def rewrite_variants(spark, sf_dir):
    """Two runs of the queries: as found, and the same hits in the order of their ids; alone and fused."""
    found = retrieval.bm25_search(passages(spark, sf_dir), corpus(spark, sf_dir), 20, decimals=6)
    other = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    runs = experiments.rewrite_variants(other, found)
    both = [retrieval.same_top_k(r, 20, 20) for r in (other, found)]
    fused = retrieval.reciprocal_rank_fusion(both, 40).withColumn("score", F.round("score", 12))
    return runs["Q1"].select(F.lit("Q1").alias("variant"), "query_id", "chunk_id").unionByName(retrieval.top(fused, 10).select(F.lit("Q2").alias("variant"), "query_id", "chunk_id"))


@query(f"""WITH {BM25}, {DENSE}, pools AS (SELECT unnest([5, 10, 20]) AS pool), p AS (SELECT pool, query_id, chunk_id, every.score FROM dense JOIN every USING (query_id, chunk_id), pools WHERE dense.rank <= pool)
SELECT * FROM (SELECT pool, query_id, row_number() OVER (PARTITION BY pool, query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id FROM p) WHERE rank <= 5""")
def rerank_pools(spark, sf_dir):
    out = experiments.rerank_pools(passages(spark, sf_dir), corpus(spark, sf_dir), dense(spark, sf_dir), [5, 10, 20], 5, decimals=6)
    return out.select("pool", "query_id", "rank", "chunk_id")


# --- evidence on real windows ----------------------------------------------------------------------------------------

BENCH = f"""{SPANS}, {FIXED.replace('chunks AS', 'fx AS')},
held AS (SELECT chunk_id, doc_id, 'chars' AS strategy, c_start, c_end, c_end - c_start AS token_count FROM windows UNION ALL SELECT {NAME}, doc_id, 'fixed', char_start, char_end, token_end - token_start FROM fx),
parts AS (SELECT evidence_id || '@' || doc_id AS evidence_id, evidence_id AS item, span, chunk_id, strategy, token_count, greatest(c_start, "start") - "start" AS s, least(c_end, "end") - "start" AS e, "end" - "start" AS length FROM spans JOIN held USING (doc_id) WHERE c_start < "end" AND "start" < c_end),
best AS (SELECT evidence_id, item, strategy, chunk_id, arg_max({{'s': s, 'e': e, 'length': length}}, struct_pack(c := (e - s) / length, f := -span)) AS m FROM parts GROUP BY ALL),
ranked AS (SELECT f.evidence_id AS query_id, strategy, chunk_id, token_count, row_number() OVER (PARTITION BY f.evidence_id, strategy ORDER BY md5(chunk_id)) AS rank FROM (SELECT DISTINCT evidence_id, doc_id FROM spans) f JOIN held USING (doc_id))"""


def bench_windows(spark, sf_dir) -> DataFrame:
    """(chunk_id, doc_id, strategy, c_start, c_end, token_count): windows of characters, and fixed chunks."""
    chars = char_windows(spark, sf_dir).select("chunk_id", "doc_id", F.lit("chars").alias("strategy"), "c_start", "c_end", (F.col("c_end") - F.col("c_start")).alias("token_count"))
    chunks = fixed(spark, sf_dir)
    own = evidence.fixed_chunk_spans(chunks).join(chunks.select("chunk_id", "token_count"), "chunk_id")
    return chars.unionByName(own.select("chunk_id", "doc_id", F.lit("fixed").alias("strategy"), "c_start", "c_end", "token_count"))


@query(f"WITH {BENCH} SELECT evidence_id, span, chunk_id, round((e - s) / length, 6) AS coverage, s AS \"start\", e AS \"end\" FROM parts WHERE strategy = 'fixed'")
def evidence_fixed_chunks(spark, sf_dir):
    one = spans(spark, sf_dir).withColumn("evidence_id", F.concat_ws("@", "evidence_id", "doc_id"))
    return evidence.chunk_matches(one, evidence.fixed_chunk_spans(fixed(spark, sf_dir))).select("evidence_id", "span", "chunk_id", r6("coverage").alias("coverage"), "start", "end")


EVIDENCE_RUN = f"""WITH RECURSIVE {BENCH},
fold AS (SELECT DISTINCT query_id, strategy, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, false AS overflow, [0::BIGINT] AS taken FROM ranked
  UNION ALL SELECT f.query_id, f.strategy, f.i + 1, f.used + CASE WHEN NOT f.overflow AND (f.n = 0 OR f.used + h.token_count <= 300) THEN h.token_count ELSE 0 END, f.n + (NOT f.overflow AND (f.n = 0 OR f.used + h.token_count <= 300))::INT, f.overflow OR (f.n = 0 AND h.token_count > 300), CASE WHEN NOT f.overflow AND (f.n = 0 OR f.used + h.token_count <= 300) THEN list_append(f.taken, h.rank) ELSE f.taken END
  FROM fold f JOIN ranked h ON h.query_id = f.query_id AND h.strategy = f.strategy AND h.rank = f.i + 1 AND h.rank <= 20),
budget AS (SELECT query_id, strategy, arg_max(taken, i) AS taken FROM fold GROUP BY ALL),
chosen AS (SELECT 'same_top_k' AS protocol, query_id, strategy, chunk_id, rank FROM ranked WHERE rank <= 3 UNION ALL SELECT 'same_token_budget', r.query_id, r.strategy, r.chunk_id, r.rank FROM ranked r JOIN budget b ON b.query_id = r.query_id AND b.strategy = r.strategy AND list_contains(b.taken, r.rank)),
high AS (SELECT evidence_id, max(m.e) AS high FROM best GROUP BY 1),
hit AS (SELECT protocol, c.strategy, c.query_id, b.evidence_id, c.rank, b.m.s AS s, b.m.e AS e FROM chosen c JOIN best b ON b.chunk_id = c.chunk_id AND b.item = c.query_id),
u AS (SELECT *, coalesce(max(e) OVER (PARTITION BY protocol, strategy, query_id, evidence_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM hit),
cov AS (SELECT protocol, strategy, query_id, evidence_id, least(1.0, sum(greatest(0, e - greatest(s, reached))) / max(high)) AS coverage FROM u JOIN high USING (evidence_id) GROUP BY ALL),
asked AS (SELECT protocol, strategy, evidence_id AS query_id, evidence_id || '@' || doc_id AS evidence_id FROM (SELECT DISTINCT evidence_id, doc_id FROM spans), (SELECT unnest(['same_top_k', 'same_token_budget']) AS protocol), (SELECT unnest(['chars', 'fixed']) AS strategy)),
rows_ AS (SELECT protocol, strategy, query_id, count(*) AS units, sum((coalesce(coverage, 0) >= 1)::INT)::BIGINT AS covered_units, round(avg(coalesce(coverage, 0)), 6) AS evidence_coverage, min((coalesce(coverage, 0) >= 1)::INT) AS all_covered FROM asked LEFT JOIN cov USING (protocol, strategy, query_id, evidence_id) GROUP BY ALL),
firsts AS (SELECT protocol, strategy, query_id, min(rank) AS first_rank FROM hit GROUP BY ALL)"""


def evidence_run(spark, sf_dir) -> DataFrame:
    """Passages as questions: the windows of their documents, ranked by a hash, under both protocols."""
    found = spans(spark, sf_dir)
    held = bench_windows(spark, sf_dir)
    order = Window.partitionBy("query_id", "strategy").orderBy(F.md5("chunk_id"))
    asked = found.select(F.col("evidence_id").alias("query_id"), "doc_id").distinct()
    ranked = asked.join(held, "doc_id").select("query_id", "strategy", "chunk_id", "token_count", F.row_number().over(order).alias("rank"))
    one = found.withColumn("evidence_id", F.concat_ws("@", "evidence_id", "doc_id"))
    best = evidence.best_matches(evidence.chunk_matches(one, held.select("chunk_id", "doc_id", "c_start", "c_end")))
    units = asked.select("query_id", F.concat_ws("@", "query_id", "doc_id").alias("evidence_id"))
    return benchmarks.evidence_benchmark(ranked, best, units, ["chars", "fixed"], benchmarks.Protocols(3, 20, 300))


@query(f"{EVIDENCE_RUN} SELECT rows_.*, first_rank FROM rows_ LEFT JOIN firsts USING (protocol, strategy, query_id)")
def evidence_benchmark(spark, sf_dir):
    return rounded(evidence_run(spark, sf_dir))


@query(f"{EVIDENCE_RUN} SELECT protocol, strategy, count(*) AS queries, round(avg(evidence_coverage), 5) AS evidence_coverage, round(avg(all_covered), 6) AS all_evidence_rate, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr FROM rows_ LEFT JOIN firsts USING (protocol, strategy, query_id) GROUP BY ALL")
def evidence_benchmark_means(spark, sf_dir):
    means = benchmarks.evidence_summary(rounded(evidence_run(spark, sf_dir)))
    return rounded(means.withColumn("evidence_coverage", F.round("evidence_coverage", 5)))


@query(f"{EVIDENCE_RUN} SELECT protocol, round(avg(evidence_coverage), 5) AS evidence_coverage, round(avg(all_covered), 6) AS all_evidence_rate FROM rows_ WHERE strategy = 'fixed' GROUP BY 1")
def evidence_macro(spark, sf_dir):
    rows = rounded(evidence_run(spark, sf_dir)).where("strategy = 'fixed'")
    out = None
    for protocol in ("same_top_k", "same_token_budget"):
        part = evidence.evidence_macro(rows.where(F.col("protocol") == protocol)).withColumn("protocol", F.lit(protocol))
        out = part if out is None else out.unionByName(part)
    return out.select("protocol", F.round("evidence_coverage", 5).alias("evidence_coverage"), r6("all_evidence_rate").alias("all_evidence_rate"))


# --- answers ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {TURNS}, b AS (SELECT question_id, max(f1) AS f1, max(exact) AS exact, max(containment) AS containment FROM evaluated GROUP BY 1)
SELECT question_id, round(b.f1, 6) AS f1, round(p.precision, 6) AS precision, round(p.recall, 6) AS recall, p.i AS f1_reference, b.exact, b.containment FROM b JOIN (SELECT *, CASE strategy WHEN 'next' THEN 0 ELSE 1 END AS i, row_number() OVER (PARTITION BY question_id ORDER BY round(f1, 12) DESC, strategy DESC) AS place FROM evaluated) p USING (question_id) WHERE p.place = 1""")
def best_references(spark, sf_dir):
    """The two turns that follow as references of one answer: the better for each metric, the first among equals."""
    rows = turns(spark, sf_dir)
    given = rows.select("question_id", F.lit("s").alias("strategy"), "prediction").distinct()
    refs = rows.select("question_id", F.when(F.col("strategy") == "next", 0).otherwise(1).alias("reference_index"), "reference")
    return rounded(answers.evaluate_references(given, refs, tx.plain_form).drop("strategy"))


BENCHED = f"""{TURNS}, asked AS (SELECT question_id, role, s AS strategy FROM (SELECT question_id, role FROM turns WHERE strategy = 'next'), (SELECT unnest(['a', 'b']) AS s)),
got AS (SELECT a.*, CASE WHEN hashed % 5 = 0 THEN 'failed' WHEN hashed % 5 = 1 AND a.strategy = 'b' THEN 'missing' ELSE 'success' END AS status FROM (SELECT *, ('0x' || substr(md5(question_id), 1, 6))::INT AS hashed FROM asked) a),
rows_ AS (SELECT got.*, CASE WHEN status = 'success' THEN f1 END AS f1, CASE WHEN status = 'success' THEN exact END AS exact FROM got LEFT JOIN (SELECT question_id, f1, exact FROM evaluated WHERE strategy = 'next') e USING (question_id))"""


def benched(spark, sf_dir) -> dict[str, DataFrame]:
    """Answers of two strategies: a fifth of the questions failed, of the second strategy another fifth is missing."""
    rows = turns(spark, sf_dir).where("strategy = 'next'").withColumn("hashed", F.conv(F.substring(F.md5("question_id"), 1, 6), 16, 10).cast("int") % 5)
    questions = rows.select("question_id", "reference", F.col("role").alias("question_type"))
    given = rows.select("question_id", "prediction", F.explode(F.when(F.col("hashed") == 0, F.array().cast("array<string>")).when(F.col("hashed") == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("strategy"))
    failed = rows.where("hashed = 0").select("question_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("strategy"), F.lit("provider").alias("failure"))
    return benchmarks.answer_benchmark(questions, given, failed, ["a", "b"], tx.plain_form)


@query(f"WITH {BENCHED} SELECT question_id, strategy, status, round(f1, 6) AS f1 FROM rows_")
def answer_statuses(spark, sf_dir):
    return rounded(benched(spark, sf_dir)["records"].select("question_id", "strategy", "status", "f1"))


@query(f"""WITH {BENCHED} SELECT strategy, role AS question_type, count(*) AS expected, count(f1) AS answered, round(avg(f1), 6) AS f1, round(sum(coalesce(f1, 0)) / count(*), 6) AS success_aware_f1, round(avg((status = 'success')::INT), 6) AS success_rate, round(avg((status = 'failed')::INT), 6) AS failed_rate, round(avg((status = 'missing')::INT), 6) AS missing_rate FROM rows_ GROUP BY ALL""")
def answer_benchmark(spark, sf_dir):
    return rounded(benched(spark, sf_dir)["by_type"].select("strategy", "question_type", "expected", "answered", "f1", "success_aware_f1", "success_rate", "failed_rate", "missing_rate"))


# --- statistics ------------------------------------------------------------------------------------------------------


@query(f"""WITH {RANKS}, z AS (SELECT role, n, least(plus, minus) AS statistic, (least(plus, minus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM s),
p AS (SELECT role, n, statistic, z, (SELECT sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) * i / 2000, 2) / 2)) FROM range(0, 2001) t(i)) * abs(z) / 6000 / sqrt(2 * pi()) AS half FROM z)
SELECT role, n, statistic, round(1 - 2 * half, 5) AS p FROM p""")
def wilcoxon_p(spark, sf_dir):
    """The test's p; the SQL integrates the normal density."""
    rows = statistics.wilcoxon(deltas(spark, sf_dir), "d", ["role"])
    return rows.select("role", "n", "statistic", F.round("p", 5).alias("p"))


@query(f"WITH {PAIRED} SELECT role, 0::BIGINT AS n, count(d)::BIGINT AS zeros, 0.0 AS statistic, 1.0 AS p, 0.0 AS rank_biserial FROM deltas GROUP BY 1")
def all_zero_differences(spark, sf_dir):
    """Differences that are all 0: no test, but a row for each group."""
    flat = deltas(spark, sf_dir).withColumn("d", F.lit(0.0))
    return statistics.wilcoxon(flat, "d", ["role"]).drop("z").join(statistics.rank_biserial(flat, "d", ["role"]), "role")


@query("SELECT lang, sum((n_chars >= 500)::INT)::BIGINT AS with_n, round(avg(n_chars) FILTER (n_chars >= 500), 4) AS with_mean, sum((n_chars < 500)::INT)::BIGINT AS without_n, round(avg(n_chars) FILTER (n_chars < 500), 4) AS without_mean FROM documents GROUP BY 1")
def event_relation(spark, sf_dir):
    """Mean scores with and without an event: lengths of long and short documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("strategy"), F.col("n_chars").cast("double").alias("f1"), (F.col("n_chars") >= 500).cast("int").alias("event"))
    rows = experiments.relation(docs.select("question_id", "strategy", "f1"), docs.select("question_id", "strategy", "event"), "event")
    return rows.select(F.col("strategy").alias("lang"), "with_n", F.round("with_mean", 4).alias("with_mean"), "without_n", F.round("without_mean", 4).alias("without_mean"))


@query(f"""WITH {PAIRED} SELECT 'd' AS name, round(avg(d), 9) AS found, round(avg(d), 9) + 1 AS wanted FROM deltas UNION ALL SELECT 'absent', NULL, 0.0""")
def freeze_errors(spark, sf_dir):
    """Pinned values against a recomputation: one is reproduced, one is not, one is not computed."""
    mean = deltas(spark, sf_dir).agg(F.round(F.avg("d"), 9).alias("value"))
    measured = mean.select(F.lit("run").alias("k"), F.explode(F.array(F.lit("c"), F.lit("d"))).alias("name"), "value")
    pinned = mean.select(F.lit("run").alias("k"), F.explode(F.array(F.struct(F.lit("c").alias("name"), F.col("value").alias("wanted")), F.struct(F.lit("d").alias("name"), (F.col("value") + 1).alias("wanted")), F.struct(F.lit("absent").alias("name"), F.lit(0.0).alias("wanted")))).alias("p")).select("k", "p.*")
    return experiments.freeze_errors(measured, pinned, ["k"]).select("name", "found", "wanted")
