"""Queries of the parser and the chunkers that work on blocks.

The tables hold no Markdown, so every document's words are set into a page of Markdown with one block of each kind; the SQL
states the blocks that the page must have, without parsing anything.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, evidence, parsing
from tessera.plans.catalog import query, rounded, table
from tessera.session import scratch_folder
from tessera.sources.answered import AnswerStore

PAGE = """---
title: "Doc {id}"
lang: {lang}
weight: {m}
draft: yes
not a pair
---

# {w1} guide

{w2}   {w3} [{w4}](http://x/{w5} "{w6}") ends.
The {w4} line two.

## Part {w5} `{w6}`

- {w6} one
- {w7} two
  1. nested {w8}

| Name | Value |
|:---|---:|
| {w9} | a \\| b |
| {w10} |

NOTE: {w11} is noted.

```sql
select {w12}
```

> {w13} quoted. Again.
> And more.

<docs-code path="src/{w1}.ts" header="{w2}" />

<docs-step title="Do {w3} \\"{w4}\\"">

Inside {w4} step.

</docs-step>

#### Deep {w14}

Last {w15} words.

#### Other {w16}

Tail {w17}.

[ref{m}]: http://y/{w1} "T {w2}"
"""
#: (type, text, level, language, ordered, first line, last line) of the page's blocks.
BLOCKS = [
    ("heading", "{w1} guide", 1, None, None, 9, 9),
    ("paragraph", '{w2} {w3} [{w4}](http://x/{w5} "{w6}") ends. The {w4} line two.', None, None, None, 11, 12),
    ("heading", "Part {w5} `{w6}`", 2, None, None, 14, 14),
    ("list", "- {w6} one\n- {w7} two\n  1. nested {w8}", None, None, False, 16, 18),
    ("table", "| Name | Value |\n|:---|---:|\n| {w9} | a \\| b |\n| {w10} |", None, None, None, 20, 23),
    ("callout", "{w11} is noted.", None, None, None, 25, 25),
    ("code_block", "select {w12}", None, "sql", None, 27, 29),
    ("blockquote", "{w13} quoted. Again. And more.", None, None, None, 31, 32),
    ("code_reference", "Referenced code: {w2}", None, None, None, 34, 34),
    ("paragraph", "Inside {w4} step.", None, None, None, 38, 38),
    ("heading", "Deep {w14}", 4, None, None, 42, 42),
    ("paragraph", "Last {w15} words.", None, None, None, 44, 44),
    ("heading", "Other {w16}", 4, None, None, 46, 46),
    ("paragraph", "Tail {w17}.", None, None, None, 48, 48),
]
#: Blocks of the page's sections, and of which section each is a child.
SECTIONS = [(range(0, 2), None), (range(2, 10), 0), (range(10, 12), 1), (range(12, 14), 1)]
TITLES = ["{w1} guide", "Part {w5} `{w6}`", "Deep {w14}", "Other {w16}"]
PATHS = [[0], [0, 1], [0, 1, 2], [0, 1, 3]]
_SLOT = re.compile(r"\{(\w+)\}")


def filled(template: str) -> Column:
    """The template with its slots filled from a row of `page_words`."""
    parts = _SLOT.split(template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts) if i % 2 or p])


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(template: str | None) -> str:
    """filled, as SQL."""
    if template is None:
        return "NULL::VARCHAR"
    parts = _SLOT.split(template)
    return "(" + " || ".join(quoted(p) if i % 2 == 0 else p for i, p in enumerate(parts) if i % 2 or p) + ")"


def literal(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else quoted(x) if isinstance(x, str) else str(x)


def page_words(spark, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), words.alias("w"))
    word = lambda i: F.coalesce(F.get("w", F.lit(i - 1)), F.lit("word")).alias(f"w{i}")
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("id"), "lang", (F.col("doc_id") % 7).cast("string").alias("m"), *[word(i) for i in range(1, 18)])


WORDS = "w AS (SELECT doc_id, doc_id::VARCHAR AS id, coalesce(lang, 'xx') AS lang, (doc_id % 7)::VARCHAR AS m, " + ", ".join(f"coalesce(ws[{i}], 'word') AS w{i}" for i in range(1, 18)) + " FROM (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents))"
BLOCK_ROWS = f"""{WORDS}, blocks AS (
  {" UNION ALL ".join(f"SELECT doc_id, {i} AS block_index, {literal(k)} AS type, {sql(t)} AS text, {literal(level)}::INT AS level, {literal(lang)}::VARCHAR AS language, {literal(o)}::BOOLEAN AS ordered, {a} AS line_start, {b} AS line_end FROM w" for i, (k, t, level, lang, o, a, b) in enumerate(BLOCKS))})"""
LINEAR = f"{BLOCK_ROWS}, linear AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS text FROM blocks GROUP BY 1)"
CHUNK_ROWS = f"""{WORDS}, chunks AS (
  {" UNION ALL ".join(f"SELECT doc_id, {i} AS chunk_index, {sql((chr(10) * 2).join(BLOCKS[k][1] for k in own))} AS text, {literal(parent)}::INT AS parent, {len(own)} AS fragments, {BLOCKS[own[0]][2]} AS level, {sql(' > '.join(TITLES[k] for k in PATHS[i]))} AS path FROM w" for i, (own, parent) in enumerate(SECTIONS))})"""


def pages(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the pages."""
    return page_words(spark, sf_dir).select("doc_id", filled(PAGE).alias("text"))


def parsed(spark, sf_dir: str) -> DataFrame:
    return parsing.parse_documents(pages(spark, sf_dir))


def chunked(spark, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(parsed(spark, sf_dir), "structure")


def meta(path: str, column: str = "metadata_json") -> Column:
    return F.get_json_object(column, path)


def hashed(part: str, modulus: int) -> Column:
    """Which of the documents a query damages: doc_id % modulus = 0, of rows whose doc_id is text or a number."""
    return F.col(part).cast("long") % modulus == 0


# --- parsing ---------------------------------------------------------------------------------------------------------


@query(f"WITH {BLOCK_ROWS} SELECT * FROM blocks")
def md_blocks(spark, sf_dir):
    rows = parsing.block_rows(parsed(spark, sf_dir))
    return rows.select("doc_id", "block_index", "type", "text", "level", "language", "ordered", F.col("source_line_start").alias("line_start"), F.col("source_line_end").alias("line_end"))


#: Shapes of pages around a whole text's letters: template, and the blocks (type, text, level, first line, last line).
SHAPES = [
    ("Under {w1}\n---\n{body}", [("heading", "Under {w1}", 2, 1, 2), ("paragraph", "{body}", None, 3, 3)]),
    ("- {w1}\n\n\n- {body}\n", [("list", "- {w1}\n- {body}", None, 1, 4)]),
    ("1. {w1}\n- {body}\n* {w1}", [("list", "1. {w1}", None, 1, 1), ("list", "- {body}", None, 2, 2), ("list", "* {w1}", None, 3, 3)]),
    ("{body}\n2. {w1}\n1. {w1}", [("paragraph", "{body} 2. {w1}", None, 1, 2), ("list", "1. {w1}", None, 3, 3)]),
    ("<div>\n\n{body}\n</div>\n\nend", [("html_block", "<div>", None, 1, 1), ("paragraph", "{body}", None, 3, 3), ("html_block", "</div>", None, 4, 4), ("paragraph", "end", None, 6, 6)]),
    ("[x]: <u v> 'T'\n\n> {body}\n\n***\n{w1}\n===", [("blockquote", "{body}", None, 3, 3), ("heading", "{w1}", 1, 6, 7)]),
    ("~~~ sql\n{body}\n---\n~~~\n\n    {w1}", [("code_block", "{body}\n---", None, 1, 4), ("code_block", "{w1}", None, 6, 6)]),
]
BODIES = "bodies AS (SELECT doc_id, coalesce(regexp_extract(text, '[A-Za-z]+'), '') || 'x' AS w1, 'T' || coalesce(regexp_replace(text, '[^A-Za-z]+', '', 'g'), '') AS body FROM documents)"


@query(f"WITH {BODIES} " + " UNION ALL ".join(f"SELECT doc_id, {i} AS block_index, {literal(k)} AS type, md5({sql(t)}) AS text_md5, {literal(level)}::INT AS level, {a} AS line_start, {b} AS line_end FROM bodies WHERE doc_id % {len(SHAPES)} = {n}" for n, (_, blocks) in enumerate(SHAPES) for i, (k, t, level, a, b) in enumerate(blocks)))
def md_shapes(spark, sf_dir):
    """Pages of seven shapes, each with all letters of a document's text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")), F.lit("x")).alias("w1"), F.concat(F.lit("T"), F.coalesce(F.regexp_replace("text", "[^A-Za-z]+", ""), F.lit(""))).alias("body"))
    page = F.coalesce(*[F.when(F.col("doc_id") % len(SHAPES) == n, filled(t)) for n, (t, _) in enumerate(SHAPES)])
    found = parsing.block_rows(parsing.parse_documents(rows.select("doc_id", page.alias("text"))))
    return found.select("doc_id", "block_index", "type", F.md5("text").alias("text_md5"), "level", F.col("source_line_start").alias("line_start"), F.col("source_line_end").alias("line_end"))


@query(f"WITH {WORDS} SELECT doc_id, 'Doc ' || id AS title, lang, m AS weight, 'true' AS draft, 'not a pair' AS unparsed FROM w")
def md_front_matter(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", *[meta(f"$.{c}", "front_matter_json").alias(c) for c in ("title", "lang", "weight", "draft")], meta("$._unparsed[0]", "front_matter_json").alias("unparsed"))


@query(f"WITH {WORDS} SELECT doc_id, 'Name' AS first, 'right' AS align, w9 AS cell, 'a | b' AS escaped, w10 AS short, '' AS padded, '[1]' AS ragged FROM w")
def md_tables(spark, sf_dir):
    rows = parsing.block_rows(parsed(spark, sf_dir)).where("type = 'table'")
    got = {"first": "$.header[0]", "align": "$.alignments[1]", "cell": "$.rows[0][0]", "escaped": "$.rows[0][1]", "short": "$.rows[1][0]", "padded": "$.rows[1][1]", "ragged": "$.ragged_rows"}
    return rows.select("doc_id", *[meta(p).alias(c) for c, p in got.items()])


@query(f"WITH {WORDS} " + " UNION ALL ".join(f"SELECT doc_id, {i} AS item, {level} AS level, {literal(mark)} AS marker, {literal(o)} AS ordered, {sql(t)} AS text FROM w" for i, (level, mark, o, t) in enumerate([(0, "-", False, "{w6} one"), (0, "-", False, "{w7} two"), (1, "1.", True, "nested {w8}")])))
def md_list_items(spark, sf_dir):
    rows = parsing.block_rows(parsed(spark, sf_dir)).where("type = 'list'")
    items = F.from_json(meta("$.items"), "array<struct<level: int, marker: string, ordered: boolean, text: string>>")
    return rows.select("doc_id", F.posexplode(items).alias("item", "x")).select("doc_id", "item", "x.*")


@query(f"""WITH {WORDS} SELECT doc_id, w4 AS label, 'http://x/' || w5 AS href, w6 AS title, 'http://y/' || w1 AS ref_href, 'T ' || w2 AS ref_title, '50' AS ref_line FROM w""")
def md_links(spark, sf_dir):
    docs = parsed(spark, sf_dir)
    rows = parsing.block_rows(docs).where("block_index = 1").select("doc_id", meta("$.links[0].text").alias("label"), meta("$.links[0].href").alias("href"), meta("$.links[0].title").alias("title"))
    refs = F.from_json(meta("$.references"), "map<string, struct<href: string, title: string, line: string>>")
    own = docs.select("doc_id", F.element_at(F.map_values(refs), 1).alias("r"), F.element_at(F.map_keys(refs), 1).alias("k")).where(F.col("k") == F.concat(F.lit("ref"), (F.col("doc_id") % 7).cast("string")))
    return rows.join(own.select("doc_id", F.col("r.href").alias("ref_href"), F.col("r.title").alias("ref_title"), F.col("r.line").alias("ref_line")), "doc_id")


@query(f"""WITH {WORDS} SELECT doc_id, 'src/' || w1 || '.ts' AS path, w2 AS header, 'step' AS container FROM w""")
def md_containers(spark, sf_dir):
    rows = parsing.block_rows(parsed(spark, sf_dir))
    reference = rows.where("type = 'code_reference'").select("doc_id", meta("$.attributes.path").alias("path"), meta("$.attributes.header").alias("header"))
    inside = rows.where(meta("$.container_path").isNotNull()).select("doc_id", meta("$.container_path[0].type").alias("container"))
    return reference.join(inside, "doc_id")


NUMBERED = [(1, '{w2} {w3} [{w4}](http://x/{w5} "{w6}") ends.'), (1, "The {w4} line two."), (3, "- {w6} one"), (3, "- {w7} two"), (3, "1. nested {w8}"), (5, "{w11} is noted."), (7, "{w13} quoted."), (7, "Again."), (7, "And more."), (9, "Inside {w4} step."), (11, "Last {w15} words."), (13, "Tail {w17}.")]


@query(f"WITH {WORDS} " + " UNION ALL ".join(f"SELECT doc_id, id || ':s{n:06}' AS sentence_id, {b} AS block_index, {sql(t)} AS text FROM w" for n, (b, t) in enumerate(NUMBERED)))
def md_sentences(spark, sf_dir):
    return parsing.sentence_rows(parsed(spark, sf_dir))


@query(f"WITH {LINEAR} SELECT doc_id, md5(text) AS text_md5, length(text) AS length FROM linear")
def md_linear_text(spark, sf_dir):
    text = parsing.linear_text(F.col("blocks"))
    return parsed(spark, sf_dir).select("doc_id", F.md5(text).alias("text_md5"), F.length(text).alias("length"))


@query(f"WITH {BLOCK_ROWS} SELECT doc_id, block_index, (sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_index) - length(text) - 2)::INT AS char_offset FROM blocks")
def md_block_offsets(spark, sf_dir):
    return parsing.block_rows(parsed(spark, sf_dir)).select("doc_id", "block_index", "char_offset")


@query(f"WITH {BLOCK_ROWS} SELECT type, count(*) AS blocks, count(DISTINCT doc_id) AS documents FROM blocks GROUP BY 1")
def md_corpus_statistics(spark, sf_dir):
    return parsing.corpus_statistics(parsed(spark, sf_dir))


@query("""SELECT doc_id, 'heading level' AS problem FROM documents, range(4) WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, 'block type' FROM documents WHERE doc_id % 15 = 0
UNION ALL SELECT doc_id, 'line span' FROM documents WHERE doc_id % 21 = 0
UNION ALL SELECT doc_id, 'block order' FROM documents WHERE doc_id % 33 = 0
UNION ALL SELECT doc_id, 'duplicate id' FROM documents WHERE doc_id % 35 = 0""")
def md_corpus_errors(spark, sf_dir):
    """Pages damaged in five ways: heading levels, a type, a span, the order of two blocks, and rows that stand twice."""
    docs = parsed(spark, sf_dir).select("doc_id", "blocks")

    def damaged(b: Column, i: Column) -> Column:
        b = b.withField("level", F.when(hashed("doc_id", 10) & (b["type"] == "heading"), F.lit(9)).otherwise(b["level"]))
        b = b.withField("type", F.when(hashed("doc_id", 15) & (i == 1), F.lit("verse")).otherwise(b["type"]))
        b = b.withField("source_line_end", F.when(hashed("doc_id", 21) & (i == 3), F.lit(1)).otherwise(b["source_line_end"]))
        return b.withField("source_line_start", F.when(hashed("doc_id", 33) & (i == 5), F.lit(0)).otherwise(b["source_line_start"]))

    return once(docs.withColumn("blocks", F.transform("blocks", damaged)))


def once(bad: DataFrame) -> DataFrame:
    """The errors of the pages, and which of them stand twice when some are repeated. A repeated row has no blocks, so that
    its page's other errors count once."""
    copies = F.explode(F.when(hashed("doc_id", 35), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = bad.select("doc_id", "blocks", copies.alias("copy"))
    return parsing.corpus_errors(rows.select("doc_id", F.when(F.col("copy") == 0, F.col("blocks")).alias("blocks")))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unclosed docs-code at line 51' END AS parse_error, CASE WHEN doc_id % 4 <> 0 THEN 14 END AS blocks FROM documents""")
def md_isolated_failures(spark, sf_dir):
    """Every fourth page ends in a code element that never closes: it fails for itself."""
    docs = pages(spark, sf_dir).withColumn("text", F.when(hashed("doc_id", 4), F.concat("text", F.lit('<docs-code language="ts">\nnever closed\n'))).otherwise(F.col("text")))
    out = parsing.parse_documents(docs, fail_fast=False)
    return out.select("doc_id", "parse_error", F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("blocks"))


# --- sections and chunks ---------------------------------------------------------------------------------------------


@query(f"WITH {WORDS} " + " UNION ALL ".join(f"SELECT doc_id, {SECTIONS[i][0][0]} AS block_index, {sql(' > '.join(TITLES[k] for k in PATHS[i]))} AS path, {sql(' > '.join(TITLES[k] for k in p))} AS positional_path FROM w" for i, p in enumerate([[0], [0, 1], [0, 1, 2], [0, 1, 2, 3]])))
def md_section_paths(spark, sf_dir):
    """Both trees of headings: the one that closes what is as deep, and the one that counts levels, where skipped ones nest."""
    kind = "array<struct<block_index: int, path: string>>"
    plain = lambda found: [{"block_index": i, "path": " > ".join(p)} for i, p in found]
    stacked = F.udf(lambda blocks: plain((s.blocks[0], s.path) for s in chunking.sections([b.asDict() for b in blocks]) if s.path), kind)
    counted = F.udf(lambda blocks: plain(chunking.positional_sections([b.asDict() for b in blocks])), kind)
    docs = parsed(spark, sf_dir)
    a = docs.select("doc_id", F.explode(stacked("blocks")).alias("s")).select("doc_id", "s.*")
    b = docs.select("doc_id", F.explode(counted("blocks")).alias("s")).select("doc_id", "s.block_index", F.col("s.path").alias("positional_path"))
    return a.join(b, ["doc_id", "block_index"])


@query(f"""WITH {CHUNK_ROWS} SELECT doc_id || '::structure::' || lpad(chunk_index::VARCHAR, 6, '0') AS chunk_id, doc_id::VARCHAR AS doc_id, chunk_index, text, level, path, CASE WHEN parent IS NOT NULL THEN doc_id || '::structure::' || lpad(parent::VARCHAR, 6, '0') END AS parent_id,
  CASE chunk_index WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS children, fragments, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS token_count, 'section_end' AS boundary_reason FROM chunks""")
def md_structure_chunks(spark, sf_dir):
    rows = chunked(spark, sf_dir)
    return rows.select("chunk_id", "doc_id", "chunk_index", "text", "level", F.array_join("title_path", " > ").alias("path"), "parent_id", F.size("children_ids").alias("children"), F.size("fragments").alias("fragments"), "token_count", meta("$.boundary_reason").alias("boundary_reason"))


LONG = "l AS (SELECT doc_id, 2 + doc_id % 29 AS n, coalesce(regexp_extract_all(text, '[A-Za-z]+')[1], 'word') AS w1 FROM documents)"
LONG_CHUNKS = f"""{LONG}, long_chunks AS (SELECT doc_id, k AS chunk_index, n, least(6, n - 6 * k) AS sentences, CASE WHEN k = 0 THEN 'T' || chr(10) || chr(10) ELSE '' END || array_to_string(list_transform(range(6 * k, least(6 * k + 6, n)), lambda i: 'Sent a b c d e f g' || i || ' ' || w1 || '.'), ' ') || CASE WHEN 6 * k + 6 < n THEN ' ' ELSE '' END AS text
  FROM (SELECT *, unnest(range(0, (n + 5) // 6)) AS k FROM l))"""


def long_documents(spark, sf_dir: str) -> DataFrame:
    """A heading and one paragraph of 2 to 30 sentences, of ten tokens each."""
    word = F.coalesce(F.get(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lit(0)), F.lit("word"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (2 + F.col("doc_id") % 29).cast("int").alias("n"), word.alias("w1"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("Sent a b c d e f g"), i.cast("string"), F.lit(" "), F.col("w1"), F.lit("."))), " ")
    return parsing.parse_documents(rows.select("doc_id", F.concat(F.lit("# T\n\n"), body).alias("text")))


def long_chunks(spark, sf_dir: str) -> DataFrame:
    config = chunking.StructureConfig(max_tokens=64)
    return chunking.chunk_documents(long_documents(spark, sf_dir), "structure", lambda blocks: chunking.structure_chunks_of(blocks, config))


@query(f"""WITH {LONG_CHUNKS} SELECT doc_id::VARCHAR AS doc_id, chunk_index, text, sentences * 10 + (chunk_index = 0)::INT AS token_count, CASE WHEN 6 * chunk_index + 6 < n THEN 'oversized_paragraph_sentence_split' ELSE 'section_end' END AS boundary_reason FROM long_chunks""")
def md_sentence_splits(spark, sf_dir):
    return long_chunks(spark, sf_dir).select("doc_id", "chunk_index", "text", "token_count", meta("$.boundary_reason").alias("boundary_reason"))


@query(f"""WITH {LONG_CHUNKS} SELECT CASE WHEN 6 * chunk_index + 6 < n THEN 'oversized_paragraph_sentence_split' ELSE 'section_end' END AS reason, count(*) AS chunks FROM long_chunks GROUP BY 1""")
def md_structure_statistics(spark, sf_dir):
    return chunking.structure_statistics(long_chunks(spark, sf_dir))


@query(f"""WITH {LONG_CHUNKS} SELECT 'heading' AS block_type, sum((chunk_index = 0)::INT)::BIGINT AS chunks, sum((chunk_index = 0)::INT)::BIGINT AS fragments, 0::BIGINT AS split_fragments FROM long_chunks
UNION ALL SELECT 'paragraph', count(*), count(*), sum((n > 6)::INT)::BIGINT FROM long_chunks""")
def md_block_type_statistics(spark, sf_dir):
    return chunking.block_type_statistics(long_chunks(spark, sf_dir))


@query(f"""WITH {LINEAR} SELECT doc_id::VARCHAR AS doc_id, 4 AS chunks, md5(text) AS text_md5 FROM linear""")
def md_planned_chunks(spark, sf_dir):
    rows = chunking.chunk_documents(parsed(spark, sf_dir), "prompt").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return rows.select("doc_id", F.size("c").alias("chunks"), F.md5(F.array_join(F.transform("c", lambda c: c["text"]), "")).alias("text_md5"))


def hesitant(request: list[dict]) -> str:
    """A planner that gives no plan at all for pages whose first letter comes before n, and needs a second try for others."""
    if request[0]["preview"][:1].lower() < "n":
        return "no plan"
    return chunking.by_sections(request[:-1]) if "correction" in request[-1] else "[]"


def under_two_ids(docs: DataFrame) -> DataFrame:
    """Every document under its own id and another one, parsed once for both."""
    ids = F.explode(F.array(F.col("doc_id"), -1 - F.col("doc_id")))
    return docs.select(ids.alias("doc_id"), *[c for c in docs.columns if c != "doc_id"])


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, lower(w1[1]) < 'n' AS failed, md5(concat_ws('|', {", ".join(f"w{i}" for i in range(1, 18))})) AS page FROM w)
SELECT (SELECT count(*) FROM p WHERE failed) * 2 AS failures, (SELECT count(*) FROM p WHERE NOT failed) * 8 AS chunks, (SELECT count(DISTINCT page) FROM p WHERE NOT failed) AS plans""")
def md_concurrent_planning(spark, sf_dir):
    """Every page under two ids: a request is asked once, corrected once, and a failed document is left out whole."""
    chunks, failures, plans = chunking.planned_chunks(under_two_ids(parsed(spark, sf_dir).select("doc_id", "blocks")), hesitant)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(failures, "failures").crossJoin(count(chunks, "chunks")).crossJoin(count(plans, "plans"))


@query(f"""WITH {WORDS}, p AS (SELECT lower(w1[1]) < 'n' AS failed, md5(concat_ws('|', {", ".join(f"w{i}" for i in range(1, 18))})) AS page FROM w)
SELECT 2 * count(DISTINCT page) AS calls, sum((NOT failed)::INT)::BIGINT * 8 AS chunks, sum(failed::INT)::BIGINT * 2 AS failures, count(DISTINCT page) FILTER (WHERE NOT failed) AS plans, count(DISTINCT page) FILTER (WHERE failed) AS asked_again FROM p""")
def plan_calls(spark, sf_dir):
    """How often a planner is called (twice a request, as `hesitant` needs it) over all results of a run, each read twice;
    then a run over the same store, which asks only what failed."""
    held = f"{scratch_folder(spark)}/parsed"
    parsed(spark, sf_dir).select("doc_id", "blocks").write.parquet(held)  # two runs read them
    docs = spark.read.parquet(held)
    store = AnswerStore(spark, f"{scratch_folder(spark)}/plans", {"planner": "hesitant"})
    calls, again = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(request: list[dict]) -> str:
        calls.add(1)
        return hesitant(request)

    def refused(request: list[dict]) -> str:
        again.add(1)
        return "no plan"

    results = chunking.planned_chunks(under_two_ids(docs), counted, store=store)
    for _ in range(2):
        counts = [df.count() for df in results]
    chunking.planned_chunks(docs, refused, config=chunking.PlannerConfig(corrections=0), store=store)
    return spark.range(1).select(F.lit(calls.value).cast("long").alias("calls"), F.lit(counts[0]).cast("long").alias("chunks"), F.lit(counts[1]).alias("failures"), F.lit(counts[2]).alias("plans"), F.lit(again.value).cast("long").alias("asked_again"))


@query(f"""WITH {LINEAR} SELECT doc_id::VARCHAR AS doc_id FROM linear WHERE doc_id % 9 = 0 OR doc_id % 11 = 0""")
def planned_partition_check(spark, sf_dir):
    """Chunks damaged in two ways: all of a document's are gone, or one has another text."""
    docs = parsed(spark, sf_dir)
    rows = chunking.chunk_documents(docs, "prompt").where(~hashed("doc_id", 9))
    rows = rows.withColumn("text", F.when(hashed("doc_id", 11) & (F.col("chunk_index") == 1), F.lit("other")).otherwise(F.col("text")))
    return chunking.partition_errors(rows, docs.select("doc_id", parsing.linear_text(F.col("blocks")).alias("text")))


@query("""SELECT doc_id || '::structure::000003' AS chunk_id, 'numbering' AS problem FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id || '::structure::000002', 'link' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id || '::structure::000003', 'duplicate id' FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id || '::structure::000003', 'numbering' FROM documents WHERE doc_id % 7 = 0""")
def md_contract_errors(spark, sf_dir):
    """Chunks without the third of some documents, and with the fourth of others twice."""
    rows = chunked(spark, sf_dir).where(~(hashed("doc_id", 5) & (F.col("chunk_index") == 2)))
    return chunking.contract_errors(rows.unionByName(rows.where(hashed("doc_id", 7) & (F.col("chunk_index") == 3))))


@query("""SELECT doc_id || '::structure::000000' AS chunk_id, 'hash' AS problem FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id || '::structure::000001', 'coverage' FROM documents WHERE doc_id % 8 = 0""")
def md_fragment_errors(spark, sf_dir):
    """A block that has changed since it was chunked, and a fragment that starts too late."""
    docs = parsed(spark, sf_dir)
    blocks = parsing.block_rows(docs)
    blocks = blocks.withColumn("text", F.when(hashed("doc_id", 7) & (F.col("block_index") == 1), F.reverse("text")).otherwise(F.col("text")))

    def late(f: Column, i: Column) -> Column:
        moved = hashed("doc_id", 8) & (F.col("chunk_index") == 1) & (i == 2)
        return f.withField("char_start", F.when(moved, f["char_start"] + 1).otherwise(f["char_start"]))

    rows = chunking.chunk_documents(docs, "structure").withColumn("fragments", F.transform("fragments", late))
    return chunking.fragment_errors(rows, blocks).where(~((F.col("problem") == "hash") & F.endswith("chunk_id", F.lit("::000001"))))


# --- fixed windows ---------------------------------------------------------------------------------------------------

PIECES = r"(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D])[\x20\x09-\x0D]*"
FIXED = f"""
t AS (SELECT doc_id, text, regexp_extract_all(text, '{PIECES}') AS pieces FROM documents),
n AS (SELECT *, len(pieces) AS n, length(text) - length(array_to_string(pieces, '')) AS lead FROM t),
x AS (SELECT *, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 128 THEN 1 ELSE 1 + ceil((n - 128) / 112.0)::INT END)) AS chunk_index FROM n),
y AS (SELECT doc_id, chunk_index, n, chunk_index * 112 AS token_start, least(chunk_index * 112 + 128, n) AS token_end, lead, pieces, text FROM x),
chunks AS (SELECT doc_id, chunk_index, token_start, token_end, CASE WHEN chunk_index = 0 THEN 0 ELSE lead + length(array_to_string(pieces[1 : token_start], '')) END::INT AS char_start, (lead + length(array_to_string(pieces[1 : token_end], '')))::INT AS char_end, text AS body FROM y)"""


def fixed(spark, sf_dir: str, size: int = 128, overlap: int = 16) -> DataFrame:
    return chunking.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), size, overlap)


NAME = "doc_id || '::fixed::' || lpad(chunk_index::VARCHAR, 6, '0') AS chunk_id"


@query(f"WITH {FIXED} SELECT {NAME}, doc_id, chunk_index, token_start, token_end, token_end - token_start AS token_count, char_start, char_end, md5(substr(body, char_start + 1, char_end - char_start)) AS text_md5 FROM chunks")
def fixed_chunks(spark, sf_dir):
    return fixed(spark, sf_dir).withColumn("text_md5", F.md5("text")).drop("text")


@query(f"WITH {FIXED} SELECT {NAME}, doc_id, char_start AS c_start, char_end AS c_end FROM chunks")
def fixed_chunk_spans(spark, sf_dir):
    return evidence.fixed_chunk_spans(fixed(spark, sf_dir))


@query(r"SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]')")
def fixed_round_trip(spark, sf_dir):
    """Windows without overlap, one after the other, are the documents."""
    rows = fixed(spark, sf_dir, 100, 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return rows.select("doc_id", F.md5(F.array_join(F.transform("c", lambda c: c["text"]), "")).alias("text_md5"))


@query(f"""WITH {FIXED}, c AS (SELECT *, {NAME} FROM chunks)
SELECT chunk_id, 'missing' AS problem FROM c WHERE doc_id % 6 = 0 AND chunk_index = 1
UNION ALL SELECT chunk_id || 'x', 'unexpected' FROM c WHERE doc_id % 6 = 1 AND chunk_index = 0
UNION ALL SELECT chunk_id, 'window' FROM c WHERE doc_id % 6 = 2 AND chunk_index = 0
UNION ALL SELECT chunk_id, 'text' FROM c WHERE doc_id % 6 = 3 AND chunk_index = 0""")
def fixed_chunk_errors(spark, sf_dir):
    """Chunks damaged in four ways."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind, first = F.col("doc_id") % 6, F.col("chunk_index") == 0
    rows = fixed(spark, sf_dir).where(~((kind == 0) & (F.col("chunk_index") == 1)))
    rows = rows.withColumn("token_end", F.when((kind == 2) & first, F.col("token_end") + 1).otherwise(F.col("token_end")))
    rows = rows.withColumn("text", F.when((kind == 3) & first, F.lit("other")).otherwise(F.col("text")))
    added = rows.where((kind == 1) & first).withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))
    return chunking.fixed_errors(rows.unionByName(added), docs, 128, 16)


@query(f"""WITH {FIXED}, g AS (SELECT doc_id, min(char_start) FILTER (chunk_index = 2) - max(char_end) FILTER (chunk_index = 0) AS gap, max(n) AS n, max(length) AS length FROM (SELECT c.*, y.n, length(y.text) AS length FROM chunks c JOIN y USING (doc_id, chunk_index)) GROUP BY 1)
SELECT doc_id, (length - gap)::BIGINT AS covered, length::BIGINT AS length FROM g WHERE doc_id % 3 = 0 AND n > 240
UNION ALL SELECT doc_id, 0::BIGINT, length(text)::BIGINT FROM n WHERE n = 0 AND length(text) > 0""")
def fixed_coverage_gaps(spark, sf_dir):
    """Documents of which the second window is gone, where a third follows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = fixed(spark, sf_dir)
    third = rows.where("chunk_index = 2").select("doc_id", F.lit(True).alias("third"))
    kept = rows.join(third, "doc_id", "left").where(~(F.coalesce("third", F.lit(False)) & hashed("doc_id", 3) & (F.col("chunk_index") == 1)))
    return chunking.coverage_gaps(kept, docs)


@query(f"WITH {FIXED}, c AS (SELECT (token_end - token_start)::DOUBLE AS n FROM chunks) SELECT min(n) AS min, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS max FROM c")
def chunk_distribution(spark, sf_dir):
    return rounded(chunking.distribution(fixed(spark, sf_dir), "token_count"))


# --- text ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(lower(replace(replace(replace(text, 'ß', 'ss'), chr(160), ' '), '…', '...')), '[ \t\n\r\f\v]+'), lambda x: x <> ''), ' ')) AS form_md5 FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7fßäöüÄÖÜàâéèêëîïôùûçœÀÂÉÈÊËÎÏÔÙÛÇŒáíóúñÁÍÓÚÑ¿¡«»–—„“”’…]')""")
def canonical_forms(spark, sf_dir):
    """The exact normal form, of the documents whose letters SQL can fold as well."""
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\x7fßäöüÄÖÜàâéèêëîïôùûçœÀÂÉÈÊËÎÏÔÙÛÇŒáíóúñÁÍÓÚÑ¿¡«»–—„“”’…]"))
    return docs.select("doc_id", F.md5(tx.canonical_form("text")).alias("form_md5"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(' ' || chr(160) || lang || chr(9) || source || chr(8195), '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '') AS stripped, CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 80 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 79)) || '…' END AS excerpt FROM documents")
def stripped_and_excerpts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    padded = F.concat(F.lit("  "), "lang", F.lit("\t"), "source", F.lit(" "))
    return docs.select("doc_id", tx.stripped(padded).alias("stripped"), tx.excerpt(F.col("text"), 80).alias("excerpt"))


LEAKY = {"credential": "password = abcdefghijklmnopqrstuvwxyz0123456789", "token": "use ghp_abcdefghijklmnopqrstuvwxyz0123456789 now", "Unix path": "see /home/someone/notes.txt", "file URI": "file://C: is not file:///home/x"}


@query("SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN {quoted(k)}" for i, k in enumerate(LEAKY)) + " END AS leak FROM documents")
def outbound_leaks(spark, sf_dir):
    """Payloads with a secret or a private path in four of five, behind the document's words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]+", " ").alias("body"))
    text = F.col("body")
    for i, x in enumerate(LEAKY.values()):
        text = F.when(F.col("doc_id") % 5 == i, F.concat(text, F.lit(" " + x))).otherwise(text)
    found = tx.leaks(text)
    return rows.select("doc_id", F.when(F.size(found) > 0, F.element_at(found, 1)).alias("leak"))
