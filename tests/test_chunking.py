import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, parsing
from tessera.plans import markdown_queries

PAGE = """---
title: Start
draft: yes
tags: ["a", "b"]
---
# Guide

First sentence. Second `one`!
Still the same paragraph.

NOTE: mind the gap.

<docs-callout title="Look">
Inside *here*.
</docs-callout>

## Steps

- one
  - nested
- two

```ts
const x = 1;
```

| a | b |
|---|:-:|
| 1 \\| 2 | `x|y` |
| only |

<docs-code path="src/app.ts" header="App"/>

> quoted text

### Deep
tail
"""


def blocks_of(text):
    return [{"type": b.type, "text": b.text, "level": b.level} for b in parsing.parse(text).blocks]


def test_parser_finds_the_blocks():
    page = parsing.parse(PAGE)
    assert [b.type for b in page.blocks] == ["heading", "paragraph", "callout", "callout", "heading", "list", "code_block", "table", "code_reference", "blockquote", "heading", "paragraph"]
    assert page.front_matter == {"title": "Start", "draft": True, "tags": ["a", "b"]}
    assert page.blocks[1].text == "First sentence. Second `one`! Still the same paragraph."
    assert page.blocks[3].metadata["attributes"]["title"] == "Look" and page.blocks[3].text == "Inside *here*."
    assert [i["level"] for i in page.blocks[5].metadata["items"]] == [0, 1, 0]
    table = page.blocks[7].metadata
    assert table["rows"] == [["1 | 2", "`x|y`"], ["only", ""]] and table["ragged_rows"] == [1] and table["alignments"] == [None, "center"]
    assert page.blocks[8].text == "Referenced code: App"
    assert [b.start for b in page.blocks] == sorted(b.start for b in page.blocks)
    assert page.blocks[0].start == 6


@pytest.mark.parametrize(
    "page, want",
    [
        ("Foo\n---\nbar", [("heading", "Foo"), ("paragraph", "bar")]),
        ("Foo\nbar\n===\n", [("heading", "Foo bar")]),
        ("Foo\n\n---\nbar", [("paragraph", "Foo"), ("paragraph", "bar")]),
        ("- a\n\n\n- b", [("list", "- a\n- b")]),
        ("- a\n\n  more\n\n- b\n\nend", [("list", "- a\n  more\n- b"), ("paragraph", "end")]),
        ("1. a\n- b", [("list", "1. a"), ("list", "- b")]),
        ("- a\n* b\n1) c\n2) d\n1. e", [("list", "- a"), ("list", "* b"), ("list", "1) c\n2) d"), ("list", "1. e")]),
        ("- a\n  1. b\n- c", [("list", "- a\n  1. b\n- c")]),
        ("- a\n***\n- b", [("list", "- a"), ("list", "- b")]),
        ("- a\nlazy\n\nnot", [("list", "- a\nlazy"), ("paragraph", "not")]),
        ("para\n2. x", [("paragraph", "para 2. x")]),
        ("para\n1. x", [("paragraph", "para"), ("list", "1. x")]),
        ("para\n-\nmore", [("heading", "para"), ("paragraph", "more")]),
        ("<div>\n\ntext\n</div>\n\nend", [("html_block", "<div>"), ("paragraph", "text"), ("html_block", "</div>"), ("paragraph", "end")]),
        ("text <span>\n<span>x</span> more", [("paragraph", "text <span> <span>x</span> more")]),
        ("[x]: <u v> 'T'\n[y]: z\n\np", [("paragraph", "p")]),
    ],
)
def test_blocks_as_commonmark_has_them(page, want):
    assert [(b.type, b.text) for b in parsing.parse(page).blocks] == want


def test_reference_definitions():
    found = parsing.parse("[x]: <u v> 'T'\n[y]: http://z (a b)\n[w]: <> \"\"\n").metadata["references"]
    assert found == {"x": {"href": "u v", "line": 1, "title": "T"}, "y": {"href": "http://z", "line": 2, "title": "a b"}, "w": {"href": "", "line": 3}}


@pytest.mark.parametrize("text, end", [("<a>", 2), ("<a", -1), ("<a b='>'>", 8), ('<a b="\\">" c>', 12), ("<a b=\"x>", -1), ("<a 'x\ny' >", 9), ("", -1)])
def test_the_end_of_a_tag(text, end):
    assert parsing.Scanner.tag_end(text) == end


def test_two_section_algorithms_differ_on_skipped_levels():
    blocks = blocks_of("# A\n\n### B\n\n### C\n")
    assert [s.path for s in chunking.sections(blocks)] == [["A"], ["A", "B"], ["A", "C"]]
    assert [p for _, p in chunking.positional_sections(blocks)] == [["A"], ["A", "B"], ["A", "B", "C"]]


def test_section_tree_links():
    chunks = chunking.structure_chunks_of(blocks_of("# A\n\na\n\n## B\n\nb\n\n### C\n\nc\n\n## D\n\nd\n"), chunking.StructureConfig())
    assert [p for p, _ in chunking.section_links(chunks)] == [None, 0, 1, 0]
    assert [c for _, c in chunking.section_links(chunks)] == [[1, 3], [2], [], []]


@pytest.mark.parametrize("most", [3, 7, 20])
def test_chunks_keep_the_budget_and_every_character(most):
    text = PAGE + "\n\n" + "One two three four. Five six seven! Eight nine ten eleven twelve thirteen fourteen. " * 6
    blocks = blocks_of(text)
    for c in chunking.structure_chunks_of(blocks, chunking.StructureConfig(most)):
        assert chunking.count_tokens(c.text) <= most
    planned = chunking.planned_chunks_of(blocks, chunking.PlannerConfig(most))
    assert "".join(c.text for c in planned) == "\n\n".join(b["text"] for b in blocks)
    for i, b in enumerate(blocks):
        parts = chunking.split_block(b, i, most)
        assert "".join(b["text"][f.char_start : f.char_end] for f in parts) == b["text"]
        assert [f.fragment_index for f in parts] == list(range(len(parts)))


@pytest.mark.parametrize("raw", ["{", '{"groups": []}', '{"groups": [{"start_block_index": 1, "end_block_index": 2, "reason": "x"}]}', '{"groups": [{"start_block_index": 0, "end_block_index": 1, "reason": "x"}]}', '{"groups": 1, "groups": 2}', '{"groups": [{"start_block_index": true, "end_block_index": 2, "reason": "x"}]}'])
def test_bad_plans(raw):
    with pytest.raises(chunking.PlanError):
        chunking.parse_plan(raw, 0, 2)


def test_good_plan_and_batches():
    raw = '{"groups": [{"start_block_index": 0, "end_block_index": 1, "reason": "a"}, {"start_block_index": 2, "end_block_index": 2, "reason": "b"}]}'
    assert chunking.parse_plan(raw, 0, 2) == [(0, 1, "a"), (2, 2, "b")]
    three = [3, 3, 3]
    assert [len(b) for b in chunking.batched(three, int, 9, 2)] == [2, 1]
    assert [len(b) for b in chunking.batched(three, int, 5)] == [1, 1, 1]
    with pytest.raises(ValueError, match="exceeds"):
        chunking.batched(three, int, 2)


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(512, 512, 64, [0]), (513, 512, 64, [0, 448]), (1400, 512, 64, [0, 448, 896]), (1025, 512, 0, [0, 512, 1024]), (0, 512, 64, [])])
def test_fixed_windows(spark, n, size, overlap, want):
    docs = spark.createDataFrame([("d", "w " * n)], "doc_id string, text string")
    got = chunking.fixed_chunks(docs, size, overlap).orderBy("chunk_index").collect()
    assert [r["token_start"] for r in got] == want
    assert not got or got[-1]["token_end"] == n
    assert chunking.window_gaps(chunking.fixed_chunks(docs, size, overlap)).count() == 0


def test_chunks_as_frames(spark):
    docs = parsing.parse_documents(spark.createDataFrame([("d", PAGE), ("e", ""), ("f", None)], "doc_id string, text string"))
    assert parsing.corpus_errors(docs).count() == 0
    rows = parsing.block_rows(docs)
    whole = docs.select("doc_id", parsing.linear_text(docs["blocks"]).alias("text"))
    for r in rows.join(whole.withColumnRenamed("text", "whole"), "doc_id").collect():
        assert r["whole"][r["char_offset"] :].startswith(r["text"])
    for strategy in ("structure", "prompt"):
        chunks = chunking.chunk_documents(docs, strategy)
        assert chunking.contract_errors(chunks).count() == 0
        assert chunking.fragment_errors(chunks, rows).where("problem = 'hash'").count() == 0
    assert chunking.partition_errors(chunking.chunk_documents(docs, "prompt"), whole).count() == 0
    ids = [r["sentence_id"] for r in parsing.sentence_rows(docs).orderBy("sentence_id").collect()]
    assert ids[0] == "d:s000000" and len(ids) == len(set(ids))
    with pytest.raises(chunking.UnavailableStrategyError):
        chunking.chunk_documents(docs, "hierarchical")


def test_a_short_document_is_one_request_without_counting_its_candidates(monkeypatch):
    blocks = [{"type": "paragraph", "text": f"text {i}", "level": None, "metadata_json": None} for i in range(20)]
    whole = chunking.requests_of(blocks, chunking.PlannerConfig())
    counted = []
    monkeypatch.setattr(chunking, "count_tokens", lambda text, count=chunking.count_tokens: counted.append(text) or count(text))
    assert chunking.requests_of(blocks, chunking.PlannerConfig()) == whole and len(whole) == 1 and len(counted) == 20  # before: 40
    most = max(chunking.count_tokens(json.dumps(c, ensure_ascii=False)) for c in whole[0])
    assert [c for r in chunking.requests_of(blocks, chunking.PlannerConfig(batch_tokens=2 * most)) for c in r] == whole[0]
    assert len(chunking.requests_of(blocks, chunking.PlannerConfig(batch_tokens=2 * most))) >= 10
    assert chunking.requests_of([], chunking.PlannerConfig()) == []


def test_pages_under_two_ids_are_parsed_once(spark):
    parses = spark.sparkContext.accumulator(0)

    def parse(text):
        parses.add(1)
        return text

    docs = spark.createDataFrame([(i, f"page {i}") for i in range(6)], "doc_id long, text string").select("doc_id", F.udf(parse)("text").alias("blocks"))
    rows = markdown_queries.under_two_ids(docs).collect()
    assert parses.value == 6 and sorted(tuple(r) for r in rows) == sorted((x, f"page {i}") for i in range(6) for x in (i, -1 - i))


@pytest.mark.parametrize("name,text", [
    ("private key", "-----begin RSA PRIVATE KEY-----"), ("credential", "API-KEY = '" + "a1" * 20), ("credential", "client_ſecret: sk-" + "a" * 20), ("token", "AKIA" + "A1" * 8), ("token", "ghp_" + "a" * 36),
    ("Windows path", "c:\\users\\x"), ("Unix path", " /Users/me/x"), ("file URI", "FıLE:///home/x"), ("environment key", "OPENAI_API_KEY ="),
])
def test_leaks_are_found_behind_their_telltales(name, text):
    assert chunking._LEAKS[name].search(text) and all(t == t.casefold() for ts in chunking._TELLTALES.values() for t in ts)
    with pytest.raises(chunking.UnsafeRequestError, match=name):
        chunking.check_outbound(f"before {text} after" if name != "environment key" else text)
    chunking.check_outbound("nothing of the kind")


def test_errors_of_repeated_documents_are_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    pages = spark.createDataFrame([(1, "# A\n\nb\n\nc"), (1, "# A\n\nb\n\nc"), (1, "x"), (2, "fine"), (3, None), (3, None)], "doc_id int, text string")
    docs = parsing.parse_documents(pages.select("doc_id", F.udf(read)("text").alias("text")))
    bad = lambda b: b.withField("level", F.when(b["type"] == "heading", 9)).withField("source_line_start", F.when(b["text"] == "c", 0).otherwise(b["source_line_start"])).withField("type", F.when(b["text"] == "b", "verse").otherwise(b["type"]))
    got = sorted(tuple(r) for r in parsing.corpus_errors(docs.withColumn("blocks", F.transform("blocks", bad))).collect())
    assert got == sorted([(1, "heading level"), (1, "block type"), (1, "block order")] * 2 + [(1, "duplicate id"), (3, "duplicate id")])
    assert reads.value == 6  # before: 36
