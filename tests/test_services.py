"""Providers, planners, settings, question files and benchmarks, offline."""

import json
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.tokenizers import BytePairTokenizer, NoProgressError, stable_windows
from tessera.operators import chunking, evidence, metrics, parsing, providers, reconciliation, retrieval
from tessera.plans import benchmarks, experiments
from tessera.sources import artifacts, files

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Server:
    """A transport that gives prepared answers and keeps what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked, self.slept = list(answers), [], []

    def __call__(self, url, headers, body):
        self.asked.append(json.loads(body))
        status, headers, value = self.answers.pop(0)
        return status, headers, value if isinstance(value, bytes) else json.dumps(value).encode()

    def endpoint(self, **more):
        return providers.Endpoint("http://x", "m", "a secret key", transport=self, sleep=self.slept.append, **more)


def said(text, reason="stop"):
    return 200, {}, {"choices": [{"message": {"content": text}, "finish_reason": reason}]}


def test_endpoint_tries_again_and_keeps_secrets():
    s = Server((429, {"Retry-After": "7"}, {}), (503, {}, {}), said("yes"))
    assert providers.http_answer(s.endpoint(), "sys", "user", 10) == "yes" and s.slept == [7.0, 2.0]
    with pytest.raises(providers.ProviderError):
        providers.http_answer(Server((401, {}, {})).endpoint(), "s", "u", 1)
    with pytest.raises(providers.ProviderError):
        providers.http_answer(Server(*[(500, {}, {})] * 4).endpoint(), "s", "u", 1)
    with pytest.raises(chunking.UnsafeRequestError):
        providers.http_answer(Server().endpoint(), "s", "this is a secret key", 1)
    for bad in (said("cut", "length"), said("  "), (200, {}, b"no json")):
        with pytest.raises(providers.IntegrityError):
            providers.http_answer(Server(bad).endpoint(), "s", "u", 1)
    assert "secret" not in json.dumps(s.endpoint().identity())


def test_vectors_are_checked_and_put_in_order():
    data = {"data": [{"index": 1, "embedding": [0.0, 2]}, {"index": 0, "embedding": [1.0, 0.5]}]}
    assert providers.http_vectors(Server((200, {}, data)).endpoint(), ["a", "b"], 2) == [[1.0, 0.5], [0.0, 2.0]]
    for vectors in ([[1.0]], [[1.0, True]], [[1.0, float("inf")]], [[1.0, 2.0], [1.0, 2.0]]):
        with pytest.raises(providers.IntegrityError):
            providers.checked_vectors(vectors, 1, 2)
    with pytest.raises(providers.IntegrityError):
        providers.http_vectors(Server((200, {}, {"data": [{"index": 0, "embedding": [1.0, 1.0]}] * 2})).endpoint(), ["a", "b"], 2)


def test_query_cache(spark):
    asked = spark.createDataFrame([(1, " a "), (2, "a"), (3, "b")], "query_id int, query string")
    settings = {"m": 1}
    provider = lambda q: F.array(F.length(q).cast("double"))
    first = providers.embed_queries(asked, settings, provider)
    assert first.select("key").distinct().count() == 2 and not any(r["cached"] for r in first.collect())
    cache = first.where("query_id = 1").select("key", "vector")
    assert {r["query_id"]: r["cached"] for r in providers.embed_queries(asked, settings, provider, cache).collect()} == {1: True, 2: True, 3: False}
    assert [r["query"] for r in providers.missing_queries(asked, settings, cache).collect()] == ["b"]
    with pytest.raises(providers.CacheMissError):
        providers.embed_queries(asked, settings, provider, cache, only_cache=True)
    keys = spark.range(1).select(providers.query_key(F.lit("a"), settings).alias("q"), providers.embedding_key(F.lit("a"), settings).alias("d"), providers.query_key(F.lit("a"), {"m": 2}).alias("o")).first()
    assert len(set(keys)) == 3


def test_rewrites_are_parsed_strictly():
    assert providers.parse_rewrite('{"rewritten_query": " a b "}') == "a b"
    for raw in ("x", "[]", '{"rewritten_query": 1}', '{"rewritten_query": " "}', '{"rewritten_query": "a", "b": 1}', json.dumps({"rewritten_query": "a" * 1001})):
        with pytest.raises(providers.IntegrityError):
            providers.parse_rewrite(raw)


PAGE = "# A\n\none two\n\n## B\n\nthree\n"


def page_blocks(text=PAGE):
    return [{"type": b.type, "text": b.text, "level": b.level, "language": b.language, "ordered": b.ordered, "metadata_json": json.dumps(b.metadata)} for b in parsing.parse(text).blocks]


def test_planner_is_corrected_once():
    blocks = page_blocks()
    request = chunking.requests_of(blocks, chunking.PlannerConfig())[0]
    good = chunking.by_sections(request)
    tries = []

    def plan(answers):
        tries.clear()
        return lambda asked: (tries.append(asked), answers.pop(0))[1]

    assert chunking.resolve_plan(request, plan(["no", good])) == good and "correction" in tries[1][-1]
    with pytest.raises(chunking.PlanError):
        chunking.resolve_plan(request, plan(["no", "no"]))
    with pytest.raises(chunking.UnsafeRequestError):
        chunking.resolve_plan(request, plan([good]), secrets=("one two",))
    s = Server(said("", "length"), said(good))
    assert providers.http_planner(s.endpoint())(request) == good and s.asked[1]["max_tokens"] == 2 * s.asked[0]["max_tokens"]
    s = Server((400, {}, {}), said(good))
    assert providers.http_planner(s.endpoint())(request) == good and "response_format" not in s.asked[1]
    with pytest.raises(ValueError, match="exceeds"):
        chunking.requests_of(blocks, chunking.PlannerConfig(batch_tokens=5))


def test_structure_summaries():
    blocks = page_blocks("| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n  - y\n\nNOTE: z\n\n```ts\nq\n```\n\n## H\n")
    assert [chunking.structure_summary(b) for b in blocks] == [{"rows": 1, "columns": 2}, {"items": 2, "max_level": 1, "ordered": False}, {"kind": "note"}, {"language": "ts"}, {"level": 2}]


def test_plan_cache(spark):
    docs = parsing.parse_documents(spark.createDataFrame([("a", PAGE), ("b", PAGE), ("c", "")], "doc_id string, text string"))
    chunks, failures, plans = chunking.planned_chunks(docs)
    assert plans.count() == 1 and failures.count() == 0 and chunks.groupBy("doc_id").count().count() == 2
    never = lambda request: "no plan"
    again, failures, _ = chunking.planned_chunks(docs, never, cache=plans)
    assert failures.count() == 0 and again.exceptAll(chunks).count() == 0
    assert chunking.planned_chunks(docs, never)[1].count() == 2
    stale = plans.withColumn("request", F.lit("[]"))
    with pytest.raises(Exception, match="another request"):
        chunking.planned_chunks(docs, never, cache=stale)[0].collect()


def test_separators_are_counted():
    blocks = [{"type": "paragraph", "text": "a b c", "level": None} for _ in range(4)]
    count = lambda t: len(t)
    for run in chunking.pack_group(blocks, 1, 3, 14, count):
        assert count(chunking.SEPARATOR + chunking.rendered(blocks, run)) <= 14


def test_parser_edges():
    assert parsing.Scanner.tag_end('<docs-x a="1 \\" > 2">') == 20
    assert parsing.parse('<docs-step title="a \\"b\\"">\n\nx\n\n</docs-step>').blocks[0].metadata["container_path"][0]["type"] == "step"
    with pytest.raises(parsing.ParseError):
        parsing.parse('<docs-code language="ts">\nx\n')
    nested = parsing.parse("- one\n\n  | a | b |\n  |---|---|\n  | 1 | 2 |\n- two\n").blocks[0].metadata["nested_tables"]
    assert nested[0]["header"] == ["a", "b"] and nested[0]["rows"] == [["1", "2"]] and nested[0]["line_start"] == 1


# --- tokenizer -------------------------------------------------------------------------------------------------------


def test_windows_of_byte_pairs_are_text():
    t = BytePairTokenizer(VOCABULARY)
    for text in ("héllo wörld 字字字 \U0001f600\U0001f600 some more text that goes on", "plain words " * 30, "字" * 40):
        tokens = t.encode(text)
        assert t.decode_strict(tokens) == text
        for size, overlap in ((8, 2), (16, 0), (64, 8)):
            windows = stable_windows(t, tokens, size, overlap)
            assert windows[0][0] == 0 and windows[-1][1] == len(tokens) and all(b - a <= size for a, b in windows)
            assert all(t.is_stable(tokens[a:b]) for a, b in windows)
            assert all(x[0] < y[0] <= x[1] < y[1] for x, y in zip(windows, windows[1:], strict=False))
            if not overlap:
                assert "".join(t.decode_strict(tokens[a:b]) for a, b in windows) == text
    tokens = t.encode("\U0001f9ff")
    inside = [i for i in range(1, len(tokens)) if not t.is_boundary(tokens, i)]
    assert inside and t.retreat(tokens, inside[-1]) == 0
    with pytest.raises(NoProgressError):
        stable_windows(t, tokens, 1, 0)


def test_byte_pair_chunks(spark):
    docs = spark.createDataFrame([("d", "héllo wörld 字字字 and so on and on " * 9), ("e", ""), ("f", None)], "doc_id string, text string")
    t = BytePairTokenizer(VOCABULARY)
    rows = chunking.byte_pair_chunks(docs, t, 16, 4).orderBy("chunk_index").collect()
    text = docs.first()["text"]
    assert {r["doc_id"] for r in rows} == {"d"} and all(text[r["char_start"] : r["char_end"]] == r["text"] and t.count(r["text"]) == r["token_count"] for r in rows)
    assert all(a["token_end"] - b["token_start"] == b["actual_overlap"] for a, b in zip(rows, rows[1:], strict=False))
    whole = "".join(r["text"] for r in chunking.byte_pair_chunks(docs, t, 16, 0).orderBy("chunk_index").collect())
    assert whole == text


# --- settings and files ----------------------------------------------------------------------------------------------


@dataclass
class Settings:
    size: int
    overlap: int = 0
    names: tuple = ()


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "a.yaml").write_text("# c\nsize: 5 # five\nchunk_overlap: 2\nnames: [a, 'b']\n")
    assert files.load_config(str(tmp_path / "a.yaml"), Settings, {"chunk_overlap": "overlap"}) == Settings(5, 2, ["a", "b"])
    (tmp_path / "a.json").write_text('{"size": 5, "other": 1}')
    with pytest.raises(ValueError, match="unknown"):
        files.load_config(str(tmp_path / "a.json"), Settings)
    assert files.plain_yaml("a:\n  b: true\n  c:\n    d: null\ne: x") == {"a": {"b": True, "c": {"d": None}}, "e": "x"}
    for bad in ("a: 1\na: 2", "- x"):
        with pytest.raises(ValueError):
            files.plain_yaml(bad)
    (tmp_path / "in").mkdir()
    (tmp_path / ".env").write_text("export TESSERA_A='x'\nTESSERA_B=y\n")
    monkeypatch.setenv("TESSERA_B", "kept")
    monkeypatch.delenv("TESSERA_A", raising=False)
    assert files.load_dotenv(str(tmp_path / "in"), str(tmp_path)) == {"TESSERA_A": "x", "TESSERA_B": "y"}
    import os

    assert (os.environ.pop("TESSERA_A"), os.environ["TESSERA_B"]) == ("x", "kept")
    assert files.load_dotenv(str(tmp_path / "in"), str(tmp_path / "in")) == {}
    assert files.parse_filters(["a=1", "b=x=y"], ("a", "b")) == {"a": "1", "b": "x=y"}
    for bad in (["a"], ["a=1", "a=2"], ["c=1"]):
        with pytest.raises(ValueError):
            files.parse_filters(bad, ("a", "b"))
    assert files.resolve_strategies("all", ["a", "b"]) == ["a", "b"] and files.resolve_strategies("b", ["a", "b"]) == ["b"]
    for bad in ("c", "a,a", ""):
        with pytest.raises(ValueError):
            files.resolve_strategies(bad, ["a", "b"])
    assert files.build_scope(None) == "full" and files.build_scope(3) == "sample"


def test_question_files(spark, tmp_path):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    path = tmp_path / "q.json"

    def write(*records):
        path.write_text(json.dumps(records))
        return str(path)

    good = {"id": "1", "doc_id": "d", "question": "?", "answer": "!"}
    assert files.load_questions(spark, write(good), docs).count() == 1
    for bad in ([good, good], [good | {"doc_id": "x"}], [good | {"answer": " "}], [good | {"question": None}]):
        with pytest.raises(files.DatasetError):
            files.load_questions(spark, write(*bad), docs)
    assert files.load_questions(spark, write(good | {"answer": None}), docs, require_answer=False).count() == 1
    path.write_text('[{"id": "1", "id": "2"}]')
    with pytest.raises(Exception, match="stands twice"):
        files.json_records(spark, str(path), files.LEGACY).collect()
    lines = tmp_path / "r.jsonl"
    lines.write_text('{"query_id": "1", "strategy": "a"}\n\n{"query_id": "1"\n')
    with pytest.raises(Exception, match="r.jsonl:3"):
        files.json_lines(spark, str(lines), "query_id string, strategy string").collect()
    lines.write_text('{"query_id": "1", "strategy": "a"}\n{"query_id": "1", "strategy": "a"}\n')
    with pytest.raises(files.DatasetError):
        files.load_ranked_rows(spark, str(lines), "query_id string, strategy string")
    lines.write_text('{"query_id": "1", "query": "old", "rewrite": "x", "status": "rewritten"}\n')
    with pytest.raises(files.DatasetError):
        files.load_rewrites(spark, str(lines), spark.createDataFrame([("1", "new")], "query_id string, query string"))


# --- metrics and benchmarks ------------------------------------------------------------------------------------------


def test_queries_without_hits_count(spark):
    hits = spark.createDataFrame([("q1", "a", 1, "x"), ("q1", "a", 2, "y"), ("q2", "b", 1, "y")], "query_id string, strategy string, rank int, source string")
    relevant = spark.createDataFrame([("q1", "y"), ("q2", "y")], "query_id string, source string")
    asked = metrics.asked_of(relevant.select("query_id"), ["a", "b"])
    rows = {(r["query_id"], r["strategy"]): r for r in metrics.per_query(hits, relevant, asked=asked).collect()}
    assert len(rows) == 4 and rows["q2", "a"]["reciprocal_rank"] == 0 and rows["q2", "a"]["recall_5"] == 0 and rows["q1", "a"]["first_rank"] == 2
    deep = {(r["query_id"], r["strategy"]): r for r in metrics.depth_metrics(hits, relevant, 5, asked=asked).collect()}
    assert (deep["q2", "a"]["unique_sources"], deep["q2", "a"]["concentration"], deep["q2", "a"]["hit_10"], deep["q2", "a"]["hit_5"]) == (0, 0, None, 0)
    few = metrics.per_query(hits, relevant)
    assert tuple(metrics.pairwise(few, ["a", "b"]).first()) == ("a", "b", 1, 0, 1)
    assert {(r["strategy"], r["change"], r["queries"]) for r in metrics.compared(few.where("strategy = 'a'"), few.where("query_id = 'q2'").withColumn("strategy", F.lit("a"))).collect()} == {("a", "improved", 1), ("a", "degraded", 1)}


def test_fragmentation(spark):
    rows = [("a", "1", 0, 10, 10), ("b", "1", 0, 6, 10), ("b", "2", 3, 8, 10), ("b", "3", 5, 10, 10), ("b", "4", 1, 4, 10), ("c", "1", 2, 10, 10), ("d", "1", 0, 4, 10), ("d", "2", 6, 10, 10)]
    found = benchmarks.fragmentation(spark.createDataFrame(rows, "evidence_id string, chunk_id string, start int, end int, length int"))
    assert {r["evidence_id"]: (r["chunks"], r["in_one"]) for r in found.collect()} == {"a": (1, True), "b": (2, False), "c": (0, False), "d": (1, False)}


def test_lineage_and_freezing(spark, tmp_path):
    questions = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    rows = spark.createDataFrame([("q1", "s", "c1"), ("q2", "s", "c2")], "query_id string, strategy string, context string")
    path = str(tmp_path / "g")
    artifacts.publish(spark, path, {"answers": rows, "contexts": rows}, {"k": 1})
    assert benchmarks.load_generation(spark, path, {"k": 1}, questions).count() == 2
    assert benchmarks.load_prepared(spark, path, questions, ["s"]).count() == 2
    with pytest.raises(artifacts.StaleArtifactError):
        benchmarks.load_generation(spark, path, {"k": 2}, questions)
    with pytest.raises(files.DatasetError):
        benchmarks.load_generation(spark, path, {"k": 1}, questions.limit(1))
    with pytest.raises(files.DatasetError):
        benchmarks.load_prepared(spark, path, questions, ["s", "t"])
    assert [r["query_id"] for r in benchmarks.context_differences(rows, rows.withColumn("context", F.when(F.col("query_id") == "q1", "x").otherwise(F.col("context")))).collect()] == ["q1"]
    none = spark.createDataFrame([], "k string, name string, found double, wanted double")
    frozen = benchmarks.freeze_manifest(none, {"a": 1}, [{"path": "p", "sha256": "x"}])
    assert frozen["fingerprint"] == benchmarks.freeze_manifest(none, {"a": 1}, [{"path": "p", "sha256": "x"}])["fingerprint"]
    with pytest.raises(benchmarks.FreezeError):
        benchmarks.freeze_manifest(spark.createDataFrame([("r", "n", 1.0, 2.0)], none.schema), {}, [])
    found = artifacts.manifest(spark, path)
    benchmarks.check_retrieval_manifest(found, {"k": 1}, {"k": 1})
    for identity, pinned in (({"k": 2}, {}), ({"k": 1}, {"k": 3})):
        with pytest.raises(benchmarks.FreezeError):
            benchmarks.check_retrieval_manifest(found, identity, pinned)
    with pytest.raises(ValueError, match="another corpus"):
        reconciliation.check_lineage({"complete": True, "dataset_fingerprint": "d", "corpus_fingerprint": "c"}, "d", "e")


def test_index_and_preflight(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "s", "d1", "x", 3, "t1"), ("c2", "s", "d2", "x", 4, "t2")], "chunk_id string, strategy string, doc_id string, source string, token_count int, text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, vector array<double>")
    path = str(tmp_path / "i")
    benchmarks.build_index(spark, path, chunks, vectors, {"m": 1}, 2)
    assert benchmarks.load_index(spark, path, {"m": 1}, 2).select("index_id").distinct().count() == 2
    with pytest.raises(artifacts.StaleArtifactError):
        benchmarks.build_index(spark, path, chunks, vectors, {"m": 2}, 2)
    for c, v, d in ((chunks, vectors.limit(1), 2), (chunks.limit(1), vectors, 2), (chunks, vectors, 3), (chunks, vectors.union(vectors), 2)):
        with pytest.raises(files.DatasetError):
            benchmarks.build_index(spark, str(tmp_path / "j"), c, v, {}, d)
    docs = spark.createDataFrame([("d1", "t1"), ("d2", "t2")], "doc_id string, text string")
    asked, said_ = spark.createDataFrame([("q", "why?")], "question_id string, question string"), spark.createDataFrame([("e", "d1", "T1")], "evidence_id string, doc_id string, text string")
    verdict = lambda **k: benchmarks.readiness_verdict(benchmarks.preflight(spark, **({"documents": docs, "chunks": chunks, "vectors": vectors, "questions": asked, "evidence_rows": said_, "dimension": 2} | k)))
    assert verdict() == "READY" and verdict(dimension=3) == "BLOCKED"
    assert verdict(evidence_rows=said_.withColumn("text", F.lit("no"))) == "READY_WITH_WARNINGS"


def test_publishing_experiments(spark, tmp_path):
    hits = spark.createDataFrame([("q1", s, r, f"c{r}", "x" if r == 2 else "y") for s in "ab" for r in (1, 2, 3)], "query_id string, strategy string, rank int, chunk_id string, source string")
    relevant = spark.createDataFrame([("q1", "x"), ("q2", "x")], "query_id string, source string")
    path = str(tmp_path / "d")
    counts = benchmarks.publish_depths(spark, path, hits, relevant, ["a", "b"], [1, 3], {"e": 1})["counts"]
    assert counts["per_query_1"] == 4 and counts["overlap_3_a_b"] == 1
    run = hits.where("strategy = 'a'").withColumn("score", F.lit(1.0) / F.col("rank"))
    variants = experiments.rewrite_variants(run, run.where("rank = 2"))
    done = benchmarks.publish_rewrites(spark, str(tmp_path / "r"), {k: v.join(hits.select("query_id", "chunk_id", "source").distinct(), ["query_id", "chunk_id"]) if "source" not in v.columns else v for k, v in variants.items()}, run, relevant, {"r": 1})
    assert set(done["counts"]) == {"per_query_Q1", "comparison_Q1", "per_query_Q2", "comparison_Q2"}
    sure = benchmarks.retrieval_uncertainty(metrics.per_query(hits, relevant), 200)
    assert {(r["strategy"], r["metric"]) for r in sure.collect()} == {(s, m) for s in "ab" for m in ("hit_5", "mrr")}


def test_dense_search_in_a_grid(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(70, 5))
    x[3] = 0
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(70)], "chunk_id long, vector array<double>")
    asked = rows.where("chunk_id between 10 and 40").withColumnRenamed("chunk_id", "query_id")
    held = retrieval.cosine_search(asked, rows, 6, exclude_same=True, decimals=9)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "PIECE_ROWS", 9)
    grid = retrieval.cosine_search(asked, rows, 6, exclude_same=True, decimals=9)
    assert grid.count() == 31 * 6 and grid.select(*held.columns).exceptAll(held).count() == 0
    with pytest.raises(Exception, match="length zero"):
        retrieval.cosine_search(rows.withColumnRenamed("chunk_id", "query_id"), rows, 6).collect()


def test_small_guards(spark):
    assert benchmarks.metric_names(["token_f1", "exact"]) == ["f1", "precision", "recall", "exact"]
    with pytest.raises(ValueError):
        benchmarks.metric_names(["bleu"])
    wide = spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, 4.0), ("c", None, 1.0)], "question_id string, x double, y double")
    assert benchmarks.score_matrix(wide, ["x", "y"]).tolist() == [[3.0, 1.0], [4.0, 2.0]]
    for bad in ([], [[1.0]], [np.nan]):
        with pytest.raises(ValueError):
            benchmarks.guarded(bad)
    missing = spark.createDataFrame([("e", "d", "alpha beta gamma")], "evidence_id string, doc_id string, sentence string")
    docs = parsing.parse_documents(spark.createDataFrame([("d", "# T\n\nalpha beta gamm\n\nother\n")], "doc_id string, text string"))
    best = reconciliation.text_candidates(missing, reconciliation.source_units(docs)).orderBy("rank").first()
    assert (best["text"], best["previous_block"], best["next_block"]) == ("alpha beta gamm", "T", "other")
    spans = spark.createDataFrame([("e", "d", 0, 0, 5)], "evidence_id string, doc_id string, span int, start int, end int")
    assert evidence.chunk_matches(spans, evidence.fixed_chunk_spans(chunking.fixed_chunks(spark.createDataFrame([("d", " ab cd")], "doc_id string, text string"), 1, 0))).count() == 2
