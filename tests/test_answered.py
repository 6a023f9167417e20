"""Stores of answers: asked once, one writer, one identity; planner and generation runs over them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, parsing, providers
from tessera.plans import experiments
from tessera.sources import answered, artifacts
from tessera.sources.answered import AnswerStore, BusyError, by_column, each

PAGE = "# Title {0}\n\nSome text of page {0}.\n\n## Part\n\nMore text.\n"


def requests(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "request string").select(F.sha2("request", 256).alias("key"), "request")


def answers_of(store):
    return {r["request"]: r["answer"] for r in store.answers().collect()}


def test_each_request_is_asked_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def ask(text):
        calls.add(1)
        if text.startswith("bad"):
            raise ValueError("not today")
        return None if text == "none" else text.upper()

    store = AnswerStore(spark, str(tmp_path / "s"), {"m": 1})
    got = store.fill(requests(spark, "a", "b", "a", "bad1", "none"), each(ask), batch_requests=2)
    assert (got.reused, got.answered, got.failed) == (0, 2, 2) and calls.value == 4
    assert answers_of(store) == {"a": "A", "b": "B"}
    for _ in range(3):
        assert {r["request"]: r["problem"] for r in store.failures().collect()} == {"bad1": "ValueError: not today", "none": "no answer"}
    assert calls.value == 4
    # another run, in another process: what failed is tried again, the rest is not
    again = AnswerStore(spark, str(tmp_path / "s"), {"m": 1})
    got = again.fill(requests(spark, "a", "c", "none"), by_column(F.upper))
    assert (got.reused, got.answered, got.failed) == (1, 2, 0)
    assert answers_of(again) == {"a": "A", "b": "B", "c": "C", "none": "NONE"}
    assert [r["request"] for r in again.failures().collect()] == ["bad1"]
    assert again.fill(requests(spark), each(ask)).answered == 0


def test_a_store_has_one_identity_and_one_writer(spark, tmp_path):
    path = str(tmp_path / "s")
    store = AnswerStore(spark, path, {"m": 1})
    with pytest.raises(artifacts.StaleArtifactError):
        AnswerStore(spark, path, {"m": 2})
    other = AnswerStore(spark, path, {"m": 1})
    with store.lease():
        store.fill(requests(spark, "a"), by_column(F.upper))  # the holder may write
        with pytest.raises(BusyError):
            other.fill(requests(spark, "b"), by_column(F.upper))
    assert other.fill(requests(spark, "a", "b"), by_column(F.upper)).reused == 1


def test_an_abandoned_lease_is_taken_over_and_its_holder_cannot_commit(spark, tmp_path):
    path = str(tmp_path / "s")
    slow = AnswerStore(spark, path, {})
    with pytest.raises(BusyError, match="taken over"), slow.lease():
        os.utime(f"{path}/lease", (1, 1))
        fast = AnswerStore(spark, path, {})
        with fast.lease():
            slow.fill(requests(spark, "late"), by_column(F.upper))
    assert answers_of(fast) == {} and not os.path.exists(f"{path}/lease")


def test_a_run_that_breaks_off_keeps_its_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    store = AnswerStore(spark, path, {})
    seen = []

    def solve(rows):
        if len(seen) == 2:
            raise KeyboardInterrupt
        seen.append(rows.count())
        return by_column(F.upper)(rows)

    with pytest.raises(KeyboardInterrupt):
        store.fill(requests(spark, *map(str, range(40))), solve, batch_requests=10)
    os.makedirs(f"{path}/answers/.batch-dead")  # what a write leaves that dies half way
    kept = answers_of(store)
    assert len(kept) == sum(seen) < 40
    got = AnswerStore(spark, path, {}).fill(requests(spark, *map(str, range(40))), by_column(F.lower))
    assert got.reused == len(kept) and got.answered == 40 - len(kept) and not os.path.exists(f"{path}/answers/.batch-dead")


def test_keys_stand_for_one_request(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "s"), {})
    two = spark.createDataFrame([("k", "a"), ("k", "b")], "key string, request string")
    with pytest.raises(Exception, match="another request"):
        store.fill(two, by_column(F.upper))
    store.fill(two.limit(1), by_column(F.upper))
    with pytest.raises(Exception, match="another request"):
        store.fill(two.where("request = 'b'"), by_column(F.upper))


# --- planners


def test_a_planner_is_called_once_for_each_request(spark, tmp_path):
    docs = parsing.parse_documents(spark.createDataFrame([(i, PAGE.format(i % 6)) for i in range(12)], "doc_id int, text string"))
    calls = spark.sparkContext.accumulator(0)

    def plan(request):
        calls.add(1)
        return chunking.by_sections(request)

    store = AnswerStore(spark, str(tmp_path / "plans"), {"planner": "counted"})
    chunks, failures, plans = chunking.planned_chunks(docs, plan, store=store)
    assert (chunks.select("doc_id").distinct().count(), failures.count(), plans.count()) == (12, 0, 6)
    assert (chunks.count(), failures.count(), plans.count()) == (24, 0, 6) and calls.value == 6
    chunking.planned_chunks(docs, plan, store=AnswerStore(spark, str(tmp_path / "plans"), {"planner": "counted"}))[0].count()
    assert calls.value == 6


def test_a_planner_that_breaks_fails_its_documents_only(spark):
    docs = parsing.parse_documents(spark.createDataFrame([(i, PAGE.format(i)) for i in range(4)], "doc_id int, text string"))

    def plan(request):
        if "page 2" in json.dumps(request):
            raise providers.ProviderError("gone")
        return chunking.by_sections(request)

    chunks, failures, plans = chunking.planned_chunks(docs, plan)
    assert [tuple(r) for r in failures.collect()] == [("2", "ProviderError: gone")]
    assert chunks.select("doc_id").distinct().count() == 3 == plans.count()


# --- generation


def prompts(spark, n):
    return spark.createDataFrame([(f"q{i}", "s", "sys", f"u{i // 2}") for i in range(n)], "query_id string, strategy string, system string, user string")


def endpoint(status=200):
    def transport(url, headers, body):
        user = json.loads(body)["messages"][1]["content"]
        reason = "length" if user == "u1" and status == 200 else "stop"
        if user == "u2" and status == 200:
            raise TimeoutError
        return 200, {}, json.dumps({"choices": [{"finish_reason": reason, "message": {"content": f"to {user}"}}]}).encode()

    return providers.Endpoint("http://model", "m", "key", 2, 0.0, transport, lambda s: None)


def test_generation_over_a_transport(spark, tmp_path):
    path, asked = str(tmp_path / "g"), prompts(spark, 8)
    assert not experiments.run_generation(spark, path, asked, {"model": "m"}, solve=providers.http_answers(endpoint(), 64))
    assert {r["query_id"]: r["problem"].split(":")[0] for r in spark.read.parquet(f"{path}/failures.parquet").collect()} == {"q2": "IntegrityError", "q3": "IntegrityError", "q4": "ProviderError", "q5": "ProviderError"}
    assert {r["query_id"]: r["answer"] for r in spark.read.parquet(f"{path}/answers.parquet").collect()} == {"q0": "to u0", "q1": "to u0", "q6": "to u3", "q7": "to u3"}
    assert artifacts.manifest(spark, path) is None
    assert experiments.run_generation(spark, path, asked, {"model": "m"}, solve=providers.http_answers(endpoint(201), 64))
    assert artifacts.load(spark, path, "answers", {"model": "m"}, unique=["query_id", "strategy"]).count() == 8
    assert not os.path.exists(f"{path}/failures.parquet")


def test_generation_keeps_its_identity(spark, tmp_path):
    path, asked = str(tmp_path / "g"), prompts(spark, 4)
    broken = lambda request: F.when(F.contains(request, F.lit("u1")), F.lit("one"))
    assert not experiments.run_generation(spark, path, asked, {"model": "a"}, broken)
    for identity, rows in (({"model": "b"}, asked), ({"model": "a"}, prompts(spark, 3))):
        with pytest.raises(artifacts.StaleArtifactError):
            experiments.run_generation(spark, path, rows, identity)
    assert experiments.run_generation(spark, path, asked, {"model": "a"}, lambda request: F.lit("two"))
    with pytest.raises(artifacts.StaleArtifactError):
        experiments.run_generation(spark, path, asked, {"model": "b"})

    def never(rows):
        raise AssertionError("a complete run asks nobody")

    assert experiments.run_generation(spark, path, asked, {"model": "a"}, solve=never)
    assert sorted(r["answer"] for r in artifacts.load(spark, path, "answers").collect()) == ["one", "one", "two", "two"]
    with pytest.raises(ValueError, match="two requests"):
        experiments.run_generation(spark, str(tmp_path / "h"), asked.union(asked), {})


def test_settings_are_in_the_key(spark):
    from tessera.operators import context

    keys = [{r["key"] for r in context.generate(prompts(spark, 2), settings=s).collect()} for s in (None, {"model": "a"}, {"model": "a", "max_tokens": 9})]
    assert all(len(k) == 1 for k in keys) and len(set.union(*keys)) == 3


def test_a_batch_reads_its_own_requests_and_batches_do_not_follow_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answered, "BATCHES", 5)
    store = AnswerStore(spark, str(tmp_path / "s"), {})
    read = []

    def solve(rows):
        read.append((rows.count(), len(rows.inputFiles())))
        return by_column(F.upper)(rows)

    names = [f"r{i}" for i in range(60)]
    got = store.fill(requests(spark, *names), solve, batch_requests=2)
    assert (got.answered, got.failed) == (60, 0) and answers_of(store) == {n: n.upper() for n in names}
    assert len(read) <= 5 and sum(n for n, _ in read) == 60
    assert max(files for _, files in read) == 1  # before, each of 30 batches read all of them
    assert not [x for x in os.listdir(tmp_path / "s") if x.startswith("asked-")]


def test_pages_are_parsed_once_for_all_results(spark, tmp_path):
    parses = spark.sparkContext.accumulator(0)

    def parse(text):
        parses.add(1)
        return text

    pages = spark.createDataFrame([(i, PAGE.format(i % 6)) for i in range(12)], "doc_id int, text string")
    docs = parsing.parse_documents(pages.select("doc_id", F.udf(parse)("text").alias("text")))
    results = chunking.planned_chunks(docs)
    assert [df.count() for df in results][1:] == [0, 6] and parses.value == 12
