import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.plans import experiments
from tessera.sources import artifacts


def test_rewrites_fall_back(spark):
    rows = spark.createDataFrame([("1", " how does @Input work "), ("2", "plain words"), ("3", "keep me")], "query_id string, query string")
    proposal = lambda q: F.when(q == "plain words", "plain simple words").when(q == "keep me", "keep me").otherwise("how does it work")
    got = {r["query_id"]: (r["rewrite"], r["status"]) for r in experiments.prepare_rewrites(rows, proposal).collect()}
    assert got == {"1": ("how does @Input work", "rejected_fidelity"), "2": ("plain simple words", "rewritten"), "3": ("keep me", "unchanged")}
    cache = spark.createDataFrame([("plain words", "plain words")], "query string, proposal string")
    assert {r["status"] for r in experiments.prepare_rewrites(rows, proposal, cache).where("query_id = '2'").collect()} == {"unchanged"}


def test_publication_and_families(spark, tmp_path):
    hits = spark.createDataFrame([("q", "s", 1, "c", "x"), ("q", "s", 2, "d", "y")], "query_id string, strategy string, rank int, chunk_id string, source string")
    wanted = spark.createDataFrame([("q", "y")], "query_id string, source string")
    kinds = spark.createDataFrame([("q", "k")], "query_id string, category string")
    done = experiments.publish_ranked(spark, str(tmp_path / "e"), experiments.Experiment("run", "E1", 2, "dense"), hits, wanted, kinds)
    assert done["counts"] == {"per_query": 1, "aggregate": 1, "by_category": 1}
    assert artifacts.load(spark, str(tmp_path / "e"), "aggregate").first()["mrr"] == 0.5
    with pytest.raises(ValueError, match="no such"):
        experiments.Experiment("run", "E9", 2, "dense")


def test_generation_resumes(spark, tmp_path):
    asked = spark.createDataFrame([("a", "s", "sys", "u1"), ("b", "s", "sys", "u2")], "query_id string, strategy string, system string, user string")
    path = str(tmp_path / "g")
    broken = lambda request: F.when(F.contains(request, F.lit("u1")), F.lit("one"))
    assert not experiments.run_generation(spark, path, asked, {"m": 1}, broken)
    assert artifacts.manifest(spark, path) is None
    assert experiments.run_generation(spark, path, asked, {"m": 1}, lambda request: F.lit("two"))
    assert {r["query_id"]: r["answer"] for r in spark.read.parquet(f"{path}/answers.parquet").collect()} == {"a": "one", "b": "two"}
    assert artifacts.manifest(spark, path)["counts"] == {"answers": 2}


def test_analysis_finds_a_clear_difference(spark):
    rows = [(str(i), s, min(1.0, 0.4 + (0.2 + i % 5 * 0.01 if s == "a" else 0.0) + i % 3 * 0.05)) for i in range(40) for s in ("a", "b")]
    scored = spark.createDataFrame(rows, "question_id string, strategy string, f1 double")
    out = experiments.paired_analysis(spark, scored, ["a", "b"], 2_000)
    r = out.first()
    assert r["supported"] and r["rank_biserial"] == 1.0 and r["low"] > 0.15
    assert experiments.conclusion(out).startswith("1 of 1")
    wide = scored.groupBy("question_id").pivot("strategy", ["a", "b"]).agg(F.first("f1")).withColumn("kind", F.when(F.col("question_id").cast("int") < 5, "few").otherwise("many"))
    kinds = {r["kind"]: (r["n"], r["small"]) for r in experiments.strata(wide, "kind", "a", "b", 200).collect()}
    assert kinds == {"few": (5, True), "many": (35, False)}
    assert experiments.sensitivity(wide, "a", "b", [1, 2], [100, 200]).first()["stable"]
    events = scored.select("question_id", "strategy", F.when(F.col("question_id").cast("int") < 10, 1).otherwise(0).alias("hit"))
    assert {r["with_n"] for r in experiments.relation(scored, events, "hit").collect()} == {10}
    pinned = spark.createDataFrame([("a", "mean", 1.0), ("a", "gone", 1.0)], "strategy string, name string, wanted double")
    measured = spark.createDataFrame([("a", "mean", 1.0 + 1e-13)], "strategy string, name string, value double")
    assert [r["name"] for r in experiments.freeze_errors(measured, pinned, ["strategy"]).collect()] == ["gone"]


def test_pools_are_reranked_from_hits_that_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    words = "alpha beta gamma delta".split()
    chunks = spark.createDataFrame([(i, " ".join(words[: 1 + i % 4]) + " x" * (i % 3)) for i in range(12)], "chunk_id long, text string")
    queries = spark.createDataFrame([(q, f"{words[q]} {words[3 - q]}") for q in range(2)], "query_id long, query string")
    rows = [(q, r, (5 * r + q) % 12) for q in range(2) for r in range(1, 9)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long").mapInArrow(lambda batches: (made.add(b.num_rows) or b for b in batches), "query_id long, rank int, chunk_id long")
    got = {tuple(r) for r in experiments.rerank_pools(queries, chunks, hits, [2, 5, 8], 3, 6).select("pool", "query_id", "rank", "chunk_id").collect()}
    once = made.value
    want = set()
    for pool in (2, 5, 8):
        own = spark.createDataFrame([x for x in rows if x[1] <= pool], "query_id long, rank int, chunk_id long")
        want |= {(pool, r["query_id"], r["rank"], r["chunk_id"]) for r in retrieval.bm25_rerank(queries, chunks, own, 3, decimals=6).collect()}
    assert got == want and len(got) == 16 and once == 16  # before, each pool made them twice
