import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, retrieval


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, strategy string, rank int, chunk_id string, source string, token_count int")


def hits_of(spark, tokens):
    return ranked(spark, [("q", "s", i + 1, f"c{i}", f"c{i}", t) for i, t in enumerate(tokens)])


def test_budget_skips_what_does_not_fit(spark):
    row = retrieval.same_token_budget(hits_of(spark, [60, 50, 40, 10]), 100, 4).first()
    assert [h["rank"] for h in row["selected"]] == [1, 3]
    assert (row["actual_selected_tokens"], row["budget_utilization"], row["budget_overflow"], row["candidate_exhausted"]) == (100, 1.0, False, False)


def test_budget_stops_at_an_oversized_first(spark):
    row = retrieval.same_token_budget(hits_of(spark, [51, 1]), 50, 4).first()
    assert [h["rank"] for h in row["selected"]] == [1]
    assert row["budget_overflow"] and row["candidate_exhausted"]


def test_top_k_protocol(spark):
    assert [r["rank"] for r in retrieval.same_top_k(hits_of(spark, [10] * 4), 3, 4).orderBy("rank").collect()] == [1, 2, 3]


def test_fusion_and_ties(spark):
    a = ranked(spark, [("q", "s", 1, "a", "", 1), ("q", "s", 2, "b", "", 1)])
    b = ranked(spark, [("q", "s", 1, "b", "", 1), ("q", "s", 2, "c", "", 1)])
    got = [(r["chunk_id"], r["score"]) for r in retrieval.reciprocal_rank_fusion([a, b], 5, 0).orderBy("rank").collect()]
    assert got == [("b", 1.5), ("a", 1.0), ("c", 0.5)]
    z = ranked(spark, [("q", "s", 1, "z", "", 1)])
    y = ranked(spark, [("q", "s", 1, "a", "", 1)])
    assert [r["chunk_id"] for r in retrieval.reciprocal_rank_fusion([z, y], 5).orderBy("rank").collect()] == ["a", "z"]


@pytest.mark.parametrize(("cap", "depth", "want"), [(1, 9, ["a1", "b1", "c1"]), (2, 3, ["a1", "a2", "b1"]), (None, 2, ["a1", "a2"])])
def test_source_cap(spark, cap, depth, want):
    rows = ranked(spark, [("q", "s", i + 1, c, c[0], 1) for i, c in enumerate(["a1", "a2", "b1", "c1"])])
    got = retrieval.source_cap(rows, cap, depth).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == want
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_cosine_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 5))
    x[7] = 0
    x[9] = x[8]
    chunks = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, vector array<double>")
    asked = chunks.where("chunk_id in (1, 8)").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in retrieval.cosine_search(asked, chunks, 50, exclude_same=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    for q in (1, 8):
        scores = [(-1.0 if not x[i].any() else float(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])), i) for i in range(50) if i != q]
        want = [(i, round(s, 9)) for s, i in sorted(scores, key=lambda p: (-round(p[0], 12), p[1]))]
        assert got[q] == want
    with pytest.raises(ValueError, match="zero"):
        retrieval.cosine_search(asked.withColumn("vector", F.array(*[F.lit(0.0)] * 5)), chunks, 1)


def test_filters(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, source string")
    assert [r["chunk_id"] for r in retrieval.with_filters(rows, {"source": "y"}).collect()] == ["b"]
    with pytest.raises(ValueError, match="no filter"):
        retrieval.with_filters(rows, {"text": "y"})


def test_bm25_ranks_everything_and_fills_with_zero(spark):
    chunks = spark.createDataFrame([("b", "beta"), ("a", "alpha"), ("exact", "@Input() café")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "CAFÉ"), ("q2", "nothing")], "query_id string, query string")
    got = retrieval.bm25_search(asked, chunks, 3).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in got] == ["exact", "a", "b", "a", "b", "exact"]
    assert [r["score"] > 0 for r in got] == [True] + [False] * 5


def test_ranking_metrics(spark):
    rows = ranked(spark, [("q", "s", i + 1, str(i), x, 1) for i, x in enumerate("xyzb")] + [("p", "s", 1, "0", "x", 1)])
    wanted = spark.createDataFrame([("q", "y"), ("q", "b"), ("p", "a")], "query_id string, source string")
    got = {r["query_id"]: r for r in metrics.per_query(rows, wanted).collect()}
    q, p = got["q"], got["p"]
    assert (q["first_rank"], q["hit_1"], q["hit_3"], q["hit_5"], q["hit_10"], q["recall_5"], q["reciprocal_rank"]) == (2, 0, 1, 1, 1, 1.0, 0.5)
    assert (p["first_rank"], p["reciprocal_rank"], p["hit_10"]) == (None, 0.0, 0)
    assert metrics.macro(metrics.per_query(rows, wanted), ["strategy"]).first()["mrr"] == 0.25


def test_depth_metrics(spark):
    rows = ranked(spark, [("q", "s", i + 1, str(i), x, 1) for i, x in enumerate(["x", "x", "gold", "other", "second"])])
    wanted = spark.createDataFrame([("q", "gold"), ("q", "second")], "query_id string, source string")
    r = metrics.depth_metrics(rows, wanted, 5).first()
    assert (r["first_rank"], r["recall_5"], r["hit_10"], r["unique_sources"], r["duplicates"]) == (3, 1.0, None, 4, 1)


def test_pairs_overlap_and_audit(spark):
    m = spark.createDataFrame([("q", "a", 1), ("q", "b", None), ("p", "a", 2), ("p", "b", 2)], "query_id string, strategy string, first_rank int")
    assert tuple(metrics.pairwise(m, ["b", "a"]).first()) == ("b", "a", 0, 1, 1)
    assert [r["query_id"] for r in metrics.disagreements(m).collect()] == ["q"]
    rows = ranked(spark, [("q", "a", 1, "1", "x", 1), ("q", "b", 1, "2", "y", 1), ("q", "b", 2, "1", "x", 1)])
    assert metrics.source_overlap(rows, "a", "b", 5).first()["jaccard"] == 0.5
    decisions = spark.createDataFrame([("q", "x", "remove"), ("q", "z", "add")], "query_id string, source string, action string")
    wanted = spark.createDataFrame([("q", "x"), ("q", "y")], "query_id string, source string")
    assert sorted(r["source"] for r in metrics.revised_relevance(wanted, decisions).collect()) == ["y", "z"]


def test_spot_checks(spark):
    wide = spark.createDataFrame([("q1", 0.9, 0.1), ("q2", 0.2, 0.3), ("q3", 0.5, 0.5)], "question_id string, a double, b double")
    got = [(r["kind"], r["question_id"]) for r in metrics.spot_checks(wide, ["a", "b"], 1).collect()]
    assert got == [("a", "q1"), ("b", "q2"), ("tie", "q3")]


def test_the_best_of_pieces_are_the_best_of_all(monkeypatch):
    """Many ties, ids as numbers and as text, far fewer scores at once than there are."""
    monkeypatch.setattr(retrieval, "CELLS", 64)
    rng = np.random.default_rng(7)
    x, q = rng.integers(-1, 2, (500, 3)).astype(float), rng.integers(1, 3, (8, 3)).astype(float)
    for cids in (rng.permutation(500), np.array([f"c{i}" for i in rng.permutation(500)], object)):
        ids = cids[:8]
        best, largest = retrieval.Best(ids, q, 5, True, 6), 0
        for at in range(0, 500, 90):
            best.add(cids[at : at + 90], x[at : at + 90])
            largest = max(largest, sum(len(p[0]) for p in best.parts))
        got = list(zip(*(a.tolist() for a in best.cut()), strict=True))
        rows, cols, scores = retrieval.best_cosines(ids, q, cids, x, 500, True, 6)
        want = [w for r in range(8) for w in sorted(((r, cids[c], s) for rr, c, s in zip(rows.tolist(), cols, scores.tolist(), strict=True) if rr == r), key=lambda w: (-w[2], w[1]))[:5]]
        assert got == want and largest <= 4 * 5 * 8 + 64
