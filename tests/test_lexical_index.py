"""BM25 from an inverted index against the formula, over blocks, query blocks and stored indexes."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical_index, retrieval
from tessera.operators.lexical_index import LexicalIndex

WORDS = ["alpha", "Beta", "GAMMA", "café", "CAFÉ", "straße", "STRASSE", "x1", "the", "the", "of"]


def chunks(n):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS + [f"r{rng.randint(0, 30)}"], k=rng.randint(0, 25)))) for i in range(n)]
    return rows + [(n, ""), (n + 1, None), (n + 2, "the " * 3000), (3, "alpha alpha")]


ASKED = [("a", "alpha the the"), ("b", "STRASSE café r1 r2 r3"), ("c", ""), ("d", "nothing here"), ("e", "r4 r5"), ("f", "of of of beta")]


def plain(rows, asked, k, k1=1.2, b=0.75):
    of = lambda t: [w.casefold() for w in (t or "").split()]
    held = [(i, Counter(of(t))) for i, t in rows]
    mean = sum(c.total() for _, c in held) / len(held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for q, text in asked:
        best = {}
        for i, c in held:
            s = sum(n * math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * c.total() / mean)) for t, n in Counter(of(text)).items() if c[t])
            best[i] = max(best.get(i, 0.0), round(s, 6))
        out |= {(q, r, i, s) for r, (s, i) in enumerate([(s, i) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))][:k], 1)}
    return out


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id string, query string")


def rows_of(df):
    return {(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_search_against_the_formula(spark, k):
    table, asked = frames(spark, chunks(300), ASKED)
    assert rows_of(retrieval.bm25_search(asked, table, k, decimals=6)) == plain(chunks(300), ASKED, k)


def test_a_stored_index_serves_many_searches_in_blocks_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "QUERY_BLOCK", 2)
    table, asked = frames(spark, chunks(300), ASKED)
    index = LexicalIndex.build(table, str(tmp_path / "i"))
    again = LexicalIndex(spark, str(tmp_path / "i"))
    for k in (3, 20):
        assert rows_of(retrieval.bm25_search(asked, again, k, decimals=6)) == plain(chunks(300), ASKED, k)
    assert index.totals()[0] == 304
    terms = [r["term"] for r in again.rows().where("term is not null").select("term").collect()]
    assert sorted(set(terms)) == sorted({w.casefold() for w in WORDS} | {f"r{i}" for i in range(31)})
    pairs = spark.createDataFrame([(q, i) for q, _ in ASKED for i in (0, 3, 9, 302)], "query_id string, chunk_id long")
    want = {(q, i): s for q, _, i, s in plain(chunks(300), ASKED, 1000)}
    got = retrieval.bm25_rerank(asked, again, pairs, 10, decimals=6).collect()
    assert len(got) == 24 and all(r["score"] == want[r["query_id"], r["chunk_id"]] for r in got)


def test_blocks_are_bounded_and_a_query_is_scored_only_where_it_can_win(spark, tmp_path):
    """Blocks that cannot reach the k-th best score are left out, whatever their order."""
    rows = [(i, "rare " * (20 if i == 5 else 1) + "filler " * 40) for i in range(60)] + [(100 + i, "filler other") for i in range(60)]
    ids = [r[0] for r in rows]
    batch = lambda part: (pa.array([i for i, _ in part]), pa.array([t.split() for _, t in part], pa.list_(pa.string())))
    parts = [lexical_index.block_rows(n, *batch(rows[s : s + 20]), None).to_pylist() for n, s in enumerate(range(0, 120, 20))]
    weights = lexical_index.Asked(pa.array(["q"]).to_numpy(zero_copy_only=False), {"rare": 0}, np.array([0, 1]), np.array([0]), np.array([2.0]), 30.0)
    reach = []
    for part in parts:
        block = lexical_index.Block(part[0]["ids"], part[0]["lengths"], 1.2, 0.75, 30.0)
        for r in part[1:]:
            if r["term"] in weights.number:
                block.add(0, r["most"], r["shortest"], r["places"], r["counts"])
        bound = block.bounds(weights)[0]
        reach.append(bound)
        scores = block.scores(weights, np.array([0]))
        assert scores.max() <= bound + 1e-12
    assert reach[0] > max(reach[1:]) and reach[3:] == [0.0] * 3 and sorted(ids) == sorted(i for p in parts for i in p[0]["ids"])


def test_awkward_tables(spark, tmp_path):
    none, asked = frames(spark, [], ASKED)
    assert retrieval.bm25_search(asked, none, 3).count() == 0
    table, nobody = frames(spark, chunks(5), [])
    assert retrieval.bm25_search(nobody, table, 3).count() == 0
    assert retrieval.bm25_rerank(asked, table, spark.createDataFrame([], "query_id string, chunk_id long"), 3).count() == 0
    long = spark.createDataFrame([(i, "word " * 200_000) for i in range(3)], "chunk_id long, text string")
    assert [r["chunk_id"] for r in retrieval.bm25_search(asked.limit(1).withColumn("query", F.lit("word")), long, 2).orderBy("rank").collect()] == [0, 1]
