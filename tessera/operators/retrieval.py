"""Ranking: exact cosine and BM25 search, reranking, fusion, caps and selection protocols.

Hits are long tables (query_id, strategy, rank, score, chunk_id, ...). Ties go to the smaller chunk_id throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import lexical_index
from tessera.session import scratch_folder

#: Queries that are held by every task at once; more are searched in blocks of about this many.
QUERY_BLOCK = 4096
#: Blocks of dense queries up to which they are broadcast, and chunks of a piece in the grid beyond.
HELD_BLOCKS, PIECE_ROWS = 8, 20_000
#: Scores that a task computes at once.
CELLS = 1_000_000


def top(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best rows of each query, with contiguous ranks from 1."""
    by = by or ["query_id"]
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_cosines(ids: np.ndarray, q: np.ndarray, cids: np.ndarray, x: np.ndarray, k: int, exclude_same: bool, decimals: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, chunk row, score): for every query the k best of these chunks, and what ties with the last of them."""
    lengths = np.linalg.norm(q, axis=1)
    if (lengths == 0).any():
        raise ValueError("a query vector has length zero")
    norms = np.linalg.norm(x, axis=1)
    scores = np.where(norms == 0, -1.0, (q @ x.T) / np.outer(lengths, np.where(norms == 0, 1, norms)))
    if decimals is not None:
        scores = np.round(scores, decimals)
    if exclude_same:
        scores[ids[:, None] == cids[None, :]] = -np.inf
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(ids), -np.inf)
    rows, cols = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))  # ties at the cut stay for the final ranking
    return rows, cols, scores[rows, cols]


class Best:
    """The k best chunks of every query, over chunks that come in pieces: what is held at once is a piece's scores (about
    CELLS of them), and the best so far. Equal scores go to the smaller id, as in `top`."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, exclude_same: bool, decimals: int | None):
        self.asked = ids, q
        self.k, self.settings = k, (exclude_same, decimals)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.least = np.full(len(ids), -np.inf)

    def add(self, cids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, CELLS // len(self.asked[0]))
        for at in range(0, len(cids), step):
            own = cids[at : at + step]
            rows, cols, scores = best_cosines(*self.asked, own, x[at : at + step], self.k, *self.settings)
            good = scores >= self.least[rows]
            self.parts.append((rows[good], own[cols[good]], scores[good]))
            if sum(len(p[0]) for p in self.parts) > max(CELLS // 4, 4 * self.k * len(self.asked[0])):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, chunk id, score) of the best so far."""
        rows, cids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((np.unique(cids, return_inverse=True)[1], -scores, rows))
        rows, cids, scores = rows[order], cids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last, kept = place == self.k - 1, place < self.k
        self.least[rows[last]] = scores[last]
        self.parts = [(rows[kept], cids[kept], scores[kept])]
        return self.parts[0]


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, components) of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine_search(queries: DataFrame, chunks: DataFrame, k: int, exclude_same: bool = False, decimals: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine top k of every query over all chunks.

    queries: (query_id, vector); chunks: (chunk_id, vector). The number of queries is counted. While they make at most
    HELD_BLOCKS blocks, each block is a matrix that every task holds, and pieces of the chunks meet it where the chunks
    stand, CELLS scores at once; a task keeps each query's best k. More blocks stay a table: blocks and pieces of the chunks are dealt to a grid, each field of which is
    searched alike. Either way what is shuffled of the results is bounded by queries x tasks x k. Zero chunks score -1; a zero
    query is refused. With `decimals`, scores are rounded before any is cut, so that what then ties is ranked by id over all
    rows.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    names = ["query_id", "chunk_id", "score"]
    kinds = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    if blocks > HELD_BLOCKS:
        pieces = -(-chunks.count() // PIECE_ROWS)
        spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(max(0, many - 1))))
        left = chunks.select(F.col("chunk_id").alias("c"), F.col("vector").alias("x"), F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, pieces))).cast("int").alias("piece"), spread(blocks).alias("block"))
        right = queries.select(F.col("query_id").alias("q"), F.col("vector").alias("v"), block.alias("block"), spread(pieces).alias("piece"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table([b["q"].slice(0, 0), a["c"].slice(0, 0), pa.array([], pa.float64())], names=names)
            ids, cids = b["q"].to_numpy(), a["c"].to_numpy()
            best = Best(ids, vectors_of(b["v"]), k, exclude_same, decimals)
            best.add(cids, vectors_of(a["x"]))
            rows, found_ids, scores = best.cut()
            return pa.table([b["q"].take(pa.array(rows)), pa.array(found_ids, a["c"].type), pa.array(scores)], names=names)

        return top(left.groupBy("piece", "block").cogroup(right.groupBy("piece", "block")).applyInArrow(meet, schema), k)
    found: DataFrame | None = None
    for number in range(blocks):
        own = queries.where(block == number).select("query_id", "vector").toPandas()
        asked = np.array([np.asarray(v, np.float64) for v in own["vector"]]).reshape(len(own), -1)
        if len(asked) and (np.linalg.norm(asked, axis=1) == 0).any():
            raise ValueError("a query vector has length zero")
        sent = queries.sparkSession.sparkContext.broadcast((own["query_id"].to_numpy(), asked))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = Best(ids, q, k, exclude_same, decimals)
            for batch in batches:
                if batch.num_rows and len(ids):
                    best.add(batch.column(0).to_numpy(zero_copy_only=False), vectors_of(batch.column(1)))
            if best.parts:
                rows, cids, scores = best.cut()
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(cids), pa.array(scores)], names)

        part = chunks.select("chunk_id", "vector").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return top(found, k)


def with_filters(chunks: DataFrame, filters: dict[str, str], allowed: tuple[str, ...] = ("strategy", "doc_id", "source")) -> DataFrame:
    """Exact equality on all the named fields, before any scoring, so that scans can be pruned."""
    for field, value in filters.items():
        if field not in allowed:
            raise ValueError(f"no filter on {field}")
        chunks = chunks.where(F.col(field) == F.lit(value))
    return chunks


#: Terms of queries up to which an index made for one search keeps only theirs.
FEW_TERMS = 200_000


def indexed(queries: DataFrame, chunks: DataFrame | lexical_index.LexicalIndex) -> tuple[lexical_index.LexicalIndex, Iterable[pd.DataFrame]]:
    """An index, and the queries' terms in blocks. Of chunks, an index is made in the shared folder: for the terms of these
    queries if they are one block of few terms, for all terms otherwise."""
    blocks = lexical_index.blocks_of(queries)
    if not isinstance(chunks, DataFrame):
        return chunks, blocks
    first = next(blocks)
    terms = sorted(set(first["term"]))
    more = next(blocks, None)
    few = more is None and len(terms) <= FEW_TERMS
    index = lexical_index.LexicalIndex.build(chunks, f"{scratch_folder(chunks.sparkSession)}/lexical", terms if few else None)
    return index, chain([first], [] if more is None else [more], blocks)


def bm25_search(queries: DataFrame, chunks: DataFrame | lexical_index.LexicalIndex, k: int, k1: float = 1.2, b: float = 0.75, decimals: int | None = None) -> DataFrame:
    """Every chunk can be ranked: those without a common term score 0 and come by id.

    chunks: (chunk_id, text), or an index of them, which is read instead; of chunks a temporary one is made. Only the k
    smallest ids can be needed to fill up; those among them that matched keep their score. With `decimals`, scores are
    rounded before any is cut, so that what then ties is ranked by id over all rows.
    """
    index, asked = indexed(queries, chunks)
    found = lexical_index.search(index, asked, queries.schema["query_id"].dataType.simpleString(), k, k1, b, decimals)
    filler = index.chunk_ids().distinct().orderBy("chunk_id").limit(k)
    zeros = queries.select("query_id").crossJoin(F.broadcast(filler)).withColumn("score", F.lit(0.0))  # k rows for each query
    # a filler's own score may have been cut in its task, but then k better chunks were kept there
    return top(found.unionByName(zeros).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def bm25_rerank(queries: DataFrame, chunks: DataFrame | lexical_index.LexicalIndex, hits: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75, decimals: int | None = None) -> DataFrame:
    """Hits reordered by BM25 (0 without a common term), cut to the limit. Only the hits' own chunks are scored; the weights
    of the queries' terms come from all chunks."""
    index, asked = indexed(queries, chunks)
    out = lexical_index.scored(index, asked, hits.select("query_id", "chunk_id"), k1, b)
    return top(out if decimals is None else out.withColumn("score", F.round("score", decimals)), limit)


def reciprocal_rank_fusion(rankings: list[DataFrame], limit: int, constant: float = 60.0) -> DataFrame:
    """Sum of 1 / (constant + rank) over the rankings."""
    parts = [r.select("query_id", "chunk_id", "rank", F.lit(i).alias("ranking")) for i, r in enumerate(rankings)]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    fused = together.groupBy("query_id", "chunk_id").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min_by("ranking", "ranking").alias("first_ranking"))
    return top(fused, limit)


def source_cap(hits: DataFrame, most: int | None, depth: int, source: str = "source") -> DataFrame:
    """At most so many hits of one source for each query, in rank order, ranks made contiguous, cut to the depth."""
    if most is not None:
        own = Window.partitionBy("query_id", source).orderBy("rank")
        hits = hits.withColumn("__own", F.row_number().over(own)).where(F.col("__own") <= most).drop("__own")
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= depth).withColumn("rank", F.col("__rank")).drop("__rank")


def same_top_k(hits: DataFrame, k: int, candidate_k: int) -> DataFrame:
    """The first k of the first candidate_k hits."""
    return hits.where(F.col("rank") <= min(k, candidate_k))


def budget_fold(hits: Column, budget: int) -> Column:
    """Walk (rank, tokens, chunk_id) in order: what fits is taken, what does not is skipped, but an oversized first stops."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("overflow"), F.array().cast("array<struct<rank:int,tokens:bigint,chunk_id:string>>").alias("taken"))

    def step(acc: Column, h: Column) -> Column:
        take = lambda over: F.struct((acc["used"] + h["tokens"]).alias("used"), F.lit(over).alias("overflow"), F.concat(acc["taken"], F.array(h)).alias("taken"))
        first = F.size(acc["taken"]) == 0
        return F.when(acc["overflow"], acc).when(first & (h["tokens"] > budget), take(True)).when(acc["used"] + h["tokens"] <= budget, take(False)).otherwise(acc)

    return F.aggregate(hits, start, step)


def same_token_budget(hits: DataFrame, budget: int, candidate_k: int) -> DataFrame:
    """One row for each (query, strategy): selected hits in rank order, their tokens, and how the budget was used.

    hits: (query_id, strategy, rank, chunk_id, token_count); a group holds candidate_k hits at most, so the fold is bounded.
    """
    pool = hits.where(F.col("rank") <= candidate_k)
    row = F.struct(F.col("rank").cast("int").alias("rank"), F.col("token_count").cast("long").alias("tokens"), F.col("chunk_id").cast("string").alias("chunk_id"))
    grouped = pool.groupBy("query_id", "strategy").agg(F.array_sort(F.collect_list(row)).alias("pool"))
    folded = grouped.withColumn("fold", budget_fold(F.col("pool"), budget))
    return folded.select(
        "query_id",
        "strategy",
        F.size("pool").alias("candidate_count"),
        F.size("fold.taken").alias("selected_chunk_count"),
        F.col("fold.used").alias("actual_selected_tokens"),
        (F.col("fold.used") / F.lit(float(budget))).alias("budget_utilization"),
        F.col("fold.overflow").alias("budget_overflow"),
        (F.size("pool") < candidate_k).alias("candidate_exhausted"),
        F.col("fold.taken").alias("selected"),
    )


def depth_sweep(hits: DataFrame, depths: list[int]) -> DataFrame:
    """Every smaller depth is a prefix of the deepest run."""
    return hits.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))).where(F.col("rank") <= F.col("depth"))
