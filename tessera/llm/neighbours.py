"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are lengthened by one component so that a larger inner product is a smaller distance (queries get a zero there).
Each of TABLES tables hashes a vector to floor((a . v + b) / w) for several Gaussian directions a. A query visits, besides
its own bucket, buckets one step off in some directions, in the order of their estimated success: the steps are ranked by
the query's distance to the bucket's boundaries, and the sequence of rank sets is the one with the smallest expected
squared distances. Bucket width w is fitted: for SAMPLE queries the true neighbours are found by brute force over all
rows, and w is the smallest of a grid for which the tables find the wanted share of them; the grid ends where a bucket and
its neighbours hold everything. Every row is indexed.

Buckets of all tables are dealt to shards of bounded size by hash; a bucket over the limit is cut into pieces and its
visitors are sent to each. In a shard, a bucket's visitors meet its members in one matrix product, in double precision,
and a running threshold for each query keeps what can still be among its nearest. Shards return each query's best, with
exact scores; these are merged.

Queries for which the buckets visited held fewer than k candidates (small or scattered tables) are finished exactly: in
blocks they meet pieces of all rows.

Equal vectors form a class that is indexed once; a class has `k + 1` least members that can appear in a result, which a
search over the members finds exactly, so a vector that a third of the rows share costs no more than another.

Defined results: vectors that are null, zero, or hold null or non-finite components, vectors of another length than most,
and rows with a null id take no part, as query or as candidate; ties go to the smaller id; rows of equal id are rows of
their own, but a query never gets its own id; every query gets min(k, candidates) rows; an empty table gives an empty
result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read

TABLES, PROBES, SAMPLE = 10, 400, 64
SHARD_ENTRIES = 100_000
#: At most so many buckets are over the limit, since it grows with the number of entries: their table may be broadcast.
HOT_BUCKETS = 100_000
#: Lengthened vectors are no longer than 1, so that at the widest every projection lies within a bucket and its neighbours.
WIDTHS = np.concatenate((np.arange(0.4, 4.0, 0.1), 4 * 1.25 ** np.arange(13)))
#: Queries in a block of the exact finish, and classes in a piece of the table that a block meets.
FINISH_QUERIES, FINISH_ROWS = 4096, 50_000


def probe_ranks(directions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (0: nearest boundary) to step over, in order of the expected sum of squared distances.

    Ranks r and 2 * directions - 1 - r belong to the two sides of one direction and exclude each other.
    """
    k = directions
    j = np.arange(1, 2 * k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    i = 2 * k + 1 - j
    cost = np.where(j <= k, near, 1 - i / (k + 1) + i * (i + 1) / (4 * (k + 1) * (k + 2)))
    found: list[tuple[int, ...]] = [()]
    heap: list[tuple[float, tuple[int, ...]]] = [(float(cost[0]), (0,))]
    while heap and len(found) < probes:
        total, ranks = heapq.heappop(heap)
        if not any(2 * k - 1 - r in ranks for r in ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * k:
            step = float(cost[last + 1])
            heapq.heappush(heap, (total - float(cost[last]) + step, (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + step, (*ranks, last + 1)))
    return found


@dataclass
class Hashing:
    """The hash functions of all tables. norm: the largest norm of an indexed vector."""

    dimension: int
    directions: int
    norm: float
    width: float = 1.0
    tables: int = TABLES
    probes: int = PROBES
    seed: int = 17

    @cached_property
    def drawn(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a = rng.normal(size=(self.dimension + 1, self.tables * self.directions))
        b = rng.random((self.tables, self.directions))
        mix = rng.integers(1, 1 << 62, size=(self.tables, self.directions), dtype=np.int64) | 1
        return a, b, mix

    @cached_property
    def ranks(self) -> list[tuple[int, ...]]:
        return probe_ranks(self.directions, self.probes)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, directions): a . v of lengthened vectors; queries have length 1, candidates at most 1 before."""
        if query:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            last = np.zeros(len(x))
        else:
            x = x / self.norm
            last = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return (np.concatenate((x, last[:, None]), axis=1) @ self.drawn[0]).reshape(len(x), self.tables, self.directions)

    def place(self, projected: np.ndarray) -> np.ndarray:
        """Positions in units of the bucket width."""
        return projected / self.width + self.drawn[1]

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """(rows, tables): one long for each table's cell."""
        table = np.arange(1, self.tables + 1, dtype=np.int64) * np.int64(0x5851F42D4C957F2D)
        return (cells.astype(np.int64) * self.drawn[2]).sum(axis=2) + table

    def visits(self, projected: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the keys a query visits, the likeliest first."""
        at = self.place(projected)
        cells = np.floor(at)
        inside = at - cells
        home = self.keys(cells)
        order = np.argsort(np.concatenate((inside, 1 - inside), axis=2), axis=2, kind="stable")
        # stepping over one side changes the key by the direction's multiplier
        change = np.concatenate((-self.drawn[2], self.drawn[2]), axis=1)[None].repeat(len(at), axis=0)
        change = np.take_along_axis(change, order, axis=2)
        return np.stack([home + sum(change[:, :, r] for r in ranks) if ranks else home for ranks in self.ranks], axis=2)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return good.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def best_pairs(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query, cid, score) for each query; equal pairs count once."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "cid"))
    return found.dropDuplicates(["query", "cid"]).withColumn("r", rank).where(F.col("r") <= k).drop("r")


def fit(classes: DataFrame, queries: DataFrame, k: int, recall: float, n: int) -> Hashing:
    """Choose the width by the recall of a bounded sample of queries against brute force over all classes (cid, v)."""
    sample = queries.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toPandas()
    norm = classes.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    asked = np.stack([np.asarray(v, np.float64) for v in sample["v"]])
    ids = sample["cid"].to_numpy()
    sent = classes.sparkSession.sparkContext.broadcast((ids, asked))

    def nearest(batches):
        own_ids, own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            scores = own @ x.T
            scores[own_ids[:, None] == cids[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1)[:, :k]
            q = np.repeat(np.arange(len(own_ids)), top.shape[1])
            j = top.ravel()
            kept = np.isfinite(scores[q, j])
            q, j = q[kept], j[kept]
            yield pa.RecordBatch.from_arrays([pa.array(own_ids[q]), pa.array(cids[j]), pa.array(scores[q, j]), batch.column(1).take(pa.array(j))], ["query", "cid", "score", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    truth = best_pairs(classes.select("cid", "v").mapInArrow(nearest, f"query long, cid long, score double, v {kind}"), k).toPandas()
    directions = max(4, round(np.log2(max(n, 2))) - 5)  # some 32 classes to a bucket before its width is fitted, at every n
    hashing = Hashing(asked.shape[1], directions, float(norm))
    if truth.empty:
        return hashing
    of = {c: i for i, c in enumerate(ids)}
    q = np.array([of[x] for x in truth["query"]])
    pq, pn = hashing.project(asked, True), hashing.project(np.stack([np.asarray(v, np.float64) for v in truth["v"]]), False)
    for width in WIDTHS:
        hashing.width = float(width)
        visits, keys = hashing.visits(pq), hashing.keys(np.floor(hashing.place(pn)))
        hit = np.array([any((visits[a, t] == keys[i, t]).any() for t in range(hashing.tables)) for i, a in enumerate(q)])
        if hit.mean() >= recall:
            return hashing
    raise RuntimeError(f"no width reaches a recall of {recall}: {hit.mean():.3f} at {width:.1f}")


def shard_of(keys: np.ndarray, piece: np.ndarray | int, shards: int) -> np.ndarray:
    mixed = (keys.astype(np.uint64) + np.asarray(piece).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def in_shard(keys: np.ndarray, cids: np.ndarray, x: np.ndarray, qrow: np.ndarray, qkeys: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, entry row, score) of each query's k best distinct candidates among the members of the buckets visited."""
    order = np.argsort(keys, kind="stable")
    keys, cids, x = keys[order], cids[order], x[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    bucket_keys, ends = keys[heads], np.append(heads[1:], len(keys))
    at = np.searchsorted(bucket_keys, qkeys)
    real = at < len(bucket_keys)
    real[real] = bucket_keys[at[real]] == qkeys[real]
    at, qrow = at[real], qrow[real]
    by_bucket = np.argsort(at, kind="stable")
    at, qrow = at[by_bucket], qrow[by_bucket]
    threshold = np.full(len(asked), -np.inf)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def compact() -> None:
        nonlocal held, fresh, count
        q, e, s = (np.concatenate([h, *[f[i] for f in fresh]]) for i, h in enumerate(held))
        o = np.lexsort((cids[e], -s, q))
        q, e, s = q[o], e[o], s[o]
        # an entry of several tables stands side by side only if its scores are equal, so pairs are made unique first
        _, first = np.unique(q.astype(np.int64) << 40 | np.unique(cids, return_inverse=True)[1][e], return_index=True)
        first.sort()
        q, e, s = q[first], e[first], s[first]
        start = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else q
        last = rank == k - 1
        threshold[q[last]] = s[last] - 1e-9
        held, fresh, count = [a[rank < k] for a in (q, e, s)], [], 0

    if len(at):
        visit_heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        for a, b in zip(visit_heads, np.append(visit_heads[1:], len(at)), strict=True):
            lo, hi, rows = heads[at[a]], ends[at[a]], qrow[a:b]
            for part in range(lo, hi, 4096):
                scores = asked[rows] @ x[part : min(hi, part + 4096)].T
                i, j = np.nonzero(scores > threshold[rows][:, None])
                if len(i):
                    fresh.append((rows[i], part + j, scores[i, j]))
                    count += len(i)
                if count > 400_000:
                    compact()
    compact()
    q, e, _ = held
    return q, order[e], np.einsum("ij,ij->i", asked[q], x[e])


def exactly(named: DataFrame, asked: DataFrame, k: int, n: int, queries: int) -> DataFrame:
    """(query, cid, score): the k best classes of (cid, v) for each of `queries` rows of asked (cid, v), its own included."""
    pieces, blocks = -(-n // FINISH_ROWS), -(-queries // FINISH_QUERIES)
    spread = lambda column, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(column)
    part = lambda many: F.pmod(F.xxhash64("cid"), F.lit(many)).cast("int")
    rows = named.select(F.col("cid").alias("of"), F.col("v").alias("x"), part(pieces).alias("piece"), spread("block", blocks))
    wanted = asked.select(F.col("cid").alias("query"), F.col("v").alias("y"), part(blocks).alias("block"), spread("piece", pieces))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, names=["query", "cid", "score"])
        cids, x, ids, y = left["of"].to_numpy(), matrix(left["x"]), right["query"].to_numpy(), matrix(right["y"])
        order = np.argsort(cids, kind="stable")
        cids, x, out = cids[order], x[order], [empty]
        for at in range(0, len(ids), 256):
            scores = np.einsum("ij,kj->ik", y[at : at + 256], x)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(scores)), top.shape[1])
            out.append([pa.array(ids[at + q]), pa.array(cids[top.ravel()]), pa.array(scores[q, top.ravel()])])
        return pa.table([pa.concat_arrays([o[i] for o in out]) for i in range(3)], names=["query", "cid", "score"])

    return rows.groupBy("piece", "block").cogroup(wanted.groupBy("piece", "block")).applyInArrow(meet, "query long, cid long, score double")


def search(vectors: DataFrame, k: int = 20, recall: float = 0.94, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where the column `is_query` holds (all, if None) their k nearest."""
    rows = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    named = cut(rows.groupBy("v").agg(F.min("vec_id").alias("cid")))
    members = cut(rows.join(named, "v").select("cid", "vec_id"))
    asking = members.where(is_query if is_query is not None else F.lit(True))
    asked = cut(named.join(asking.select("cid").distinct(), "cid"))
    n = named.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or asked.isEmpty():
        return empty
    need = k + 1
    hashing = fit(named, asked, k, recall, n)
    sent = spark.sparkContext.broadcast(hashing)
    entries = n * hashing.tables
    shards, limit = -(-entries // SHARD_ENTRIES), max(SHARD_ENTRIES // 4, entries // HOT_BUCKETS)

    def own_keys(batches):
        h = sent.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(h.keys(np.floor(h.place(h.project(matrix(batch.column(0)), False)))).ravel())], ["key"])

    hot = named.select("v").mapInArrow(own_keys, "key long").groupBy("key").count().where(F.col("count") > limit).collect()
    pieces = spark.sparkContext.broadcast({r["key"]: -(-r["count"] // limit) for r in hot})
    kind = named.schema["v"].dataType.simpleString()

    def deal_entries(batches):
        h, many = sent.value, pieces.value
        hot_keys = np.array(list(many), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = h.keys(np.floor(h.place(h.project(matrix(batch.column(1)), False)))).ravel()
            row = np.repeat(np.arange(batch.num_rows), h.tables)
            cids = batch.column(0).to_numpy(zero_copy_only=False)[row]
            piece = np.zeros(len(keys), np.int64)
            for i in np.flatnonzero(np.isin(keys, hot_keys)):
                piece[i] = cids[i] * 2654435761 % many[keys[i]]
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, piece, shards)), pa.array(keys), pa.array(cids), batch.column(1).take(pa.array(row))], ["shard", "key", "cid", "v"])

    def deal_visits(batches):
        h, many = sent.value, pieces.value
        hot_keys = np.array(list(many), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys = h.visits(h.project(matrix(batch.column(1)), True)).reshape(batch.num_rows, -1)
                row = np.repeat(np.arange(batch.num_rows), keys.shape[1])
                keys = keys.ravel()
                shard = shard_of(keys, 0, shards)
                more = [(row[i], keys[i], p) for i in np.flatnonzero(np.isin(keys, hot_keys)) for p in range(1, many[keys[i]])]
                if more:
                    extra = np.array(more, np.int64)
                    row, keys = np.concatenate((row, extra[:, 0])), np.concatenate((keys, extra[:, 1]))
                    shard = np.concatenate((shard, shard_of(extra[:, 1], extra[:, 2], shards)))
                order = np.lexsort((shard, row))
                row, keys, shard = row[order], keys[order], shard[order]
                heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(keys)), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([pa.array(shard[heads]), batch.column(0).take(pa.array(row[heads])), batch.column(1).take(pa.array(row[heads])), lists], ["shard", "query", "v", "keys"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "cid", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        keys, cids = left["key"].to_numpy(), left["cid"].to_numpy()
        queries = right["query"].to_numpy()
        lists = right["keys"].combine_chunks()
        qrow = np.repeat(np.arange(len(queries)), lists.value_lengths().to_numpy())
        q, e, s = in_shard(keys, cids, matrix(left["v"]), qrow, lists.flatten().to_numpy(), matrix(right["v"]), need)
        return pa.table([pa.array(queries[q]), pa.array(cids[e]), pa.array(s)], names=names)

    dealt = named.select("cid", "v").mapInArrow(deal_entries, f"shard int, key long, cid long, v {kind}")
    sent_out = asked.select("cid", "v").mapInArrow(deal_visits, f"shard int, query long, v {kind}, keys array<long>")
    found = dealt.groupBy("shard").cogroup(sent_out.groupBy("shard")).applyInArrow(meet, "query long, cid long, score double")
    classes = best_pairs(found, need)
    answers = cut(ranked(classes, members, asking, k))
    same = members.groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("own"))
    wanted = asking.select("cid", F.col("vec_id").alias("query_id")).distinct().join(same, "query_id")
    got = answers.groupBy("query_id").agg(F.count("*").alias("got"))
    lacking = wanted.join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.lit(members.count()) - F.col("own")))
    lacking = cut(lacking.select("cid", "query_id"))
    many = lacking.count()
    if not many:
        return answers
    classes = best_pairs(exactly(named, asked.join(lacking.select("cid").distinct(), "cid"), need, n, many), need)
    whole = ranked(classes, members, lacking.select("cid", F.col("query_id").alias("vec_id")), k)
    return answers.join(lacking.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)


def ranked(classes: DataFrame, members: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from the best classes (query, cid, score) of the classes of asking (cid, vec_id)."""
    need = k + 1
    first = Window.partitionBy("cid").orderBy("vec_id")
    least = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= need).drop("r")
    nearest = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    pool = classes.join(least, "cid").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= need).select("query", "vec_id", "score")
    answers = asking.select(F.col("cid").alias("query"), F.col("vec_id").alias("query_id")).distinct().join(pool, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)
