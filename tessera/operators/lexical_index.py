"""BM25 from a stored inverted index.

Chunks are cut into tokens once, when the index is made, in blocks of BLOCK_CHUNKS where the scan finds them. A block leaves a
row with its chunks' ids and lengths, and for every term in it a row with the places and counts of its postings, how many
they are, their greatest count and the least length of a chunk among them: block maxima, which bound the term's part of any
score in the block whatever the parameters. A stored index is sorted by term, so that a search reads the row groups of the
terms it asks for and nothing of the texts.

A search takes queries as a table. The postings of their terms are brought together by block (a block's postings are
bounded by its chunks), and each task walks through its blocks with the k-th best score so far of every query: a query is
scored in a block only if the sum of its terms' bounds can reach that score. What leaves a task are its best k for each
query, with what ties with the last of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import folded, lexical_tokens, raw_lexical_tokens

#: Chunks of a block, and bytes of their tokens, at most (but for a single longer chunk).
BLOCK_CHUNKS, BLOCK_BYTES = 1024, 48 << 20
#: Queries whose terms and weights a task holds; more are searched in blocks of about this many, which read only their own terms.
QUERY_BLOCK = 4096
#: Queries scored at once in a block: as many rows of BLOCK_CHUNKS scores.
AT_ONCE = 128
#: Rows of an Arrow batch (texts of chunks may be long), and of the parts that a block is put together from.
BATCH_ROWS, PART_ROWS = 2000, 64


def schema(id_kind: str) -> str:
    return f"block long, term string, n long, total long, most int, shortest int, places binary, counts binary, ids array<{id_kind}>, lengths binary"


def block_rows(block: int, ids: pa.Array, lists: pa.Array, wanted: pa.Array | None) -> pa.RecordBatch:
    """The rows of a block: its chunks (term null), then its terms, or those of them that are wanted."""
    lengths = lists.value_lengths().fill_null(0).to_numpy().astype("<i4")
    coded = folded(lists.flatten())
    distinct = coded.dictionary.dictionary_encode()  # folding may have made equals of some
    names, term = distinct.dictionary, distinct.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
    place = np.repeat(np.arange(len(lengths)), lengths)
    if wanted is not None:
        kept = pa.compute.is_in(names, wanted).to_numpy(zero_copy_only=False)[term]
        place, term = place[kept], term[kept]
    keys, counts = np.unique(term * max(1, len(ids)) + place, return_counts=True)
    term, place = keys // max(1, len(ids)), keys % max(1, len(ids))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts[1:], len(term)).astype(np.int64)
    cuts = list(zip(starts.tolist(), ends.tolist(), strict=True)) if len(term) else []
    places, counts = place.astype("<u2"), counts.astype("<i4")
    most = np.maximum.reduceat(counts, starts) if cuts else counts
    shortest = np.minimum.reduceat(lengths[place], starts) if cuts else counts
    columns = [
        pa.array([block] * (len(cuts) + 1), pa.int64()),
        pa.array([None, *names.take(pa.array(term[starts])).to_pylist()], pa.string()),
        pa.array([len(ids), *(e - s for s, e in cuts)], pa.int64()),
        pa.array([int(lengths.sum(dtype=np.int64)), *[None] * len(cuts)], pa.int64()),
        pa.array([None, *most[: len(cuts)].tolist()], pa.int32()),
        pa.array([None, *shortest[: len(cuts)].tolist()], pa.int32()),
        pa.array([None, *(places[s:e].tobytes() for s, e in cuts)], pa.binary()),
        pa.array([None, *(counts[s:e].tobytes() for s, e in cuts)], pa.binary()),
        pa.array([ids.to_pylist(), *[None] * len(cuts)], pa.list_(ids.type)),
        pa.array([lengths.tobytes(), *[None] * len(cuts)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "total", "most", "shortest", "places", "counts", "ids", "lengths"])


def index_rows(chunks: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Rows of an index of chunks (chunk_id, text): of all terms, or of those given."""
    id_kind = chunks.schema["chunk_id"].dataType.simpleString()
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast(None if terms is None else pa.array(terms, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, block = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size, size_bytes = 0, 0

        def closed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            return block_rows(partition << 32 | block, *(whole.column(i).combine_chunks() if whole.column(i).num_chunks != 1 else whole.column(i).chunk(0) for i in (0, 1)), sent.value)

        for batch in batches:
            for part in (batch.slice(s, PART_ROWS) for s in range(0, batch.num_rows, PART_ROWS)):
                if held and (size + part.num_rows > BLOCK_CHUNKS or size_bytes + part.nbytes > BLOCK_BYTES):
                    yield closed()
                    held, size, size_bytes, block = [], 0, 0, block + 1
                held.append(part)
                size, size_bytes = size + part.num_rows, size_bytes + part.nbytes
        if held:
            yield closed()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return chunks.select("chunk_id", raw_lexical_tokens(F.col("text")).alias("tokens")).mapInArrow(run, schema(id_kind))


@dataclass
class LexicalIndex:
    """An index that was written to a folder which all executors share."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, chunks: DataFrame, path: str, terms: list[str] | None = None) -> LexicalIndex:
        """Index chunks (chunk_id, text). With terms, only their postings are kept (all chunks and lengths count)."""
        rows = index_rows(chunks, terms)
        if terms is None:  # what many searches read is sorted for them
            rows.write.parquet(f"{path}/unsorted")
            rows = chunks.sparkSession.read.parquet(f"{path}/unsorted").repartitionByRange(F.col("term").asc_nulls_first(), F.col("block")).sortWithinPartitions(F.col("term").asc_nulls_first(), "block")
        rows.write.parquet(f"{path}/index")
        return cls(chunks.sparkSession, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def blocks(self) -> DataFrame:
        return self.rows().where("term is null").select("block", "n", "ids", "lengths")

    def chunk_ids(self) -> DataFrame:
        return self.blocks().select(F.explode("ids").alias("chunk_id"))

    def totals(self) -> tuple[int, float]:
        """Chunks and their mean length."""
        n, length = self.rows().where("term is null").agg(F.sum("n"), F.sum("total")).first()
        return n or 0, length / n if n else 0.0


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Asked:
    """Queries of one block: their ids, and for each term the queries that have it, with their weights."""

    ids: np.ndarray
    number: dict[str, int]
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    mean: float


def blocks_of(queries: DataFrame) -> Iterator[pd.DataFrame]:
    """(query_id, term, qtf) of blocks of about QUERY_BLOCK queries."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = query_terms(queries)
    for b in range(blocks):
        yield (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked).toPandas()


def weights(index: LexicalIndex, own: pd.DataFrame) -> tuple[Asked, DataFrame]:
    """A block of queries, with the index rows of their terms: a term's weight is of all chunks that hold it."""
    terms, place = np.unique(own["term"].to_numpy(str), return_inverse=True) if len(own) else (np.zeros(0, str), np.zeros(0, np.int64))
    names = terms.tolist()
    rows = index.rows()
    wanted = index.spark.createDataFrame(pd.DataFrame({"term": names}), "term string")
    held = rows.where(F.col("term").between(names[0], names[-1])).join(F.broadcast(wanted), "term", "left_semi") if names else rows.where(F.lit(False))
    counts = {r["term"]: r for r in held.select("term", "n", "total").unionByName(rows.where("term is null").select("term", "n", "total")).groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    total, length = (counts[None]["n"], counts[None]["total"]) if None in counts else (0, 0)
    many = np.array([counts[t]["n"] if t in counts else 0 for t in names], float)
    order = np.argsort(place, kind="stable")
    ids, query = np.unique(own["query_id"].to_numpy(), return_inverse=True) if len(own) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    weight = (np.log(1 + (total - many + 0.5) / (many + 0.5))[place] * own["qtf"].to_numpy(float))[order] if len(own) else np.zeros(0)
    return Asked(ids, {t: i for i, t in enumerate(names)}, np.searchsorted(place[order], np.arange(len(names) + 1)), query[order], weight, length / total if total else 0.0), held


class Block:
    """A block's chunks and postings, against the queries."""

    def __init__(self, ids: list, lengths: bytes, k1: float, b: float, mean: float):
        size = np.frombuffer(lengths, "<i4").astype(float)
        self.ids, self.k1 = ids, k1
        self.norm_of = lambda length: k1 * (1 - b + b * (length / mean if mean else 0.0 * length))
        self.norm = self.norm_of(size)
        self.terms: list[tuple[int, float, np.ndarray, np.ndarray]] = []

    def add(self, term: int, most: int, shortest: int, places: bytes, counts: bytes) -> None:
        place, tf = np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(counts, "<i4").astype(float)
        bound = most * (self.k1 + 1) / (most + float(self.norm_of(np.float64(shortest))))
        self.terms.append((term, bound, place, tf * (self.k1 + 1) / (tf + self.norm[place])))

    def bounds(self, asked: Asked) -> np.ndarray:
        out = np.zeros(len(asked.ids))
        for term, bound, _, _ in self.terms:
            at = slice(asked.first[term], asked.first[term + 1])
            np.add.at(out, asked.query[at], asked.weight[at] * bound)
        return out

    def scores(self, asked: Asked, queries: np.ndarray) -> np.ndarray:
        """queries x chunks; queries by number, ascending."""
        n = len(self.norm)
        row = np.full(len(asked.ids), -1)
        row[queries] = np.arange(len(queries))
        out = np.zeros((len(queries), n))
        for term, _, place, part in self.terms:
            at = slice(asked.first[term], asked.first[term + 1])
            own, weight = row[asked.query[at]], asked.weight[at]
            held = own >= 0
            out[own[held][:, None], place] += weight[held][:, None] * part
        return out


def walk(batches: Iterator[pa.RecordBatch], asked: Asked, k1: float, b: float) -> Iterator[tuple[Block, list]]:
    """The blocks of a task, and the pairs that stand with each; rows come by block, its chunks first."""
    current, block, pairs = None, None, []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = dict(zip(names, values, strict=True))
            if row["block"] != current:
                if block is not None:
                    yield block, pairs
                current, block, pairs = row["block"], Block(row["ids"], row["lengths"], k1, b, asked.mean), []
            elif row["term"] is not None:
                block.add(asked.number[row["term"]], row["most"], row["shortest"], row["places"], row["counts"])
            else:
                pairs.append((row["query_id"], row["place"]))
    if block is not None:
        yield block, pairs


def by_block(index: LexicalIndex, held: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Rows of the blocks, each block's together: its chunks, then postings, then pairs."""
    heads = index.blocks().select("block", F.lit(0).alias("kind"), "ids", "lengths")
    terms = held.select("block", F.lit(1).alias("kind"), "term", "most", "shortest", "places", "counts")
    rows = heads.unionByName(terms, allowMissingColumns=True)
    if pairs is not None:
        rows = rows.unionByName(pairs.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "kind")


def search(index: LexicalIndex, asked_blocks: Iterable[pd.DataFrame], query_kind: str, k: int, k1: float = 1.2, b: float = 0.75, decimals: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score), from the blocks of `blocks_of`: the chunks with a common term that can be among a query's k best, and perhaps others.

    With `decimals`, scores are rounded before any is cut, so that what then ties is ranked over all chunks.
    """
    spark = index.spark
    id_kind = index.rows().schema["ids"].dataType.elementType.simpleString()
    out: DataFrame | None = None
    slack = 0.0 if decimals is None else 10.0**-decimals
    for own in asked_blocks:
        asked, held = weights(index, own)
        sent = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            best = np.zeros((len(asked.ids), k))  # of each query, ascending: the first is the score to reach
            for block, _ in walk(batches, asked, k1, b):
                reach = block.bounds(asked) * (1 + 1e-9) + slack
                able = np.flatnonzero((reach > 0) & (reach >= best[:, 0]))
                for part in (able[s : s + AT_ONCE] for s in range(0, len(able), AT_ONCE)):
                    scores = block.scores(asked, part)
                    if decimals is not None:
                        scores = np.round(scores, decimals)
                    n = scores.shape[1]
                    least = np.maximum(best[part, 0], np.partition(scores, n - k, axis=1)[:, n - k] if n > k else 0.0)
                    rows, cols = np.nonzero((scores >= least[:, None]) & (scores > 0))  # ties at the cut stay for the final ranking
                    top = np.partition(scores, n - k, axis=1)[:, n - k :] if n > k else scores
                    best[part] = np.sort(np.concatenate([best[part], top], axis=1), axis=1)[:, -k:]
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[part][rows]), pa.array([block.ids[i] for i in cols.tolist()], to_arrow(id_kind)), pa.array(scores[rows, cols])], ["query_id", "chunk_id", "score"])

        part = by_block(index, held).drop("kind").mapInArrow(run, f"query_id {query_kind}, chunk_id {id_kind}, score double")
        out = part if out is None else out.unionByName(part)
    return out


def scored(index: LexicalIndex, asked_blocks: Iterable[pd.DataFrame], pairs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score) of pairs (query_id, chunk_id): only their own chunks are scored; 0 without a common term."""
    spark = index.spark
    id_kind = index.rows().schema["ids"].dataType.elementType.simpleString()
    query_kind = pairs.schema["query_id"].dataType.simpleString()
    at = index.blocks().select("block", F.posexplode("ids").alias("place", "chunk_id"))
    placed = pairs.join(at, "chunk_id").select("block", "query_id", "place")
    out: DataFrame | None = None
    for block_of_queries in asked_blocks:
        asked, held = weights(index, block_of_queries)
        sent = spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            number = {q: i for i, q in enumerate(asked.ids.tolist())}
            for block, wanted in walk(batches, asked, k1, b):
                own = [(number[q], p) for q, p in wanted if q in number]
                queries_here = np.unique([q for q, _ in own]).astype(np.int64)
                for part in (queries_here[s : s + AT_ONCE] for s in range(0, len(queries_here), AT_ONCE)):
                    row = {int(q): i for i, q in enumerate(part)}
                    scores = block.scores(asked, part)
                    hits = [(q, p) for q, p in own if q in row]
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[[q for q, _ in hits]]), pa.array([block.ids[p] for _, p in hits], to_arrow(id_kind)), pa.array([float(scores[row[q], p]) for q, p in hits])], ["query_id", "chunk_id", "score"])

        part = by_block(index, held, placed).drop("kind").mapInArrow(run, f"query_id {query_kind}, chunk_id {id_kind}, score double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return pairs.distinct().join(best, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def to_arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
