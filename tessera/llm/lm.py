"""Language model scoring: a hashed maximum-entropy model with a class-factored softmax, beside smoothed counts.

Counting. Words (A-Z lower-cased, cut at blanks) and one end per document are counted over all training documents. The
counts table stays distributed; its HEAD most frequent words are sent to every task, where most tokens are looked up.
The others meet the table in a join on the word, each a row with its number in the document.

Model. The most frequent words, 63 classes of 64, are predicted as class, then member; the 64th class is the tail. The
class depends on the word before, the one before that (a skip feature) and both together; the member on its class and the
word before; every feature hashes to a row of weights. A tail word is predicted through a binary tree of classes, by the
bits of its hash; each branch depends on its node, the node with the word before and the node with the one before that.
The tree is as deep as leaves at most CROWD words to a leaf on average, however many words are counted. Among the words of
a leaf the probability is (c + 1) / (the leaf's tokens + words + 1), which leaves one share for its unseen words. So the
model and the smoothed counts are distributions over all words. Hashed rows grow with the counted vocabulary within ROWS.

Training. A bounded sample makes a first model on the driver: at most `warm_documents` whole texts, the first by hash of
their id, as numbers. Then training documents are dealt by hash of id and text to as many parts as TASK_TOKENS asks for,
each in order of the id, so that the model does not depend on how the input is split. Every part runs through its
documents with AdaGrad steps on mini-batches and sends the change of its weights, as half floats in blocks; the blocks
are averaged by tokens where they meet. The weights' size is bounded, so what reaches the driver is too.

Defined results: a null text is the empty one, one end token; null ids are scored, with held_out null, and not learnt
from; repeated rows are scored (and learnt from) each; with nothing to learn from, counts are zero, the model is uniform
over its classes; an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, read, remainder, slices, small

#: Most words of the head.
HEAD = 1 << 18
CLASSES, MEMBERS = 64, 64
TAIL = CLASSES - 1
WORDS = TAIL * MEMBERS
#: Most words a leaf of the tail holds on average, and the weights of each feature of the tail's branches.
CROWD, BRANCHES = 64, 1 << 18
#: Training tokens of a part.
TASK_TOKENS = 1 << 21
#: Context numbers: words 0 to WORDS - 1, the start, then hashes of tail words, at least ENDINGS.
START, ENDINGS = WORDS, 2048
CONTEXTS = WORDS + 1 + ENDINGS
PAIR_ROWS = 1 << 13
#: Bounds of the rows of each hashed table: an eighth of the counted words, as a power of two; contexts have half of it.
ROWS = (1 << 13, 1 << 14)
BATCH, RATE = 4096, 0.15
#: Repeats of a row within a batch that are added for all rows together.
REPEATS = 8
BLOCKS = 64
#: Leaves of the tail up to which their table is broadcast.
CROWD_ROWS = 1 << 18
#: Words that a task counts before it sends its counts on.
TABLE_WORDS = 400_000
END = b" "


@dataclass
class Facts:
    """Counts over the training corpus: tokens and distinct tokens, the head's counts by word, and for each word of the
    head the tokens + words of its leaf of the tail."""

    tokens: int
    distinct: int
    head: dict[bytes, int]
    model: list[bytes]
    crowds: np.ndarray

    @cached_property
    def numbers(self) -> Numbers:
        return Numbers(self)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "numbers"}

    @property
    def shape(self) -> tuple[int, int, int]:
        """(depth of the tail's tree, hashed contexts, hashed rows)."""
        return shape_for(self.distinct)


def shape_for(distinct: int) -> tuple[int, int, int]:
    depth = max(6, (-(-distinct // CROWD) - 1).bit_length())
    rows = min(ROWS[1], max(ROWS[0], 1 << (distinct // 8).bit_length()))
    return depth, max(ENDINGS, rows // 2 if rows > ROWS[0] else 0), rows


class Numbers:
    """Numbers of words: place in the head, and context."""

    def __init__(self, facts: Facts):
        self.words = pa.array(list(facts.head), pa.binary())
        depth, self.endings, _ = facts.shape
        self.leaves = 1 << depth
        inside = {w: i for i, w in enumerate(facts.model)}
        hashes = np.fromiter(map(zlib.crc32, facts.head), np.int64, len(facts.head))
        self.leaf = hashes % self.leaves
        self.context = (START + 1 + hashes % self.endings).astype(np.int32)
        for i, w in enumerate(facts.head):
            if w in inside:
                self.context[i] = inside[w]

    def sequences(self, flat: pa.Array, lengths: np.ndarray) -> Sequences:
        """Of the tokens of documents with these lengths, as from tokens()."""
        places = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy()
        rare = np.flatnonzero(places < 0)
        ids = np.take(self.context, places, mode="clip") if len(self.context) else np.empty(len(places), np.int32)
        leaf = np.take(self.leaf, places, mode="clip") if len(self.leaf) else np.empty(len(places), np.int64)
        outside = flat.take(pa.array(rare)).dictionary_encode()
        if len(rare):
            hashes = np.fromiter(map(zlib.crc32, outside.dictionary.to_pylist()), np.int64, len(outside.dictionary))[outside.indices.to_numpy()]
            ids[rare] = START + 1 + hashes % self.endings
            leaf[rare] = hashes % self.leaves
        return Sequences(*shifted(ids, lengths), leaf, np.cumsum(lengths) - lengths, places, rare, outside)


class Sequences(NamedTuple):
    """Tokens as numbers: contexts of a token, the word before and the one before that, its leaf; starts of documents; places
    in the head, -1 outside; the tokens outside it, and their words."""

    ids: np.ndarray
    one: np.ndarray
    two: np.ndarray
    leaves: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    rare: np.ndarray
    outside: pa.DictionaryArray


def shifted(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, word before, word before that) of documents of these lengths, one after the other."""
    starts = np.cumsum(lengths) - lengths
    one, two = np.empty_like(ids), np.empty_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[starts] = START
    two[starts] = START
    after = starts + 1
    two[after[after < len(ids)]] = START
    return ids, one, two


class Model:
    """Weights in one flat array: tables with rows of 64, and behind them those of the tail's branches."""

    def __init__(self, flat: np.ndarray | None = None, depth: int = 0, endings: int = ENDINGS, rows: int = PAIR_ROWS):
        # class by word before, by the one before it, by both; member by class and word before; biases
        tables = START + 1 + endings, START + 1 + endings, rows, rows, TAIL, 1
        self.depth, self.hashed = depth, rows
        wide = sum(tables) * 64
        self.flat = np.zeros(wide + 3 * BRANCHES * (depth > 0), np.float32) if flat is None else flat
        cuts = np.cumsum((0, *tables)) * 64
        self.tables = [self.flat[a:b].reshape(-1, 64) for a, b in zip(cuts, cuts[1:], strict=False)]
        # the branch by node, by node and word before, by node and the one before it
        self.tail = self.flat[wide:].reshape(-1, BRANCHES)
        self.squares = [*(np.full(n, 0.02, np.float32) for n in tables), np.full(self.tail.shape, 0.02, np.float32)]
        self.buffers = [np.empty((BATCH, 64), np.float32) for _ in range(5)]
        self.gathered = np.zeros(BRANCHES, np.float32)

    def rows(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Rows of the class features; which tokens have a member; rows of its features."""
        pair = (one.astype(np.int64) * 40503 + two.astype(np.int64) * 9973) & (self.hashed - 1)
        inside = np.flatnonzero(ids < WORDS)
        cls = ids[inside] % TAIL
        member = (cls.astype(np.int64) * 7919 + one[inside].astype(np.int64) * 31337) & (self.hashed - 1)
        return [one, two, pair], inside, np.stack([member, cls.astype(np.int64)])

    def logits(self, ids, one, two):
        """Class and member logits in buffers that the next call uses again; weights stay far from what exp can hold."""
        a, b, d, e, m, bias = self.tables[:6]
        (ra, rb, rd), inside, (re_, rm) = self.rows(ids, one, two)
        zc, zm, more = (x[:n] for x, n in zip(self.buffers[:3], (len(ids), len(inside), len(ids)), strict=True))
        np.take(a, ra, axis=0, out=zc, mode="clip")
        zc += np.take(b, rb, axis=0, out=more, mode="clip")
        zc += np.take(d, rd, axis=0, out=more, mode="clip")
        zc += bias
        np.take(e, re_, axis=0, out=zm, mode="clip")
        zm += np.take(m, rm, axis=0, out=more[: len(inside)], mode="clip")
        np.clip(zc, -40, 40, out=zc)
        np.clip(zm, -40, 40, out=zm)
        return zc, inside, zm, (ra, rb, rd), (re_, rm)

    def branches(self, outside: np.ndarray, one: np.ndarray, two: np.ndarray, leaves: np.ndarray):
        """Of the tail's tokens, (depth, tokens): logits of the branch with a one, the bit taken, places of the features."""
        o, t, leaf = one[outside].astype(np.int64), two[outside].astype(np.int64), leaves[outside]
        level = np.arange(self.depth, dtype=np.int64)[:, None]
        node = (1 << level) - 1 + (leaf & ((1 << level) - 1))
        taken = (leaf >> level & 1).astype(np.float32)
        mixed = node * 0x2545F4914F6D
        places = [node & (BRANCHES - 1)] + [(mixed + x * m >> 21) & (BRANCHES - 1) for x, m in ((o, 0x1B873593A5), (t, 0x5BD1E995C7))]
        z = sum(w[p] for w, p in zip(self.tail, places, strict=True))
        return np.clip(z, -30, 30, out=z), taken, places

    def powers(self) -> list[np.ndarray] | None:
        """exp of the tables, the bias in the first, for weights that stay as they are: products of rows are then the softmax's
        terms. None if some sum of weights might be one that logits() clips."""
        a, b, d, e, m, bias = (float(np.abs(t).max()) for t in self.tables)
        if max(a + b + d + bias, e + m) > 40:
            return None
        return [np.exp(self.tables[0] + self.tables[5]), *map(np.exp, self.tables[1:5])]

    def terms(self, powers: list[np.ndarray], ids, one, two):
        """exp of what logits() gives, in the same buffers."""
        rows, inside, (re_, rm) = self.rows(ids, one, two)
        tc, tm, more = (x[:n] for x, n in zip(self.buffers[:3], (len(ids), len(inside), len(ids)), strict=True))
        np.take(powers[0], rows[0], axis=0, out=tc, mode="clip")
        for p, r in zip(powers[1:3], rows[1:], strict=True):
            tc *= np.take(p, r, axis=0, out=more, mode="clip")
        np.take(powers[3], re_, axis=0, out=tm, mode="clip")
        tm *= np.take(powers[4], rm, axis=0, out=more[: len(inside)], mode="clip")
        return tc, inside, tm

    def log_probabilities(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, leaves: np.ndarray | None = None, powers: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural logarithms, token by token; a tail word's is that of its leaf (without leaves, of the tail class)."""
        out = np.empty(len(ids))
        chosen = chosen_log if powers is None else chosen_term
        for at in range(0, len(ids), BATCH):
            part = slice(at, at + BATCH)
            i, o, t = ids[part], one[part], two[part]
            zc, inside, zm = self.logits(i, o, t)[:3] if powers is None else self.terms(powers, i, o, t)
            cls = np.where(i < WORDS, i % TAIL, TAIL)
            value = chosen(zc, cls)
            value[inside] += chosen(zm, i[inside] // TAIL)
            outside = np.flatnonzero(i >= WORDS)
            if self.depth and len(outside):
                z, taken, _ = self.branches(outside, o, t, leaves[part])
                z *= 1 - 2 * taken
                value[outside] -= np.log1p(np.exp(z, out=z), out=z).sum(axis=0)
            out[part] = value
        return out

    def step(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, leaves: np.ndarray | None = None) -> None:
        zc, inside, zm, class_rows, member_rows = self.logits(ids, one, two)
        gc = gradient(zc, np.where(ids < WORDS, ids % TAIL, TAIL))
        gm = gradient(zm, ids[inside] // TAIL)
        for k, rows in enumerate(class_rows):
            self._push(k, rows, gc)
        for k, rows in enumerate(member_rows, 3):
            self._push(k, rows, gm)
        total = gc.sum(axis=0)
        self.squares[5] += (total * total).mean()
        self.tables[5][0] -= RATE * total / np.sqrt(self.squares[5])
        outside = np.flatnonzero(ids >= WORDS)
        if self.depth and len(outside):
            z, taken, places = self.branches(outside, one, two, leaves)
            g = (1 / (1 + np.exp(-z)) - taken).ravel()
            for weights, squares, p in zip(self.tail, self.squares[-1], map(np.ravel, places), strict=True):
                np.add.at(self.gathered, p, g)
                total = np.take(self.gathered, p)  # equal places hold equal sums, so writing them once more changes nothing
                self.gathered[p] = 0
                grown = np.take(squares, p)
                grown += total * total
                squares[p] = grown
                total *= RATE
                total /= np.sqrt(grown, out=grown)
                weights[p] = np.subtract(np.take(weights, p), total, out=total)

    def _push(self, k: int, rows: np.ndarray, g: np.ndarray) -> None:
        """AdaGrad with one sum of squares per row; gradients of equal rows are added first."""
        if not len(rows):
            return
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # all row numbers fit, and short keys sort by radix
        ordered = rows[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sizes = np.diff(heads, append=len(ordered))
        # rows with many repeats first, so that those with an i-th one stand in front: their repeats are added together
        rank = np.argsort(-sizes.astype(np.int16), kind="stable")
        heads, sizes = heads[rank], sizes[rank]
        own, n = ordered[heads], len(heads)
        least = np.searchsorted(-sizes, -np.arange(1, REPEATS + 1), side="left").tolist()
        total, more = self.buffers[4][:n], self.buffers[3]
        np.take(g, order[heads], axis=0, out=total, mode="clip")
        # the few with more repeats are summed as one run each
        far = int(np.searchsorted(-sizes, -REPEATS - 1, side="left"))
        for i, m in enumerate(least, 1):
            total[far:m] += np.take(g, order[heads[far:m] + i], axis=0, out=more[: max(0, m - far)], mode="clip")
        if far:
            starts = np.cumsum(sizes[:far]) - sizes[:far]
            members = np.arange(starts[-1] + sizes[far - 1]) + np.repeat(heads[:far] - starts, sizes[:far])
            np.add.reduceat(np.take(g, order[members], axis=0, out=more[: len(members)], mode="clip"), starts, axis=0, out=total[:far])
        squares = self.squares[k][own] + np.einsum("ij,ij->i", total, total) / 64
        self.squares[k][own] = squares
        total *= (RATE / np.sqrt(squares))[:, None]
        changed = np.take(self.tables[k], own, axis=0, out=more[:n], mode="clip")
        changed -= total
        self.tables[k][own] = changed

    def learn(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, leaves: np.ndarray | None = None) -> None:
        for at in range(0, len(ids), BATCH):
            part = slice(at, at + BATCH)
            self.step(ids[part], one[part], two[part], None if leaves is None else leaves[part])


_ONES = np.ones(64, np.float32)


def chosen_log(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at k. z is overwritten."""
    own = z[np.arange(len(z)), k]
    total = np.exp(z, out=z) @ _ONES
    return own - np.log(total)


def chosen_term(terms: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at k, of its terms."""
    return np.log(terms[np.arange(len(terms)), k]) - np.log(terms @ _ONES)


def gradient(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Softmax less the one at k, in place of z."""
    p = np.exp(z, out=z)
    p *= (1 / (p @ _ONES))[:, None]
    p[np.arange(len(p)), k] -= 1
    return p


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of every text and END, one after the other, and the number of each text's. No word becomes an object."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, lengths = split.flatten(), np.diff(split.offsets.to_numpy()).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0)  # beside blanks at a text's ends
    lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[empty.to_numpy(zero_copy_only=False)], minlength=len(lengths))
    flat = flat.filter(pc.invert(empty)).cast(pa.binary())
    lengths += 1
    index = np.empty(len(flat) + len(lengths), np.int64)
    inner = np.ones(len(index), bool)
    inner[np.cumsum(lengths) - 1] = False
    index[inner], index[~inner] = np.arange(len(flat)), len(flat)
    return pa.concat_arrays([flat, pa.array([END], pa.binary())]).take(pa.array(index)), lengths


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): END counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = lambda t: t.group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
        held = none = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        for batch in slices(batches):
            found = tokens(batch.column(1))[0].value_counts()
            held = pa.concat_tables([held, pa.table({"word": found.field("values"), "n": found.field("counts")})])
            if held.num_rows > 2 * TABLE_WORDS:
                held = summed(held)
                if held.num_rows > TABLE_WORDS:
                    yield from held.to_batches()
                    held = none
        yield from summed(held).to_batches()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def leaf_of(depth: int) -> Column:
    return F.crc32("word") % F.lit(1 << depth)


def gather_facts(counts: DataFrame) -> tuple[Facts, DataFrame]:
    """And (leaf, crowd): tokens + words of every leaf of the tail that has words. The head ends at a count, on a logarithmic
    scale, so that it is found by a histogram of a few hundred rows; where more words share the highest step than the head
    holds, their hashes choose."""
    tokens, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    step = F.floor(F.log2("c") * 16)
    histogram = counts.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect()
    held, least, share = 0, 0, 1.0
    for row in histogram:
        if held + row["count"] > HEAD:
            if not held:
                least, share = row["step"], 0.9 * HEAD / row["count"]
            break
        held, least = held + row["count"], row["step"]
    chosen = counts.where(step >= least)
    if share < 1:
        chosen = chosen.where((F.xxhash64("word").cast("double") / 2.0**64 + 0.5 < share) | (F.col("word") == F.lit(END)))
    top = chosen.limit(HEAD + 1).collect()
    top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    head = {bytes(r["word"]): r["c"] for r in top}
    model = [bytes(r["word"]) for r in top[:WORDS]]
    if END in head and END not in model:  # an end in the model even if few documents make it rare
        model[-1] = END
    depth = shape_for(distinct or 0)[0]
    spark = counts.sparkSession
    inner = spark.createDataFrame([(bytearray(w),) for w in model], "word binary")
    tail = counts.join(F.broadcast(inner), "word", "left_anti")  # WORDS rows at most
    crowds = cut(tail.groupBy(leaf_of(depth).alias("leaf")).agg(F.sum(F.col("c") + 1).alias("crowd")))
    own = np.fromiter((zlib.crc32(w) % (1 << depth) for w in head), np.int64, len(head))
    wanted = spark.createDataFrame(pd.DataFrame({"leaf": np.unique(own)}), "leaf long")
    found = {r["leaf"]: r["crowd"] for r in crowds.join(F.broadcast(wanted), "leaf").collect()}  # HEAD rows at most
    return Facts(tokens or 0, distinct or 0, head, model, np.array([found.get(x, 0) for x in own.tolist()], float)), crowds


def train(docs: DataFrame, facts: Facts, warm_documents: int = 1500) -> Model:
    """docs: (doc_id, text) of the training documents."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(facts)
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(warm_documents).distinct()

    def encode():
        numbers = sent.value.numbers

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = numbers.sequences(*tokens(batch.column(1)))
            both = np.stack([found.ids.astype(np.int64), found.leaves])
            parts = [x.tobytes() for x in np.split(both, found.starts[1:], axis=1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["doc_id", "ids"])

        return step

    warm = Model(None, *facts.shape)
    got = map_texts(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text"), encode, "doc_id long, ids binary").toPandas().sort_values(["doc_id", "ids"], kind="stable")
    rng = np.random.default_rng(5)
    first = [np.frombuffer(x, np.int64).reshape(2, -1) for x in got["ids"]]
    for _ in range(2):
        for at in range(0, len(first), 64) if first else ():
            some = [first[i] for i in rng.permutation(len(first))[:64]]
            ids, leaves = np.concatenate(some, axis=1)
            warm.learn(*shifted(ids.astype(np.int32), np.array([x.shape[1] for x in some])), leaves)
    if not facts.tokens:
        return warm
    start = context.broadcast((warm.flat, warm.squares))

    def run(part: pa.Table) -> pa.Table:
        numbers, seen = sent.value.numbers, 0
        flat, squares = start.value
        own = Model(flat.copy(), *sent.value.shape)
        own.squares = [s.copy() for s in squares]
        for batch in slices(iter(part.sort_by([("doc_id", "ascending"), ("h", "ascending")]).combine_chunks().to_batches())):
            ids, one, two, leaves, *_ = numbers.sequences(*tokens(batch.column("text")))
            own.learn(ids, one, two, leaves)
            seen += len(ids)
        change = np.array_split((own.flat - flat).astype(np.float16), BLOCKS)
        return pa.table([pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([c.tobytes() for c in change], pa.binary())], names=["block", "tokens", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, seen, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(change, np.float16).astype(np.float64) * (seen / facts.tokens)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], ["block", "change"])

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-facts.tokens // TASK_TOKENS))).alias("part")
    changes = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), part).groupBy("part").applyInArrow(run, "block int, tokens long, change binary")
    summed = changes.repartition("block").mapInArrow(add, "block int, change binary").orderBy("block").collect()
    for part, r in zip(np.array_split(warm.flat, BLOCKS), summed, strict=True):  # in place: the driver holds one model
        part += np.frombuffer(r["change"], np.float32)
    start.destroy()
    return warm


def score(docs: DataFrame, counts: DataFrame, facts: Facts, crowds: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((facts, model.flat))
    whole = float(facts.tokens + facts.distinct + 1)

    def make():
        own, flat = sent.value
        numbers, net = own.numbers, Model(flat, *own.shape)
        powers = net.powers()
        in_model = set(own.model)
        held = np.fromiter(own.head.values(), float, len(own.head))
        inside = np.fromiter((w in in_model for w in own.head), bool, len(held))
        # by place in the head, and last for all words outside: log10 of the smoothed count, and of the share of the leaf
        base_of = np.append(np.log10((held + 1) / whole), 0.0)
        share_of = np.append(np.where(inside, 0.0, np.log10((held + 1) / (own.crowds + 1))), 0.0)
        task = TaskContext.get().partitionId() << 36
        row = 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            found = numbers.sequences(*tokens(batch.column(1)))
            places, starts, n = found.places, found.starts, batch.num_rows
            over = lambda x: np.add.reduceat(x, starts)
            lengths = np.diff(starts, append=len(places))
            known = over((places >= 0).astype(np.int64))
            base, share = over(base_of[places]), over(share_of[places])
            logs = over(net.log_probabilities(found.ids, found.one, found.two, found.leaves, powers)) / np.log(10)
            rids = task + row + np.arange(n)
            row += n
            # a row for each word of a document outside the head
            owners = np.searchsorted(starts, found.rare, side="right") - 1
            many = max(len(found.outside.dictionary), 1)
            keys, times = np.unique(owners * many + found.outside.indices.to_numpy(), return_counts=True)
            held, more = keys // many, len(keys)
            none = np.zeros(more, np.int64)
            columns = [
                pa.concat_arrays([pa.array([b" %d" % r for r in rids], pa.binary()), found.outside.dictionary.take(pa.array(keys % many))]),
                np.concatenate((rids, rids[held])),
                pa.concat_arrays([batch.column(0), pa.nulls(more, pa.int64())]),
                np.concatenate((np.zeros(n, np.int64), times)),
                np.concatenate((lengths, none)),
                np.concatenate((known, none)),
                np.concatenate((base, none)),
                np.concatenate((logs + share, none)),
            ]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = ("word", "rid", "doc_id", "n", "n_tokens", "n_known", "base", "model")
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

        return step

    rows = map_texts(docs, make, "word binary, rid long, doc_id long, n long, n_tokens long, n_known long, base double, model double")
    met = rows.join(counts, "word", "left").withColumn("leaf", leaf_of(facts.shape[0])).join(small(crowds, CROWD_ROWS), "leaf", "left")
    c = F.coalesce("c", F.lit(0)) + 1
    return met.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("n") * F.log10(c / F.lit(whole))).alias("base_score"),
        F.sum(F.col("model") + F.col("n") * F.log10(c / (F.coalesce("crowd", F.lit(0)) + 1))).alias("score"),
    ).drop("rid")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = named(read(spark, sf_dir, "documents"), "doc_id", "text")
    learnt = docs.where(remainder("doc_id", 7) != 2)
    counts = cut(count_words(learnt))
    facts, crowds = gather_facts(counts)
    scored = score(docs, counts, facts, crowds, train(learnt, facts))
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
