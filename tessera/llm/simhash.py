"""SimHash fingerprints of word shingles, and groups of documents whose fingerprints lie within a radius.

Fingerprints are linked exactly. The 64 bits are cut into blocks; two fingerprints within the radius agree on some
choice of blocks, so every such choice makes a table of buckets and only bucket mates are compared. Inside a task the
mates are compared bit-sliced: bit b of all fingerprints is one plane of packed words, the mismatch of a plane with the
same plane shifted by d rows serves 64 pairs at once, and carry-save adders keep 64 distances in a few words. Words
whose pairs all exceed the radius, or are joined already, are abandoned.

A bucket over BUCKET_ROWS is dealt out as pairs of chunks, so a hot bucket never meets in one task. Each task returns a
spanning forest of the links it found, and the forests are contracted to components by rounds of hooking every node to
its least neighbour, each round cut in the shared folder.

Defined results: a null or empty text has no word and fingerprint zero, linked like any other; rows with a null id are
linked like others and name no component, so one that reaches no id has a null component_id; repeated rows give one row
each with equal component ids; an empty table gives an empty result. Columns other than the id and the text are not read,
except by `keep_first`, which tells rows of one id apart by all their columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, read, small, texts

SEED = 42
BUCKET_ROWS = 4096
#: Ids (of 8 bytes) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Copies of a component's minimum that its fingerprints meet.
SALTS = 16
#: Buckets of this many fingerprints are expected at most: it decides how many blocks a key takes.
EXPECTED_MATES = 64


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - width + 1].tolist()
    ends = np.concatenate((gaps[width - 1 :], [len(joined)])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """(doc_id, mark, fp): the fingerprint of every whole text as a signed long. mark: a long, null if not given."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, width) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "mark", "fp"])

        return step

    mark = F.lit(None).cast("long") if mark is None else mark
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark.alias("mark"))
    return map_texts(rows, make, "doc_id long, mark long, fp long")


def covering(n: int, radius: int) -> tuple[int, int]:
    """Blocks and how many of them a key takes: radius r leaves at least blocks - r equal ones."""
    for taken in range(1, 65 - radius):
        blocks = radius + taken
        if n <= EXPECTED_MATES << (taken * (64 // blocks)):
            return blocks, taken
    return 64, 64 - radius


def bucket_masks(n: int, radius: int) -> list[int]:
    """For every choice of blocks the mask of its bits; any pair within the radius agrees under one of them."""
    blocks, taken = covering(n, radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(parts[i] for i in some) for some in itertools.combinations(range(blocks), taken)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of packed words: bit r % 64 of word r // 64 in plane b is bit b of fps[r]. Two words of padding."""
    padded = np.zeros((len(fps) // 64 + 3) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def over(counter: list[np.ndarray], saturated: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of a bit-sliced counter that exceed the radius."""
    more, same = saturated.copy(), ~saturated
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def close_lanes(planes: np.ndarray, lanes: np.ndarray, d: int, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Words of lanes r whose rows r and r + d differ in at most radius bits: (word numbers, lanes of each)."""
    words = np.flatnonzero(lanes)
    alive = lanes[words]
    q, s = divmod(d, 64)
    depth = max(3, radius.bit_length())
    counter = [np.zeros(len(words), np.uint64) for _ in range(depth)]
    saturated = np.zeros(len(words), np.uint64)

    def mismatch(b: int) -> np.ndarray:
        plane = planes[b]
        shifted = plane[words + q]
        if s:
            shifted = (shifted >> np.uint64(s)) | (plane[words + q + 1] << np.uint64(64 - s))
        return plane[words] ^ shifted

    for at in range(0, 64, step):
        for b in range(at, at + step, 2):
            x, y = mismatch(b), mismatch(b + 1)
            # a carry-save adder takes two planes into the ones; its carry ripples up the counter
            half = counter[0] ^ x
            carry = (counter[0] & x) | (half & y)
            counter[0] = half ^ y
            for k in range(1, depth):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            saturated |= carry
        alive &= ~over(counter, saturated, radius)
        keep = alive != 0
        if not keep.any():
            return words[:0], alive[:0]
        if keep.mean() < 0.75:
            words, alive, saturated = words[keep], alive[keep], saturated[keep]
            counter = [c[keep] for c in counter]
    return words[alive != 0], alive[alive != 0]


def pack(lanes: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(lanes) + 63) // 64 * 64, bool)
    padded[: len(lanes)] = lanes
    return np.packbits(padded, bitorder="little").view("<u8")


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; root[r] is the least row of r's set, before and after."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(root, up := root[root]):
            root[:] = up


def forest(groups: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """root of every row, where rows of one group within the radius are joined. Rows of a group stand together."""
    n = len(fps)
    if not n:
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.concatenate((heads, [n])))
    by_size = np.argsort(-sizes, kind="stable")  # the rows that still have a mate at distance d then are a prefix
    order = np.concatenate([np.arange(heads[g], heads[g] + sizes[g]) for g in by_size[sizes[by_size] > 1]] or [np.zeros(0, np.int64)])
    root = np.arange(n)
    if not len(order):
        return root
    kept = sizes[by_size][sizes[by_size] > 1]
    ends = np.repeat(np.cumsum(kept), kept)
    planes, own, rows = bit_planes(fps[order]), np.arange(len(order)), np.arange(len(order))
    for d in range(1, int(kept[0])):
        live = int(kept[kept > d].sum())
        lanes = (rows[:live] + d < ends[:live]) & (own[:live] != own[np.minimum(rows[:live] + d, len(own) - 1)])
        if not lanes.any():
            continue
        words, found = close_lanes(planes, pack(lanes), d, radius)
        if len(words):
            hit = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, bit = np.nonzero(hit)
            a = words[at] * 64 + bit
            join_roots(own, a, a + d)
    root[order] = order[own]
    return root


def links(fps: DataFrame, radius: int, n: int) -> DataFrame:
    """(a, b): for every group of bucket mates a spanning forest of the links within the radius. fps has distinct fp."""
    masks = bucket_masks(n, radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "key"))
    hot = keyed.groupBy("t", "key").count().where(F.col("count") > BUCKET_ROWS)
    chunks = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / BUCKET_ROWS).cast("int")
    dealt = (
        keyed.join(hot, ["t", "key"], "left")
        .withColumn("chunks", chunks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_units, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(units: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            root = forest(units, fps, radius)
            rest = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(fps[rest].view(np.int64)), pa.array(fps[root[rest]].view(np.int64))], ["a", "b"])

        for batch in batches:
            units = np.concatenate((held_units, batch.column(1).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((held_fps, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(units):
                continue
            done = int(np.searchsorted(units, units[-1]))  # the last group may go on in the next batch
            if done < 2 * BUCKET_ROWS:
                done = 0  # small steps waste the packed words
            held_units, held_fps = units[done:], fps[done:]
            yield found(units[:done], fps[:done])
        yield found(held_units, held_fps)

    return dealt.repartition("unit").sortWithinPartitions("unit", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): equal roots for connected nodes.

    Each round hooks every node to the neighbour that comes first by hash if that comes before itself, then renames the
    edges' ends. Only DataFrames of edges move; every round is cut in the shared folder.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = cut(edges.where("a <> b"))
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min(rank("b")).alias("first")).select(F.col("a").alias("node"), F.least("first", rank("a"))["id"].alias("up")))
        steps.append(step)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(step.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up")), end)
        edges = cut(ends.where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[0].select("node", F.col("up").alias("root"))
    for step in steps[1:]:
        roots = roots.join(step.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return roots


def classed(marks: DataFrame, radius: int) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint of marks; fp itself where it has no link."""
    classes = cut(marks.select("fp").distinct())
    roots = components(links(classes, radius, classes.count()))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))


def first_of(marks: DataFrame, named: DataFrame, first: Column) -> DataFrame:
    """(fp, first): for every fingerprint the aggregate `first` (a minimum) over the rows of its component.

    A component may hold a third of the fingerprints: minima are taken by fingerprint, then by component, and go back to
    its fingerprints over SALTS copies.
    """
    by_fp = marks.groupBy("fp").agg(first.alias("first")).join(named, "fp")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    least = by_fp.where("linked").groupBy("root").agg(F.min("first").alias("least")).select("root", "least", salt)
    met = by_fp.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"], "left")
    return met.select("fp", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of at most radius bits."""
    marks = cut(fingerprints(docs, width, id_col, text_col))
    least = first_of(marks, cut(classed(marks, radius)), F.min("doc_id"))
    return marks.join(least, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every component: that of the least id (rows without an id come last), of several rows with that id
    the first by a hash of all columns, of equal rows one."""
    columns = docs.columns
    mark = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    marks = cut(fingerprints(docs, width, id_col, text_col, mark))
    first = first_of(marks, cut(classed(marks, radius)), F.min(row))
    told = marks.join(first, "fp").withColumn("stays", row == F.col("first"))
    rows = cut(told.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    extra, repeated = rows.where(~F.col("stays")), rows.where(F.col("stays") & (F.col("n") > 1))
    marked = docs.withColumn("__mark", mark)
    same = lambda other: marked[id_col].cast("long").eqNullSafe(other["__id"]) & (marked["__mark"] == other["__mark"])
    gone = (extra.unionByName(repeated) if not repeated.isEmpty() else extra).select("__id", F.col("__mark"))
    gone = small(gone, BROADCAST_ROWS)
    kept = marked.join(gone, same(gone), "left_anti")
    if not repeated.isEmpty():  # equal rows: one of each, partly aggregated where they stand
        again = small(repeated.select("__id", "__mark"), BROADCAST_ROWS)
        kept = kept.unionByName(marked.join(again, same(again), "left_semi").dropDuplicates(["__mark", id_col]))
    return kept.select(*columns)


def op3(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
