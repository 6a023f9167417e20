"""Alignment of two tokenizers' tokens on the bytes they share.

A slice of an Arrow batch is taken as one run of bytes: its documents (each a blank and its text) stand one after the other
at known offsets. The ends of all A tokens and all B tokens are counted once by bincount over that run. Where an end is
counted twice, both tokenizers cut, and a group of tokens ends; wherever one is counted at all, one A token and one B token
end to overlap, so that each counted place is one link. Running sums over the places say which tokens a place links and
which group it lies in, and their differences at the documents' offsets are the documents' own counts.

Both tokenizers cut before a blank that follows what is no white space. A slice's documents are therefore cut into units at
such blanks, and each distinct unit of the slice is encoded once, in long strings of many units; documents with other
white space are encoded whole. Tokens are accepted only if their bytes are the unit's.

Counts over the corpus: a document's distinct id pairs refer to its slice's table of pairs, and only those tables (a pair
once a slice, with the number of documents that hold it) are shuffled, summed and joined with the sums; a slice's documents
then meet their slice's sums. No key can hold more rows than there are slices. What the first step finds is written to the
shared folder once, as compressed Parquet.

Defined results: texts null, empty, or whose tokens' bytes differ from a blank and the text have no tokens, only zeros and
the empty string; repeated documents, also under one id, each count; a document without an id keeps its row; columns other
than the id and the text are not read; an empty table gives an empty result. Text that is not UTF-8 is read with replacement
characters.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_symbols
from .common import BATCH_ROWS, read, shared_folder, slices, texts

#: Units encoded in one call.
UNITS_A_CALL = 4000
#: Documents with a blank after white space or at their start, with white space at their end, or with the mark that stands
#: for a blank in B's pieces are encoded whole.
IRREGULAR = re.compile("(?:^|\\s) |\\s$|▁")


@dataclass
class Paths:
    """The two tokenizer files: a byte-level BPE in JSON (A) and a sentencepiece model (B)."""

    a: str | None = None
    b: str | None = None

    def contents(self) -> tuple[str, bytes]:
        import public_tokenizers

        with open(self.a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            a = f.read()
        with open(self.b or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
            return a, f.read()


class Encoder:
    """Encodes strings that begin with a blank, and knows the bytes of each token."""

    def __init__(self, token_bytes: list[bytes], encode):
        self.token_bytes, self.encode = token_bytes, encode
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.decimals = [b"%d" % i for i in range(len(token_bytes))]

    def exact(self, text: str, data: bytes) -> list[int] | None:
        """The ids, or None if their bytes are not those of the text."""
        ids = self.encode(text)
        return ids if b"".join(map(self.token_bytes.__getitem__, ids)) == data else None

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, exact): ids of all units (each begins with a blank) in a row, how many each has, and whether they
        give the unit's bytes. A unit that is not exact has none."""
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for start in range(0, len(units), UNITS_A_CALL):
            part = units[start : start + UNITS_A_CALL]
            data = [u.encode() for u in part]
            found = self.exact("".join(part), b"".join(data))
            if found is not None:
                found = np.array(found, np.int64)
                ends, unit_ends = np.cumsum(self.lengths[found]), np.cumsum([len(d) for d in data])
                upto = np.searchsorted(ends, unit_ends, side="right")
                if (ends[upto - 1] == unit_ends).all():
                    ids.append(found)
                    counts.append(np.diff(upto, prepend=0))
                    continue
            each = [self.exact(u, d) or [] for u, d in zip(part, data, strict=True)]
            ids += [np.array(e, np.int64) for e in each]
            counts.append(np.array([len(e) for e in each], np.int64))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int64), n, n > 0


def byte_level(file_text: str) -> Encoder:
    """A: special strings are plain text. The library used ranks merges by the ids they make, so these must ascend."""
    import tiktoken

    spec = json.loads(file_text)
    vocab, of_symbol = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"] for t in spec["added_tokens"]}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError("the merges of this file do not make ids in ascending order")
    token_bytes = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if token not in special:
            token_bytes[i] = bytes(of_symbol[c] for c in token)
    ranks = {b: i for i, b in enumerate(token_bytes) if b}
    return Encoder(token_bytes, tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)


def pieces(model: bytes) -> Encoder:
    """B adds the first blank itself."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    spelled = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    token_bytes = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]
    return Encoder(token_bytes, lambda text: own.encode(text[1:], num_threads=1))


@dataclass
class Tokens:
    """Tokens of a slice's documents in a row, with each document's share and bytes; none for documents left out."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    size: np.ndarray


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def tokens(docs: list[bytes | None], a: Encoder, b: Encoder) -> Tokens:
    strings = ["" if d is None else d.decode("utf-8", "replace") for d in docs]
    whole = [bool(s) and IRREGULAR.search(s) is not None for s in strings]
    cut = pa.compute.split_pattern(pa.array(["" if w else s for s, w in zip(strings, whole, strict=True)], pa.large_string()), " ")
    coded = cut.flatten().dictionary_encode()
    distinct = [" " + u for u in coded.dictionary.to_pylist()]
    at = coded.indices.to_numpy().astype(np.int64)
    n_units = np.diff(cut.offsets.to_numpy())
    of_doc = np.split(at, np.cumsum(n_units)[:-1]) if len(docs) else []
    # the documents encoded whole are units of their own
    own = [i for i, w in enumerate(whole) if w]
    for i in own:
        of_doc[i] = np.array([len(distinct)])
        distinct.append(" " + strings[i])
    empty = np.array([not s for s in strings])
    sides, good = [], ~empty
    for encoder in (a, b):
        ids, counts, exact = encoder.units(distinct)
        sides.append((ids, counts, np.cumsum(counts) - counts))
        good &= np.array([bool(exact[u].all()) for u in of_doc], bool) if len(docs) else empty
    size = np.array([len(s.encode()) + 1 if g else 0 for s, g in zip(strings, good, strict=True)], np.int64)
    units = np.concatenate([u for u, g in zip(of_doc, good, strict=True) if g] or [np.zeros(0, np.int64)])
    doc = np.repeat(np.flatnonzero(good), [len(u) for u, g in zip(of_doc, good, strict=True) if g])
    out = []
    for ids, counts, starts in sides:
        out += [ids[ragged(starts[units], counts[units])], np.bincount(doc, counts[units], minlength=len(docs)).astype(np.int64)]
    return Tokens(*out, size)


@dataclass
class Aligned:
    """By place (where a token of either side ends): whether an A token, a B token, both end there; the tokens it links; the
    document. By document: places and groups up to its end."""

    at: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    doc: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


def align(t: Tokens, a: Encoder, b: Encoder) -> Aligned:
    ends_a, ends_b = np.cumsum(a.lengths[t.a]), np.cumsum(b.lengths[t.b])
    offsets = np.cumsum(t.size)
    ends = np.bincount(np.concatenate([ends_a, ends_b]), minlength=(offsets[-1] if len(offsets) else 0) + 1).astype(np.uint8)
    at = np.flatnonzero(ends)
    cuts = ends[at] == 2
    is_a = np.zeros(len(ends), bool)
    is_a[ends_a] = True
    a_ends = is_a[at]
    b_ends = cuts | ~a_ends
    upto = np.searchsorted(at, offsets, side="right")
    groups_upto = np.concatenate([[0], np.cumsum(cuts)])[upto]
    n_links = np.diff(upto, prepend=0)
    return Aligned(at, a_ends, b_ends, cuts, np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends, np.repeat(np.arange(len(n_links)), n_links), np.diff(groups_upto, prepend=0), n_links)


def digests(t: Tokens, x: Aligned, a: Encoder, b: Encoder) -> list[str]:
    """sha256 of each document's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
    group = np.cumsum(x.cuts) - x.cuts
    group_a, group_b = group[x.a_ends], group[x.b_ends]
    last_a, last_b = x.cuts[x.a_ends], x.cuts[x.b_ends]
    n = int(x.cuts.sum())
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
    upto_a = np.cumsum(np.bincount(group_a, minlength=n))
    # a token's spelling by side, id and whether it is its group's last of its side
    spelled = [d + e for s, sep in ((a, b"|"), (b, b";")) for d in s.decimals for e in (b",", sep)]
    order = np.empty(len(t.a) + len(t.b), np.int64)
    order[np.arange(len(t.a)) + before_b[group_a]] = t.a * 2 + last_a
    order[np.arange(len(t.b)) + upto_a[group_b]] = (len(a.decimals) + t.b) * 2 + last_b
    out, start = [], 0
    codes = order.tolist()
    for count in (t.n_a + t.n_b).tolist():
        out.append(hashlib.sha256(b"".join([spelled[c] for c in codes[start : start + count]])[:-1]).hexdigest() if count else "")
        start += count
    return out


FOUND = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, docs array<int>"


def found_rows(number: int, doc_ids: pa.Array, t: Tokens, x: Aligned, a: Encoder, b: Encoder) -> pa.RecordBatch:
    """A row for each document with its distinct id pairs as places in the slice's table (differences, as uint32) and how
    often each is linked, then a row with the table: pairs, and how many of the slice's documents hold each."""
    pairs, of_link = np.unique(t.a[x.link_a] << 32 | t.b[x.link_b], return_inverse=True)
    held, times = np.unique(x.doc * max(1, len(pairs)) + of_link, return_counts=True)
    doc, place = held // max(1, len(pairs)), held % max(1, len(pairs))
    first = np.searchsorted(doc, np.arange(len(t.size) + 1))
    steps = np.diff(place, prepend=0)
    starts = first[:-1][first[:-1] < first[1:]]
    steps[starts] = place[starts]
    steps, times = steps.astype("<u4"), times.astype("<u4")
    n = len(t.size)
    cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    columns = [
        pa.array([number] * (n + 1), pa.int64()),
        pa.array([*doc_ids.to_pylist(), None], pa.int64()),
        *(pa.array([*c.tolist(), None], pa.int64()) for c in (t.n_a, t.n_b, x.n_groups, x.n_links)),
        pa.array([*digests(t, x, a, b), None], pa.string()),
        pa.array([*(steps[s:e].tobytes() for s, e in cuts), None], pa.binary()),
        pa.array([*(times[s:e].tobytes() for s, e in cuts), None], pa.binary()),
        pa.array([*[None] * n, pairs], pa.list_(pa.int64())),
        pa.array([*[None] * n, np.bincount(place, minlength=len(pairs)).astype(np.int32)], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in FOUND.split(", ")])


def encoders(docs: DataFrame, paths: Paths):
    """A function that makes, once a task, the two encoders. The driver reads the files; their size bounds what is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(paths.contents())
    return lambda: (byte_level(sent.value[0]), pieces(sent.value[1]))


def spans(docs: DataFrame, paths: Paths = Paths(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, cuts): the tokens of each text, and for each group the bytes (of a blank and the text), A
    tokens and B tokens up to its end."""
    load = encoders(docs, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load()
        for batch in slices(batches):
            t = tokens(texts(batch.column(1)), a, b)
            x = align(t, a, b)
            ends = [np.concatenate([[0], np.cumsum(n)]) for n in (t.size, t.n_a, t.n_b, x.n_groups)]
            upto = [v[x.cuts] for v in (x.at, np.cumsum(x.a_ends), np.cumsum(x.b_ends))]
            a_ids, b_ids, cuts = [], [], []
            for i in range(batch.num_rows):
                s, e = ends[3][i], ends[3][i + 1]
                a_ids.append(t.a[ends[1][i] : ends[1][i + 1]])
                b_ids.append(t.b[ends[2][i] : ends[2][i + 1]])
                cuts.append([{"bytes": p, "a": q, "b": r} for p, q, r in zip(*((v[s:e] - o[i]).tolist() for v, o in zip(upto, ends, strict=False)), strict=True)])
            kind = pa.list_(pa.struct([("bytes", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a_ids, pa.list_(pa.int32())), pa.array(b_ids, pa.list_(pa.int32())), pa.array(cuts, kind)], ["doc_id", "a_ids", "b_ids", "cuts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, cuts array<struct<bytes:int,a:int,b:int>>")


def found(docs: DataFrame, paths: Paths = Paths(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each document's counts, digest and pairs; and each slice's table of pairs. Written once to the shared folder."""
    load = encoders(docs, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load()
        partition = TaskContext.get().partitionId()
        for i, batch in enumerate(slices(batches)):
            t = tokens(texts(batch.column(1)), a, b)
            yield found_rows(partition << 32 | i, batch.column(0), t, align(t, a, b), a, b)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    path = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    rows.mapInArrow(run, FOUND).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).where("pairs is null").drop("pairs", "docs"), spark.read.parquet(path).where("pairs is not null").select("slice", "pairs", "docs")


def pair_counts(tables: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents a pair of ids is linked, and whether no pair with this A id has more."""
    table = tables.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = table.groupBy("pair").agg(F.sum("docs").alias("count")).select((F.shiftright("pair", 32)).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count")
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def aligned(docs: DataFrame, paths: Paths = Paths(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    of_docs, tables = found(docs, paths, id_col, text_col)
    counts = pair_counts(tables).select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "count", "best")
    values = tables.select("slice", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair").select("slice", "place", "count", "best")

    def meet(key: tuple, documents: pa.Table, of_places: pa.Table) -> pa.Table:
        count, best = np.zeros(of_places.num_rows, np.int64), np.zeros(of_places.num_rows, np.int64)
        place = of_places.column("place").to_numpy()
        count[place], best[place] = of_places.column("count").to_numpy(), of_places.column("best").to_numpy(zero_copy_only=False)
        steps, times = documents.column("places").to_pylist(), documents.column("times").to_pylist()
        n = np.array([len(s) // 4 for s in steps], np.int64)
        ends = np.cumsum(n)
        run = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(steps), "<u4").astype(np.int64))])
        at = run[1:] - np.repeat(run[ends - n], n)  # running sums of the differences, from each document's start
        often = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
        sums = [np.diff(np.concatenate([[0], np.cumsum(often * v[at])])[ends], prepend=0) for v in (best, count)]
        kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])).append_column("groups_sha256", documents.column("groups_sha256"))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return of_docs.groupBy("slice").cogroup(values.groupBy("slice")).applyInArrow(meet, schema)


def op11(spark, sf_dir: str) -> DataFrame:
    return aligned(read(spark, sf_dir, "documents"))
