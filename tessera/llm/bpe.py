"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer file (its path is a parameter).

A text is cut at the tokenizer's special strings, then at every place before white space (no piece of the
pre-tokenizer's pattern crosses one), so that the unit "white space and what follows" can be looked up whole. A unit
seen for the first time is cut into pieces by the pattern and each piece is merged: the ids of its parts and the ranks
of adjacent pairs stand in two short arrays; the least rank is scanned for, its boundary deleted, and the two ranks
beside it refreshed. Pieces over LONG_PIECE bytes take a heap in place of the scan, since a scan is quadratic.

Defined results: a null text encodes as the empty one, to no ids; a null or repeated doc_id keeps its row; an empty table
gives an empty result; columns other than the id and the text are not read. Text whose bytes are not UTF-8 is read with
replacement characters.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, read, texts

LONG_PIECE = 192
#: Units kept in each of a worker's two tables; a table is emptied when full.
TABLE_ENTRIES = 400_000
NO_RANK = 1 << 60
#: White space as the pre-tokenizer knows it, and its pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the file: itself if printable, else one of those from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Units(dict):
    """Ids by unit; a missing unit is encoded, with `lead` before it, and kept."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, unit: str) -> tuple[int, ...]:
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        ids = self[unit] = tuple(self.encode(self.lead + unit))
        return ids


class BytePairs:
    """Encodes and decodes with one tokenizer file, given as its JSON text."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        of_symbol = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = [vocab[c] for c in symbols]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(of_symbol[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.runs = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.crowded = regex.compile(rf"[{SPACE}] ")
        self.first, self.spaced = Units(self._unit, ""), Units(self._unit, " ")

    def _unit(self, unit: str) -> Iterable[int]:
        pieces = self.pieces.findall(unit)
        if len(pieces) == 1:
            return self.merge(unit.encode())
        out: list[int] = []
        for piece in pieces:  # a piece is a unit too, so one table serves both
            out += self.spaced[piece[1:]] if piece[0] == " " and len(piece) > 1 else self.first[piece]
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Merge a piece's bytes by rank, leftmost first among equals."""
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > LONG_PIECE:
            return self._merge_long(ids)
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 20 | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << 20 | ids[i + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, with a heap of (rank, place) over a linked list."""
        n, rank_of = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of(ids[i] << 20 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (p := before[i]) >= 0 and (r := rank_of(ids[p] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, p))
        return [x for x in ids if x >= 0]

    def _ordinary(self, text: str) -> list[int]:
        if not text:
            return []
        if self.crowded.search(text):
            return list(chain.from_iterable(map(self.first.__getitem__, self.runs.findall(text))))
        units = text.split(" ")
        ids = list(self.first[units[0]]) if units[0] else []
        if units[-1] == "" and len(units) > 1:  # a space that nothing follows
            units[-1:] = []
            tail = self.first[" "]
        else:
            tail = ()
        ids += chain.from_iterable(map(self.spaced.__getitem__, units[1:]))
        ids += tail
        return ids

    def encode(self, text: str) -> list[int]:
        if self.at_special is None or self.at_special.search(text) is None:
            return self._ordinary(text)
        ids: list[int] = []
        for part in self.at_special.split(text):
            ids += [self.special[part]] if part in self.special else self._ordinary(part)
        return ids

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The text in UTF-8; what is not UTF-8 becomes replacement characters."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def _loaded(df: DataFrame, path: str | None):
    """A function that makes, once a task, the tokenizer. The driver reads the file; its size bounds what is broadcast."""
    with open(path or default_path(), encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: BytePairs(sent.value)


def _strings(column: pa.Array) -> list[str]:
    return ["" if t is None else t.decode("utf-8", "replace") for t in texts(column)]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    load = _loaded(docs, path)

    def make():
        pairs = load()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [pairs.encode(t) for t in _strings(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""
    load = _loaded(encoded, path)

    def run(batches):
        pairs = load()
        for batch in batches:
            out = [pairs.decode_bytes(ids or ()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids and the text decoded from them, hashed where they are made."""
    load = _loaded(docs, path)

    def make():
        pairs = load()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_text = [], [], []
            for text in _strings(batch.column(1)):
                ids = pairs.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(pairs.text_of.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(pairs.decode_bytes(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenise(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and ids; the text is what the ids decode to. Columns of these names are replaced."""
    docs = docs.drop("n_tokens", "ids")
    load, place = _loaded(docs, path), docs.columns.index(text_col)

    def make():
        pairs = load()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [pairs.encode(t) for t in _strings(batch.column(place))]
            decoded = pa.array([pairs.decode_bytes(i) for i in ids], pa.binary()).cast(pa.string())
            columns = [decoded if i == place else c for i, c in enumerate(batch.columns)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "n_tokens", "ids"])

        return step

    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_texts(docs, make, schema, text_col)


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
