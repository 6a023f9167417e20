"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation
through time.

A text is cut into windows of WINDOW bytes, wherever words end. Over each window one unit runs forwards and one
backwards, across blanks and line ends, and both states together label every byte; so a word's labels depend on the
words beside it. A document's probabilities are the mean over all its bytes. `Network.positions` gives the labels of the
bytes themselves.

The unit is one whose steps are cheap in numpy: the reset gate is applied behind the recurrent product, gates are sums
clipped to 0 and 1, and the candidate is x / (1 + |x|).

The network learns windows of documents with a language: about `per_language` documents of each, those whose hashed id
is below a share that the counted documents of that language give, and at most `per_document` windows of each, chosen by
a hash of their number; every language is drawn as often as the others.

Defined results: `und` with score 0 for a null or empty text and for one without a letter (str.isalpha), and for every
text if nothing could be learnt; ties between languages go to the first by name; null ids are predicted, with held_out
null, and not learnt from; repeated rows are predicted alike; an empty table gives an empty result. Columns other than id
and text are not read by the prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, read, remainder, texts

HIDDEN, WINDOW = 16, 64
#: Windows that run side by side: their states stay in a core's cache.
BATCH = 1024
ASCII_LETTER = re.compile(rb"[A-Za-z]")
BLANK = 32


def has_letter(text: bytes) -> bool:
    return ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def cut_up(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) codes, the last window of each document filled up with blanks; bytes in, and owner of, each."""
    sizes = np.array([len(d) for d in documents])
    counts = -(-sizes // WINDOW)
    codes = np.full(int(counts.sum()) * WINDOW, BLANK, np.uint8)
    at = (np.cumsum(counts) - counts) * WINDOW
    for start, document in zip(at.tolist(), documents, strict=True):
        codes[start : start + len(document)] = np.frombuffer(document, np.uint8)
    owner = np.repeat(np.arange(len(documents)), counts)
    held = np.full(len(owner), WINDOW)
    full = np.flatnonzero(counts)
    held[np.cumsum(counts)[full] - 1] = sizes[full] - (counts[full] - 1) * WINDOW
    return codes.reshape(-1, WINDOW), held, owner


@dataclass
class Direction:
    """A gated recurrent unit. table: (3, 256, HIDDEN), what a byte adds to the reset gate, update gate and candidate;
    mix: (3, HIDDEN, HIDDEN), what the state adds."""

    table: np.ndarray
    mix: np.ndarray

    @classmethod
    def drawn(cls, rng: np.random.Generator) -> Direction:
        table, mix = (rng.normal(0, s, (3, n, HIDDEN)).astype(np.float32) for n, s in ((256, 0.3), (HIDDEN, 0.25)))
        table[:2] = 0.25 * table[:2] + 0.5
        mix[:2] *= 0.25
        return cls(table, mix)

    def run(self, codes: np.ndarray, order: range, states: np.ndarray, keep: list | None = None) -> None:
        """Fill states (positions, windows, HIDDEN); codes has positions first."""
        h = np.zeros(states.shape[1:], states.dtype)
        x, y = np.empty((3, *h.shape), h.dtype), np.empty((3, *h.shape), h.dtype)
        r, u, c = x
        p = y[2]
        for t in order:
            for k in range(3):
                np.take(self.table[k], codes[t], axis=0, out=x[k], mode="clip")
                np.matmul(h, self.mix[k], out=y[k])
            for k in range(2):
                x[k] += y[k]
                np.clip(x[k], 0, 1, out=x[k])
            if keep is not None:
                keep.append((t, h, r.copy(), u.copy(), p.copy()))
            p *= r
            c += p
            np.abs(c, out=p)
            p += 1
            c /= p
            if keep is not None:
                keep[-1] += (c.copy(),)
            new = states[t]
            np.subtract(c, h, out=new)
            new *= u
            new += h
            h = new

    def back(self, kept: list, codes: np.ndarray, g_states: np.ndarray) -> list[np.ndarray]:
        """Gradients of (table, mix) by backpropagation through time."""
        g_table, g_mix = np.zeros_like(self.table), np.zeros_like(self.mix)
        g = np.zeros_like(g_states[0])
        for t, h, r, u, p, c in reversed(kept):
            g = g + g_states[t]
            g_c = g * u * (1 - np.abs(c)) ** 2
            g_x = g_c * p * ((r > 0) & (r < 1)), g * (c - h) * ((u > 0) & (u < 1)), g_c
            order = np.argsort(codes[t], kind="stable")
            ordered = codes[t][order]
            heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            g = g * (1 - u)
            for k, own in enumerate(g_x):
                g_table[k, ordered[heads]] += np.add.reduceat(own[order], heads, axis=0)
                at_state = own * r if k == 2 else own
                g_mix[k] += h.T @ at_state
                g += at_state @ self.mix[k].T
        return [g_table, g_mix]


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    bias: np.ndarray

    def labelled(self, codes: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, windows, 2 * HIDDEN) states, and (languages, positions, windows) probabilities."""
        length, n = codes.shape
        f, b = (np.empty((length, n, HIDDEN), self.out.dtype) for _ in range(2))
        self.forward.run(codes, range(length), f, kept and kept[0])
        self.backward.run(codes, range(length - 1, -1, -1), b, kept and kept[1])
        z = self.out[:HIDDEN].T @ f.reshape(-1, HIDDEN).T  # languages first: sums over them run along long rows
        z += self.out[HIDDEN:].T @ b.reshape(-1, HIDDEN).T
        z += self.bias[:, None]
        z -= z.max(axis=0)
        p = np.exp(z, out=z)
        p /= p.sum(axis=0)
        return np.concatenate((f, b), axis=2) if kept is not None else f, p.reshape(-1, length, n)

    def summed(self, documents: list[bytes]) -> np.ndarray:
        """For every document the probabilities summed over its bytes."""
        codes, held, owner = cut_up(documents)
        out = np.zeros((len(documents), len(self.languages)))
        for at in range(0, len(codes), BATCH):
            own = slice(at, at + BATCH)
            _, p = self.labelled(np.ascontiguousarray(codes[own].T))
            sums = p.sum(axis=1)
            for i in np.flatnonzero(held[own] < WINDOW).tolist():
                sums[:, i] = p[:, : held[at + i], i].sum(axis=1)
            for k, row in enumerate(sums):
                out[:, k] += np.bincount(owner[own], row, len(documents))
        return out

    def positions(self, text: bytes) -> list[str]:
        """The language of every byte."""
        codes, held, _ = cut_up([text])
        found = [p.argmax(axis=0) for p in (self.labelled(np.ascontiguousarray(codes[at : at + BATCH].T))[1] for at in range(0, len(codes), BATCH))]
        best = np.concatenate(found, axis=1).T if found else np.zeros((0, WINDOW), int)
        return [self.languages[k] for row, n in zip(best, held, strict=True) for k in row[:n].tolist()]


def predicted(network: Network | None, documents: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    labels, scores = ["und"] * len(documents), np.zeros(len(documents))
    if network is None:
        return labels, scores
    told = [i for i, t in enumerate(documents) if t and has_letter(t)]
    for i, total in zip(told, network.summed([documents[i] for i in told]), strict=True):
        p = total / len(documents[i])
        k = int(p.argmax())
        labels[i], scores[i] = network.languages[k], min(1.0, float(p[k]))
    return labels, scores


def train(codes: np.ndarray, held: np.ndarray, languages: list[str], steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 11) -> Network | None:
    """Adam over batches of windows, all languages drawn alike. codes: (windows, WINDOW), of which held bytes count."""
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = Network(names, Direction.drawn(rng), Direction.drawn(rng), rng.normal(0, 0.2, (2 * HIDDEN, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    target = np.searchsorted(names, languages)
    of = [np.flatnonzero(target == k) for k in range(len(names))]
    params = [net.forward.table, net.forward.mix, net.backward.table, net.backward.mix, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        drawn = np.array([own[rng.integers(len(own))] for own in (of[k] for k in rng.integers(len(names), size=batch).tolist())])
        own = np.ascontiguousarray(codes[drawn].T)
        mask = (np.arange(WINDOW)[:, None] < held[drawn][None, :]).astype(np.float32)
        kept: tuple[list, list] = ([], [])
        states, p = net.labelled(own, kept)
        g = p.transpose(1, 2, 0).copy()
        g[:, np.arange(batch), target[drawn]] -= 1
        g *= mask[:, :, None] / mask.sum()
        g_states = g @ net.out.T
        grads = [
            *net.forward.back(kept[0], own, g_states[:, :, :HIDDEN]),
            *net.backward.back(kept[1], own, g_states[:, :, HIDDEN:]),
            states.reshape(-1, 2 * HIDDEN).T @ g.reshape(-1, len(names)),
            g.sum(axis=(0, 1)),
        ]
        now = rate * min(1.0, 2 * (1 - step / steps) + 0.02)
        norm = float(np.sqrt(sum(float((x**2).sum()) for x in grads)))
        for q, m, v, x in zip(params, first, second, grads, strict=True):
            x = x * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (x - m)
            v += 0.01 * (x * x - v)
            q -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, per_language: int = 1000, per_document: int = 12, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Learn from the rows of docs with id and language. The driver gets 64 bytes for each window of the sample."""
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    least = F.lit(-(1 << 63)).cast("double")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    rows = known.where(F.xxhash64("id").cast("double") - least <= share[F.col("lang")] * F.lit(2.0**64))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, str, int, bytes]] = []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                starts = range(0, len(text or b""), WINDOW)
                if len(starts) > per_document:
                    starts = sorted(starts, key=lambda s: crc32(b"%d|%d" % (doc_id, s)))[:per_document]
                out += [(doc_id, lang, s, text[s : s + WINDOW]) for s in starts]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["id", "lang", "start", "piece"])

        return step

    got = map_texts(rows, make, "id long, lang string, start long, piece binary").toPandas().sort_values(["lang", "id", "start", "piece"], kind="stable")
    codes, held, _ = cut_up([bytes(p) for p in got["piece"]])
    return train(codes, held, got["lang"].tolist())


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            labels, scores = predicted(own, texts(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, lang_pred string, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    network = fit(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs, network).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
