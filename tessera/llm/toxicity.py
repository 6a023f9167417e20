"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

Words (letters of any script, A-Z lower-cased) hash to embedding rows. Filters of widths 1, 2 and 3 slide over the whole
text, each keeps its largest response, and a linear layer makes the logit. For scoring, every embedding row is multiplied
with every filter column once, so that a position costs one table row and a few additions. The gradient of max pooling
reaches one position for each document and filter, so training costs little more than the forward pass.

Thresholds are calibrated by language. Which language a text is in is itself predicted, from its words, by naive Bayes
over the same rows (the column lang of the labelled documents teaches it and is read for nothing else). A fifth of the
labelled rows is set aside; each language's best threshold on it is drawn towards the best one of all, and that one
towards 0.5, with the weight of PRIOR labels, so that every language has its own and few labels move it little. Logits
are shifted so that the threshold lies at 0.5.

The classifier is fitted on at most `sample` labelled documents (the first by hash of their id, all positives of the
sample included), whose words reach the driver as four bytes each; words that stand in fewer of them than `vocabulary`
asks for have no row and are not told apart. Scoring reads every whole text.

Defined results: a null or empty text, or one without a word, is scored by the bias alone; rows with a null label, and
labels of absent documents, are not learnt from; without any labelled row every score is 0; without a column of languages, or with
nulls only, all documents share one threshold; a label repeated is learnt
from as often as it stands there; null doc_ids are scored with held_out null. Columns other than id and text are not
read by the scorer.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, read, remainder, texts

#: Words hash to one of these; those of at least `least` training documents (see vocabulary) have an embedding row.
BUCKETS = 1 << 22
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
#: Words a slab of convolution holds; longer texts take several slabs that overlap.
SLAB = 1 << 16
WORD = re.compile(rb"[a-z\x80-\xff]+")
#: A language's threshold counts as much as its rarer label has rows, that of all as much as so many.
PRIOR = 20


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class Rows(dict):
    """Numbers by word, a bounded table: the hash bucket itself, or the bucket's embedding row, 0 where it has none."""

    def __init__(self, rows: dict[int, int] | None = None):
        super().__init__()
        self.rows = rows

    def __missing__(self, word: bytes) -> int:
        found = bucket(word) if self.rows is None else self.rows.get(bucket(word), 0)
        if len(self) < 300_000:
            self[word] = found
        return found


def word_rows(text: bytes | None, table: Rows) -> np.ndarray:
    words = WORD.findall((text or b"").lower())
    return np.fromiter(map(table.__getitem__, words), np.int32, len(words))


def vocabulary(docs: list[np.ndarray]) -> dict[int, int]:
    """Row numbers, from 1, of the buckets that occur in enough documents: a 400th of them, but 2 to 10."""
    seen, n = np.unique(np.concatenate([np.unique(d) for d in docs] or [np.zeros(0, np.int32)]), return_counts=True)
    kept = seen[n >= min(10, max(2, len(docs) // 400))]
    return dict(zip(kept.tolist(), range(1, len(kept) + 1), strict=True))


@dataclass
class Model:
    """table: for each row its product with every filter column, by (width, offset); shift: by language, of the logit."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray
    rows: dict[int, int]
    #: (rows, languages): logarithms of the chance of a row in a language; zeros for row 0.
    languages: np.ndarray

    def groups(self, docs: list[np.ndarray]) -> np.ndarray:
        """Number of the likeliest language of each document; behind the last one for those without a known word."""
        n = self.languages.shape[1]
        if not n:
            return np.zeros(len(docs), int)
        told = np.array([self.languages[rows[rows > 0]].sum(axis=0) if rows.any() else np.zeros(n) for rows in docs]).reshape(-1, n)
        return np.where((told != 0).any(axis=1), told.argmax(axis=1), n)

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """(documents, filters): the largest response of every filter over each whole document, zero if none is positive."""
        result = np.zeros((len(docs), len(self.out)), np.float32)
        slab, owners, positions, held = [], [], [], 0
        reach = max(WIDTHS) - 1

        def flush() -> None:
            nonlocal slab, owners, positions, held
            if slab:
                rows = np.concatenate([*slab, np.zeros(reach, np.int32)])
                starts = np.cumsum([0, *map(len, slab[:-1])])
                # from each part's first word to its last; what stands between, where windows would cross, is left out
                bounds = np.stack((starts, starts + positions), axis=1).ravel()
                best = np.maximum.reduceat(self.responses(rows), bounds, axis=0)[::2]
                np.maximum.at(result, owners, best)
            slab, owners, positions, held = [], [], [], 0

        for i, rows in enumerate(docs):
            for at in range(0, len(rows), SLAB):
                part = np.concatenate((rows[at : at + SLAB + reach], np.zeros(reach, np.int32)))
                if slab and held + len(part) > SLAB:
                    flush()
                slab.append(part)
                owners.append(i)
                positions.append(min(SLAB, len(rows) - at))
                held += len(part)
        flush()
        return result

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Responses at every position of rows but the last few, which pad."""
        n, columns, at = len(rows) - max(WIDTHS) + 1, [], 0
        products = self.table[rows]
        for w in WIDTHS:
            columns.append(sum(products[o : o + n, at + o * FILTERS : at + (o + 1) * FILTERS] for o in range(w)))
            at += w * FILTERS
        return np.concatenate(columns, axis=1) + self.bias

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pooled(docs) @ self.out + self.out_bias

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z = (self.logits(docs) + self.shift[self.groups(docs)]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def without_runs(rows: np.ndarray, most: int) -> np.ndarray:
    """rows with at most so many zeros in a row: windows without any known word are all alike."""
    zero = np.concatenate((np.zeros(most, bool), rows == 0))
    run = np.logical_and.reduce([zero[i : i + len(rows)] for i in range(most + 1)])
    return rows[~run]


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the logit interval with the best F1; of several the middle one."""
    cuts = np.unique(logits)
    mids = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    found = logits[None, :] > mids[:, None]
    hit = (found & (labels > 0)).sum(axis=1)
    f1 = 2 * hit / np.maximum(found.sum(axis=1) + (labels > 0).sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(mids[best[len(best) // 2]])


def calibrated(z: np.ndarray, truth: np.ndarray, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """Thresholds of the groups, on the scale of the logits z."""

    def drawn(own: np.ndarray, towards: float) -> float:
        rarer = min(int((truth[own] > 0).sum()), int((truth[own] <= 0).sum()))
        return (rarer * best_threshold(z[own], truth[own]) + PRIOR * towards) / (rarer + PRIOR) if rarer else towards

    of_all = drawn(np.ones(len(z), bool), 0.0)
    return np.array([drawn(groups == k, of_all) for k in range(n_groups)])


def language_table(docs: list[np.ndarray], langs: list[str | None], n_rows: int) -> np.ndarray:
    """Naive Bayes: logarithms of smoothed shares of the rows among the words of each language, languages by name."""
    names = sorted({x for x in langs if x is not None})
    counts = np.full((n_rows, len(names)), 0.5)
    for rows, lang in zip(docs, langs, strict=True):
        if lang is not None:
            counts[:, names.index(lang)] += np.bincount(rows, minlength=n_rows)
    counts[0] = 0
    table = np.log(counts / np.maximum(counts.sum(axis=0), 1), out=np.zeros_like(counts), where=counts > 0)
    return table.astype(np.float32)


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None] | None = None, visits: int = 96000, batch: int = 32, rate: float = 0.1, drop: float = 0.2, seed: int = 7) -> Model:
    """Fit documents given as word buckets: AdaGrad over mini-batches, words dropped at random; a fifth calibrates.

    visits: documents shown in all, in 3 to 14 epochs. langs: the documents' languages, as far as known."""
    rng = np.random.default_rng(seed)
    rows_of = vocabulary(docs)
    to_row = np.zeros(BUCKETS, np.int32)
    to_row[list(rows_of)] = list(rows_of.values())
    n_rows = len(rows_of) + 1
    docs = [to_row[d] for d in docs]
    languages = language_table(docs, langs or [None] * len(docs), n_rows)
    docs = [without_runs(d, max(WIDTHS)) for d in docs]
    columns = len(WIDTHS) * FILTERS
    emb = rng.normal(0, 0.1, (n_rows, DIM)).astype(np.float32)
    emb[0] = 0
    filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, out = np.zeros(columns, np.float32), np.abs(rng.normal(0, 0.3, columns)).astype(np.float32)
    out[1::4] *= -1
    held = np.arange(len(docs)) % 5 == 4 if len(docs) >= 50 else np.zeros(len(docs), bool)
    learnt = np.flatnonzero(~held)
    rate_of = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    out_bias = float(np.log(rate_of / (1 - rate_of)))
    sums = [np.full_like(x, 1e-2) for x in (emb, *filters, bias, out)]
    sum_b = 1e-2

    def model() -> Model:
        flat = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in filters], axis=1)
        return Model(emb @ flat, bias.copy(), out.copy(), out_bias, np.zeros(languages.shape[1] + 1), rows_of, languages)

    reach = max(WIDTHS) - 1
    most = max((len(d) for d in docs), default=0) + 2 * reach + 1
    room = np.empty((max(most, 1 << 15), columns + sum(WIDTHS) * FILTERS + DIM), np.float32)

    def step(which: np.ndarray) -> None:
        nonlocal out_bias, sum_b, room
        parts = [np.concatenate((docs[i], np.zeros(reach + 1, np.int32))) for i in which]
        rows = np.concatenate([*parts, np.zeros(reach, np.int32)])
        ends = np.cumsum([len(p) for p in parts])
        starts = np.concatenate(([0], ends[:-1]))
        stops = starts + [max(1, len(docs[i])) for i in which]
        rows[rng.random(len(rows)) < drop] = 0
        if len(rows) > len(room):
            room = np.empty((2 * len(rows), room.shape[1]), np.float32)
        flat, n, m = room.ravel(), len(rows), ends[-1]
        x = np.take(emb, rows, axis=0, out=flat[: n * DIM].reshape(n, DIM), mode="clip")
        wide = sum(WIDTHS) * FILTERS
        products = np.matmul(x, np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in filters], axis=1), out=flat[n * DIM : n * (DIM + wide)].reshape(n, wide))
        r = flat[n * (DIM + wide) : n * (DIM + wide) + m * columns].reshape(m, columns)
        r[:] = bias
        at = 0
        for k, w in enumerate(WIDTHS):
            for o in range(w):
                r[:, k * FILTERS : (k + 1) * FILTERS] += products[o : o + m, at : at + FILTERS]
                at += FILTERS
        places = np.stack([s + r[s:e].argmax(axis=0) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)])
        pooled = np.maximum(np.take_along_axis(r, places, axis=0), 0)
        z = pooled @ out + out_bias
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[which]) / len(which)).astype(np.float32)
        g_out, g_pool = pooled.T @ g + 1e-4 * out, (g[:, None] * out) * (pooled > 0)
        grads = [None, *[np.zeros_like(f) for f in filters], g_pool.sum(axis=0), g_out]
        touched, pushes = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            gp, at = g_pool[:, cols], places[:, cols]
            for o in range(w):
                grads[1 + k][o] = np.einsum("bfd,bf->df", x[at + o], gp)
                touched.append(rows[at + o].ravel())
                pushes.append((gp[:, :, None] * f[o].T).reshape(-1, DIM))
        touched, pushes = np.concatenate(touched), np.concatenate(pushes)
        rows_hit, inverse = np.unique(touched, return_inverse=True)
        g_emb = np.zeros((len(rows_hit), DIM), np.float32)
        np.add.at(g_emb, inverse, pushes)
        g_emb[rows_hit == 0] = 0
        sums[0][rows_hit] += g_emb**2
        emb[rows_hit] -= rate * g_emb / np.sqrt(sums[0][rows_hit])
        for p, s, gr in zip((*filters, bias, out), sums[1:], grads[1:], strict=True):
            s += gr**2
            p -= rate * gr / np.sqrt(s)
        sum_b += float(g.sum()) ** 2
        out_bias -= rate * float(g.sum()) / sum_b**0.5

    positive = learnt[labels[learnt] > 0]
    repeats = int(np.clip((len(learnt) - len(positive)) // (2 * max(1, len(positive))) - 1, 0, 9))  # up to a third of what is shown
    kept = [docs[i] for i in np.flatnonzero(held)]
    truth = labels[held]
    best = (np.inf, model())
    for _ in range(int(np.clip(visits // len(learnt), 3, 14)) if len(learnt) else 0):
        order = rng.permutation(np.concatenate((learnt, np.resize(positive, repeats * len(positive)))))
        for at in range(0, len(order), batch):
            step(order[at : at + batch])
        now = model()
        if kept:
            z = now.logits(kept)
            loss = float(np.mean(np.logaddexp(0, z) - truth * z))
            if loss < best[0]:
                best = (loss, now)
        else:
            best = (0.0, now)
    chosen = best[1]
    if kept:
        chosen.shift[:] = -calibrated(chosen.logits(kept), truth, chosen.groups(kept), len(chosen.shift))
    return chosen


def nothing_learnt() -> Model:
    columns = len(WIDTHS) * FILTERS
    return Model(np.zeros((1, sum(WIDTHS) * FILTERS), np.float32), np.zeros(columns, np.float32), np.zeros(columns, np.float32), -40.0, np.zeros(1), {}, np.zeros((1, 0), np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 16000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most `sample` rows of labels, the first by hash of the id; rows held out must not be in `labels`."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("float").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)

    def make():
        table = Rows()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [word_rows(t, table).tobytes() for t in texts(batch.column(3))]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], ["id", "y", "lang", "rows"])

        return step

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    joined = docs.select(F.col(id_col).cast("long").alias("__id"), lang.alias("__lang"), F.col(text_col).cast("string").alias("text"))
    joined = joined.join(F.broadcast(chosen), "__id").select("__id", "__y", "__lang", "text")
    got = map_texts(joined, make, "id long, y float, lang string, rows binary").toPandas().sort_values(["id", "y", "rows"], kind="stable")
    if got.empty:
        return nothing_learnt()
    rows = [np.frombuffer(r, np.int32) for r in got["rows"]]
    order = np.random.default_rng(3).permutation(len(rows))
    langs = [x if isinstance(x, str) else None for x in got["lang"]]
    return train([rows[i] for i in order], got["y"].to_numpy(np.float32)[order], [langs[i] for i in order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        table = Rows(own.rows)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = own.scores([word_rows(t, table) for t in texts(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

        return step

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, all columns and types kept, without the rows that score at or above the threshold."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def make():
        own = sent.value
        table = Rows(own.rows)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = own.scores([word_rows(t, table) for t in texts(batch.column(place))])
            return batch.filter(pa.array(scores < threshold))

        return step

    return map_texts(docs, make, docs.schema, text_col)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", 5) != 0)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, learnable(read(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
