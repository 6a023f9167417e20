"""Bootstrap and permutation tests as aggregations.

How often a question counts in a resample is a function of the question, the resample and a seed: three coefficients from
a hash of question and seed make a polynomial in the resample's number, over a prime field, whose value is looked up in the
Poisson distribution of mean one (or, for a permutation test, gives a sign). So a resample is a sum over rows: tasks add up
their own questions, what is shuffled is a row for each resample and task, and any number of strata, seeds and strategies
goes into one aggregation. All strategies of a question share its counts (a joint bootstrap).

Values count to nine decimals, as whole numbers: sums are exact, so neither the order nor the place of rows changes a
result (as long as n |value| stays below 9 x 10^9). A resample in which nothing is drawn (a few questions only) is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The field's size: products of two of its elements fit a long.
PRIME = (1 << 31) - 1
#: Values of the field from which on a draw counts at least once, twice, ...: the Poisson distribution of mean one.
POISSON = [math.ceil(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10)]
#: Whole numbers to one.
UNIT = 1_000_000_000
#: Resamples and draws, where a caller does not say how many.
RESAMPLES = 50_000


def coefficients(question: Column, seed: Column) -> list[Column]:
    digest = F.md5(F.concat_ws("|", seed.cast("string"), question.cast("string")))
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % PRIME for i in range(3)]


def drawn(resample: Column, a: Column, b: Column, c: Column) -> Column:
    """An element of the field."""
    return ((a * resample + b) % PRIME * resample + c) % PRIME


def count_of(element: Column) -> Column:
    total = F.lit(0)
    for least in POISSON:
        total = total + F.when(element >= least, 1).otherwise(0)
    return total


#: Questions and resamples that a task works on at once, and groups whose sums it holds.
BLOCK_QUESTIONS, BLOCK_RESAMPLES, BLOCK_GROUPS = 64, 512, 32


def folded(x: np.ndarray) -> np.ndarray:
    """The same element of the field, in fewer bits: 2^31 is one in it."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def block_sums(a: np.ndarray, b: np.ndarray, c: np.ndarray, values: np.ndarray, first: int, last: int, signs: bool) -> np.ndarray:
    """Rows n, <value>... of whole numbers, of questions with these coefficients and values (values x questions), for the
    resamples from first to last: `drawn` and `count_of` over arrays, and exact sums as products of small numbers."""
    r = np.arange(first, last, dtype=np.uint64)[None, :]
    x = folded(folded(folded(a[:, None] * r + b[:, None]) * r + c[:, None]))
    x = np.minimum(x, x - np.uint64(PRIME)).astype(np.uint32)  # below zero wraps to a great number
    if signs:
        times = ((x & np.uint32(1)) * np.uint32(2)).astype(np.float64) - 1.0
    else:
        count, over = np.zeros(x.shape, np.uint8), np.empty(x.shape, bool)
        for least in POISSON:
            if least < PRIME:
                np.add(count, np.greater_equal(x, np.uint32(least), out=over).view(np.uint8), out=count)
        times = count.astype(np.float64)
    low, high = values & 0x3FFFFFF, values >> 26  # parts whose sums over a block are exact in double precision
    sums = (np.concatenate([low, high]).astype(np.float64) @ times).astype(np.int64)
    n = np.full(x.shape[1], len(a), np.int64) if signs else times.sum(axis=0).astype(np.int64)
    return np.concatenate([n[None, :], sums[: len(values)] + (sums[len(values) :] << 26)])


def resampled(rows: DataFrame, question: str, values: list[str], by: list[str], resamples: int, seeds: list[int], signs: bool = False) -> DataFrame:
    """(by..., seed, resample, n, <value>...): how many rows each resample draws, and the sums of their values as whole
    numbers; with signs, every row counts, with its sign. The rows are dealt out to all cores, as each is much work."""
    whole = [F.round(F.col(v) * UNIT).cast("long").alias(v) for v in values]
    seeded = rows.select(*by, question, *whole, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    named = [x.alias(f"__{k}") for k, x in zip("abc", coefficients(F.col(question), F.col("seed")), strict=True)]
    dealt = seeded.select(*by, "seed", *named, *values).repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    keys = len(by) + 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema[:keys])
    totals = ", ".join(f"`{v}` long" for v in values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                own = [pa.repeat(pa.scalar(k, t), resamples) for k, t in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(resamples)), *map(pa.array, sums)], [*by, "seed", "resample", "__n", *values])
            held.clear()

        for batch in batches:
            kinds = [batch.column(i).type for i in range(keys)]
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True)):
                places.setdefault(key, []).append(i)
            numbers = [batch.column(k).to_numpy() for k in range(keys, batch.num_columns)]
            for key, at in places.items():
                if key not in held and len(held) == BLOCK_GROUPS:
                    yield from flushed()
                sums = held.setdefault(key, np.zeros((1 + len(values), resamples), np.int64))
                for s in range(0, len(at), BLOCK_QUESTIONS):
                    part = at[s : s + BLOCK_QUESTIONS]
                    a, b, c = (x[part].astype(np.uint64) for x in numbers[:3])
                    own = np.stack([x[part] for x in numbers[3:]])
                    for r in range(0, resamples, BLOCK_RESAMPLES):
                        end = min(r + BLOCK_RESAMPLES, resamples)
                        sums[:, r:end] += block_sums(a, b, c, own, r, end, signs)
        yield from flushed()

    parts = dealt.mapInArrow(run, f"{fields}, resample long, __n long, {totals}")
    return parts.groupBy(*by, "seed", "resample").agg(F.sum("__n").alias("n"), *[F.sum(v).alias(v) for v in values]).where("n > 0")


def ends(column: str) -> Column:
    return F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))


def intervals(paired: DataFrame, strategies: list[str], by: list[str] | None = None, resamples: int = RESAMPLES, seeds: list[int] | None = None, question: str = "question_id") -> DataFrame:
    """(by..., seed, strategy, questions, mean, low, high, se, sole_wins) of questions that have all scores; sole_wins is
    the share of resamples that a strategy wins alone."""
    by, seeds = by or [], seeds or [2026]
    complete = paired.select(*by, question, *strategies).dropna(subset=strategies)
    sums = resampled(complete, question, strategies, by, resamples, seeds)
    best = F.greatest(*strategies) if len(strategies) > 1 else F.col(strategies[0])
    winners = sum((F.when(F.col(s) == best, 1).otherwise(0) for s in strategies), F.lit(0))
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), (F.col(s) / F.col("n") / UNIT).alias("m"), ((F.col(s) == best) & (winners == 1)).cast("int").alias("won")) for s in strategies])
    long = sums.select(*by, "seed", F.explode(each).alias("v")).select(*by, "seed", "v.*")
    out = long.groupBy(*by, "seed", "strategy").agg(ends("m").alias("q"), F.stddev_samp("m").alias("se"), F.avg("won").alias("sole_wins"))
    seen = complete.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("m")) for s in strategies])).alias("v")).select(*by, "v.*")
    means = seen.groupBy(*by, "strategy").agg(F.count("*").alias("questions"), F.avg("m").alias("mean"))
    return joined(means, out, [*by, "strategy"]).select(*by, "seed", "strategy", "questions", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "se", "sole_wins")


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal; a few rows on both sides."""
    if not keys:
        return left.crossJoin(right)  # one row and a few
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, same).drop(*[f"__{k}" for k in keys])


def difference_means(deltas: DataFrame, column: str, by: list[str], resamples: int, seeds: list[int], question: str = "question_id") -> DataFrame:
    """(by..., seed, resample, m): a difference's mean in every resample."""
    known = deltas.select(*by, question, column).dropna(subset=[column])
    return resampled(known, question, [column], by, resamples, seeds).select(*by, "seed", "resample", (F.col(column) / F.col("n") / UNIT).alias("m"))


def difference_intervals(deltas: DataFrame, column: str, by: list[str] | None = None, resamples: list[int] | None = None, seeds: list[int] | None = None, question: str = "question_id") -> DataFrame:
    """(by..., seed, resamples, questions, mean, low, high, p_positive, p_zero): the bootstrap distribution of a mean
    difference, in every stratum, for every seed and number of resamples. The first resamples of the greatest number are
    those of a smaller one."""
    by, resamples, seeds = by or [], resamples or [RESAMPLES], seeds or [2026]
    means = difference_means(deltas, column, by, max(resamples), seeds, question)
    sizes = F.filter(F.array(*[F.lit(r) for r in sorted(set(resamples))]), lambda r: r > F.col("resample"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = means.select(*by, "seed", F.explode(sizes).alias("resamples"), "m").groupBy(*by, "seed", "resamples").agg(ends("m").alias("q"), share(F.col("m") > 0).alias("p_positive"), share(F.col("m") == 0).alias("p_zero"))
    known = deltas.dropna(subset=[column]).groupBy(*by).agg(F.count("*").alias("questions"), F.avg(column).alias("mean"))
    return joined(known, out, by).select(*by, "seed", "resamples", "questions", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_positive", "p_zero")


def sign_flips(deltas: DataFrame, column: str, by: list[str] | None = None, draws: int = RESAMPLES, seed: int = 2026, question: str = "question_id") -> DataFrame:
    """(by..., questions, mean, extreme, p): two-sided test of a mean difference by flipped signs; p counts the data itself
    as one draw. Without a difference p is 1."""
    by = by or []
    known = deltas.select(*by, question, column).dropna(subset=[column])
    flipped = resampled(known, question, [column], by, draws, [seed], signs=True)
    real = known.groupBy(*by).agg(F.count("*").alias("questions"), F.avg(column).alias("mean"), F.abs(F.sum(F.round(F.col(column) * UNIT).cast("long"))).alias("__observed"))
    met = joined(real, flipped.drop("seed"), by)
    out = met.groupBy(*by, "questions", "mean").agg(F.sum(F.when(F.abs(column) >= F.col("__observed"), 1).otherwise(0)).alias("extreme"))
    return out.select(*by, "questions", "mean", "extreme", ((F.col("extreme") + 1) / (draws + 1)).alias("p"))


def sensitivity(deltas: DataFrame, column: str, seeds: list[int], resamples: list[int], by: list[str] | None = None, question: str = "question_id") -> DataFrame:
    """(by..., low_min, low_max, high_min, high_max, stable): ranges of the interval's ends over a grid of seeds and numbers
    of resamples, and whether zero lies in all of them or in none."""
    by = by or []
    grid = difference_intervals(deltas, column, by, resamples, seeds, question)
    inside = F.when((F.col("low") <= 0) & (F.col("high") >= 0), 1).otherwise(0)
    return grid.groupBy(*by).agg(F.min("low").alias("low_min"), F.max("low").alias("low_max"), F.min("high").alias("high_min"), F.max("high").alias("high_max"), (F.min(inside) == F.max(inside)).alias("stable"))


def winners(paired: DataFrame, strategies: list[str], by: list[str] | None = None, resamples: int = RESAMPLES, seed: int = 2026) -> DataFrame:
    """(by..., strategy, wins, rank): how often a strategy wins a resample alone, the most frequent winner first."""
    by = by or []
    found = intervals(paired, strategies, by, resamples, [seed]).select(*by, "strategy", F.col("sole_wins").alias("wins"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("wins").desc(), "strategy")))
