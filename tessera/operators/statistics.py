"""Descriptive and paired statistics. What has a closed form is an aggregate; what needs a seeded stream of random numbers
runs in NumPy on one small group: the per-question scores of one experiment. `spread_bootstrap` is the form for scores of
any number: resamples are split over tasks and a resample's draws are Poisson counts by hash, so partial sums add up."""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-15


def describe(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, mean, linear quartiles, sample deviation and variance (0 for one value), range, interquartile range."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = values.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), q.alias("q"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"),
        F.coalesce(F.var_samp(column), F.lit(0.0)).alias("variance"), F.min(column).alias("min"), F.max(column).alias("max"),
    )
    return rows.select(*by, "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "sd", "variance", "min", "max", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def paired_summary(deltas: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Signs, sums and mean magnitudes of differences."""
    d = F.col(column)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return deltas.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), n(d > 0).alias("positive"), n(d == 0).alias("zero"), n(d < 0).alias("negative"),
        F.sum(F.when(d > 0, d).otherwise(0.0)).alias("sum_positive"), F.sum(F.when(d < 0, d).otherwise(0.0)).alias("sum_negative"), F.avg(F.abs(d)).alias("mean_magnitude"),
    )


def cohens_dz(deltas: DataFrame, column: str, by: list[str]) -> DataFrame:
    """mean / sd; without spread 0 if the mean is 0, else null; null below two values."""
    rows = deltas.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("sd"))
    value = F.when(F.col("n") < 2, None).when(F.col("sd") == 0, F.when(F.col("m") == 0, 0.0)).otherwise(F.col("m") / F.col("sd"))
    return rows.select(*by, value.cast("double").alias("dz"))


def average_ranks(rows: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """rows with the rank of a column within its group, equal values sharing the mean of their places.

    Equal values are counted first, so what the window of a group ranks is its distinct values.
    """
    sizes = rows.groupBy(*by, column).agg(F.count("*").alias("__t"))
    before = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col(column).alias("__value"), (F.coalesce(F.sum("__t").over(before), F.lit(0)) + (F.col("__t") + 1) / 2).alias(out))
    same = F.col(column).eqNullSafe(F.col("__value"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(ranked, same).drop("__value", *[f"__by_{c}" for c in by])


def signed_ranks(deltas: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., n, zeros, plus, minus, tie_sum) of the non-zero differences' ranks by magnitude.

    Equal magnitudes are counted first, so what the window of a group ranks is its distinct magnitudes.
    """
    known = deltas.where(F.col(column).isNotNull()).withColumn("a", F.abs(column))
    sizes = known.groupBy(*by, "a").agg(F.count("*").alias("t"), F.sum(F.when(F.col(column) > 0, 1).otherwise(0)).alias("p"))
    t = F.when(F.col("a") != 0, F.col("t")).otherwise(0)
    before = Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("r", F.coalesce(F.sum(t).over(before), F.lit(0)) + (t + 1) / 2)
    real = lambda x: F.sum(F.when(F.col("a") != 0, x).otherwise(0))
    return ranked.groupBy(*by).agg(
        real(F.col("t")).alias("n"),
        (F.sum("t") - real(F.col("t"))).alias("zeros"),
        real(F.col("r") * F.col("p")).cast("double").alias("plus"),
        real(F.col("r") * (F.col("t") - F.col("p"))).cast("double").alias("minus"),
        real(F.pow("t", F.lit(3)) - F.col("t")).cast("double").alias("tie_sum"),
    )


def rank_biserial(deltas: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(plus - minus) / (plus + minus) of the signed ranks; 0 where all differences are 0."""
    r = signed_ranks(deltas, column, by)
    return r.select(*by, F.when(F.col("n") == 0, 0.0).otherwise((F.col("plus") - F.col("minus")) / (F.col("plus") + F.col("minus"))).alias("rank_biserial"))


def wilcoxon(deltas: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Two-sided signed-rank test by the normal approximation with tie correction, without continuity correction. Where all
    differences are 0 the statistic is 0 and p is 1."""
    r = signed_ranks(deltas, column, by)
    mean = F.col("n") * (F.col("n") + 1) / 4
    spread = F.sqrt((F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) - F.col("tie_sum") / 2) / 24)
    rows = r.select(*by, "n", "zeros", F.least("plus", "minus").alias("statistic"), F.when(F.col("n") == 0, 0.0).otherwise((F.least("plus", "minus") - mean) / spread).alias("z"))
    p = F.pandas_udf(lambda z: z.map(lambda x: math.erfc(abs(x) / math.sqrt(2))), "double")
    return rows.withColumn("p", p("z"))


def holm(tests: DataFrame, p: str = "p", order: str = "idx") -> DataFrame:
    """tests with `adjusted`: a running maximum of (m - rank + 1) p, at most 1. A family of tests is a handful of rows."""
    by_p = Window.orderBy(p, order)
    ranked = tests.withColumn("__k", F.row_number().over(by_p)).withColumn("__m", F.count("*").over(Window.partitionBy()))
    step = F.least(F.lit(1.0), (F.col("__m") - F.col("__k") + 1) * F.col(p))
    return ranked.withColumn("adjusted", F.max(step).over(by_p.rowsBetween(Window.unboundedPreceding, 0))).drop("__k", "__m")


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks, of the rows that have both values."""
    ranked = rows.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        ranked = average_ranks(ranked, c, by, f"__{c}")
    return ranked.groupBy(*by).agg(F.corr(f"__{x}", f"__{y}").alias("rho"))


def shape(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    rows = values.groupBy(*by).agg(F.count(column).cast("double").alias("n"), F.skewness(column).alias("g"), F.kurtosis(column).alias("k"))
    n = F.col("n")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    return rows.select(*by, skew.alias("skewness"), kurt.alias("kurtosis"))


#: Coefficients of Royston's approximation (Applied Statistics algorithm R94), ascending powers.
ROYSTON_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
ROYSTON_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_SMALL_GAMMA = (-2.273, 0.459)
ROYSTON_SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
ROYSTON_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values: list[float] | np.ndarray) -> tuple[float, float]:
    """(W, p) of the Shapiro-Wilk test of normality, by Royston's approximation; (1, 1) without spread."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        raise ValueError("at least three values are needed")
    if x[-1] - x[0] < 1e-19:
        return 1.0, 1.0
    power = lambda c, t: sum(a * t**i for i, a in enumerate(c))
    normal = statistics.NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    size, u = float(m @ m), n**-0.5
    a = m / math.sqrt(size)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = power(ROYSTON_LAST, u) + a[-1]
        if n > 5:
            second = power(ROYSTON_SECOND, u) + a[-2]
            rest = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(rest)
            a[[1, -2]] = -second, second
        else:
            a = m / math.sqrt((size - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[[0, -1]] = -last, last
    spread = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(spread @ spread))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = power(ROYSTON_SMALL_GAMMA, n)
        if y >= gamma:
            return w, 1e-19
        y, mean, sd = -math.log(gamma - y), power(ROYSTON_SMALL_MEAN, n), math.exp(power(ROYSTON_SMALL_LOG_SD, n))
    else:
        t = math.log(n)
        mean, sd = power(ROYSTON_LARGE_MEAN, t), math.exp(power(ROYSTON_LARGE_LOG_SD, t))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


def truncated_interval(samples: list[float], tail: float = 0.025) -> tuple[float, float]:
    """Percentile interval by truncated indices into the sorted samples."""
    ordered = sorted(samples)
    n = len(ordered)
    return ordered[int(tail * n)], ordered[int((1 - tail) * n) - 1]


def joint_bootstrap(matrix: np.ndarray, resamples: int = 50_000, seed: int = 2026, batch: int = 5_000) -> np.ndarray:
    """(resamples, strategies) means; every strategy is resampled by the same questions."""
    rng = np.random.default_rng(seed)
    n = matrix.shape[1]
    parts = []
    for at in range(0, resamples, batch):
        index = rng.integers(0, n, size=(min(batch, resamples - at), n))
        parts.append(matrix[:, index].mean(axis=2).T)
    return np.concatenate(parts)


def permutation_p(deltas: np.ndarray, draws: int = 50_000, seed: int = 2026, batch: int = 5_000) -> tuple[float, int]:
    """Two-sided sign-flip test of the mean: (p with one added, number of draws as extreme). Zeros count in n only."""
    n, real = len(deltas), deltas[deltas != 0]
    if not len(real):
        return 1.0, draws
    observed = abs(deltas.sum() / n)
    rng = np.random.default_rng(seed)
    extreme = 0
    for at in range(0, draws, batch):
        signs = rng.integers(0, 2, size=(min(batch, draws - at), len(real)), dtype=np.int8) * 2 - 1
        extreme += int((np.abs((signs * real).sum(axis=1) / n) >= observed - TOLERANCE).sum())
    return (extreme + 1) / (draws + 1), extreme


def paired_bootstrap(deltas: list[float], samples: int = 5_000, seed: int = 20260811) -> tuple[float, float]:
    """Interval of the mean difference, by the standard library's generator."""
    rng = random.Random(seed)
    n = len(deltas)
    return truncated_interval([sum(deltas[rng.randrange(n)] for _ in range(n)) / n for _ in range(samples)])


def on_group(rows: DataFrame, by: list[str], compute: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """A seeded statistic of each group: one experiment's scores, a row for each question."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(by, key, strict=True)) | compute(group)])

    return rows.groupBy(*by).applyInPandas(run, schema)


def bootstrap_intervals(paired: DataFrame, strategies: list[str], resamples: int = 50_000, seed: int = 2026) -> DataFrame:
    """(strategy, mean, low, high, se, sole_wins) from one joint bootstrap over the questions of paired scores."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        matrix = group.sort_values("question_id")[strategies].to_numpy(float).T
        means = joint_bootstrap(matrix, resamples, seed)
        best = means == means.max(axis=1, keepdims=True)
        sole = best & (best.sum(axis=1, keepdims=True) == 1)
        low, high = np.quantile(means, [0.025, 0.975], axis=0)
        return pd.DataFrame({"strategy": strategies, "mean": matrix.mean(axis=1), "low": low, "high": high, "se": means.std(axis=0, ddof=1), "sole_wins": sole.mean(axis=0)})

    complete = paired.select("question_id", *strategies).dropna()
    return complete.groupBy(F.lit(0).alias("g")).applyInPandas(run, "strategy string, mean double, low double, high double, se double, sole_wins double")


def pair_bootstrap(paired: DataFrame, left: str, right: str, resamples: int = 50_000, seed: int = 2026) -> DataFrame:
    """(mean, low, high, p_positive, p_zero) of the difference's bootstrap distribution."""

    def compute(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("question_id")
        means = joint_bootstrap(g[[left, right]].to_numpy(float).T, resamples, seed)
        d = means[:, 0] - means[:, 1]
        low, high = np.quantile(d, [0.025, 0.975])
        return pd.DataFrame([{"mean": float((g[left] - g[right]).mean()), "low": low, "high": high, "p_positive": float((d > 0).mean()), "p_zero": float((d == 0).mean())}])

    rows = paired.select("question_id", left, right).dropna()
    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(compute, "mean double, low double, high double, p_positive double, p_zero double")


def spread_bootstrap(paired: DataFrame, strategies: list[str], resamples: int = 50_000, seed: int = 2026, parts: int = 64) -> DataFrame:
    """(strategy, mean, low, high, se) of a joint bootstrap over any number of questions.

    The resamples are dealt to `parts` ranges. In each a question counts as often as a Poisson draw of mean one says that
    its hash, the resample and the seed give, the same for all strategies; so tasks add up sums of their own questions,
    and what is shuffled is a vector of resamples for each task. The order and place of rows change nothing.
    """
    wide = paired.select("question_id", *[F.col(s).cast("double") for s in strategies]).dropna()
    width, m = -(-resamples // parts), len(strategies)
    schema = "part int, sums array<double>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            part, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.stack([np.ones(batch.num_rows), *(batch.column(2 + i).to_numpy() for i in range(m))])
            for p in np.unique(part).tolist():
                own = part == p
                got = totals.setdefault(p, np.zeros((m + 1, width)))
                for hashed, row in zip(h[own].tolist(), x[:, own].T, strict=True):
                    got += np.outer(row, np.random.default_rng([seed, p, hashed & (1 << 64) - 1]).poisson(1.0, width))
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.ravel() for t in totals.values()], pa.list_(pa.float64()))], ["part", "sums"])

    rows = wide.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.xxhash64(F.col("question_id").cast("string")).alias("h"), *strategies)
    sums = rows.mapInArrow(add, schema).select("part", F.posexplode("sums").alias("at", "x")).groupBy("part", "at").agg(F.sum("x").alias("x"))
    split = sums.select((F.col("part") * width + F.col("at") % width).alias("resample"), F.floor(F.col("at") / width).alias("of"), "x").where(F.col("resample") < resamples)
    means = split.groupBy("resample").pivot("of", list(range(m + 1))).agg(F.first("x"))
    values = means.select(F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), (F.col(str(i + 1)) / F.col("0")).alias("m")) for i, s in enumerate(strategies)])).alias("v")).select("v.*")
    ends = values.groupBy("strategy").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_samp("m").alias("se"))
    seen = wide.agg(*[F.avg(s).alias(s) for s in strategies]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("mean")) for s in strategies])).alias("v")).select("v.*")
    return seen.join(ends, "strategy").select("strategy", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "se")


def supported(interval_low: float, interval_high: float, adjusted_p: float, alpha: float = 0.05) -> bool:
    """A difference holds if its interval excludes 0 and its adjusted p lies below alpha."""
    return (interval_low > 0 or interval_high < 0) and adjusted_p < alpha
