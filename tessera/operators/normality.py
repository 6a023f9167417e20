"""The Shapiro-Wilk test over groups of any size.

Values are sorted by range over all groups together, each partition counts its own run of a group, and a partition's
offset in a group is the number of values in the partitions before it: ranks without a group in one task. Equal values are
kept apart by where they stood, so that a value that a third of all rows have is cut across partitions too. The expected
normal scores are a rational approximation in Columns, and W and its p follow from one aggregation.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.statistics import ROYSTON_LARGE_LOG_SD, ROYSTON_LARGE_MEAN, ROYSTON_LAST, ROYSTON_SECOND, ROYSTON_SMALL_GAMMA, ROYSTON_SMALL_LOG_SD, ROYSTON_SMALL_MEAN
from tessera.session import scratch_folder

#: Coefficients of Wichura's approximation of the normal quantile (Applied Statistics algorithm AS 241),
#: ascending powers of numerators and denominators for the middle, the tails and the far tails.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def power_sum(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def with_normal_quantile(rows: DataFrame, p: Column, out: str) -> DataFrame:
    """rows with the normal quantile of probabilities between 0 and 1, to about 15 digits; in steps, as each step's result is
    used many times in the next."""
    fraction = lambda c, x: power_sum(c[0], x) / power_sum(c[1], x)
    rows = rows.withColumn("__p", p).withColumn("__q", F.col("__p") - 0.5).withColumn("__middle", 0.180625 - F.col("__q") * F.col("__q")).withColumn("__r", F.sqrt(-F.log(F.least(F.col("__p"), 1 - F.col("__p")))))
    rows = rows.withColumn("__near", F.col("__r") - 1.6).withColumn("__far", F.col("__r") - 5)
    tail = F.when(F.col("__r") <= 5, fraction(TAIL, F.col("__near"))).otherwise(fraction(FAR, F.col("__far")))
    value = F.when(F.abs("__q") <= 0.425, F.col("__q") * fraction(MIDDLE, F.col("__middle"))).otherwise(F.signum("__q") * tail)
    return rows.withColumn(out, value).drop("__p", "__q", "__middle", "__r", "__near", "__far")


def ranked(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., x, rank, n): every value's place in its group (equal values have places of their own) and the group's size."""
    spark = values.sparkSession
    rows = values.select(*by, F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").withColumn("__id", F.monotonically_increasing_id())
    keys = [*by, "x", "__id"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            groups = zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True) if by else [()] * batch.num_rows
            for g in groups:
                count = count + 1 if g == last else 1
                last = g
                places.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], [*by, "x", "part", "place"])

    path = f"{scratch_folder(spark)}/ranks-{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(run, f"{kinds + ', ' if kinds else ''}x double, part int, place long").write.parquet(path)  # ranges are drawn anew each time
    kept = spark.read.parquet(path)
    runs = kept.groupBy(*by, "part").agg(F.max("place").alias("size"))
    whole = Window.partitionBy(*by)
    offsets = runs.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("part").alias("__part"), F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n"))
    same = F.col("part") == F.col("__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return kept.join(offsets, same).select(*by, "x", (F.col("place") + F.col("offset")).alias("rank"), "n")


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))


def shapiro_wilk(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., n, w, p) of groups of three values and more, by Royston's approximation; (1, 1) without spread."""
    n = F.col("n")
    score = lambda rows, i, out: with_normal_quantile(rows, (i - 0.375) / (n + 0.25), out)
    rows = score(ranked(values, column, by), F.col("rank"), "m")
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("x")))
    sums = rows.groupBy(*by, "n").agg(F.sum(F.col("m") * F.col("m")).alias("size"), F.sum(F.col("m") * F.col("x")).alias("mx"), F.var_pop("x").alias("variance"), at(1).alias("x1"), at(2).alias("x2"), at(n - 1).alias("y2"), at(n).alias("y1")).where(n >= 3)
    rows = score(score(sums, n, "m1"), n - 1, "m2").withColumn("u", 1 / F.sqrt(n)).withColumn("wide", F.col("y1") - F.col("x1")).withColumn("near", F.col("y2") - F.col("x2"))
    size, m1, m2, wide, near, last, second = (F.col(c) for c in ("size", "m1", "m2", "wide", "near", "last", "second"))
    rows = rows.withColumn("last", power_sum(ROYSTON_LAST, F.col("u")) + m1 / F.sqrt(size)).withColumn("second", power_sum(ROYSTON_SECOND, F.col("u")) + m2 / F.sqrt(size))
    few = F.sqrt((size - 2 * m1 * m1) / (1 - 2 * last * last))
    many = F.sqrt((size - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * last * last - 2 * second * second))
    product = F.when(n == 3, math.sqrt(0.5) * wide).when(n <= 5, last * wide + (F.col("mx") - m1 * wide) / few).otherwise(last * wide + second * near + (F.col("mx") - m1 * wide - m2 * near) / many)
    rows = rows.withColumn("product", product).withColumn("flat", wide < 1e-19)
    rows = rows.withColumn("w", F.when(F.col("flat"), 1.0).otherwise(F.least(F.lit(1.0), F.col("product") * F.col("product") / (F.col("variance") * n))))
    rows = rows.withColumn("y", F.log(F.greatest(1 - F.col("w"), F.lit(1e-300)))).withColumn("t", F.log(n.cast("double"))).withColumn("gamma", power_sum(ROYSTON_SMALL_GAMMA, n.cast("double")))
    w, y, t, gamma = (F.col(c) for c in ("w", "y", "t", "gamma"))
    small = (-F.log(gamma - y) - power_sum(ROYSTON_SMALL_MEAN, n.cast("double"))) / F.exp(power_sum(ROYSTON_SMALL_LOG_SD, n.cast("double")))
    large = (y - power_sum(ROYSTON_LARGE_MEAN, t)) / F.exp(power_sum(ROYSTON_LARGE_LOG_SD, t))
    three = F.greatest(F.lit(0.0), 6 / F.lit(math.pi) * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    z = F.when(n <= 11, F.when(y < gamma, small)).otherwise(large)
    p = F.when(F.col("flat"), 1.0).when(n == 3, three).when((n <= 11) & (y >= gamma), 1e-19).otherwise(upper_tail(F.col("z")))
    return rows.withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("p", p).select(*by, "n", "w", "p")
