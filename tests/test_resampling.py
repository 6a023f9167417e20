"""Resamples by hash: their distribution, against NumPy's, and that neither order nor place of rows matters."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import resampling, statistics


def scores(spark, n=400):
    rng = random.Random(5)
    rows = [(f"q{i}", "ab"[i % 2], rng.random(), rng.random() * 0.9, i % 7) for i in range(n)]
    return spark.createDataFrame([(*r[:4], None if r[4] == 0 else r[2] - r[3]) for r in rows], "question_id string, role string, x double, y double, d double")


def test_draws_are_poisson_and_signs_even(spark):
    rows = scores(spark).select("question_id", F.lit(1.0).alias("one"))
    sums = resampling.resampled(rows, "question_id", ["one"], [], 500, [1, 2]).toPandas()
    assert len(sums) == 1000 and (sums["n"] * resampling.UNIT == sums["one"]).all()
    assert abs(sums["n"].mean() - 400) < 3 and abs(sums["n"].std() - 20) < 2
    assert abs(np.corrcoef(sums[sums.seed == 1].sort_values("resample")["n"], sums[sums.seed == 2].sort_values("resample")["n"])[0, 1]) < 0.2
    flips = resampling.resampled(rows, "question_id", ["one"], [], 2000, [1], signs=True).toPandas()
    assert (flips["n"] == 400).all() and abs(flips["one"].mean() / resampling.UNIT) < 2 and abs(flips["one"].std() / resampling.UNIT - 20) < 2


def test_intervals_agree_with_numpy(spark):
    table = scores(spark)
    got = {r["strategy"]: r for r in resampling.intervals(table, ["x", "y"], resamples=4000).collect()}
    frame = table.toPandas()
    means = statistics.joint_bootstrap(frame[["x", "y"]].to_numpy().T, 4000, 1)
    for i, s in enumerate("xy"):
        low, high = np.quantile(means[:, i], [0.025, 0.975])
        assert abs(got[s]["low"] - low) < 0.004 and abs(got[s]["high"] - high) < 0.004 and abs(got[s]["mean"] - frame[s].mean()) < 1e-12 and got[s]["questions"] == 400
    assert abs(got["x"]["sole_wins"] - (means[:, 0] > means[:, 1]).mean()) < 0.02
    assert got["x"]["sole_wins"] + got["y"]["sole_wins"] <= 1


def test_flips_agree_with_numpy(spark):
    table = scores(spark).withColumn("d", F.col("d") / 4 + F.when(F.col("role") == "a", 0.02).otherwise(0.0))
    for r in resampling.sign_flips(table, "d", ["role"], 4000).collect():
        own = table.where(F.col("role") == r["role"]).dropna().toPandas()["d"].to_numpy()
        p, _ = statistics.permutation_p(own, 4000, 3)
        assert abs(r["p"] - p) < 0.03 and r["questions"] == len(own)
    none = resampling.sign_flips(table.withColumn("d", F.lit(0.0)), "d", [], 50).first()
    assert none["p"] == 1.0


def test_place_and_order_change_nothing(spark):
    table = scores(spark)
    one = resampling.difference_intervals(table.coalesce(1).orderBy("d"), "d", ["role"], [100, 300], [1, 2]).collect()
    many = resampling.difference_intervals(table.repartition(5), "d", ["role"], [100, 300], [1, 2]).collect()
    assert sorted((r["role"], r["seed"], r["resamples"], r["low"], r["high"], r["p_positive"]) for r in one) == sorted((r["role"], r["seed"], r["resamples"], r["low"], r["high"], r["p_positive"]) for r in many)
    assert len(one) == 8
    # the first 100 resamples of 300 are those of 100
    first = {(r["role"], r["low"]) for r in resampling.difference_intervals(table, "d", ["role"], [100], [1]).collect()}
    assert first == {(r["role"], r["low"]) for r in one if r["resamples"] == 100 and r["seed"] == 1}


def test_awkward_strata(spark):
    rows = spark.createDataFrame([("a", None, 1.0), ("b", None, 3.0), ("c", "s", 2.0), (None, "s", 2.0), ("d", "t", None)], "question_id string, role string, d double")
    got = {r["role"]: r for r in resampling.difference_intervals(rows, "d", ["role"], [200]).collect()}
    assert got[None]["questions"] == 2 and got[None]["low"] == 1.0 and got[None]["high"] == 3.0 and got["s"]["low"] == got["s"]["high"] == 2.0 and "t" not in got
    assert resampling.difference_intervals(rows.limit(0), "d", ["role"], [10]).count() == 0
    assert {(r["strategy"], r["rank"]) for r in resampling.winners(rows.withColumn("e", F.col("d") + 1), ["d", "e"], ["role"], 50).collect()} == {("e", 1), ("d", 2)}


def test_draws_over_arrays_are_those_of_the_columns(spark):
    """Many strata, negative and large values, more resamples than a block; and no task works on all rows."""
    rows = spark.createDataFrame([(f"q{i}", f"s{i % 40}" if i % 41 else None, (-1) ** i * (i / 7 + (5e6 if i == 3 else 0))) for i in range(200)], "question_id string, stratum string, v double")
    for signs in (False, True):
        got = resampling.resampled(rows.coalesce(1), "question_id", ["v"], ["stratum"], 5000, [7], signs)
        a, b, c = resampling.coefficients(F.col("question_id"), F.lit(7))
        each = rows.select("stratum", F.round(F.col("v") * resampling.UNIT).cast("long").alias("v"), a.alias("a"), b.alias("b"), c.alias("c")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4999).cast("long"))).alias("resample"))
        x = resampling.drawn(F.col("resample"), F.col("a"), F.col("b"), F.col("c"))
        n = (x % 2 * 2 - 1) if signs else resampling.count_of(x)
        want = each.select("stratum", "resample", n.cast("long").alias("n"), "v").groupBy("stratum", "resample").agg((F.count("*") if signs else F.sum("n")).alias("n"), F.sum(F.col("n") * F.col("v")).alias("v")).where("n > 0").withColumn("seed", F.lit(7)).select("stratum", "seed", "resample", "n", "v")
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert "RoundRobinPartitioning" in got._jdf.queryExecution().executedPlan().toString()
