"""Shapiro-Wilk over partitions against the test of one group."""

import statistics as reference

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import normality, statistics


def test_normal_quantiles(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.07, 0.075, 0.2, 0.5, 0.77, 0.925, 0.93, 0.9999, 1 - 1e-12]
    rows = normality.with_normal_quantile(spark.createDataFrame([(x,) for x in p], "p double"), F.col("p"), "q").collect()
    for r in rows:
        want = reference.NormalDist().inv_cdf(r["p"])
        assert abs(r["q"] - want) <= 1e-12 * max(1.0, abs(want))


@pytest.mark.parametrize("parts", [1, 7])
def test_groups_of_all_sizes(spark, parts, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(2)
        groups = {f"n{n}": rng.normal(size=n).round(3) for n in (3, 4, 5, 6, 11, 12, 40, 700)}
        groups |= {"skew": np.exp(rng.normal(size=200)), "ties": rng.integers(0, 3, 300).astype(float), "flat": np.ones(9), "hot": np.concatenate([np.zeros(500), rng.normal(size=100)]), None: rng.normal(size=25)}
        rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("two", 1.0), ("two", 2.0), ("flat", None), ("n3", float("nan"))]
        table = spark.createDataFrame(rows, "g string, v double").repartition(3)
        got = {r["g"]: (r["n"], r["w"], r["p"]) for r in normality.shapiro_wilk(table, "v", ["g"]).collect()}
        assert got.keys() == groups.keys()
        for g, xs in groups.items():
            w, p = statistics.shapiro_wilk(xs)
            assert got[g][0] == len(xs) and abs(got[g][1] - w) < 1e-9 and abs(got[g][2] - p) < 1e-7
        ranks = normality.ranked(table.where("g = 'ties'"), "v", ["g"]).orderBy("rank").collect()
        assert [r["rank"] for r in ranks] == list(range(1, 301)) and [r["x"] for r in ranks] == sorted(groups["ties"].tolist())
        whole = normality.shapiro_wilk(table.where("g = 'n40'"), "v", []).first()
        assert abs(whole["w"] - statistics.shapiro_wilk(groups["n40"])[0]) < 1e-9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
