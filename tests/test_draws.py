"""The registered queries draw as often as the operators do by default."""

from tessera.plans import catalog


def test_permutations_are_the_operators_own_number(spark):
    got = catalog.QUERIES["permutation_test"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(abs(r["p"] - (r["extreme"] + 1) / 50_001) < 1e-12 for r in got)
