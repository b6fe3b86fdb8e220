import pytest

from glimmerframe.operators import network


def test_closeness_of_a_long_path_counts_every_pair(spark):
    n = 67  # the ends are 66 hops apart
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "src long, dst long, w double")
    got = {r.node: r.closeness for r in network.closeness(edges, spark.createDataFrame([(i,) for i in range(n)], "node long")).collect()}
    assert got == {i: pytest.approx(n / sum(abs(i - j) for j in range(n))) for i in range(n)}


def test_label_propagation_of_a_long_path_ends(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)] + [(1000, 1001, 2.0), (1001, 1002, 2.0), (1000, 1002, 2.0)], "src long, dst long, w double")
    got = {r.node: r.community for r in network.label_propagation(edges, spark.createDataFrame([(i,) for i in [*range(n), 1000, 1001, 1002, 5000]], "node long")).collect()}
    assert {got[k] for k in (1000, 1001, 1002)} == {1000} and got[5000] == 5000 and all(got[i] <= i for i in range(n))
