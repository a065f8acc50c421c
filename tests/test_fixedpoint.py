"""Exact sums: one result however the rows are dealt out."""
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.fixedpoint import exact_sum, exact_sums
from ledgerflow.operators.buckets import bucket_aggregate, fit_buckets
from ledgerflow.operators.evaluate import cell_metrics


def total(spark, values, parts=1):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return df.agg(exact_sum(F.col("x")).alias("s")).first()["s"]


def test_refund_cancels_in_every_order(spark):
    for order in itertools.permutations([0.1, 0.2, -0.3]):
        assert total(spark, order) == 0.0


@pytest.mark.parametrize("values", [
    [1e-11, 2.5e-9, 0.0099999999999, -0.00123456789012345, 0.00123456789012345],
    [1e12, 123456789012345.5, -1e14, 0.1, 1e14],
    [0.0, -0.0], [999999999999.9, -999999999999.8], [5e-324, 1e300], [0.30000000000000004, -0.3],
])
def test_sum_of_decimals(spark, values):
    want = float(sum(Decimal(repr(v)) for v in values))
    # beyond 9e9 a DOUBLE counts as its binary value, to the millionth; below it to the difference from its millionths
    near = 1e-4 * len(values) if max(values) > 9e9 else 2e-17 * len(values) if max(values) > 0.01 else 0
    assert total(spark, values) == pytest.approx(want, rel=1e-13, abs=near)


def test_no_value_and_special_values(spark):
    assert total(spark, [None, None]) is None
    assert total(spark, [None, 2.0]) == 2.0
    assert str(total(spark, [float("nan"), 1.0])) == "nan"
    assert total(spark, [float("inf"), 1.0]) == float("inf")
    empty = spark.createDataFrame([], "x double")
    assert exact_sums(empty, {"s": F.col("x")}, zero=True).first() == (0.0,)
    assert exact_sums(empty, {"s": F.col("x")}).first() == (None,)


def test_tiny_sums_stay(spark):
    df = spark.createDataFrame([(1e-300,), (2e-300,)], "x double")
    assert exact_sums(df, {"s": F.col("x")}).first()["s"] == pytest.approx(3e-300)


def refunds():
    """Purchases and refunds that cancel within cells, in shuffled order."""
    rows = []
    for user in range(60):
        for brand in "ABC":
            rows += [(user, "2024-01-02", brand, a) for a in (0.1, 0.2, -0.3, 19.99, 5.01, -25.0)]
        rows.append((user, "2024-01-03", "D", 0.7))
    rows.append((0, "2024-01-01", "Z", 1.0))
    rows.append((0, "2024-01-29", "Z", 1.0))
    random.Random(5).shuffle(rows)
    return rows


def test_refund_fixture_over_any_partitions(spark, tx):
    base = tx(refunds())
    spec = fit_buckets(base, "7D")
    seen = []
    for parts in (1, 7, 200):
        cells = bucket_aggregate(base.repartition(parts, F.rand(parts)), spec).where("brand != 'Z'")
        aligned = cells.select(F.lit("test").alias("split"), "user_id", "brand", F.col("amount").alias("t"),
                               F.when(F.col("brand") == "A", 1.0).otherwise(0.0).alias("p"))
        users = spark.createDataFrame([("test", 60)], "split string, n_users long")
        got = cell_metrics(aligned, users, 4).first()
        seen.append((sorted(map(tuple, cells.select("user_id", "brand", "amount").collect())), tuple(got)))
    assert seen[0] == seen[1] == seen[2]
    cells, metrics = seen[0]
    assert {a for _, b, a in cells if b != "D"} == {0.0} and {a for _, b, a in cells if b == "D"} == {0.7}
    # 60 positive cells (D), all missed; of 180 others the 60 of A were predicted
    assert metrics[3] == 60 and metrics[4] == pytest.approx(60 / 180) and metrics[5] == 1.0
