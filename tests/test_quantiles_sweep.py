import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.scaling import piecewise_linear
from ledgerflow.operators.quantiles import exact_quantiles, quantile_bin_edges
from ledgerflow.operators.sweep import Param, flatten_space, trial_table


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    xs = [float(rnd.randint(0, 500)) for _ in range(5000)] + [7.0] * 3000  # a heavy duplicate
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    qs = [i / 10 for i in range(11)]
    assert exact_quantiles(df, "x", qs) == pytest.approx(list(np.quantile(np.array(xs), qs)), abs=1e-9)


def test_bin_edges_and_ple(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    edges = quantile_bin_edges(df, "x", n_bins=5)
    assert edges == pytest.approx([0, 2, 4, 6, 8, 10])
    vals = spark.createDataFrame([(-1.0,), (3.0,), (11.0,)], "x double")
    got = [r.e for r in vals.select(piecewise_linear(F.col("x"), F.array(*[F.lit(e) for e in edges])).alias("e")).collect()]
    assert got[0] == pytest.approx([-0.5, 0, 0, 0, 0])
    assert got[1] == pytest.approx([1, 0.5, 0, 0, 0])
    assert got[2] == pytest.approx([1, 1, 1, 1, 1.5])


def test_few_values_give_two_bins(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "x double")
    assert quantile_bin_edges(df, "x", n_bins=48) == pytest.approx([1.0, 3.0, 5.0])


def test_param_validation():
    with pytest.raises(ValueError):
        Param("a", "int", min=1)
    with pytest.raises(ValueError):
        Param("a", "categorical")
    with pytest.raises(ValueError):
        Param("a", "normal", 0, 1)
    names = [p.name for p in flatten_space({"data": {"top_n": {"type": "int", "min": 1, "max": 3}}})]
    assert names == ["data.top_n"]


def test_trial_table_deterministic_and_in_range(spark):
    space = {"a": {"type": "int", "min": 2, "max": 4}, "b": {"type": "loguniform", "min": 1e-4, "max": 1e-1},
             "c": {"type": "categorical", "options": ["x", "y"]}, "d": {"type": "float", "min": 0, "max": 1}}
    t1 = trial_table(spark, space, 200, 7).collect()
    t2 = trial_table(spark, space, 200, 7).collect()
    assert t1 == t2
    assert {r.a for r in t1} == {2, 3, 4} and {r.c for r in t1} == {"x", "y"}
    assert all(1e-4 <= r.b <= 1e-1 and 0 <= r.d < 1 for r in t1)


def test_global_row_number_distributed_equals_window(spark):
    from pyspark.sql import Window
    from ledgerflow.operators import ranking
    rnd = random.Random(8)
    rows = [(i, rnd.randint(0, 50), rnd.choice("abcdef")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, c long, s string")
    order = [F.col("c").desc(), F.col("s"), F.col("id")]
    ref = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).collect()}
    old = ranking.ROWS_PER_RANGE
    ranking.ROWS_PER_RANGE = 100  # force ~30 ranges
    try:
        got = {r.id: r.rn for r in ranking.global_row_number(df, order, "rn", single_max=0).collect()}
    finally:
        ranking.ROWS_PER_RANGE = old
    assert got == ref


def test_piecewise_linear_without_a_bin(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1.0, [2.0]), (1.0, []), (1.0, [0.0, 2.0])], "x double, e array<double>")
    assert [r.p for r in df.select(piecewise_linear(F.col("x"), F.col("e")).alias("p")).collect()] == [[], [], [0.5]]


def test_row_numbers_of_tied_and_wide_keys(spark, monkeypatch):
    """Half of the rows tie on the leading column, and first-seen keys lie closer than a double
    can tell: no range may take them all."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from ledgerflow.operators import ranking
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 200)
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("c"),
                                  (F.lit(2).cast("decimal(38,0)") * F.lit(1 << 62) * F.lit(1 << 40) + F.col("id")).cast("decimal(38,0)").alias("first"))
    order = [F.col("c").desc(), F.col("first"), F.col("id")]
    got = ranking.global_row_number(df, order, single_max=0)
    want = df.withColumn("want", F.row_number().over(Window.orderBy(*order)))
    assert got.join(want, "id").where("rn != want").count() == 0 and got.count() == 4000
    cut = df.repartitionByRange(20, *order).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in cut) < 600
