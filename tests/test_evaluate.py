import math

import pytest

from ledgerflow.functions.scaling import time_features
from ledgerflow.operators.evaluate import cell_losses, cell_metrics


def aligned(spark, pairs):
    return spark.createDataFrame([("test", 1, i, float(p), float(t)) for i, (p, t) in enumerate(pairs)],
                                 "split string, user_id long, brand_id int, p double, t double")


def one_user(spark):
    return spark.createDataFrame([("test", 1)], "split string, n_users long")


def test_losses(spark):
    a = aligned(spark, [(.5, .5), (.7, .6), (.2, .1), (-1.4, -12.0)])
    r = cell_losses(a, one_user(spark), 4).first()
    assert r.l1 == pytest.approx(2.7) and r.l2 == pytest.approx(28.095) and r.no_op == 0.0


def test_metrics(spark):
    a = aligned(spark, [(0, 0), (5, 0), (0, 4), (6, 8)])
    r = cell_metrics(a, one_user(spark), 4).first()
    assert r.false_positive_rate == 0.5 and r.false_negative_rate == 0.5
    assert r.positive_mae == 3.0 and r.percentage_error == 25.0


def test_implicit_zero_cells_count(spark):
    # only 2 explicit cells, 10 vocabulary slots: 8 implicit (0, 0) cells
    a = aligned(spark, [(5, 0), (0, 4)])
    r = cell_metrics(a, one_user(spark), 10).first()
    assert r.false_positive_rate == pytest.approx(1 / 9) and r.percentage_error is None


def test_time_features(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(float(t),) for t in range(1, 6)], "tau double")
    out = df.select("tau", time_features(F.col("tau"), [.5, .5], [.2, .2], .5, .1).alias("f")).collect()
    for r in out:
        assert r.f == pytest.approx([math.sin(.5 * r.tau + .2)] * 2 + [.5 * r.tau + .1], abs=1e-6)


def test_baseline_denominators(spark):
    from pyspark.sql import functions as F
    from ledgerflow.operators.encoders import BrandVocab
    from ledgerflow.operators.predict import average_spend
    rows = spark.createDataFrame(
        [("test", 1, 1, "A", 10.0), ("test", 1, 3, "A", 30.0), ("test", 1, 3, "B", 5.0), ("test", 2, 2, "B", 7.0)],
        "split string, user_id long, k long, brand string, amount double")
    vocab = BrandVocab().fit(rows.withColumnRenamed("split", "s"), "brand")
    got_all = {(r.user_id, r.brand_id): r.predicted
               for r in average_spend(rows, vocab, F.lit(4), "all").collect()}
    got_active = {(r.user_id, r.brand_id): r.predicted
                  for r in average_spend(rows, vocab, F.lit(4), "active").collect()}
    assert got_all == {(1, 3): 10.0, (1, 4): 1.25, (2, 4): 1.75}
    assert got_active == {(1, 3): 20.0, (1, 4): 5.0, (2, 4): 7.0}


def test_threshold_positive_cells(spark):
    a = aligned(spark, [(0.004, 0), (5, 0.001), (6, 8)])
    exact = cell_metrics(a, one_user(spark), 3).first()
    loose = cell_metrics(a, one_user(spark), 3, threshold=0.01).first()
    assert exact.n_positive == 2 and loose.n_positive == 1
    assert loose.false_positive_rate == 0.5  # (5, 0.001) counts as a false positive now


def test_small_amounts_stay(spark):
    """No quantum: a spend of 0.00004 sums to itself, 0.01 over 500 intervals predicts a positive."""
    from pyspark.sql import functions as F
    from ledgerflow.functions.fixedpoint import exact_sums
    from ledgerflow.operators.encoders import BrandVocab
    from ledgerflow.operators.predict import average_spend
    rows = spark.createDataFrame([("test", 1, 1, "A", 0.00004), ("test", 2, 1, "B", 0.01)],
                                 "split string, user_id long, k long, brand string, amount double")
    assert [r.s for r in exact_sums(rows.groupBy("user_id"), {"s": F.col("amount")}).orderBy("user_id").collect()] == [0.00004, 0.01]
    vocab = BrandVocab().fit(rows.withColumnRenamed("split", "s"), "brand")
    got = {r.user_id: r.predicted for r in average_spend(rows, vocab, F.lit(500), "all").collect()}
    assert got[2] == 0.01 / 500 and got[1] > 0
    a = aligned(spark, [(got[2], 1.0)])
    assert cell_metrics(a, one_user(spark), 1).first().false_negative_rate == 0.0


def test_settled_sums(spark):
    from pyspark.sql import functions as F
    from ledgerflow.functions.fixedpoint import settled
    values = [0.0, -0.3, 0.1 + 0.2, 1e-13, 123456789.1234, -1e15, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.s for r in df.select("i", settled(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got[:2] == [0.0, -0.3] and got[2] == 0.3 and got[4] == 123456789.1234 and got[5] == -1e15 and got[6] is None
    assert abs(got[3] / 1e-13 - 1) < 1e-12


@pytest.mark.parametrize("denominator", ["all", "active"])
def test_one_aggregate_equals_the_join(spark, denominator):
    from pyspark.sql import functions as F
    from ledgerflow.operators.encoders import BrandVocab
    from ledgerflow.operators.evaluate import align
    from ledgerflow.operators.predict import average_and_actual, average_spend
    kind = "split string, user_id long, k long, brand string, amount double"
    inp = spark.createDataFrame([("test", 1, 1, "A", 10.0), ("test", 1, 3, "A", 30.0), ("val", 1, 3, "B", 5.0), ("test", 2, 2, "Z", 7.0)], kind)
    tgt = spark.createDataFrame([("test", 1, 4, "A", 3.0), ("val", 3, 4, "C", 2.5)], kind)
    vocab = BrandVocab(top_n=2).fit(inp.drop("split"), "brand")
    t = vocab.transform(tgt, "brand", "brand_id").groupBy("split", "user_id", "brand_id").agg(F.sum("amount").alias("amount_raw"))
    want = align(average_spend(inp, vocab, F.lit(4), denominator), t)
    got = average_and_actual(inp, tgt, vocab, F.lit(4), denominator)
    cols = ["split", "user_id", "brand_id", "p", "t"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_unknown_names(tx):
    from dataclasses import replace
    from ledgerflow.config import Cutoffs, DataConfig
    from ledgerflow.plans.prepare import prepare
    df = tx([(u, f"2024-01-{1 + u % 28:02d}", "AB"[u % 2], 1.0) for u in range(60)])
    cfg = DataConfig("7D", Cutoffs("2024-01-01", "2024-01-10", "2024-01-15", "2024-01-20"))
    with pytest.raises(KeyError, match="min_max_scaler"):
        prepare(df, replace(cfg, amount_encoder="nothing"))
    for field, known in (("predictor", "baseline.avg"), ("loss", "l1"), ("output_type", "multi_hot_separate")):
        with pytest.raises(KeyError, match=known):
            prepare(df, replace(cfg, **{field: "nothing"})).configured_loss()


def test_registered_pandas_predictor(spark, tx):
    from dataclasses import replace
    from ledgerflow.config import Cutoffs, DataConfig
    from ledgerflow.operators.predict import PREDICTORS, pandas_predictor
    from ledgerflow.plans.prepare import prepare
    PREDICTORS.register("test.sum")(pandas_predictor(
        lambda pdf: pdf.groupby(["split", "user_id", "brand_id"], as_index=False).amount.sum().rename(columns={"amount": "predicted"})))
    df = tx([(u, f"2024-01-{1 + (u * 7) % 28:02d}", "AB"[u % 2], 1.0) for u in range(60)])
    cfg = DataConfig("7D", Cutoffs("2024-01-01", "2024-01-10", "2024-01-15", "2024-01-20"), predictor="test.sum")
    rows = prepare(df, cfg).configured_loss().collect()
    assert {r.split for r in rows} == {"train", "val", "test"} and all(r.loss > 0 for r in rows)


def test_batched_scorer_equals_baseline(spark):
    """Users that straddle Arrow batches and calls are scored whole, for both denominators."""
    from pyspark.sql import functions as F
    from ledgerflow.operators.encoders import BrandVocab
    from ledgerflow.operators.predict import _average_of, arrow_predictor, average_spend
    rows = (spark.range(6000).selectExpr("if(id % 5 = 0, 'val', 'train') AS split", "id % 37 AS user_id", "id % 11 AS k", "cast(id % 7 AS string) AS brand",
                                         "if(id % 13 = 0, NULL, (id % 101) / 10D) AS amount"))
    vocab = BrandVocab().fit(rows.drop("split"), "brand")
    calls = spark.sparkContext.accumulator(0)

    def fn(table, denominator):
        calls.add(1)
        return _average_of(table, denominator)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for how in ("all", "active"):
            want = sorted(map(tuple, average_spend(rows, vocab, F.lit(11), how).na.fill(0.0).collect()))
            got = sorted(map(tuple, arrow_predictor(fn, 500)(rows, vocab, F.lit(11), how).collect()))
            assert got == want and len(got) > 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 8 < calls.value < 60  # many users a call, more than one call
