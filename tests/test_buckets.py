import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import D
from ledgerflow.functions.timecols import parse_interval
from ledgerflow.operators.buckets import (bucket_aggregate, bucket_coverage, bucket_label,
                                          date_window, dense_grid_summary, fit_buckets)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_seven_day_single_bucket(tx):
    df = tx([(1, "2024-01-01", "A", 100), (1, "2024-01-07", "A", 150), (2, "2024-01-08", "B", 200)])
    spec = fit_buckets(df, "7D")
    assert spec.n_buckets == 1
    out = rows(bucket_aggregate(df, spec), "user_id", "k", "brand", "amount", "date")
    assert out == [(1, 1, "A", 250.0, D("2024-01-01")), (2, 1, "B", 200.0, D("2024-01-08"))]
    dense = dense_grid_summary(df, spec).first()
    assert (dense.n_cells, dense.n_nonempty, dense.n_empty) == (4, 2, 2)


def test_label_of_lowest_bucket(tx):
    df = tx([(1, "2024-01-01", "A", 1), (1, "2024-01-15", "A", 1)])
    spec = fit_buckets(df, "7D")
    lab = bucket_label(bucket_aggregate(df, spec), spec).orderBy("k").select("time_interval").collect()
    assert [r[0] for r in lab] == ["[2024-01-01 00:00:00, 2024-01-08 00:00:00]",
                                   "(2024-01-08 00:00:00, 2024-01-15 00:00:00]"]


def test_right_closed_edges_and_tail(tx):
    df = tx([(1, "2024-01-01", "A", 1), (1, "2024-01-08", "A", 2), (1, "2024-01-08 00:00:00.000001", "A", 4),
             (1, "2024-01-15", "A", 8), (1, "2024-01-16", "A", 16)])
    spec = fit_buckets(df, "7D")
    assert spec.n_buckets == 2
    out = rows(bucket_aggregate(df, spec), "k", "amount")
    assert out == [(1, 3.0), (2, 12.0)]  # the last row falls after the last edge
    cov = bucket_coverage(df, spec).first()
    assert (cov.n_rows, cov.n_binned, cov.n_dropped, cov.amount_binned) == (5, 4, 1, 15.0)
    kept = rows(bucket_aggregate(df, spec, keep_tail=True), "k", "amount")
    assert kept[-1] == (3, 16.0)


def test_weekly_anchor_on_sunday(tx):
    # 2024-01-01 is a Monday: the first edge is Sunday 2024-01-07 at 00:00
    df = tx([(1, "2024-01-01", "A", 1), (1, "2024-01-07", "A", 2), (1, "2024-01-10", "A", 4),
             (1, "2024-01-21", "A", 8)])
    spec = fit_buckets(df, "1W")
    assert spec.origin == D("2024-01-07") and spec.n_buckets == 2
    assert rows(bucket_aggregate(df, spec), "k", "amount") == [(1, 6.0), (2, 8.0)]


def test_null_rules(tx):
    df = tx([(1, "2024-01-01", "A", None), (1, "2024-01-02", "A", None), (None, "2024-01-03", "A", 5),
             (1, "2024-01-04", None, 5), (1, "2024-01-09", "A", 1)])
    spec = fit_buckets(df, "7D")
    assert rows(bucket_aggregate(df, spec), "user_id", "k", "brand", "amount") == [(1, 1, "A", 0.0)]


def test_short_span_has_no_bucket(tx):
    df = tx([(1, "2024-01-01", "A", 1), (1, "2024-01-03", "A", 1)])
    spec = fit_buckets(df, "7D")
    assert spec.n_buckets == 0 and bucket_aggregate(df, spec).count() == 0


def test_window_prefilter_is_exact(tx):
    import random
    rnd = random.Random(7)
    base = D("2024-01-01")
    data = [(rnd.randint(1, 5), base + dt.timedelta(hours=rnd.randint(0, 24 * 60)), rnd.choice("ABC"),
             rnd.randint(1, 100)) for _ in range(400)]
    df = tx(data)
    spec = fit_buckets(df, "5D")
    for s, e in [("2024-01-03", "2024-01-20 13:00"), ("2023-12-01", "2024-01-02"), ("2024-02-01", "2024-05-01")]:
        a = rows(bucket_aggregate(df, spec, window=(s, e)), "user_id", "k", "brand", "amount", "date")
        b = rows(date_window(bucket_aggregate(df, spec), s, e), "user_id", "k", "brand", "amount", "date")
        assert a == b


def test_amount_is_conserved(tx):
    df = tx([(u, D("2024-01-01") + dt.timedelta(days=d), b, 0.1 * (u + d)) for u in range(3)
             for d in range(21) for b in "AB"])
    spec = fit_buckets(df, "7D")
    cov = bucket_coverage(df, spec).first()
    total = bucket_aggregate(df, spec).agg(F.sum("amount")).first()[0]
    assert abs(total - cov.amount_binned) < 1e-9


def test_intervals():
    assert parse_interval("28D") == (28 * 86_400_000_000, False)
    assert parse_interval("1W") == (7 * 86_400_000_000, True)
    assert parse_interval("30min")[0] == 1_800_000_000
    with pytest.raises(ValueError):
        parse_interval("1M")


@pytest.mark.parametrize("interval", ["MS", "M", "2M", "QS", "Q", "Y", "YS", "W-MON", "2W-THU"])
def test_calendar_buckets_equal_pandas(spark, tx, interval):
    """Edges and buckets of unequal width against pandas' date ranges; dates on edges included."""
    import random
    import pandas as pd
    from ledgerflow.operators.buckets import bucket_label, bucketize
    rng = random.Random(interval)
    days = [D("2021-01-31 06:00")] + [D("2021-02-01") + dt.timedelta(hours=rng.randrange(24 * 1200)) for _ in range(300)]
    name = {"M": "ME", "2M": "2ME", "Q": "QE", "Y": "YE"}.get(interval, interval)
    edges = list(pd.date_range(min(days), max(days), freq=name))
    days += [e.to_pydatetime() for e in edges]
    df = tx([(i, d, "A", 1) for i, d in enumerate(days)])
    spec = fit_buckets(df, interval)
    assert list(spec.edges) == edges
    got = {r.user_id: r.k for r in bucketize(df, spec).collect()}
    at = pd.cut(pd.Series(days), edges, labels=False, include_lowest=True)
    assert got == {i: int(k) + 1 for i, k in enumerate(at) if k == k}
    assert all(spec.index_of(days[i]) == k for i, k in got.items())
    label = bucket_label(spark.range(1, 2).withColumnRenamed("id", "k"), spec).first()["time_interval"]
    assert label.startswith(f"[{edges[0]:%Y-%m-%d}") and f", {edges[1]:%Y-%m-%d}" in label


def test_calendar_windows(tx):
    """A window's rows are found by its buckets; a range without two edges has none."""
    df = tx([(1, "2024-01-01", "A", 1), (1, "2024-02-01", "A", 2), (1, "2024-02-02", "A", 4), (1, "2024-03-01", "B", 8), (1, "2024-05-20", "B", 16)])
    spec = fit_buckets(df, "MS")
    assert spec.n_buckets == 4 and spec.advance(D("2024-01-31")) == D("2024-02-29")
    got = sorted(tuple(r) for r in bucket_aggregate(df, spec, window=(D("2024-02-02"), D("2024-03-01"))).collect())
    assert got == [(1, 2, "A", 4.0, D("2024-02-02"))]
    assert bucket_aggregate(df, fit_buckets(tx([(1, "2024-01-05", "A", 1), (1, "2024-01-20", "A", 1)]), "MS")).count() == 0
