"""Bucketing agrees with pandas' date_range + cut(include_lowest=True) +
groupby(sum, first) -- the semantics the reference relies on -- on random
inputs, including week-anchored intervals and sub-second timestamps."""
import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerflow.operators.buckets import bucket_aggregate, fit_buckets

BASE = dt.datetime(2024, 1, 1, 5, 30)


def pandas_buckets(rows, interval):
    df = pd.DataFrame(rows, columns=["user_id", "date", "brand", "amount"]).sort_values(["user_id", "date"])
    bins = pd.date_range(df["date"].min(), df["date"].max(), freq=interval)
    if len(bins) < 2:
        return []
    df["iv"] = pd.cut(df["date"], bins=bins, include_lowest=True)
    g = df.groupby(["user_id", "iv", "brand"], observed=True).agg(amount=("amount", "sum"), date=("date", "first"))
    g = g.reset_index()
    g["k"] = g["iv"].cat.codes.astype(int) + 1
    return sorted((int(r.user_id), int(r.k), r.brand, round(float(r.amount), 6), r.date.to_pydatetime())
                  for r in g.itertuples())


rows_strategy = st.lists(
    st.tuples(st.integers(1, 4),
              st.integers(0, 40 * 24 * 3600 * 1000).map(lambda ms: BASE + dt.timedelta(milliseconds=ms)),
              st.sampled_from("ABC"),
              st.integers(1, 10_000).map(lambda c: c / 100)),
    min_size=2, max_size=60)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, interval=st.sampled_from(["1D", "3D", "7D", "1W", "12h"]))
def test_matches_pandas(tx, rows, interval):
    expected = pandas_buckets(rows, interval)
    df = tx(rows)
    got = sorted((r.user_id, r.k, r.brand, round(r.amount, 6), r.date)
                 for r in bucket_aggregate(df, fit_buckets(df, interval)).collect())
    assert got == expected
