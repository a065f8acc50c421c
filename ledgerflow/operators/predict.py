"""Predictors of next-interval spend per (user, brand id).

``baseline.avg``: for each user and brand the input-window spend divided by
the number of intervals -- all intervals in the window (``'all'``, empty ones
count as zero) or only those where the user bought the brand
(``'active'``). 
User code can register its own predictor (e.g. a pandas scorer).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixedpoint import DIGITS, LEAST_SETTLED, exact_sums
from ..registry import Registry

PREDICTORS = Registry("predictor")


@PREDICTORS.register("baseline.avg")
def average_spend(rows: DataFrame, brand_enc, n_intervals, denominator: str = "all") -> DataFrame:
    """``rows``: ``(split, user_id, k, brand, amount)`` in each input window.
    ``n_intervals``: Column (per split) with the number of intervals in the
    window.  Returns ``(split, user_id, brand_id, predicted)``."""
    if denominator not in ("all", "active"):
        raise ValueError("denominator must be 'all' or 'active'")
    enc = brand_enc.transform(rows, "brand", "brand_id")
    g = exact_sums(enc.groupBy("split", "user_id", "brand_id"), {"_s": F.col("amount")},
                   F.countDistinct("k").alias("_active"))
    denom = n_intervals if denominator == "all" else F.col("_active")
    return g.select("split", "user_id", F.col("brand_id").cast("int").alias("brand_id"),
                    (F.col("_s") / denom.cast("double")).alias("predicted"))


def average_and_actual(inputs: DataFrame, targets: DataFrame, brand_enc, n_intervals,
                       denominator: str = "all") -> DataFrame:
    """``(split, user_id, brand_id, p, t)``: the average-spend prediction beside
    the actual spend of every cell that has either, by one vocabulary lookup
    and one aggregate over both windows' rows -- no join of the two."""
    cols = ["split", "user_id", "k", "brand", "amount"]
    rows = inputs.select(*cols, F.lit(True).alias("_in")).unionByName(targets.select(*cols, F.lit(False).alias("_in")))
    enc = brand_enc.transform(rows, "brand", "brand_id")
    enc = enc.withColumns({"_i": F.when(F.col("_in"), F.col("amount")), "_o": F.when(~F.col("_in"), F.col("amount"))})
    others = []
    if denominator == "active":
        others.append(F.countDistinct(F.when(F.col("_in"), F.col("k"))).alias("_active"))
    elif denominator != "all":
        raise ValueError("denominator must be 'all' or 'active'")
    g = exact_sums(enc.groupBy("split", "user_id", "brand_id"), {"_s": F.col("_i"), "_t": F.col("_o")}, *others)
    denom = n_intervals if denominator == "all" else F.col("_active")
    return g.select("split", "user_id", F.col("brand_id").cast("int").alias("brand_id"),
                    F.coalesce(F.col("_s") / denom.cast("double"), F.lit(0.0)).alias("p"),
                    F.coalesce(F.col("_t"), F.lit(0.0)).alias("t"))


# Rows that a batched scorer is given at once, at least; a user is never divided.
SCORER_ROWS = 50_000


def arrow_predictor(fn, rows_per_call: int = SCORER_ROWS):
    """Wrap a scorer of many users as a predictor with the common signature, to be registered by name.

    ``fn(table)`` receives a ``pyarrow.Table`` of whole users' input rows -- ``split, user_id,
    brand_id, k, amount, n_intervals``, sorted by all but the last two -- and returns a table with
    ``split, user_id, brand_id, predicted``.  Rows are sorted inside partitions by (split, user), so
    users arrive one after the other; the last user of a batch waits for the next batch, and ``fn``
    is called once for about ``rows_per_call`` rows.  A user has at most buckets x brands rows."""
    def predictor(rows: DataFrame, brand_enc, n_intervals, denominator: str = "all") -> DataFrame:
        import pyarrow as pa
        enc = brand_enc.transform(rows, "brand", "brand_id").select(
            "split", "user_id", F.col("brand_id").cast("int").alias("brand_id"), "k", "amount",
            n_intervals.cast("bigint").alias("n_intervals"))
        out = pa.schema([("split", pa.string()), ("user_id", pa.int64()), ("brand_id", pa.int32()), ("predicted", pa.float64())])

        def whole_users(batches):
            held, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                n += batch.num_rows
                if n < rows_per_call:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                split, user = (table.column(c).combine_chunks() for c in ("split", "user_id"))
                cut = table.num_rows - 1  # where the last user begins
                while cut > 0 and split[cut - 1] == split[-1] and user[cut - 1] == user[-1]:
                    cut -= 1
                if cut:
                    yield table.slice(0, cut)
                    table = table.slice(cut)
                held, n = table.to_batches(), table.num_rows
            if held:
                yield pa.Table.from_batches(held)

        def run(batches):
            for table in whole_users(batches):
                yield from fn(table, denominator).select(out.names).cast(out).to_batches()

        keys = ["split", "user_id"]
        return (enc.repartition(*keys).sortWithinPartitions(*keys, "brand_id", "k")
                .mapInArrow(run, "split string, user_id long, brand_id int, predicted double"))
    return predictor


def _average_of(table, denominator: str):
    """The average-spend baseline over many users: runs of equal (split, user, brand) are divided into
    groups at once; a group's amounts are added exactly (fsum)."""
    import math

    import numpy as np
    import pyarrow as pa
    table = table.combine_chunks()
    n = table.num_rows
    keys = [table.column(c).combine_chunks() for c in ("split", "user_id", "brand_id")]
    codes = [np.asarray(k.dictionary_encode().indices if pa.types.is_string(k.type) else k) for k in keys]
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    at = np.flatnonzero(new)
    k = np.asarray(table.column("k"))
    other_k = new.copy()
    other_k[1:] |= k[1:] != k[:-1]
    active = np.add.reduceat(other_k.astype(np.int64), at)
    amount = table.column("amount").to_pylist()
    ends = [*at[1:].tolist(), n]
    total = np.array([math.fsum(x for x in amount[a:b] if x is not None) for a, b in zip(at.tolist(), ends)])
    digits = np.where(np.abs(total) < LEAST_SETTLED, 1.0, np.abs(total))
    unit = np.power(10.0, float(DIGITS - 1) - np.floor(np.log10(digits)))
    total = np.where(np.abs(total) < LEAST_SETTLED, total, np.rint(total * unit) / unit)
    intervals = np.asarray(table.column("n_intervals"))[at] if denominator == "all" else active
    picked = [x.take(pa.array(at)) for x in keys]
    return pa.table([*picked, pa.array(total / intervals)], names=["split", "user_id", "brand_id", "predicted"])


PREDICTORS.register("baseline.avg.batched")(arrow_predictor(_average_of))


def pandas_predictor(fn, schema: str = "split string, user_id long, brand_id int, predicted double"):
    """Wrap a user scorer written in pandas as a predictor with the common
    signature, to be registered by name.

    ``fn(pdf)`` receives one user's encoded input rows (one split) and
    returns that user's predictions.  It runs through ``applyInPandas``
    grouped by (split, user): Arrow batches, one user per call.  A user's
    rows are bounded by buckets x brands after aggregation; scorers needing
    more context should stay in DataFrame expressions."""
    def predictor(rows: DataFrame, brand_enc, n_intervals=None, denominator: str = "all") -> DataFrame:
        enc = brand_enc.transform(rows, "brand", "brand_id")
        return enc.groupBy("split", "user_id").applyInPandas(fn, schema)
    return predictor
