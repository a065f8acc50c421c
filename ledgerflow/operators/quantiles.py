"""Exact quantiles without gathering a column into one task, and the
quantile bin edges of the piecewise-linear number encoding.

Selection works in three distributed passes:

1. count the values and sketch ``G`` approximate split points
   (``percentile_approx``, bounded memory);
2. count the distinct values falling between consecutive split points
   (``Bucketizer``: a JVM binary search; duplicates collapse first);
3. inside only the few ranges that hold a wanted rank, a window over the
   sorted distinct values finds the exact value.

Only range counts (G rows) and the wanted values reach the driver.  Ranks
use linear interpolation between the two neighbouring order statistics
(``v[lo] + (v[hi] - v[lo]) * frac`` with ``h = (n - 1) * q``).
"""
from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


ROWS_PER_RANGE = 5_000_000
MIN_RANGES, MAX_RANGES = 1024, 100_000


def _ranges(n: int) -> int:
    # ~5M rows per range at most, between 1,024 and 100k ranges
    return int(min(MAX_RANGES, max(MIN_RANGES, n // ROWS_PER_RANGE)))


def _sketch(x: DataFrame, G: int):
    probs = [j / G for j in range(1, G)]
    return F.percentile_approx("x", probs, max(10_000, 10 * G))


def count_and_splits(df: DataFrame, col: str):
    """One pass: value count and approximate range boundaries (re-sketched
    with more ranges only when the count calls for it)."""
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    row = x.agg(F.count(F.lit(1)).alias("n"), _sketch(x, MIN_RANGES).alias("p")).first()
    n, approx = row["n"], row["p"] or []
    if _ranges(n) > MIN_RANGES:
        approx = x.agg(_sketch(x, _ranges(n)).alias("p")).first()["p"] or []
    return n, approx


def exact_order_stats(df: DataFrame, col: str, ranks, n: int | None = None, approx=None) -> dict:
    """``{rank: value}`` for 0-based ranks of the non-null values of ``col``
    (``n`` / ``approx``: their count and range boundaries, when known)."""
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    ranks = sorted(set(int(r) for r in ranks))
    if not ranks:
        return {}
    if n is None or approx is None:
        n, approx = count_and_splits(df, col)
    vc = x.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    inner = sorted(set(v for v in approx if v is not None)) or [0.0]
    splits = [float("-inf")] + inner + [float("inf")]
    bz = Bucketizer(splits=splits, inputCol="x", outputCol="r", handleInvalid="keep")
    # distinct values with their range: read twice (range counts, then the
    # window inside the wanted ranges), so kept once
    vr = bz.transform(vc).persist(StorageLevel.MEMORY_AND_DISK)
    counts = sorted((int(r["r"]), int(r["n"])) for r in
                    vr.groupBy("r").agg(F.sum("c").alias("n")).collect())
    wanted = {}
    off = 0
    it = iter(ranks)
    t = next(it, None)
    for r, cnt in counts:
        while t is not None and t < off + cnt:
            wanted.setdefault(r, []).append((t, t - off))
            t = next(it, None)
        off += cnt
    if t is not None:
        vr.unpersist()
        raise ValueError(f"rank {t} out of range for {off} values")
    spark = df.sparkSession
    targets = spark.createDataFrame([(float(r), int(t), int(loc)) for r, lst in wanted.items()
                                     for t, loc in lst], "r double, rank long, loc long")
    sub = vr.join(F.broadcast(targets.select("r").distinct()), "r")
    w = Window.partitionBy("r").orderBy("x")
    cum = sub.withColumn("_hi", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.withColumn("_lo", F.col("_hi") - F.col("c"))
    hit = cum.join(F.broadcast(targets), "r").where((F.col("loc") >= F.col("_lo")) & (F.col("loc") < F.col("_hi")))
    out = {int(row["rank"]): float(row["x"]) for row in hit.select("rank", "x").collect()}
    vr.unpersist()
    return out


def exact_quantiles(df: DataFrame, col: str, probs, n: int | None = None, approx=None) -> list:
    if n is None or approx is None:
        n, approx = count_and_splits(df, col)
    if n == 0:
        return [None for _ in probs]
    pos = []
    for q in probs:
        h = (n - 1) * float(q)
        lo = math.floor(h)
        hi = min(lo + 1, n - 1)
        pos.append((lo, hi, h - lo))
    stats = exact_order_stats(df, col, [p for a, b, _ in pos for p in (a, b)], n, approx)
    return [stats[a] + (stats[b] - stats[a]) * f for a, b, f in pos]


def quantile_bin_edges(df: DataFrame, col: str, n_bins: int = 48) -> list:
    """Bin edges: ``min(n_bins, max(2, n - 1))`` bins at evenly spaced
    quantiles of the training values, duplicates removed."""
    n, approx = count_and_splits(df, col)
    b = min(int(n_bins), max(2, n - 1))
    qs = exact_quantiles(df, col, [i / b for i in range(b + 1)], n, approx)
    return sorted(set(q for q in qs if q is not None))
