"""Exact global row numbers without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row to one task.
Below a counted bound that is the cheapest plan; above it the rows are range
partitioned on the whole ordering, so ties of a leading column are split by
the columns after it.  The partitioning is written to the shared folder once
(a recomputation could cut other ranges), each range is numbered by its own
window, and the per-range counts (at most one per range on the driver) give
the offsets.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Tables up to this many rows are numbered by one window.
SINGLE_WINDOW_MAX = 1_000_000
ROWS_PER_RANGE = 1_000_000


def global_row_number(df: DataFrame, order: list, out: str = "rn",
                      n_rows: int | None = None, single_max: int = SINGLE_WINDOW_MAX) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order``, which should
    be total.  ``n_rows``: the table size when known (else it is counted)."""
    n = df.count() if n_rows is None else n_rows
    if n <= single_max:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))
    spark = df.sparkSession
    path = scratch_path(spark, "ledgerflow-ranges", uuid.uuid4().hex)
    cut = df.repartitionByRange(max(2, n // ROWS_PER_RANGE), *order).withColumn("_r", F.spark_partition_id())
    cut.write.parquet(path)
    ranged = spark.read.schema(cut.schema).parquet(path)
    counts = sorted((r["_r"], r["c"]) for r in ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, acc = [], 0
    for r, c in counts:
        offsets.append((r, acc))
        acc += c
    off = spark.createDataFrame(offsets, "_r int, _off long")
    w = Window.partitionBy("_r").orderBy(*order)
    return (ranged.join(F.broadcast(off), "_r")  # one row per range
                  .withColumn(out, F.col("_off") + F.row_number().over(w))
                  .drop("_r", "_off"))
