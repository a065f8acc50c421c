"""Transaction sources.

Every operator consumes a DataFrame ``(user_id BIGINT, date TIMESTAMP_NTZ,
brand STRING, amount DOUBLE)``.  Two canonical views are derived from the
supplied test tables; any other table can be adapted with :func:`normalize`.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import partitions_for, planned_bytes, spread

TX_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("brand", T.StringType()),
    T.StructField("amount", T.DoubleType()),
])

# Bytes of lineitem files for each partition of the join with orders.
JOIN_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def normalize(df: DataFrame, user_id="user_id", date="date", brand="brand",
              amount="amount") -> DataFrame:
    """Rename / cast arbitrary columns to the transaction schema."""
    return df.select(
        F.col(user_id).cast("bigint").alias("user_id"),
        F.col(date).cast("timestamp_ntz").alias("date"),
        F.col(brand).cast("string").alias("brand"),
        F.col(amount).cast("double").alias("amount"),
    )


def tx_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales view: lineitem JOIN orders JOIN part.

    Only the six needed columns are read (column pruning reaches the scans).
    No broadcast hint: at scale orders and part are large, so the join
    strategy is left to the planner / AQE runtime statistics.  Where the
    session has too few shuffle partitions for lineitem's files, the orders are
    dealt out over more, and the planner deals lineitem out likewise: a task
    sorts, and later aggregates, a bounded share of the sales.
    """
    lines = read_table(spark, sf_dir, "lineitem")
    li = lines.select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = partitions_for(spark, planned_bytes(lines), JOIN_BYTES)
    if n:
        od = spread(od, n, "o_orderkey")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(pt, li.l_partkey == pt.p_partkey))
    return j.select(
        F.col("o_custkey").cast("bigint").alias("user_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
        F.col("p_brand").alias("brand"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("amount"),
    )


def ev_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event view: events(ts, user_id, event_type, value)."""
    ev = read_table(spark, sf_dir, "events")
    return normalize(ev, user_id="user_id", date="ts", brand="event_type", amount="value")


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      schema: T.StructType = TX_SCHEMA) -> DataFrame:
    """Read raw transactions with an explicit schema (no inference pass).

    CSV files have a header row, by which columns are chosen: their order does
    not matter, further columns are ignored, a missing one is an error.  Blanks
    around names and values are tolerated; a value that does not parse fails
    the job."""
    if fmt == "csv":
        raw = (spark.read.option("header", True)
               .option("ignoreLeadingWhiteSpace", True)
               .option("ignoreTrailingWhiteSpace", True)
               .option("mode", "FAILFAST")
               .csv(path))  # all columns as strings: no inference pass
        named = {c.strip(): c for c in raw.columns}
        absent = [f.name for f in schema if f.name not in named]
        if absent:
            raise ValueError(f"{path} has no column {', '.join(absent)}; its header is {raw.columns}")
        df = raw.select(*(F.col(f"`{named[f.name]}`").cast(f.dataType).alias(f.name) for f in schema))
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return normalize(df)
