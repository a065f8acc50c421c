"""Lookups in fitted tables (vocabularies, per-group scalers, brand ranks).

Catalyst's size statistics choose how a fitted table meets the rows; they are exact for a table that
has been persisted and counted.  Up to ``BROADCAST_BYTES`` it is broadcast.  A larger one is joined
by a shuffle on the key, where one brand on half of all rows would put half of all rows in one task.
So the rows of hot keys, and those without a key, don't take part in that shuffle: they stay where
they are and meet the few table rows of the hot keys by a broadcast.

A key is hot with at least half the rows of a mean shuffle partition, or one row in ``HOT_KEYS``
where that is more; no more than ``HOT_KEYS`` keys can be.  They come from one mergeable
frequent-items sketch over the key column, whose size is fixed.  The sketch decides only which way a
row goes, so its errors cost time and never change a result.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000
# Items that the sketch tracks: its counts are off by at most about one row in 4,000.
TRACKED = 16_384


def partitions_for(spark: SparkSession, size: int, share: int) -> int | None:
    """The number of partitions that gives each about ``share`` of ``size`` rows or bytes; None where the
    session's own number of shuffle partitions does, which AQE may then coalesce and split."""
    n = -(-size // share)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out by keys over ``n`` partitions (None: as many as the session says)."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def materialize_small(df: DataFrame) -> tuple[DataFrame, int]:
    """Persist a fitted parameter table and count it (the size proof)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size of a table: an estimate, exact once it is persisted and counted."""
    return int(df.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the statistics prove that a table fits; an estimate above the limit (joins multiply
    theirs) is checked by counting the table, which fills its storage if it is persisted."""
    if planned_bytes(table) <= limit:
        return True
    table.count()
    return planned_bytes(table) <= limit


def hot_keys(df: DataFrame, key: str, most: int = HOT_KEYS) -> list:
    """Keys that hold at least 1 / min(``most``, 2 x shuffle partitions) of the rows with a key."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(2, min(most, 2 * partitions))
    found = df.select(F.col(key).alias("_key")).where("_key is not null").agg(
        F.expr(f"approx_top_k(_key, {share}, {max(TRACKED, share)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in found["top"] or [] if item["count"] * share >= found["n"]]


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of ``df`` with a fitted ``table``: ``df[key] = table[table_key]``, the latter unique
    and dropped from the result.  ``table``'s column names differ from ``df``'s."""
    same = F.col(key) == F.col(table_key)
    if fits_broadcast(table, limit):
        return df.join(F.broadcast(table), same, "left").drop(table_key)
    hot = hot_keys(df, key)
    apart = F.col(key).isNull() | F.col(key).isin(hot)
    # at most HOT_KEYS rows, as the key is unique
    heavy = df.where(apart).join(F.broadcast(table.where(F.col(table_key).isin(hot))), same, "left")
    rest = df.where(~apart).join(table, same, "left")
    return heavy.unionByName(rest).drop(table_key)
