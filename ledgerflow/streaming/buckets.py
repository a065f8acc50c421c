"""Tumbling-bucket aggregation on a stream.

With a fixed ``origin`` the bucket of a row depends on the row alone, so the
batch aggregate becomes a windowed streaming aggregate: Spark's ``window``
is left-closed ``[s, s + W)``, the buckets here are right-closed
``(e[k-1], e[k]]`` with the origin included in bucket 1, so the event time is
shifted by one microsecond (and clamped at the origin) before windowing.
Windows are aligned to the origin via ``startTime``.  The watermark bounds
the state; late rows beyond it are dropped by Spark, as usual.
"""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixedpoint import exact_sums
from ..functions.timecols import micros_between, parse_interval, ts_lit
from ..session import scratch_path

_EPOCH = dt.datetime(1970, 1, 1)


def stream_bucket_aggregate(events: DataFrame, origin: dt.datetime, interval: str,
                            watermark: str = "1 day", n_buckets: int | None = None) -> DataFrame:
    """Streaming ``(user_id, k, brand, amount, date)`` for a fixed origin.

    ``n_buckets`` (optional) keeps only buckets ``k <= n_buckets``; without it
    every bucket after the origin is kept (a stream has no known end)."""
    width, weekly = parse_interval(interval)
    if weekly:
        origin = origin + dt.timedelta(days=(6 - origin.weekday()) % 7)
    origin_us = (origin - _EPOCH) // dt.timedelta(microseconds=1)
    start_us = origin_us % width
    o = ts_lit(origin)
    # event time must be an instant (TIMESTAMP): NTZ micros read as UTC micros
    us = micros_between(ts_lit(_EPOCH), F.col("date"))
    t = F.timestamp_micros(F.greatest(us - F.lit(1), F.lit(origin_us)))
    ev = (events.where(F.col("user_id").isNotNull() & F.col("brand").isNotNull()
                       & F.col("date").isNotNull() & (F.col("date") >= o))
                .withColumn("_t", t)
                .withWatermark("_t", watermark))
    keyed = ev.groupBy(F.window("_t", f"{width} microseconds", startTime=f"{start_us} microseconds").alias("w"),
                       "user_id", "brand")
    agg = exact_sums(keyed, {"amount": F.col("amount")}, F.min("date").alias("date"), zero=True)
    out = agg.select(
        "user_id",
        ((F.unix_micros(F.col("w.end")) - F.lit(origin_us)) / F.lit(width)).cast("bigint").alias("k"),
        "brand", "amount", "date")
    if n_buckets is not None:
        out = out.where(F.col("k") <= F.lit(n_buckets))
    return out


def run_to_table(spark: SparkSession, stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Drive a stream over the input available now and return its rows as a batch DataFrame.

    Every micro-batch is written as Parquet to a folder named by its id, below the shared checkpoint
    folder; a batch that is run again after a failure replaces its folder.  In ``complete`` mode a
    batch holds the whole state, so the last one is the result; in ``append`` mode all are.  No row
    passes through the driver."""
    root = scratch_path(spark, "ledgerflow-streams", uuid.uuid4().hex)
    done: list[int] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        done.append(batch_id)

    q = (stream.writeStream.foreachBatch(keep).outputMode(output_mode)
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(done)] if output_mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{root}/rows/batch={i}" for i in wanted])


def stream_to_parquet(stream: DataFrame, path: str, checkpoint: str | None = None,
                      trigger: dict | None = None):
    """Durable sink for :func:`stream_bucket_aggregate`: ``append`` mode, so a
    bucket is written once, after the watermark has passed its end; rows
    later than the watermark are dropped by Spark.  The checkpoint (offsets
    and aggregation state) lives in the shared ``spark.checkpoint.dir`` by
    default, so a restarted query resumes after executor or driver loss.
    Returns the started query."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "ledgerflow-streams", uuid.uuid4().hex)
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", ckpt))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
