"""Fingerprints, the processed-data cache and result sinks.

The cache key is ``md5(config JSON with sorted keys)`` plus a content
fingerprint of the input rows: the row count and the sums of the limbs of every
row's md5, an aggregate of one scan.  The same rows at another path (or in
another file layout) hit, and a changed row misses; row order carries no meaning
here (a deliberate change from a hash of file bytes).  Fingerprints of parts add
up, so appended rows update one without a second scan of the rest.

Cached tables live under ``<spark.checkpoint.dir>/ledgerflow-cache/<key>/``;
see :class:`ProcessedCache` for how an entry is published.
"""
from __future__ import annotations

import hashlib
import json
import os
import uuid
from decimal import Decimal
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import PIPELINE_VERSION
from ..session import scratch_path


# Limb sums are kept modulo this.
MODULUS = 2 ** 64
N_LIMBS = 4
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _canonical(df: DataFrame, name: str) -> Column:
    """A column as text that no two values share: numbers as integers, times as microseconds."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        text = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{name}`)").cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # millionths and what is left of them in units of 1e-18: all of a DOUBLE from 0.01 to 9e9
        v = c.cast("double")
        near = F.rint(v * F.lit(1e6))
        left = F.rint((v - near / F.lit(1e6)) * F.lit(1e18))
        usual = (v == 0) | ((F.abs(v) >= F.lit(0.01)) & (F.abs(v) < F.lit(9e9)))
        text = F.when(usual, F.concat_ws("/", near.cast("bigint").cast("string"), left.cast("bigint").cast("string"))).otherwise(v.cast("string"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def fingerprint_parts(df: DataFrame, by: list | None = None, cols=None) -> DataFrame:
    """Per part (``by``; the whole table without): ``n_rows, l0..l3``, the sums modulo 2^64 of the four
    32-bit limbs of every row's md5.  A multiset's sums add up over its parts, in any order."""
    by = list(by or [])
    h = F.md5(F.concat(*[_canonical(df, c) for c in (cols or df.columns)]))
    rows = df.select(*by, *[F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(12,0)").alias(f"l{i}") for i in range(N_LIMBS)])
    sums = [_modulo(F.sum(f"l{i}")).alias(f"l{i}") for i in range(N_LIMBS)]
    return (rows.groupBy(*by) if by else rows).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def _modulo(total: Column) -> Column:
    m = F.lit(Decimal(MODULUS)).cast("decimal(20,0)")
    return F.pmod(F.coalesce(total.cast("decimal(38,0)"), F.lit(Decimal(0)).cast("decimal(38,0)")), m).cast("decimal(20,0)")


def fold_parts(parts: DataFrame) -> DataFrame:
    """The fingerprint of the union of parts (a ``sign`` column of -1 takes a part away)."""
    sign = F.col("sign") if "sign" in parts.columns else F.lit(1)
    folded = parts.agg(F.coalesce(F.sum(F.col("n_rows") * sign), F.lit(0)).cast("bigint").alias("n_rows"),
                       *[_modulo(F.sum(F.col(f"l{i}") * sign.cast("decimal(2,0)"))).alias(f"l{i}") for i in range(N_LIMBS)])
    return with_fingerprint(folded)


def with_fingerprint(parts: DataFrame) -> DataFrame:
    text = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(N_LIMBS)])
    return parts.withColumn("fingerprint", F.md5(text))


def content_fingerprint(df: DataFrame, cols=None) -> DataFrame:
    """One row: ``n_rows, l0..l3, fingerprint`` of a table's rows as a multiset."""
    return with_fingerprint(fingerprint_parts(df, cols=cols))


class FingerprintLedger:
    """Fingerprints per part of a table that grows (a day, a file): adding, replacing or dropping a part
    reads that part alone, and the whole table's fingerprint is folded from the ledger's rows."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "ledgerflow-fingerprints")

    def put(self, part: str, rows: DataFrame, cols=None) -> None:
        """A part's rows as they are now; one folder a part, so a repeated call replaces it."""
        (fingerprint_parts(rows, cols=cols).withColumn("part", F.lit(part)).coalesce(1)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path))

    def drop(self, part: str) -> None:
        self.put(part, self.spark.createDataFrame([], "x int"))

    def whole(self) -> DataFrame:
        return fold_parts(self.spark.read.parquet(self.path))


def config_hash(config_json: str) -> str:
    return hashlib.md5(config_json.encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(1).collect()
        return True
    except AnalysisException:
        return False


class ProcessedCache:
    """Parquet tables keyed by (config hash, data fingerprint).

    A key's tables are written to a folder of their own, under a fresh name; then its manifest is
    written beside it and renamed into place, which is one step on the file system.  A reader sees
    the manifest of whole tables or none: a build that died, or one that still runs, is a miss.  Of
    two writers of one key each has its folder, and the manifest names one of them.  Manifests carry
    the pipeline version in their name, so another version's entry is a miss and stays whole."""

    def __init__(self, spark: SparkSession, base: str | None = None,
                 version: str = PIPELINE_VERSION):
        self.spark = spark
        self.base = base or scratch_path(spark, "ledgerflow-cache")
        self.version = version

    def key(self, config_json: str, data: DataFrame) -> str:
        fp = content_fingerprint(data).first()["fingerprint"]
        return f"{config_hash(config_json)}_{fp}"

    def path(self, key: str) -> str:
        return os.path.join(self.base, key)

    def _manifest(self, key: str) -> str:
        return os.path.join(self.path(key), f"manifest-{config_hash(self.version)}.json")

    def _file_system(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def lookup(self, key: str) -> dict | None:
        """The tables of a published entry, by name; None where there is none."""
        name = self._manifest(key)
        at, fs = self._file_system(name)
        if not fs.exists(at):
            return None
        entry = json.loads("\n".join(r["value"] for r in self.spark.read.text(name).collect()))  # one line
        root = os.path.join(self.path(key), entry["folder"])
        return {t: self.spark.read.schema(T.StructType.fromJson(schema)).parquet(os.path.join(root, t))
                for t, schema in entry["tables"].items()}

    def store(self, key: str, config_json: str, tables: dict) -> dict:
        """Writes the tables and publishes them; what counts is the entry that a reader then finds."""
        folder = f"tables-{uuid.uuid4().hex}"
        for name, df in tables.items():
            w = df.write
            if "split" in df.columns:
                w = w.partitionBy("split")
            w.parquet(os.path.join(self.path(key), folder, name))
        entry = {"version": self.version, "config": config_json, "folder": folder,
                 "tables": {name: df.schema.jsonValue() for name, df in tables.items()}}
        draft, fs = self._file_system(os.path.join(self.path(key), f".manifest-{folder}"))
        out = fs.create(draft, True)
        out.write(json.dumps(entry).encode())
        out.close()
        place, _ = self._file_system(self._manifest(key))
        if not fs.rename(draft, place):  # another writer of the same key was first
            fs.delete(draft, False)
        return self.lookup(key)

    def load_or_build(self, config_json: str, data: DataFrame,
                      build: Callable[[], dict]) -> tuple[dict, bool, str]:
        """(tables, hit?, key).  ``build`` runs only on a miss."""
        key = self.key(config_json, data)
        hit = self.lookup(key)
        if hit is not None:
            return hit, True, key
        return self.store(key, config_json, build()), False, key


def write_predictions(df: DataFrame, path: str) -> DataFrame:
    """Prediction sink ``(split, user_id, brand_id, predicted, actual)``,
    partitioned by split; returns the table read back."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return df.sparkSession.read.parquet(path)


class TrialLog:
    """Append-only metric log ``(run, trial, split, step, metric, value)``.

    Partitioned by run and chunk; each append writes one chunk with dynamic
    partition overwrite, so a retried append of the same chunk replaces it
    instead of duplicating rows, and other chunks of the run stay.
    """
    COLS = ["run", "trial", "split", "step", "metric", "value"]

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "ledgerflow-trials")

    def append(self, df: DataFrame, chunk: str = "0") -> None:
        (df.select(*self.COLS).withColumn("chunk", F.lit(str(chunk)))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("run", "chunk").parquet(self.path))

    def read(self, run: str | None = None) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame(
                [], "run string, trial bigint, split string, step bigint, metric string, value double")
        df = self.spark.read.parquet(self.path)
        df = df if run is None else df.where(F.col("run") == run)
        return df.select(*self.COLS)


def melt_metrics(metrics: DataFrame, run: str, id_cols=("trial", "split"), step: int = 0,
                 metric_cols=None) -> DataFrame:
    """Wide metric rows -> log rows (a narrow ``stack``, no shuffle)."""
    metric_cols = list(metric_cols or [c for c in metrics.columns if c not in id_cols])
    stack = "stack({n}, {pairs}) as (metric, value)".format(
        n=len(metric_cols), pairs=", ".join(f"'{c}', cast(`{c}` as double)" for c in metric_cols))
    return metrics.select(F.lit(run).alias("run"), *id_cols, F.lit(step).cast("bigint").alias("step"),
                          F.expr(stack))
