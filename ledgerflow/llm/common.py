"""Small helpers shared by the operators: tables, scratch tables, Arrow batches, word hashing."""
from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once inside a task; one longer document is still taken whole.
SLICE_BYTES = 2 << 20

#: The white space that separates words: 0x20 and 0x09-0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

SALT = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where the session sets none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext
        shared = context.getCheckpointDir()
        if not shared:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerflow-"))
            shared = context.getCheckpointDir()
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and lost executors cost
    a re-read only."""
    path = f"{scratch_dir(df.sparkSession)}/ledgerflow-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        part = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(int(a), int(b - a))


def with_struct(df: DataFrame, column: str, name: str, kind: T.StructType,
                work: Callable[[pa.Array], dict[str, pa.Array]], drop: bool = False,
                limit: int = SLICE_BYTES, finish: Callable[[], None] | None = None) -> DataFrame:
    """All rows and columns of ``df`` plus one struct column ``name`` that ``work`` derives from
    the text column, slice by slice. ``drop`` leaves the text column out, which saves sending it
    back from the workers; ``finish`` is called at the end of each task."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit):
            got = work(part.column(part.schema.get_field_index(column)))
            fields = [arrow.field(i) for i in range(arrow.num_fields)]
            struct = pa.StructArray.from_arrays([_as(got[f.name], f.type) for f in fields], fields=fields)
            kept = [c for c in part.schema.names if not (drop and c == column)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), struct], [*kept, name])
        if finish:
            finish()
        release()

    schema = T.StructType([*(f for f in df.schema.fields if not (drop and f.name == column)), T.StructField(name, kind)])
    return df.mapInArrow(run, schema)


def release() -> None:
    """Hands memory that a task has freed back to the system: Python workers live on, and what they
    hold counts against the executor in later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def _as(values, kind: pa.DataType) -> pa.Array:
    array = values if isinstance(values, pa.Array) else pa.array(values)
    return array if array.type == kind else array.cast(kind)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FACTORS = [mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(SALT)) | np.uint64(1)]


def factors(n: int) -> np.ndarray:
    """One odd 64-bit factor per position in a word."""
    if len(_FACTORS[0]) < n:
        _FACTORS[0] = mix(np.arange(1, 2 * n, dtype=np.uint64) * np.uint64(SALT)) | np.uint64(1)
    return _FACTORS[0]


#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bytes(separators: bytes) -> np.ndarray:
    """A table over the 256 bytes: True for bytes of words. UTF-8 bytes from 0x80 are never
    separators here, so whole code points stay whole."""
    out = np.ones(256, bool)
    out[np.frombuffer(separators, np.uint8)] = False
    return out


class Words:
    """The words of some texts: where each starts and ends, its 64-bit hash, and per text the
    index of its first word (``first`` has one entry more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashed: bool = True):
        self.data = data
        n = len(data)
        inside = is_word[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            at = offsets[:-1][offsets[:-1] < n]
            before[at] = False
            at = offsets[1:][offsets[1:] > 0] - 1
            after[at] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        if hashed:
            length = self.ends - self.starts
            base = np.cumsum(length) - length
            at = np.arange(int(length.sum())) - np.repeat(base, length)
            value = (data[inside].astype(np.uint64) + np.uint64(1)) * factors(int(length.max(initial=1)))[at]
            total = np.add.reduceat(value, base) if len(base) else np.zeros(0, np.uint64)
            self.hashes = mix(total + length.astype(np.uint64) * np.uint64(SALT))

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The index of the text that each word stands in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def empty_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
