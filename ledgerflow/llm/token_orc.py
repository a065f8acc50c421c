"""Token ids as ORC files: one row per document, in ascending order of document ids.

A file is a range of document ids, its stripes are runs of it. ORC stores integers run-length
encoded, keeps least and greatest values per stripe and per ``STRIDE`` rows (the row index), and a
Bloom filter on ``doc_id`` for each of those runs. So a reader takes stripes in parallel,
:func:`lookup` skips files, stripes and runs by document id, and :func:`token_range` by the place of
tokens in the whole stream; Spark pushes both filters into the ORC reader.

Columns: doc_id, shard (the file's number, ascending), at (ids in the file before the document),
n_tokens, ids. Beside them lies ``offsets``: for each file the ids before it. It is written last, from
the files' ``at`` column alone, and a folder without it is not read: an interrupted write isn't taken
for whole.

Work: documents are dealt by ranges of (doc_id, hash of the text), so that a hot id is split too,
and sorted inside them by Spark; texts then stream through the tokenizers library in slices. Texts
are cut where the vocabulary's pieces always end (see ``_CUT``), and every distinct part of a slice is
encoded once (parts seen lately are remembered, at most ``KNOWN`` of them); a text's ids are those of
its parts. The driver sees one number per file.

Defined results: null and empty texts hold the end id only; null ids come first; rows with one id
follow by the hash of their texts, repeated rows each have their place; very long texts are encoded
whole; an empty table makes no rows; extra columns don't pass.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import empty_text, release, scratch_dir, slices, strings, table

#: The id that ends each document.
END = 2
#: Rows per entry of the row index, bytes of a stripe.
STRIDE, STRIPE = 1_000, 16 << 20
#: Distinct words that a worker remembers.
KNOWN = 500_000
SLICE = 4 << 20

FILE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()),
                     T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
OFFSETS = "shard int, first long, n_tokens long"


def vocabulary(path: str | None = None):
    """The tokenizers library with a vocabulary file (by default word_bpe_49k.json of public_tokenizers)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


#: Classes of bytes: 0 white space, 1 letters A-Z and a-z, 2 digits, 3 apostrophe, 4 other ASCII, 5 parts of other characters,
#: 6 and 7 the two bytes of a letter from U+00C0 to U+00FF.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[39] = 3
_CLASS[128:] = 5
#: Whether the vocabulary's pieces always end between bytes of two classes: at white space; at a digit, which is a piece of its own;
#: after a letter and before one, but for an apostrophe, which may take the letters behind it. Next to other characters, which may
#: be letters, marks that combine or signs, there is no telling.
_CUT = np.zeros((8, 8), bool)
_CUT[0, 1:] = _CUT[1:, 0] = True
_CUT[2, [1, 2, 3, 4, 6]] = _CUT[[1, 3, 4, 7], 2] = True
_CUT[1, 3:5] = _CUT[7, 3:5] = _CUT[4, [1, 6]] = True
_CUT = _CUT.ravel()
#: What begins the text of a special token, which the library takes as such and which no cut may divide.
_SPECIAL = b"<|"


class Encoder:
    """Texts to ids, part by distinct part: texts are cut where pieces always end, and A-Z are lowered
    as the vocabulary does, but before characters that may combine with them."""

    def __init__(self, path: str | None = None, end: int | None = END):
        self.library = vocabulary(path)
        self.end = end
        self._forget()

    def _forget(self) -> None:
        """Starts anew: no part has a number, the end has number 0."""
        self.known: dict[str, int] = {}
        self.flat = np.array([] if self.end is None else [self.end], np.int32)
        self.at = np.array([0, len(self.flat)], np.int64)

    def parts(self, parts: list[str]) -> np.ndarray:
        """The numbers of distinct parts, whose ids are ``flat[at[number]:at[number + 1]]``."""
        out = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(out < 0)
        if self.known and len(self.known) + len(new) > KNOWN:
            self._forget()
            out[:], new = -1, np.arange(len(parts))
        words = [parts[i] for i in new]
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        out[new] = len(self.at) - 1 + np.arange(len(new))
        self.known.update(zip(words, out[new].tolist()))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the n + 1 offsets of the texts in them."""
        data, at = strings(texts)
        kind = _CLASS[data]
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
            kind[latin], kind[latin + 1] = 6, 7
            cut[1:-1] = _CUT[kind[:-1] * np.uint8(8) + kind[1:]]
            upper = (data >= 65) & (data <= 90)
            upper[:-1] &= kind[1:] < 5
            lowered = data + (upper * np.uint8(32))
            raw = data.tobytes()
            if _SPECIAL in raw:  # such a text stays one part, as it is
                for a, b in zip(at, at[1:]):
                    if _SPECIAL in raw[a:b]:
                        cut[a:b] = kind[a:b] == 0  # a piece may begin at white space, which may go
                        lowered[a:b] = data[a:b]
            cut[at] = True
            solid = kind != 0  # white space makes no piece
            behind = np.concatenate([[0], np.cumsum(solid)])
            bounds, at = behind[cut], behind[at]
            bounds = bounds[np.concatenate([[True], bounds[1:] != bounds[:-1]])]
            lowered = lowered[solid]
        else:
            lowered, bounds = data, np.zeros(1, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(lowered)))
        coded = pieces.dictionary_encode()
        which = self.parts(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        first = np.searchsorted(bounds, at)
        if self.end is not None:  # the end is one more part behind each text
            which = np.insert(which, first[1:], 0)
            first = first + np.arange(len(first))
        begins = self.at[which]
        counts = self.at[which + 1] - begins
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(begins - total[:-1], counts) + np.arange(total[-1])]
        return ids, total[first]


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder, with what it remembers of earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, path: str, vocabulary_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the documents' ids as files in ``path``/ids and their offsets in ``path``/offsets."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), empty_text(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, before = encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", SLICE):
            ids, at = encode(part["text"])
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(np.full(n, shard, np.int32)), pa.array(at[:-1] + before), pa.array(np.diff(at)),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], FILE.names)
            before += int(at[-1])
        release()

    (given.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, FILE)
     .write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.row.index.stride", str(STRIDE))
     .option("orc.stripe.size", str(STRIPE)).option("compression", "zstd").orc(f"{path}/ids"))
    ends = F.max(F.col("at") + F.col("n_tokens")).cast("bigint").alias("n_tokens")
    files = sorted((r["shard"], r["n_tokens"]) for r in _files(spark, path).groupBy("shard").agg(ends).collect())  # one row a file
    rows, first = [], 0
    for shard, n in files:
        rows.append((shard, first, n))
        first += n
    spark.createDataFrame(rows, OFFSETS).coalesce(1).write.orc(f"{path}/offsets")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).orc(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before."""
    offsets = spark.read.schema(OFFSETS).orc(f"{path}/offsets").select("shard", "first")  # one row a file
    return _files(spark, path).join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents with these ids; files, stripes and runs of rows are skipped by their least and
    greatest ids and their Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(*doc_ids))


def token_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The documents with tokens at places ``first`` <= place < ``last`` of the whole stream, and how
    many of their ids lie before the range; only files and stripes that hold some are read."""
    offsets = spark.read.schema(OFFSETS).orc(f"{path}/offsets").where((F.col("first") < last) & (F.col("first") + F.col("n_tokens") > first))
    hit = sorted((r["shard"], r["first"]) for r in offsets.collect())  # one row a file
    parts = F.lit(False)
    for shard, before in hit[:1] + hit[-1:]:  # the border files; those between are wanted whole
        parts = parts | ((F.col("shard") == shard) & (F.col("at") < last - before) & (F.col("at") + F.col("n_tokens") > first - before))
    if len(hit) > 2:
        parts = parts | ((F.col("shard") > hit[0][0]) & (F.col("shard") < hit[-1][0]))
    chosen = _files(spark, path).where(parts)
    return chosen.join(F.broadcast(offsets.select("shard", F.col("first").alias("_before"))), "shard").select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids",
        F.greatest(F.lit(0), F.lit(first) - F.col("_before") - F.col("at")).alias("skip"))


def op12_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, from the files."""
    path = f"{scratch_dir(spark)}/ledgerflow-{uuid.uuid4().hex}/tokens"
    write(table(spark, sf_dir, "documents"), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
