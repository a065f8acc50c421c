"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of ``width`` consecutive benchmark words (a shorter item is one window).
For each window length a shift table, indexed by the hash of a block of two words, says how far
the search may jump; at shift 0 the block's bucket selects test strings, their first block is
compared, then all words' hashes, and at last the bytes of both passages.

The test strings are taken in blocks of at most ``block_chars`` characters of benchmark text: one
block is what the driver collects and broadcasts at a time. Each block is one narrow pass over the
documents; there is no shuffle, so no key can be hot. Between passes a document carries a bitmap of
hit words and the ids of items found.

Defined results: a null or empty text has no words and is clean; null or word-less items match
nothing; items that repeat an id count once; a null item id is the string ``null``; repeated
documents each get their row; other columns pass through, whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import LOWER, Words, mix, strings, table, with_struct, word_bytes

#: Words are runs of bytes outside these, after A-Z are lowered.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WIDTH = 10
BLOCK_CHARS = 16_000_000
TABLE_BITS = 20
#: A lane of the search: so many end positions are searched by one cursor.
LANE = 256

STATE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("bits", T.BinaryType()),
                      T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(column: pa.Array) -> Words:
    data, offsets = strings(column)
    return Words(LOWER[data], offsets, word_bytes(SEPARATORS))


def _pair(h: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of ``size`` words that ends at each p."""
    return h[p] if size == 1 else mix(h[p] + np.uint64(3) * h[p - 1])


class Patterns:
    """The tables for the test strings of one length."""

    def __init__(self, length: int, hashes: np.ndarray, texts: list[bytes], items: list[list[str]]):
        self.length, self.block = length, min(2, length)
        self.hashes, self.texts, self.items = hashes, texts, items
        mask = np.uint64((1 << TABLE_BITS) - 1)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint8)
        for q in range(self.block - 1, length):
            at = self._blocks(q) & mask
            np.minimum.at(self.shift, at, np.uint8(length - 1 - q))
        suffix = self._blocks(length - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.prefix = self._blocks(self.block - 1)[self.order]

    def _blocks(self, q: int) -> np.ndarray:
        return self.hashes[:, q] if self.block == 1 else mix(self.hashes[:, q] + np.uint64(3) * self.hashes[:, q - 1])

    def find(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, test string) of each occurrence."""
        h, size = words.hashes, self.length
        first, last = words.first[:-1] + size - 1, words.first[1:]
        lanes = np.maximum(0, -(-(last - first) // LANE))
        a = np.repeat(first, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        b = np.minimum(a + LANE, np.repeat(last, lanes))
        mask = np.uint64((1 << TABLE_BITS) - 1)
        stops = []
        while len(a):
            step = self.shift[_pair(h, a, self.block) & mask]
            stops.append(a[step == 0])
            a = a + np.maximum(step, 1)
            go = a < b
            a, b = a[go], b[go]
        at = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        if not len(at):
            return
        key = _pair(h, at, self.block)
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        n = high - low
        at, low = np.repeat(at, n), np.repeat(low, n)
        slot = low + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        same = self.prefix[slot] == _pair(h, at - size + self.block, self.block)
        at, which = at[same], self.order[slot[same]]
        for q in range(size):
            same = h[at - size + 1 + q] == self.hashes[which, q]
            at, which = at[same], which[same]
        for p, k in zip(at.tolist(), which.tolist()):
            start = p - size + 1
            if b" ".join(words.word(i) for i in range(start, p + 1)) == self.texts[k]:
                yield start, k


def compile_patterns(rows: list[tuple[str, str]], width: int) -> list[Patterns]:
    """Tables for (item id, text) rows, one per window length."""
    words = words_of(pa.array([text or "" for _, text in rows], pa.string()))
    found: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for k, (item, _) in enumerate(rows):
        a, n = int(words.first[k]), int(words.counts[k])
        size = min(width, n)
        for s in range(a, a + n - size + 1) if n else ():
            text = b" ".join(words.word(i) for i in range(s, s + size))
            found.setdefault(size, {}).setdefault(text, (words.hashes[s:s + size], set()))[1].add(item)
    return [Patterns(size, np.stack([h for h, _ in one.values()]), list(one), [sorted(i) for _, i in one.values()])
            for size, one in sorted(found.items())]


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", width: int = WIDTH, block_chars: int = BLOCK_CHARS,
         name: str = "__hits") -> DataFrame:
    """``docs`` plus a struct column ``name``: n_words, bits (one per word, little-endian), items."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                             F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // max(1, block_chars // 2)))
    out = docs.withColumn(name, F.lit(None).cast(STATE))
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        tables = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in mine.collect()], width))
        out = _pass(out, text, name, tables)
    return out


def _pass(docs: DataFrame, text: str, name: str, tables) -> DataFrame:
    before = f"{name}_before"
    source = docs.withColumnRenamed(name, before)

    def work(column: pa.Array) -> dict[str, pa.Array]:
        words = words_of(column)
        hit = np.zeros(len(words), bool)
        items: list[set[str]] = [set() for _ in range(len(column))]
        for patterns in tables.value:
            for start, k in patterns.find(words):
                hit[start:start + patterns.length] = True
                items[int(np.searchsorted(words.first, start, "right")) - 1].update(patterns.items[k])
        bits = [np.packbits(hit[a:b], bitorder="little").tobytes() if items[i] else b""
                for i, (a, b) in enumerate(zip(words.first, words.first[1:]))]
        return {"n_words": pa.array(words.counts, pa.int64()), "bits": pa.array(bits, pa.binary()),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}

    new = with_struct(source, text, name, STATE, work)
    old = F.col(before)
    return new.withColumn(name, F.when(old.isNull(), F.col(name)).otherwise(F.struct(
        F.col(f"{name}.n_words").alias("n_words"),
        _or(old["bits"], F.col(f"{name}.bits")).alias("bits"),
        F.array_sort(F.array_union(old["items"], F.col(f"{name}.items"))).alias("items")))).drop(before)


@F.pandas_udf(T.BinaryType())
def _or_bits(a, b):
    def one(x: bytes, y: bytes) -> bytes:
        if not x or not y:
            return x or y
        return np.bitwise_or(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).tobytes()

    return a.combine(b, one)


def _or(a, b):
    return F.when(F.length(a) == 0, b).when(F.length(b) == 0, a).otherwise(_or_bits(a, b))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    return mark(docs, benchmark, **options).where(F.size("__hits.items") == 0).drop("__hits")


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = mark(docs, table(spark, sf_dir, "benchmark"))
    ones = F.expr("aggregate(transform(sequence(1, greatest(length(__hits.bits), 1)), "
                  "i -> bit_count(cast(conv(hex(substring(__hits.bits, i, 1)), 16, 10) as int))), 0L, (s, x) -> s + x)")
    n_items = F.size("__hits.items").cast("long")
    return hits.select(
        "doc_id", F.col("__hits.n_words").alias("n_words"),
        F.when(n_items == 0, F.lit(0).cast("long")).otherwise(ones).alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join("__hits.items", ","), 256).alias("items_sha256"), (n_items > 0).alias("contaminated"))


#: A text's words in DuckDB: A-Z lowered, separators to one space, cut at spaces.
_WORDS = ("list_filter(string_split(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')")

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS VARCHAR), 'null') AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)
  WHERE len(w) >= n),
occ AS (SELECT r, i, wins.n, item FROM dw JOIN wins ON dw.n = wins.n AND dw.t = wins.t),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + n)) AS u(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_items, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)"""
