"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each UTF-8 byte from the ``ORDER`` - 1 before it (0 before the start of a text);
an n-gram is a 64-bit integer of 9 bits a symbol, so counts are exact. The counts of the highest
order are raw counts in trusted texts, those of lower orders numbers of distinct left extensions;
the three discounts of an order follow from its counts of counts.

Texts are cut into blocks of about 4 MB, written once, compressed, in buckets by block. Every block
lists its distinct n-grams. Counts, and then the probabilities of all n-grams that occur in any
text, are tables sharded by n-gram and joined order by order: a few joins of distinct n-grams, on
keys with at most 257 rows each, whatever the frequency of an n-gram in the texts. Each block gets
the probabilities of its list back, and is joined with them without moving its texts again.

A text's perplexity is judged by its language: quantiles of the bits per byte of the trusted texts
(histograms in thousandths of a bit, folded by partial aggregation) give a limit, which is wider
for short texts. A language with fewer than ``LEAST_DOCS`` trusted texts takes the limit of all.

Defined results: null and empty texts have 0 bytes, score 0, no perplexity, and aren't kept; null
languages form a language; a null id is not trusted; repeated rows each count and get their row;
without trusted texts all bytes are equally likely and every text that has bytes is kept.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import scratch_dir, slices, strings, table, written

ORDER = 4
SYMBOL_BITS = 9
#: The limit of a language: median + SPREAD * (high quantile - median), per sqrt(bytes) wider.
MIDDLE, HIGH, SPREAD, SHORT = 0.5, 0.95, 3.0, 8.0
LEAST_DOCS = 20


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram of ORDER symbols that ends at each byte, 0 for symbols before the text."""
    n = len(data)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(n, np.int64)
    for j in range(ORDER):
        symbol = np.zeros(n, np.int64)
        symbol[j:] = data[:max(n - j, 0)] + np.int64(1)
        symbol[place < j] = 0
        out |= symbol << (SYMBOL_BITS * j)
    return out


def _ranged(unique: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted n-grams by (range of their context, n-gram), and ranges' cuts."""
    mine = (unique >> SYMBOL_BITS) % ranges
    order = np.argsort(mine, kind="stable")
    return order, np.searchsorted(mine[order], np.arange(ranges + 1))


def _blocks(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in enumerate(slices(batches, "text")):
            data, offsets = strings(part.column("text"))
            unique = np.unique(grams(data, offsets))
            order, _ = _ranged(unique, ranges)
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId() * (1 << 32) + number]),
                pa.array([part.column("doc").to_pylist()], pa.list_(part.column("doc").type)),
                pa.array([part.column("lang").to_pylist()], pa.list_(pa.string())),
                pa.array([np.diff(offsets).tolist()], pa.list_(pa.int64())),
                pa.array([zlib.compress(data.tobytes(), 1)], pa.binary()), pa.array([unique[order].tobytes()], pa.binary())],
                ["block", "docs", "langs", "sizes", "bytes", "grams"])
    return run


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets by ``key``."""
    name = f"ledgerflow_{uuid.uuid4().hex}"
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def _block_data(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zlib.decompress(row["bytes"]), np.uint8), np.cumsum([0, *row["sizes"]])


def _trusted_counts(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = _block_data(row)
                trusted = np.zeros(len(offsets) - 1, np.int64)
                trusted[row["places"]] = 1
                all_ = grams(data, offsets)[np.repeat(trusted, np.diff(offsets)) > 0]
                unique, n = np.unique(all_, return_counts=True)
                order, cut = _ranged(unique, ranges)
                unique, n = unique[order], n[order].astype(np.int64)
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int32)), pa.array([unique[cut[r]:cut[r + 1]].tobytes() for r in used], pa.binary()),
                    pa.array([n[cut[r]:cut[r + 1]].tobytes() for r in used], pa.binary())], ["range", "grams", "n"])
    return run


def _sum_range(rows: pa.Table) -> pa.Table:
    flat = np.concatenate([np.frombuffer(x, np.int64) for x in rows["grams"].to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in rows["n"].to_pylist()])
    unique, place = np.unique(flat, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, place, n)
    return pa.table({"g": unique, "c": total})


def _split_ranges(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("grams").to_pylist()):
                all_ = np.frombuffer(packed, np.int64)
                cut = np.searchsorted((all_ >> SYMBOL_BITS) % ranges, np.arange(ranges + 1))
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(used), pa.int64()), pa.array(used.astype(np.int32)),
                    pa.array([all_[cut[r]:cut[r + 1]].tobytes() for r in used], pa.binary())], ["block", "range", "grams"])
    return run


def _distinct(rows: pa.Table) -> pa.Table:
    return pa.table({"g": np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in rows["grams"].to_pylist()]))})


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The log probabilities of each block's n-grams of a range."""
    order = np.argsort(known["g"].to_numpy())
    g, p = known["g"].to_numpy()[order], known["p"].to_numpy()[order].astype(np.float32)
    got = [p[np.searchsorted(g, np.frombuffer(x, np.int64))].tobytes() for x in asked["grams"].to_pylist()]
    return pa.table({"block": asked["block"], "range": asked["range"], "p": pa.array(got, pa.binary())})


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_type = batch.schema.field("docs").type.value_type
        for row in batch.to_pylist():
            data, offsets = _block_data(row)
            p = np.concatenate([np.frombuffer(x["p"], np.float32) for x in row["answers"]] or [np.zeros(0, np.float32)])
            known = np.frombuffer(row["grams"], np.int64)
            order = np.argsort(known)
            each = np.r_[p[order][np.searchsorted(known[order], grams(data, offsets))], np.float32(0)]
            total = np.add.reduceat(each, offsets[:-1], dtype=np.float64)
            total[np.diff(offsets) == 0] = 0.0
            trusted = np.zeros(len(total), bool)
            trusted[row["places"] or []] = True
            yield pa.RecordBatch.from_arrays([
                pa.array(row["docs"], doc_type), pa.array(row["langs"], pa.string()), pa.array(row["sizes"], pa.int64()),
                pa.array(total), pa.array(trusted)], ["doc", "lang", "n_bytes", "score", "trusted"])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ of a table of counts c."""
    n = counts.agg(*(F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (int(x or 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    of = lambda k, a, b: min(float(k), max(0.05, k - (k + 1) * y * b / a)) if a else 0.5 * k
    return of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, F.lit(d[0])).when(c == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def probabilities(counts: DataFrame, needed: DataFrame) -> DataFrame:
    """(g, p): log10 of the interpolated probability of every needed n-gram, from the raw counts
    (g, c) of the highest order."""
    mask = lambda k: F.lit((1 << (SYMBOL_BITS * k)) - 1)
    tables, wanted = {ORDER: counts}, {ORDER: needed}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(F.col("g").bitwiseAND(mask(k)).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        wanted[k] = wanted[k + 1].select(F.col("g").bitwiseAND(mask(k)).alias("g")).distinct()
    lower = None
    for k in range(1, ORDER + 1):
        t = written(tables[k], f"counts{k}") if k < ORDER else tables[k]
        d = _discounts(t)
        context = t.groupBy(F.shiftright("g", SYMBOL_BITS).alias("h")).agg(
            F.sum("c").alias("total"), F.sum(_discount(F.col("c"), d)).alias("mass"))
        rows = (wanted[k].withColumn("h", F.shiftright("g", SYMBOL_BITS)).withColumn("s", F.col("g").bitwiseAND(mask(k - 1)))
                .join(t, "g", "left").join(context, "h", "left"))
        rows = rows.withColumn("q", F.lit(1.0 / 256)) if lower is None else rows.join(lower, "s")
        own = F.greatest(F.col("c") - _discount(F.col("c"), d), F.lit(0.0)) / F.col("total")
        p = F.coalesce(own, F.lit(0.0)) + F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0)) * F.col("q")
        now = written(rows.select("g", p.alias("q")), f"order{k}")
        lower = now.withColumnRenamed("g", "s")
    return now.select("g", F.log10("q").alias("p"))


def perplexities(docs: DataFrame, trusted: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc, lang, n_bytes, score, trusted) of each document: score is the log10 probability of its
    bytes under the model of the documents whose key is in ``trusted`` (column ``doc``)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 2 * buckets + 1
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = _bucketed(source.mapInArrow(_blocks(ranges), f"block long, docs array<{kind}>, langs array<string>, sizes array<long>, bytes binary, grams binary"),
                       "block", buckets)
    places = written(blocks.select("block", F.posexplode("docs").alias("place", "doc")).join(trusted.select("doc").distinct(), "doc", "left_semi")
                     .groupBy("block").agg(F.collect_list("place").alias("places")), "places")
    counts = written(blocks.select("block", "sizes", "bytes").join(places, "block")
                     .mapInArrow(_trusted_counts(ranges), "range int, grams binary, n binary")
                     .groupBy("range").applyInArrow(_sum_range, "g long, c long"), "counts")
    asked = written(blocks.select("block", "grams").mapInArrow(_split_ranges(ranges), "block long, range int, grams binary"), "asked")
    needed = written(asked.select("range", "grams").groupBy("range").applyInArrow(_distinct, "g long"), "needed")
    known = probabilities(counts, needed).withColumn("range", F.pmod(F.shiftright("g", SYMBOL_BITS), F.lit(ranges)).cast("int"))
    answers = (asked.groupBy("range").cogroup(known.groupBy("range")).applyInArrow(_answer, "block long, range int, p binary")
               .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "p"))).alias("answers")))
    return (blocks.join(answers, "block", "left").join(places, "block", "left")
            .select("docs", "langs", "sizes", "bytes", "grams", F.coalesce("answers", F.array().cast("array<struct<range:int,p:binary>>")).alias("answers"),
                    F.coalesce("places", F.array().cast("array<int>")).alias("places"))
            .mapInArrow(_score, f"doc {kind}, lang string, n_bytes long, score double, trusted boolean"))


def judge(scored: DataFrame) -> DataFrame:
    """``scored`` plus perplexity (per byte) and kept."""
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes"))
    scored = written(scored.withColumn("bits", bits), "scored")
    sketch = (scored.where("trusted and n_bytes > 0").groupBy("lang", F.floor(F.col("bits") * 1000).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    sketch = written(sketch, "sketch")

    def limit(*keys: str) -> DataFrame:
        q = F.percentile("bin", F.array(F.lit(MIDDLE), F.lit(HIGH)), F.col("n"))
        found = sketch.groupBy(*keys).agg(q.alias("q"), F.sum("n").alias("docs"))
        return found.select(*keys, "docs", ((F.get("q", F.lit(0)) + SPREAD * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))) / 1000).alias("limit"))

    every = limit().select("limit").scalar()
    own = limit("lang").where(F.col("docs") >= LEAST_DOCS).select(F.col("lang").alias("l"), F.col("limit").alias("own"))
    widest = F.coalesce("own", every, F.lit(float("inf"))) + SHORT / F.sqrt(F.col("n_bytes"))
    return (scored.join(own, F.col("lang").eqNullSafe(F.col("l")), "left")
            .select("doc", "lang", "trusted", "n_bytes", "score", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"),
                    F.coalesce(F.col("bits") <= widest, F.lit(False)).alias("kept")))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("doc"))
    scored = perplexities(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), trusted)
    return judge(scored).withColumnRenamed("doc", "doc_id")
