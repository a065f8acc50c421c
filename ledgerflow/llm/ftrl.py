"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct buckets of its words, word pairs, word triples and pairs with one
word left out (``BUCKETS`` hash buckets). Training sees a bounded sample: the ``SAMPLE`` labelled
rows with the smallest hash of their id. Their features are derived on all executors; one task then
runs FTRL over them in that order, ``EPOCHS`` times, with per-coordinate rates and L1, so at most
``SAMPLE`` rows ever meet in it. The weights that L1 leaves (at most ``BUCKETS``) are broadcast,
and scoring is one narrow pass over whole texts.

Defined results: null and empty texts have no features and get the score of the intercept; labels
that are null or not 0/1, and null ids, teach nothing; a doc_id labelled twice counts as toxic if
one label says so, and if it has several texts it teaches with the smallest; without any usable
label every score is 0.5; repeated rows each get their row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import LOWER, Words, mix, slices, strings, table, with_struct, word_bytes
from ledgerflow.llm.wu_manber import SEPARATORS

BUCKETS = 1 << 20
SAMPLE = 24_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.0
THRESHOLD = 0.7


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence, by text."""
    data, offsets = strings(column)
    words = Words(LOWER[data], offsets, word_bytes(SEPARATORS))
    h, text = words.hashes, words.text_of()
    texts, found = [text], [h]
    for gap, seed in ((1, 1), (2, 2)):
        same = text[:-gap] == text[gap:]
        found.append(mix(h[:-gap] * np.uint64(2 * seed + 1) + h[gap:])[same])
        texts.append(text[:-gap][same])
    same = text[:-2] == text[2:]
    found.append(mix(mix(h[:-2] * np.uint64(7) + h[1:-1]) * np.uint64(5) + h[2:])[same])
    texts.append(text[:-2][same])
    return np.concatenate(texts), (np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64)


def _training_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text, bucket = features(part.column(part.schema.get_field_index("text")), buckets)
            key = np.unique(text * buckets + bucket)
            at = np.searchsorted(key, np.arange(part.num_rows + 1) * buckets).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array((key % buckets).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), lists],
                                             ["place", "label", "buckets"])
    return run


def fit_rows(rows: list[tuple[float, np.ndarray]], buckets: int, epochs: int, alpha: float, beta: float,
             l1: float, l2: float) -> tuple[float, np.ndarray]:
    """FTRL-proximal over (label, buckets) rows, in order. Returns the intercept and the weights."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for label, found in rows:
            i = np.append(found, buckets)
            w = weight(i)
            w[-1] = -z[buckets] / ((beta + np.sqrt(n[buckets])) / alpha + l2)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            if g:
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * w
                n[i] += g * g
    bias = -z[buckets] / ((beta + np.sqrt(n[buckets])) / alpha + l2)
    return float(bias), weight(np.arange(buckets)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, text: str = "text", key: str = "doc_id",
        label: str = "toxic", sample: int = SAMPLE, buckets: int = BUCKETS, epochs: int = EPOCHS,
        alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, buckets with a weight, their weights) learned from the labelled rows for which
    ``learn``, a condition on ``key``, holds."""
    place = F.xxhash64(F.col(key))
    chosen = (labels.where(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull())
              .select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), place.alias("place"))
              .orderBy("place", "key", "label").limit(sample)
              .groupBy("key", "place").agg(F.max("label").alias("label")))
    rows = (docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "key")  # at most ``sample`` rows
            .groupBy("key", "place", "label").agg(F.min("text").alias("text"))
            .select("place", "label", "text"))
    found = rows.mapInArrow(_training_rows(buckets), "place long, label double, buckets array<int>")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for batch in batches:
            at = batch.column("buckets").offsets.to_numpy()
            flat = batch.column("buckets").values.to_numpy()
            places, label_of = batch.column("place").to_pylist(), batch.column("label").to_pylist()
            data += [(p, y, flat[a:b]) for p, y, a, b in zip(places, label_of, at, at[1:])]
        data.sort(key=lambda x: x[0])
        if data:
            bias, w = fit_rows([(y, b) for _, y, b in data], buckets, epochs, alpha, beta, l1, l2)
            at = np.flatnonzero(w).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([at.tobytes()], pa.binary()),
                                              pa.array([w[at].tobytes()], pa.binary())], ["bias", "at", "w"])

    model = found.repartition(1).mapInArrow(train, "bias double, at binary, w binary").collect()
    if not model:
        return 0.0, np.zeros(0, np.int32), np.zeros(0, np.float32)
    return model[0]["bias"], np.frombuffer(model[0]["at"], np.int32), np.frombuffer(model[0]["w"], np.float32)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], *, text: str = "text",
          buckets: int = BUCKETS, name: str = "__toxic", drop: bool = False) -> DataFrame:
    """``docs`` plus a struct column ``name`` with ``score``, the probability of label 1; ``drop``
    leaves the text out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> dict[str, pa.Array]:
        bias, at, weight = shared.value
        w = np.zeros(buckets, np.float64)
        w[at] = weight
        text, bucket = features(column, buckets)
        used = w[bucket] != 0
        key = np.unique(text[used] * buckets + bucket[used])
        total = bias + np.bincount(key // buckets, w[key % buckets], len(column))
        return {"score": pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))}

    return with_struct(docs, text, name, T.StructType([T.StructField("score", T.DoubleType())]), work, drop)


def op7_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = fit(docs, table(spark, sf_dir, "labels"), fold != 1)
    return score(docs, model, drop=True).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.col("__toxic.score").alias("score"),
        (F.col("__toxic.score") >= THRESHOLD).cast("int").alias("predicted"))
