"""Connected components of an edge table by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a vertex is tied to the vertex's smallest neighbour or itself."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of ``edges`` (columns a, b): the smallest id it reaches.

    Each step is partial aggregates and joins by vertex; a vertex with very many neighbours is
    split by AQE's skew join. Steps end when a step changes nothing, after about the logarithm of
    the longest chain."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionAll(
        now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges and two order-free checksums."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())
