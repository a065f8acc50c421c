"""Lookups in tables above the broadcast bound: hot keys go apart, results stay those of a left join."""
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import joins
from ledgerflow.operators.encoders import BrandVocab, MinMaxEncoder


@pytest.fixture
def skewed(spark):
    """80,000 rows: half of one brand, a tenth without a brand, the rest of 4,000 brands."""
    n = F.col("id")
    brand = (F.when(n % 2 == 0, "hot").when(n % 10 == 1, None)
             .otherwise(F.concat(F.lit("b"), (F.floor(n / 2) % 4000).cast("string"))))
    return spark.range(80_000, numPartitions=8).select(
        n.alias("user_id"), (n % 5).alias("k"), brand.alias("brand"), (n % 97).cast("double").alias("amount"))


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda table, limit=0: False)


def table_of(df):
    return df.where("brand is not null and brand <> 'b7'").groupBy(F.col("brand").alias("_b")).agg(F.count("*").alias("n"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_keys_are_the_frequent_ones(skewed):
    assert joins.hot_keys(skewed, "brand") == ["hot"]
    assert joins.hot_keys(skewed.where("brand <> 'hot'"), "brand") == []
    assert joins.hot_keys(skewed.limit(0), "brand") == []
    assert joins.hot_keys(skewed.where("brand is null"), "brand") == []


def test_hot_keys_are_bounded(skewed):
    few = skewed.select((F.col("user_id") % 3).alias("key"))
    assert sorted(joins.hot_keys(few, "key", most=4)) == [0, 1, 2]
    assert len(joins.hot_keys(skewed.select((F.col("user_id") % 16).alias("key")), "key", most=8)) <= 8


@pytest.mark.parametrize("limit", [0, joins.BROADCAST_BYTES])
def test_same_rows_as_a_left_join(skewed, limit):
    table = table_of(skewed).persist()
    want = skewed.join(table, skewed.brand == table["_b"], "left").drop("_b")
    for df in (skewed, skewed.limit(0), skewed.where("brand = 'hot'"), skewed.where("brand is null")):
        got = joins.lookup(df, table, "brand", "_b", limit)
        assert got.columns == want.columns
        keep = rows(want.join(df.select("user_id"), "user_id", "left_semi")) if df is not skewed else rows(want)
        assert rows(got) == keep
    empty = joins.lookup(skewed, table.where("n < 0"), "brand", "_b", limit)
    assert empty.count() == 80_000 and empty.where("n is not null").count() == 0


def test_no_task_holds_the_hot_brand(spark, skewed):
    """One brand on half of all rows: no task above three times the median."""
    table = table_of(skewed).persist()
    table.count()
    was = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = [r["c"] for r in joins.lookup(skewed, table, "brand", "_b", limit=0).groupBy(
            F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
        plain = [r["c"] for r in skewed.join(table, F.col("brand") == F.col("_b"), "left").groupBy(
            F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    assert sum(sizes) == sum(plain) == 80_000
    assert max(sizes) <= 3 * statistics.median(sizes)
    assert max(plain) > 3 * statistics.median(plain)


def test_statistics_choose(spark, skewed):
    table = table_of(skewed).persist()
    table.count()
    assert joins.planned_bytes(table) < 1 << 20
    assert joins.fits_broadcast(table) and not joins.fits_broadcast(table, 100)
    # an estimate above the limit is checked by filling the table's storage
    late = spark.range(10).selectExpr("explode(sequence(1, 50)) x").crossJoin(spark.range(1000)).limit(5).persist()
    assert joins.fits_broadcast(late, 4096)


def test_encoders_give_the_same_without_broadcast(skewed, no_broadcast, monkeypatch):
    vocab = BrandVocab(top_n=100).fit(skewed, "brand")
    scaler = MinMaxEncoder(group_by="brand").fit(skewed, "amount")

    def all_of():
        coded = vocab.transform(skewed, "brand", "brand_id")
        return (rows(coded), rows(vocab.inverse(coded.select("user_id", "brand_id"), "brand_id", "back")),
                rows(scaler.transform(skewed, "amount", "scaled")), rows(scaler.inverse(skewed, "amount", "back")))

    apart = all_of()
    monkeypatch.undo()
    assert apart == all_of()
