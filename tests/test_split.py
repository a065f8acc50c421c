import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.config import Splits
from ledgerflow.operators.split import (hash_rank, role_expr, split_cuts, split_membership,
                                        split_quotas, user_split)


def test_eight_users(spark):
    """The sizes that 8 users give at these shares."""
    users = spark.range(1, 9).withColumnRenamed("id", "user_id")
    mem = split_membership(user_split(users, Splits(train=0.65, val=0.15, test=0.2, overlap=0.5)))
    n = {r["split"]: r["n"] for r in mem.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 5, "val": 3, "test": 4}
    assert split_quotas(8, Splits(0.65, 0.15, 0.2, 0.5)) == {"n": 8, "train": 5, "val": 1, "test": 2, "overlap": 2}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40, 333])
@pytest.mark.parametrize("shares", [(0.7, 0.15, 0.15, 0.2), (0.5, 0.3, 0.2, 1.0), (0.9, 0.05, 0.05, 0.0)])
def test_every_user_has_one_role_and_overlap_is_shared(spark, n, shares):
    users = spark.range(n).withColumnRenamed("id", "user_id")
    roles = {r.user_id: r.role for r in user_split(users, Splits(*shares)).collect()}
    assert sorted(roles) == list(range(n))
    splits = {}
    for r in split_membership(user_split(users, Splits(*shares))).collect():
        splits.setdefault(r.user_id, set()).add(r.split)
    for user, role in roles.items():
        assert splits[user] == ({"train", "val", "test"} if role == "train_overlap" else {role})


def test_hash_rank_equals_global_ranking(spark):
    users = spark.range(0, 3000).withColumnRenamed("id", "user_id")
    h = F.md5(F.concat(F.lit("42"), F.lit(":"), F.col("user_id").cast("string")))
    ref = users.withColumn("_h", h).withColumn("r", F.row_number().over(Window.orderBy("_h", "user_id")))
    got = hash_rank(users, 42)
    diff = got.join(ref, "user_id").where(F.col("rank") != F.col("r")).count()
    assert diff == 0 and got.count() == 3000


def test_role_expression_equals_ranked_roles(spark):
    users = spark.range(0, 2500).withColumnRenamed("id", "user_id")
    sp = Splits()
    a = user_split(users, sp).select("user_id", F.col("role").alias("a"))
    cuts = split_cuts(users, sp)
    b = users.withColumn("b", role_expr(cuts))
    assert a.join(b, "user_id").where(F.col("a") != F.col("b")).count() == 0


def test_zero_overlap_is_allowed(spark):
    users = spark.range(0, 50).withColumnRenamed("id", "user_id")
    roles = user_split(users, Splits(overlap=0.0))
    assert roles.where("role = 'train_overlap'").count() == 0
    assert roles.count() == 50


def test_users_without_complete_rows_are_members(spark, tx):
    from ledgerflow.config import Cutoffs, DataConfig
    from ledgerflow.plans.prepare import prepare
    rows = [(u, f"2024-01-{d:02d}", "A", 10) for u in range(1, 6) for d in range(1, 28)]
    rows += [(7, "2024-01-05", None, 5), (8, None, "B", 5), (None, "2024-01-06", "A", 5)]
    cfg = DataConfig(interval="2D", cutoffs=Cutoffs("2024-01-01", "2024-01-15", "2024-01-19", "2024-01-22"))
    prep = prepare(tx(rows), cfg)
    users = {r.user_id for r in prep.roles.collect()}
    assert users == {1, 2, 3, 4, 5, 7, 8}
    seq = prep.sequences().where(F.col("user_id").isin(7, 8)).groupBy("split", "user_id").count().collect()
    assert seq and all(r["count"] == 2 for r in seq)  # [SOS, EOS] only
