"""Reproducible user-level train / val / test split with an overlap cohort.

Quotas follow the reference: ``n_temp = ceil((val + test) * n)`` users leave
train, ``n_test = ceil(test / (val + test) * n_temp)`` of them form test and
the rest val; ``n_overlap = ceil(train * overlap * n_train)`` train users
also join val and test.  Members are chosen by a seeded hash order
``md5(seed || ':' || user_id), user_id`` (same sizes as the reference, not
the same members -- numpy's permutation is not reproduced).

The global rank is exact without a single-partition sort: users are
histogrammed on the first four hex digits of their hash (at most 65,536
buckets, a proven bound, so the offsets table is broadcast), and the rank is
the bucket offset plus a row number inside the bucket.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Splits

ROLES = ("train", "train_overlap", "val", "test")


def distinct_users(df: DataFrame) -> DataFrame:
    """Every non-null user id -- also users whose rows all lack a brand or a
    date (they still span a row of the reference's dense grid and get an
    empty sequence)."""
    return df.where(F.col("user_id").isNotNull()).select("user_id").distinct()


def split_quotas(n: int, splits: Splits) -> dict:
    n_temp = math.ceil((splits.val + splits.test) * n) if n else 0
    n_train = n - n_temp
    n_test = math.ceil(splits.test / (splits.val + splits.test) * n_temp) if n_temp else 0
    n_val = n_temp - n_test
    n_overlap = math.ceil(splits.train * splits.overlap * n_train) if n_train else 0
    return {"n": n, "train": n_train, "val": n_val, "test": n_test, "overlap": n_overlap}


def hash_rank(users: DataFrame, seed: int, key: str = "user_id") -> DataFrame:
    """Exact 1-based rank of users by ``(md5(seed:key), key)``."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    u = users.select(key).withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 4))
    hist = u.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    # <= 16^4 rows: a single ordered window here is bounded by construction
    offsets = hist.select(
        "_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_off"))
    inner = Window.partitionBy("_p").orderBy("_h", key)
    return (u.join(F.broadcast(offsets), "_p")
             .withColumn("rank", F.col("_off") + F.row_number().over(inner))
             .drop("_h", "_p", "_off"))


def user_split(users: DataFrame, splits: Splits, n_users: int | None = None) -> DataFrame:
    """``(user_id, role, rank)`` with role in train / train_overlap / val / test."""
    n = users.count() if n_users is None else n_users
    q = split_quotas(n, splits)
    ranked = hash_rank(users, splits.seed)
    r = F.col("rank")
    t, v, o = q["test"], q["test"] + q["val"], q["test"] + q["val"] + q["overlap"]
    role = (F.when(r <= t, "test").when(r <= v, "val")
            .when(r <= o, "train_overlap").otherwise("train"))
    return ranked.withColumn("role", role).select("user_id", "role", "rank")


def split_membership(roles: DataFrame) -> DataFrame:
    """``(user_id, split)``: val = val-only + overlap, test = test-only +
    overlap, train = train + overlap (a narrow explode, no shuffle)."""
    return roles.select("user_id", F.explode(splits_of(F.col("role"))).alias("split"))


def _hash_cols(users: DataFrame, seed: int, key: str = "user_id") -> DataFrame:
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))
    return users.select(key).withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 4))


def split_cuts(users: DataFrame, splits: Splits, n_users: int | None = None, hist=None) -> dict:
    """Hash keys ``(md5, user_id)`` of the users at the three cut ranks.

    With them a user's role is a pure function of its own key, so rows are
    assigned to splits by an expression instead of a join with the member
    table.  Work: one histogram of hash prefixes (at most 16^4 rows reach the
    driver) and one small window inside the (at most three) prefixes that
    hold a cut rank.
    """
    u = _hash_cols(users, splits.seed)
    if hist is None:  # [(prefix, users)], unless the caller already has it
        hist = u.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).collect()
    hist = sorted((p, c) for p, c in hist)
    n = sum(c for _, c in hist) if n_users is None else n_users
    q = split_quotas(n, splits)
    ranks = {"test": q["test"], "val": q["test"] + q["val"],
             "train_overlap": q["test"] + q["val"] + q["overlap"]}
    where, off = {}, 0
    for p, c in hist:
        for role, r in ranks.items():
            if off < r <= off + c:
                where[role] = (p, r - off)
        off += c
    cuts = {role: None for role in ranks}
    if where:
        prefixes = sorted({p for p, _ in where.values()})
        w = Window.partitionBy("_p").orderBy("_h", "user_id")
        sub = u.where(F.col("_p").isin(prefixes)).withColumn("_rn", F.row_number().over(w))
        wanted = [(p, l) for p, l in where.values()]
        cond = None
        for p, l in wanted:
            c = (F.col("_p") == p) & (F.col("_rn") == l)
            cond = c if cond is None else cond | c
        found = {(r["_p"], r["_rn"]): (r["_h"], r["user_id"]) for r in sub.where(cond).collect()}
        for role, pl in where.items():
            cuts[role] = found[pl]
    return {"quotas": q, "cuts": cuts, "seed": splits.seed}


def hash_prefix(seed: int, key: str = "user_id") -> Column:
    """First four hex digits of the user's split hash (NULL for a NULL id)."""
    return F.substring(F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string"))), 1, 4)


def role_expr(cuts: dict, key: str = "user_id") -> Column:
    """Role of a user from its hash key and the cut keys (no join)."""
    h = F.md5(F.concat(F.lit(str(cuts["seed"])), F.lit(":"), F.col(key).cast("string")))

    def le(cut):
        if cut is None:
            return F.lit(False)
        ch, cu = cut
        return (h < F.lit(ch)) | ((h == F.lit(ch)) & (F.col(key) <= F.lit(cu)))

    c = cuts["cuts"]
    return (F.when(le(c["test"]), "test").when(le(c["val"]), "val")
            .when(le(c["train_overlap"]), "train_overlap").otherwise("train"))


def splits_of(role: Column) -> Column:
    """Array of the splits a role belongs to."""
    return (F.when(role == "train_overlap", F.array(F.lit("train"), F.lit("val"), F.lit("test")))
            .when(role == "train", F.array(F.lit("train")))
            .otherwise(F.array(role)))
