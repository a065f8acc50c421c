"""Batches, padding and masks over long-form sequences.

Batches hold exactly ``batch_size`` users of a split (the last one what is
left).  A user's place in a split is the exact rank of a seeded hash: the
offset of the hash's first four hex digits (at most 16^4 counts per split, so
the offsets are broadcast) plus a row number among the users that share them,
so no window spans a split.  Validation and test keep that order in every
epoch.  Train users change places: :func:`shuffled_place` is a keyed bijection
on 0 .. n-1, so an epoch's batches are an expression over places that are
ranked once -- no epoch sorts or shuffles the users again.

Padding repeats each sequence's last element (its end token) up to the batch
maximum length; the mask is ``false`` on real elements and ``true`` on
padding (the reference's code, whose consumer ignores ``true`` positions).
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Rounds of the permutation: each one swaps about half of the pairs it makes.
ROUNDS = 24


def shuffled_place(place: Column, n: Column, seed: int, epoch: int) -> Column:
    """The place of ``place`` (0 .. n-1) in the permutation that (seed, epoch) names.

    A swap-or-not shuffle: a round pairs every place x with key - x (mod n) and swaps the pair or
    not, by one bit of a hash of the pair's greater place.  Each round is its own inverse, so the
    whole is a bijection for any n, without a table of the places."""
    rounds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(int(hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest()[:13], 16)).alias("key"))
                       for i in range(ROUNDS)])

    def swap(x, r):
        other = F.pmod(r["key"] - x, n)
        pair = F.concat_ws(":", F.lit(f"{seed}:{epoch}"), r["i"].cast("string"), F.greatest(x, other).cast("string"))
        return F.when(F.substring(F.md5(pair), 1, 1) < "8", other).otherwise(x)

    return F.aggregate(rounds, place.cast("bigint"), swap)


def split_places(members: DataFrame, seed: int = 42) -> DataFrame:
    """``(split, user_id, place, n_split)``: dense places from 0 in each split, by seeded hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("split"), F.col("user_id").cast("string")))
    m = members.select("split", "user_id", h.alias("_h")).withColumn("_p", F.substring("_h", 1, 4))
    counts = m.groupBy("split", "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("split").orderBy("_p")  # <= 16^4 rows per split
    offsets = counts.select("split", "_p", (F.sum("_c").over(before) - F.col("_c")).alias("_off"),
                            F.sum("_c").over(Window.partitionBy("split")).alias("n_split"))
    inner = Window.partitionBy("split", "_p").orderBy("_h", "user_id")
    return (m.join(F.broadcast(offsets), ["split", "_p"])
             .select("split", "user_id", (F.col("_off") + F.row_number().over(inner) - 1).alias("place"), "n_split"))


def epoch_batches(places: DataFrame, batch_size: int = 32, seed: int = 42, epoch: int = 0,
                  shuffled: tuple = ("train",)) -> DataFrame:
    """``(split, user_id, batch, slot)`` of one epoch, from places: a projection."""
    place = F.when(F.col("split").isin(*shuffled), shuffled_place(F.col("place"), F.col("n_split"), seed, epoch)
                   ).otherwise(F.col("place"))
    return places.withColumn("_at", place).select(
        "split", "user_id", F.floor(F.col("_at") / F.lit(batch_size)).cast("int").alias("batch"),
        F.pmod(F.col("_at"), F.lit(batch_size)).cast("int").alias("slot"))


def assign_batches(members: DataFrame, batch_size: int = 32, seed: int = 42, epoch: int = 0) -> DataFrame:
    """``(split, user_id, batch, slot)``: ``ceil(n / batch_size)`` batches per split."""
    return epoch_batches(split_places(members, seed), batch_size, seed, epoch)


def pad_and_mask(seq: DataFrame, batches: DataFrame, features) -> DataFrame:
    """Padded long form ``(split, batch, user_id, pos, <features>, mask)``."""
    features = list(features)
    lengths = seq.groupBy("split", "user_id").agg(F.max("pos").alias("_last"))
    lb = batches.join(lengths, ["split", "user_id"])
    wb = Window.partitionBy("split", "batch")
    lb = lb.withColumn("_len", F.col("_last") + 1).withColumn("_max", F.max("_len").over(wb))
    # the last element of a shorter sequence stands for itself and its padding
    at = F.when(F.col("pos") == F.col("_last"), F.sequence(F.col("pos"), F.col("_max") - 1)).otherwise(F.array("pos"))
    return (seq.join(lb.select("split", "user_id", "batch", "_last", "_max"), ["split", "user_id"])
               .withColumn("_at", F.explode(at))
               .select("split", "batch", "user_id", F.col("_at").alias("pos"), *features,
                       (F.col("_at") > F.col("_last")).alias("mask")))


def unbatch(padded: DataFrame, features) -> DataFrame:
    """Back to rows: only unmasked positions (framing tokens included)."""
    return padded.where(~F.col("mask")).select("split", "user_id", "pos", *features)


def collate_arrays(padded: DataFrame, features) -> DataFrame:
    """Per user: padded arrays and the mask array, ordered by position."""
    features = list(features)
    g = padded.groupBy("split", "batch", "user_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", *features, "mask"))).alias("_e"))
    return g.select("split", "batch", "user_id",
                    *[F.transform("_e", _field(f)).alias(f) for f in features],
                    F.transform("_e", lambda x: x["mask"]).alias("mask"))


def _field(name: str):
    """Element getter for ``transform`` (a two-argument lambda would be read
    as (element, index))."""
    return lambda x: x[name]
