"""The fitted state and the products of a preparation as tables, and back.

What a later run needs beside the sequences and targets -- who is in which split, the vocabulary, the
scaler's bounds, the earliest date -- is a handful of small tables, so a cache hit restores encoders
that transform and invert as the fitted ones did, without a scan of the transactions.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DataConfig
from ..functions.scaling import minmax_param_cols
from ..operators.encoders import ENCODERS, BrandVocab, MinMaxEncoder, NoOpEncoder, TimeDeltaEncoder
from ..operators.joins import materialize_small
from ..operators.split import split_membership
from .prepare import Prepared


def state_tables(prep: Prepared) -> dict:
    """Tables by name: sequences, targets, roles, overlap_users, vocab, scaler, clock."""
    amount, spark = prep.encoders["amount"], prep.buckets.sparkSession
    if isinstance(amount, NoOpEncoder):
        scaler = spark.createDataFrame([], "grp string, lo double, hi double")
    elif amount.group_by:
        scaler = amount.params.select(F.col(amount.group_by).cast("string").alias("grp"), "lo", "hi")
    else:
        scaler = spark.createDataFrame([(None, amount.lo, amount.hi)], "grp string, lo double, hi double")
    return {
        "sequences": prep.sequences(), "targets": prep.targets(), "roles": prep.roles,
        "overlap_users": prep.roles.where(F.col("role") == "train_overlap").select("user_id"),
        "vocab": prep.encoders["brand"].vocab, "scaler": scaler,
        "clock": spark.createDataFrame([(prep.encoders["date"].earliest,)], "earliest timestamp_ntz"),
    }


@dataclass
class Restored:
    """A preparation's products and encoders, read from tables."""
    cfg: DataConfig
    sequences: DataFrame
    targets: DataFrame
    roles: DataFrame
    members: DataFrame
    overlap_users: DataFrame
    encoders: dict


def restore(cfg: DataConfig, tables: dict) -> Restored:
    brand = BrandVocab(top_n=cfg.brand.top_n, freq_threshold=cfg.brand.freq_threshold)
    brand.vocab, brand.size = materialize_small(tables["vocab"])
    brand.fitted = True
    kind = ENCODERS.get(cfg.amount_encoder)
    if issubclass(kind, NoOpEncoder):
        amount = kind("amount")
        amount.fitted = True
    elif not issubclass(kind, MinMaxEncoder):
        raise ValueError(f"no table form for the state of the encoder {cfg.amount_encoder!r}")
    else:
        amount = kind(feature_range=cfg.feature_range, clip=cfg.clip, group_by=cfg.amount_group_by)
        if cfg.amount_group_by:
            scale, offset = minmax_param_cols(F.col("lo"), F.col("hi"), cfg.feature_range)
            params = tables["scaler"].select(F.col("grp").alias(cfg.amount_group_by), "lo", "hi", scale.alias("_scale"), offset.alias("_offset"))
            amount.params, amount.n_groups = materialize_small(params)
            amount.fitted = True
        else:
            row = tables["scaler"].first()
            amount.set_range(row["lo"], row["hi"])
    date = TimeDeltaEncoder().set_earliest(tables["clock"].first()["earliest"])
    return Restored(cfg, tables["sequences"], tables["targets"], tables["roles"], split_membership(tables["roles"]),
                    tables["overlap_users"], {"brand": brand, "amount": amount, "date": date})
