"""End-to-end data preparation as one set of DataFrame plans.

    scan -> bounds (2 scalars) -> bucket aggregate (shuffle by user/bucket/brand)
         -> user split (hash rank) -> fit encoders on the train input window
         -> input rows / target rows per split -> sequences and sparse targets

The bucket table and the user roles are reused by every later step, so they
are persisted once (they are far smaller than the raw scan).
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DataConfig
from ..functions.timecols import ts_lit
from ..session import checkpoint_dir
from ..functions.fixedpoint import exact_sums, settled
from ..operators.buckets import BucketSpec, bucket_aggregate, bucketize, fit_buckets
from ..operators.encoders import (ENCODERS, BrandVocab, MinMaxEncoder, NoOpEncoder, TimeDeltaEncoder,
                                  first_seen_key)
from ..operators.evaluate import LOSSES, align
from ..operators.joins import partitions_for
from ..operators.predict import PREDICTORS
from ..operators.sequences import SEQUENCE_BUILDERS, newest_rows, sequence_rows, target_cells
from ..operators.split import hash_prefix, role_expr, split_cuts, split_membership, splits_of

SPLITS = ("train", "val", "test")

# Raw rows for each partition of what is dealt out by user.
TASK_ROWS = 500_000


def _dt(x) -> dt.datetime:
    return x if isinstance(x, dt.datetime) else dt.datetime.fromisoformat(str(x))


def split_case(values: dict) -> Column:
    """CASE split WHEN 'train' THEN v_train ... END over literal values."""
    expr = None
    for s, v in values.items():
        lit = ts_lit(v) if isinstance(v, dt.datetime) else F.lit(v)
        expr = F.when(F.col("split") == s, lit) if expr is None else expr.when(F.col("split") == s, lit)
    return expr


@dataclass
class Prepared:
    cfg: DataConfig
    spec: BucketSpec
    buckets: DataFrame
    roles: DataFrame
    members: DataFrame
    encoders: dict = field(default_factory=dict)
    n_users: int = 0
    cuts: dict | None = None
    max_user_rows: int | None = None  # raw rows of the busiest user: bounds any sequence
    window_cells: DataFrame | None = None  # align='strict': cells built per window
    partitions: int | None = None  # of what is dealt out by user; None: the session's number will do
    held: list = field(default_factory=list)  # further tables kept in storage until unpersist()

    # windows -------------------------------------------------------------
    def input_start(self) -> dict:
        return {s: _dt(self.cfg.cutoffs.in_start) for s in SPLITS}

    def target_start(self) -> dict:
        return {s: _dt(self.cfg.cutoffs.target_start(s)) for s in SPLITS}

    def target_end(self) -> dict:
        return {s: self.spec.advance(v) for s, v in self.target_start().items()}

    def role(self) -> Column:
        return F.col("role") if "role" in self.buckets.columns else role_expr(self.cuts)

    def _rows_in(self, starts: dict, ends: dict) -> DataFrame:
        """Bucket rows tagged with each split their user belongs to.  The
        role is an expression of the user id (see ``split_cuts``), so the
        bucket table is not joined with -- nor shuffled for -- the members."""
        j = self.buckets.withColumn("split", F.explode(splits_of(self.role()))).drop("role")
        return j.where((F.col("date") >= split_case(starts)) & (F.col("date") < split_case(ends)))

    def _strict(self, kind: str) -> DataFrame:
        return self.window_cells.where(F.col("window_kind") == kind).drop("window_kind")

    def input_rows(self) -> DataFrame:
        """Bucket rows of each split's users in ``[in_start, target_start)``."""
        if self.window_cells is not None:
            return self._strict("input")
        return self._rows_in(self.input_start(), self.target_start())

    def target_rows(self) -> DataFrame:
        """Bucket rows in ``[target_start, target_start + interval)``."""
        if self.window_cells is not None:
            return self._strict("target")
        return self._rows_in(self.target_start(), self.target_end())

    def fit_rows(self) -> DataFrame:
        if self.window_cells is not None:
            return self._strict("input").where(F.col("split") == "train").drop("split")
        c = self.cfg.cutoffs
        b = self.buckets.where(self.role().isin("train", "train_overlap")).drop("role")
        return b.where((F.col("date") >= ts_lit(_dt(c.in_start))) & (F.col("date") < ts_lit(_dt(c.train))))

    # products --------------------------------------------------------------
    def sequences(self, features=None, max_len: int | None = None) -> DataFrame:
        """Framed input sequences; ``max_len`` bounds their length, the two tokens included, and
        keeps the newest rows."""
        feats = list(features or self.cfg.input_features)
        if max_len is not None and max_len < 2:
            raise ValueError("a sequence has its two tokens at least: max_len >= 2")
        rows = self.input_rows() if max_len is None else newest_rows(self.input_rows(), max_len - 2)
        return sequence_rows(rows, self.members, self.encoders, feats,
                             self.input_start(), self.target_start(), longest=self.max_user_rows, partitions=self.partitions)

    def targets(self, ratio: float = 1.0, kind: str | None = None) -> DataFrame:
        """Sparse target cells; ``kind`` picks a registered multi-hot builder
        (default: all columns)."""
        if kind is not None:
            return SEQUENCE_BUILDERS.get(kind)(self.target_rows(), self.members, self.encoders["brand"],
                                               self.encoders.get("amount"), ratio)
        return target_cells(self.target_rows(), self.members, self.encoders["brand"],
                            self.encoders.get("amount"), ratio)

    def n_intervals(self) -> Column:
        """Intervals in each split's input window."""
        c = self.cfg.cutoffs
        return split_case({s: self.spec.count_in_window(c.in_start, c.target_start(s)) for s in SPLITS})

    def configured_loss(self, denominator: str = "all") -> DataFrame:
        """``(split, loss)``: the mean over all cells of the loss that the
        configuration names, between its predictor and its target builder."""
        cfg, brand = self.cfg, self.encoders["brand"]
        predicted = PREDICTORS.get(cfg.predictor)(self.input_rows(), brand, self.n_intervals(), denominator)
        cells = align(predicted, self.targets(kind=cfg.output_type))
        sums = cells.groupBy("split").agg(LOSSES.get(cfg.loss)().alias("_l"))
        users = self.members.groupBy("split").agg(F.count(F.lit(1)).alias("_n"))
        mean = F.coalesce(settled(F.col("_l")), F.lit(0.0)) / (F.col("_n") * F.lit(brand.size)).cast("double")
        return users.join(sums, "split", "left").select("split", mean.alias("loss"))

    def unpersist(self):
        """Release every table that the preparation keeps in storage."""
        for df in (self.buckets, self.window_cells, *self.held):
            if df is not None:
                df.unpersist()


def _materialize(df: DataFrame, how: str) -> DataFrame:
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)  # reliable copy in the shared folder
    return df


def strict_window_cells(tx: DataFrame, spec: BucketSpec, role: Column, starts: dict, ends: dict,
                        t_starts: dict, t_ends: dict) -> DataFrame:
    """Cells per (window kind, split, user, bucket, brand) built only from raw
    rows inside each split's input / target window, so a bucket straddling a
    cutoff contributes only its rows on the window's side (no future rows
    leak into the input).  One aggregate for all splits and both kinds."""
    lo, hi = min(starts.values()), max(t_ends.values())
    raw = tx.where((F.col("date") >= ts_lit(lo)) & (F.col("date") < ts_lit(hi)))  # pushed to the scan
    rows = bucketize(raw, spec).withColumn("split", F.explode(splits_of(role)))
    kind = (F.when((F.col("date") >= split_case(starts)) & (F.col("date") < split_case(ends)), "input")
            .when((F.col("date") >= split_case(t_starts)) & (F.col("date") < split_case(t_ends)), "target"))
    keyed = rows.withColumn("window_kind", kind).where(F.col("window_kind").isNotNull()).groupBy(
        "window_kind", "split", "user_id", "k", "brand")
    return exact_sums(keyed, {"amount": F.col("amount")}, F.min("date").alias("date"), zero=True)


def prepare(tx: DataFrame, cfg: DataConfig, persist: bool = True, spec: BucketSpec | None = None,
            fit: bool = True, materialize: str | None = None, align: str = "bucket") -> Prepared:
    """Bucket, split and (optionally) fit.  Two scans of the source: a
    per-user summary (bucket bounds and the user list in one pass) and the
    bucket aggregate, pruned to the windows the splits use.

    ``materialize``: ``'persist'`` (default when ``persist``) caches the
    bucket table -- lost blocks are recomputed from a short lineage;
    ``'checkpoint'`` writes it to ``spark.checkpoint.dir`` and cuts the
    lineage (long sweeps on clusters that lose executors); ``'none'``.

    ``align``: ``'bucket'`` (default, as the reference) keeps a bucket
    whole on the side of its first date; ``'strict'`` builds each window's
    cells from the raw rows inside the window only."""
    if align not in ("bucket", "strict"):
        raise ValueError("align must be 'bucket' or 'strict'")
    how = materialize or ("persist" if persist else "none")
    summary = tx.groupBy("user_id").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n"))
    if how != "none":
        summary = summary.persist(StorageLevel.MEMORY_AND_DISK)
    # one small aggregate (<= 16^4 + 1 rows) gives the bucket bounds, the
    # row counts and the split's hash-prefix histogram
    by_prefix = summary.groupBy(hash_prefix(cfg.splits.seed).alias("_p")).agg(
        F.count("user_id").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.when(F.col("user_id").isNotNull(), F.col("n"))).alias("mx"), F.sum("n").alias("n")).collect()
    hist = [(r["_p"], r["c"]) for r in by_prefix if r["_p"] is not None]
    los = [r["lo"] for r in by_prefix if r["lo"] is not None]
    his = [r["hi"] for r in by_prefix if r["hi"] is not None]
    mxs = [r["mx"] for r in by_prefix if r["mx"] is not None]
    max_rows = max(mxs) if mxs else 0
    if spec is None:
        spec = fit_buckets(tx, cfg.interval, origin=min(los), end=max(his)) if los \
            else fit_buckets(tx, cfg.interval)
    c = cfg.cutoffs
    last_end = max(spec.advance(_dt(t)) for t in (c.train, c.val, c.test))
    users = summary.where(F.col("user_id").isNotNull()).select("user_id")
    cuts = split_cuts(users, cfg.splits, hist=hist)  # the histogram also yields the user count
    n = cuts["quotas"]["n"]
    roles = users.withColumn("role", role_expr(cuts))
    # the role travels with each bucket row: computed once, before caching
    buckets = bucket_aggregate(tx, spec, window=(_dt(c.in_start), last_end)).withColumn("role", role_expr(cuts))
    buckets = _materialize(buckets, how)
    members = split_membership(roles)
    prep = Prepared(cfg, spec, buckets, roles, members, {}, n, cuts, max_rows,
                    partitions=partitions_for(tx.sparkSession, sum(r["n"] for r in by_prefix), TASK_ROWS))
    if how != "none":
        prep.held.append(summary)
    if align == "strict":
        prep.window_cells = _materialize(strict_window_cells(
            tx, spec, role_expr(cuts), prep.input_start(), prep.target_start(),
            prep.target_start(), prep.target_end()), how)
    if fit:
        fit_encoders(prep)
    return prep


def fit_encoders(prep: Prepared) -> Prepared:
    """Fit brand vocabulary, amount scaler and time-delta encoder with ONE
    aggregate over the train input window: per brand the row count, first
    appearance, amount min / max and earliest date.  The global parameters
    are reduced from that small table."""
    cfg = prep.cfg
    rows = prep.fit_rows()
    stats = rows.groupBy("brand").agg(
        F.count(F.lit(1)).alias("cnt"), first_seen_key(("user_id", "k")).alias("first_seen"),
        F.min("amount").cast("double").alias("lo"), F.max("amount").cast("double").alias("hi"),
        F.min("date").alias("e"))
    stats = stats.persist(StorageLevel.MEMORY_AND_DISK)
    prep.held.append(stats)
    g = stats.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("e").alias("e"),
                  F.count(F.lit(1)).alias("n_brands")).first()
    brand = BrandVocab(top_n=cfg.brand.top_n, freq_threshold=cfg.brand.freq_threshold).fit_stats(
        stats, n_brands=g["n_brands"])
    kind = ENCODERS.get(cfg.amount_encoder)
    if issubclass(kind, NoOpEncoder):
        amount = kind("amount").fit(rows, "amount")
    elif not issubclass(kind, MinMaxEncoder):
        amount = kind().fit(rows, "amount")
    elif cfg.amount_group_by:
        amount = kind(feature_range=cfg.feature_range, clip=cfg.clip, group_by=cfg.amount_group_by).fit(rows, "amount")
    else:
        amount = kind(feature_range=cfg.feature_range, clip=cfg.clip).set_range(g["lo"], g["hi"])
    prep.held += [df for df in vars(brand).values() if isinstance(df, DataFrame)]
    prep.encoders = {"brand": brand, "amount": amount, "date": TimeDeltaEncoder().set_earliest(g["e"])}
    return prep


def noop_encoders(start=None, end=None) -> dict:
    return {"brand": NoOpEncoder("brand"), "amount": NoOpEncoder("amount"),
            "date": NoOpEncoder("time", start, end)}
