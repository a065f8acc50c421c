"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the
matching DuckDB oracle SQL.  Every query reads the supplied tables in full.

Array / map results are returned in long form (one row per element or cell)
so that they compare row by row with the oracle.
"""
from __future__ import annotations

import datetime as dt
import re
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EV_CONFIG, TX_CONFIG, DataConfig
from ..functions.fixedpoint import exact_sums
from ..operators.buckets import (bucket_aggregate, bucket_coverage, bucket_label, date_window,
                                 dense_grid_summary, fit_buckets)
from ..operators.encoders import BrandVocab, MinMaxEncoder, NoOpEncoder
from ..operators.split import distinct_users, role_expr, split_membership, splits_of, user_split
from ..sources.views import ev_view, tx_view
from . import oracle as O
from .prepare import Prepared, prepare, split_case

QUERIES: dict = {}
ORACLE: dict = {}


# Sums that several oracles share, named in their texts as @NAME@.
_SHARED = {
    "AE": O.exact_sum("CASE WHEN abs(t) > 0 THEN abs(p - t) END"),
    "PE": O.exact_sum("CASE WHEN abs(t) > 0 AND abs(p) > 0 THEN abs((t - p) / t) END")
    + " / CAST(count(*) FILTER (WHERE abs(t) > 0 AND abs(p) > 0) AS DOUBLE)",
    "L1": O.exact_sum("abs(p - t)"),
    "L2": O.exact_sum("(p - t) * (p - t)"),
    "BM": O.exact_sum("l1 / CAST(n * (SELECT v FROM vsize) AS DOUBLE)"),
}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = re.sub(r"@(\w+)@", lambda m: _SHARED[m.group(1)], sql)
        return fn
    return deco


def _view(spark, sf_dir, view):
    return tx_view(spark, sf_dir) if view == "tx" else ev_view(spark, sf_dir)


def _prep(spark, sf_dir, view="tx", cfg: DataConfig = TX_CONFIG, fit=True) -> Prepared:
    return prepare(_view(spark, sf_dir, view), cfg, fit=fit)


_TX_C = TX_CONFIG.cutoffs
_IN_START = dt.datetime.fromisoformat(_TX_C.in_start)
_TRAIN_T = dt.datetime.fromisoformat(_TX_C.train)
EV_BUCKET_INTERVAL = "7D"
FREQ_THRESHOLD = 0.04

# ---------------------------------------------------------------- sources
@register("read_transactions", f"{O.SOURCES['tx']}")
def q_read_transactions(spark, sf):
    """The view through CSV: written with its columns in another order and one
    more, read by header name."""
    import uuid
    from ..session import scratch_path
    from ..sources.views import read_transactions
    path = scratch_path(spark, "ledgerflow-csv", uuid.uuid4().hex)
    tx_view(spark, sf).select("amount", "brand", F.lit("x").alias("note"), "user_id", "date").write.option("header", True).csv(path)
    return read_transactions(spark, path)


# ---------------------------------------------------------------- buckets
_CELLS = "SELECT user_id, k, brand, amount, date FROM cells"


@register("tx_bucket", O.chain("tx", TX_CONFIG) + _CELLS)
def q_tx_bucket(spark, sf):
    tx = tx_view(spark, sf)
    return bucket_aggregate(tx, fit_buckets(tx, TX_CONFIG.interval))


@register("ev_bucket", O.chain("ev", EV_CONFIG, interval=EV_BUCKET_INTERVAL) + _CELLS)
def q_ev_bucket(spark, sf):
    ev = ev_view(spark, sf)
    return bucket_aggregate(ev, fit_buckets(ev, EV_BUCKET_INTERVAL))


@register("tx_bucket_weekly", O.chain("tx", TX_CONFIG, interval="1W") + _CELLS)
def q_tx_bucket_weekly(spark, sf):
    tx = tx_view(spark, sf)
    return bucket_aggregate(tx, fit_buckets(tx, "1W"))


_MONTHLY = replace(TX_CONFIG, interval="MS")


@register("tx_bucket_monthly", O.chain("tx", _MONTHLY) + _CELLS)
def q_tx_bucket_monthly(spark, sf):
    """Buckets between first days of months."""
    tx = tx_view(spark, sf)
    return bucket_aggregate(tx, fit_buckets(tx, _MONTHLY.interval))


@register("multi_hot_amount_monthly", O.targets_sql("tx", _MONTHLY) + "SELECT split, user_id, brand_id, amount, amount_raw FROM tcells")
def q_multi_hot_amount_monthly(spark, sf):
    """Targets of the month after each split's cutoff, from monthly buckets."""
    return _prep(spark, sf, cfg=_MONTHLY).targets().select("split", "user_id", "brand_id", "amount", "amount_raw")


def _label_sql():
    W = 28 * 86_400_000_000
    def txt(e):
        return (f"strftime({e}, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us({e}) % 1000000 <> 0 "
                f"THEN '.' || lpad(CAST(epoch_us({e}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END")
    lo = f"(spec.lo + to_microseconds((k - 1) * {W}))"
    hi = f"(spec.lo + to_microseconds(k * {W}))"
    return (O.chain("tx", TX_CONFIG) +
            f"SELECT k, (CASE WHEN k = 1 THEN '[' ELSE '(' END) || {txt(lo)} || ', ' || {txt(hi)} || ']' "
            f"AS time_interval, count(*) AS n_cells FROM cells, spec GROUP BY k, spec.lo")


@register("bucket_label", _label_sql())
def q_bucket_label(spark, sf):
    tx = tx_view(spark, sf)
    spec = fit_buckets(tx, TX_CONFIG.interval)
    g = bucket_aggregate(tx, spec).groupBy("k").agg(F.count(F.lit(1)).alias("n_cells"))
    return bucket_label(g, spec).select("k", "time_interval", "n_cells")


@register("bucket_coverage", O.chain("ev", EV_CONFIG, interval=EV_BUCKET_INTERVAL) + f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE inside) AS n_binned,
       count(*) FILTER (WHERE NOT inside) AS n_dropped,
       {O.money_sum('CASE WHEN inside THEN amount END')} AS amount_binned
FROM (SELECT r.amount, r.date >= spec.lo AND {O.bucket_idx('r.date', 7 * 86_400_000_000)} <= spec.m AS inside
      FROM raw r, spec)""")
def q_bucket_coverage(spark, sf):
    ev = ev_view(spark, sf)
    return bucket_coverage(ev, fit_buckets(ev, EV_BUCKET_INTERVAL))


@register("densify", O.chain("tx", TX_CONFIG) + f"""
SELECT u.n_users, spec.m AS n_buckets, u.n_brands, u.n_users * u.n_brands * spec.m AS n_cells,
       f.n_nonempty, u.n_users * u.n_brands * spec.m - f.n_nonempty AS n_empty, f.amount
FROM (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT brand) AS n_brands FROM src) u,
     (SELECT count(*) AS n_nonempty, {O.money_sum('amount')} AS amount FROM cells) f,
     spec""")
def q_densify(spark, sf):
    tx = tx_view(spark, sf)
    return dense_grid_summary(tx, fit_buckets(tx, TX_CONFIG.interval))


@register("date_window", O.chain("tx", TX_CONFIG) +
          f"SELECT user_id, k, brand, amount, date FROM cells WHERE date >= {O.ts(_IN_START)} AND date < {O.ts(_TRAIN_T)}")
def q_date_window(spark, sf):
    tx = tx_view(spark, sf)
    return bucket_aggregate(tx, fit_buckets(tx, TX_CONFIG.interval), window=(_IN_START, _TRAIN_T))

# ---------------------------------------------------------------- windows / split
_TX_CHAIN = O.chain("tx", TX_CONFIG)


def _split_windows_spark(prep: Prepared) -> DataFrame:
    inp = prep.input_rows().withColumn("window_kind", F.lit("input"))
    tgt = prep.target_rows().withColumn("window_kind", F.lit("target"))
    return exact_sums(inp.unionByName(tgt).groupBy("split", "window_kind"), {"amount": F.col("amount")},
                      F.count(F.lit(1)).alias("n_cells"), F.countDistinct("user_id").alias("n_users"), zero=True)


@register("split_windows", _TX_CHAIN + f"""
SELECT split, window_kind, count(*) AS n_cells, count(DISTINCT user_id) AS n_users, {O.money_sum('amount')} AS amount
FROM (SELECT *, 'input' AS window_kind FROM inrows UNION ALL SELECT *, 'target' AS window_kind FROM trows)
GROUP BY split, window_kind""")
def q_split_windows(spark, sf):
    return _split_windows_spark(_prep(spark, sf, fit=False))


@register("rows_by_split", _TX_CHAIN + "SELECT m.split, c.user_id, c.k, c.brand, c.amount, c.date "
          "FROM cells c JOIN members m ON c.user_id = m.user_id")
def q_rows_by_split(spark, sf):
    prep = _prep(spark, sf, fit=False)  # bounds and cut keys from one summary per user
    cells = bucket_aggregate(tx_view(spark, sf), prep.spec)
    return cells.withColumn("split", F.explode(splits_of(role_expr(prep.cuts)))).select(
        "split", "user_id", "k", "brand", "amount", "date")


@register("distinct_users", _TX_CHAIN + "SELECT user_id FROM users")
def q_distinct_users(spark, sf):
    return distinct_users(tx_view(spark, sf))


@register("user_split", _TX_CHAIN + "SELECT user_id, role, rank FROM roles")
def q_user_split(spark, sf):
    return user_split(distinct_users(tx_view(spark, sf)), TX_CONFIG.splits)


@register("overlap_users", _TX_CHAIN + "SELECT user_id FROM roles WHERE role = 'train_overlap'")
def q_overlap_users(spark, sf):
    roles = user_split(distinct_users(tx_view(spark, sf)), TX_CONFIG.splits)
    return roles.where(F.col("role") == "train_overlap").select("user_id")


@register("split_membership", _TX_CHAIN + "SELECT user_id, split FROM members")
def q_split_membership(spark, sf):
    return split_membership(user_split(distinct_users(tx_view(spark, sf)), TX_CONFIG.splits))


# ---------------------------------------------------------------- brand vocabulary
@register("brand_counts", _TX_CHAIN + "SELECT brand, count(*) AS cnt FROM fitrows GROUP BY brand")
def q_brand_counts(spark, sf):
    prep = _prep(spark, sf, fit=False)
    return prep.fit_rows().groupBy("brand").agg(F.count(F.lit(1)).alias("cnt"))


@register("top_n_brands", _TX_CHAIN + "SELECT brand, cnt FROM kept")
def q_top_n_brands(spark, sf):
    prep = _prep(spark, sf, fit=False)
    return BrandVocab(top_n=TX_CONFIG.brand.top_n).kept_brands(prep.fit_rows(), "brand").select("brand", "cnt")


@register("freq_threshold_brands", O.chain("tx", TX_CONFIG, top_n=None, freq_threshold=FREQ_THRESHOLD)
          + "SELECT brand, cnt FROM kept")
def q_freq_threshold_brands(spark, sf):
    prep = _prep(spark, sf, fit=False)
    return BrandVocab(freq_threshold=FREQ_THRESHOLD).kept_brands(prep.fit_rows(), "brand").select("brand", "cnt")


@register("vocab", _TX_CHAIN + "SELECT id, value FROM vocab")
def q_vocab(spark, sf):
    return _prep(spark, sf).encoders["brand"].vocab


_WCELLS_ID = ("SELECT w.user_id, w.k, w.brand, CAST(coalesce(v.id, 2) AS INTEGER) AS brand_id "
              "FROM wcells w LEFT JOIN vocab v ON v.value = w.brand")


@register("brand_to_id", _TX_CHAIN + _WCELLS_ID)
def q_brand_to_id(spark, sf):
    prep = _prep(spark, sf)
    return prep.encoders["brand"].transform(prep.buckets, "brand", "brand_id").select(
        "user_id", "k", "brand", "brand_id")


@register("id_to_brand", _TX_CHAIN + f"""
SELECT x.user_id, x.k, x.brand_id, v.value AS brand_back FROM ({_WCELLS_ID}) x JOIN vocab v ON v.id = x.brand_id""")
def q_id_to_brand(spark, sf):
    prep = _prep(spark, sf)
    b = prep.encoders["brand"]
    ids = b.transform(prep.buckets, "brand", "brand_id").select("user_id", "k", "brand_id")
    return b.inverse(ids, "brand_id", "brand_back")


# ---------------------------------------------------------------- scalers / time
@register("minmax_fit", _TX_CHAIN + 'SELECT lo, hi, scale, "offset" FROM mm')
def q_minmax_fit(spark, sf):
    from ..functions.scaling import minmax_param_cols
    rows = _prep(spark, sf, fit=False).fit_rows()
    agg = rows.agg(F.min("amount").cast("double").alias("lo"), F.max("amount").cast("double").alias("hi"))
    scale, offset = minmax_param_cols(F.col("lo"), F.col("hi"), TX_CONFIG.feature_range)
    return agg.select("lo", "hi", scale.alias("scale"), offset.alias("offset"))


@register("minmax_scale", _TX_CHAIN +
          "SELECT user_id, k, brand, amount, amount * mm.scale + mm.offset AS amount_scaled FROM wcells, mm")
def q_minmax_scale(spark, sf):
    prep = _prep(spark, sf)
    return prep.encoders["amount"].transform(prep.buckets, "amount", "amount_scaled").select(
        "user_id", "k", "brand", "amount", "amount_scaled")


@register("minmax_inverse", _TX_CHAIN + """
SELECT user_id, k, brand, (amount * mm.scale + mm.offset - mm.offset) / mm.scale AS amount_back FROM wcells, mm""")
def q_minmax_inverse(spark, sf):
    prep = _prep(spark, sf)
    a = prep.encoders["amount"]
    s = a.transform(prep.buckets, "amount", "x")
    return a.inverse(s, "x", "amount_back").select("user_id", "k", "brand", "amount_back")


@register("minmax_by_brand", _TX_CHAIN + f"""
, g0 AS (SELECT brand, CAST(min(amount) AS DOUBLE) AS lo, CAST(max(amount) AS DOUBLE) AS hi FROM fitrows GROUP BY brand),
g AS (SELECT brand, {O.d(1.0)} / (CASE WHEN hi - lo <> 0 THEN hi - lo ELSE {O.d(1.0)} END) AS scale, lo FROM g0)
SELECT w.user_id, w.k, w.brand, w.amount * g.scale + ({O.d(0.0)} - g.lo * g.scale) AS amount_scaled
FROM wcells w LEFT JOIN g ON g.brand = w.brand""")
def q_minmax_by_brand(spark, sf):
    prep = _prep(spark, sf, fit=False)
    enc = MinMaxEncoder(group_by="brand").fit(prep.fit_rows(), "amount")
    return enc.transform(prep.buckets, "amount", "amount_scaled").select(
        "user_id", "k", "brand", "amount_scaled")


@register("time_delta", _TX_CHAIN +
          f"SELECT user_id, k, brand, date, {O.delta('date')} AS day_delta FROM wcells, ee")
def q_time_delta(spark, sf):
    prep = _prep(spark, sf)
    return prep.encoders["date"].transform(prep.buckets, "date", "day_delta").select(
        "user_id", "k", "brand", "date", "day_delta")


@register("time_delta_inverse", _TX_CHAIN +
          f"SELECT user_id, k, brand, ee.e + to_days(CAST({O.delta('date')} AS INTEGER)) AS date_back FROM wcells, ee")
def q_time_delta_inverse(spark, sf):
    prep = _prep(spark, sf)
    t = prep.encoders["date"]
    d = t.transform(prep.buckets, "date", "day_delta")
    return t.inverse(d, "day_delta", "date_back").select("user_id", "k", "brand", "date_back")


@register("noop_encoder", _TX_CHAIN + "SELECT user_id, k, brand, amount, date FROM wcells")
def q_noop_encoder(spark, sf):
    prep = _prep(spark, sf, fit=False)
    out = prep.buckets
    for name, col in (("brand", "brand"), ("amount", "amount"), ("time", "date")):
        out = NoOpEncoder(name).fit(out, col).transform(out, col)
    return out.select("user_id", "k", "brand", "amount", "date")


# ---------------------------------------------------------------- sequences / targets
_SEQ_COLS = ["split", "user_id", "pos", "brand", "amount", "date"]
_SEQ_SQL = O.sequences_sql("tx", TX_CONFIG)
_TGT_SQL = O.targets_sql("tx", TX_CONFIG)


@register("input_sequences", _SEQ_SQL + "SELECT split, user_id, pos, brand, amount, date FROM seq")
def q_input_sequences(spark, sf):
    return _prep(spark, sf).sequences().select(*_SEQ_COLS)


# Fixed value: the greatest length of the registered bounded sequences.
MAX_LEN = 12


@register("newest_sequences", O.sequences_sql("tx", TX_CONFIG, newest=MAX_LEN - 2) + "SELECT split, user_id, pos, brand, amount, date FROM seq")
def q_newest_sequences(spark, sf):
    """Input sequences of at most MAX_LEN elements: the newest rows between the tokens."""
    return _prep(spark, sf).sequences(max_len=MAX_LEN).select(*_SEQ_COLS)


@register("empty_user_sequences", _SEQ_SQL + """
SELECT s.split, s.user_id, s.pos, s.brand, s.amount, s.date FROM seq s
JOIN (SELECT split, user_id FROM seq GROUP BY split, user_id HAVING count(*) = 2) e
  ON s.split = e.split AND s.user_id = e.user_id""")
def q_empty_user_sequences(spark, sf):
    seq = _prep(spark, sf).sequences()
    empty = seq.groupBy("split", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return seq.join(empty.select("split", "user_id"), ["split", "user_id"]).select(*_SEQ_COLS)


@register("multi_hot_brand", _TGT_SQL + "SELECT split, user_id, brand_id, brand_flag FROM tcells")
def q_multi_hot_brand(spark, sf):
    return _prep(spark, sf).targets().select("split", "user_id", "brand_id", "brand_flag")


@register("multi_hot_amount", _TGT_SQL + "SELECT split, user_id, brand_id, amount FROM tcells")
def q_multi_hot_amount(spark, sf):
    return _prep(spark, sf).targets().select("split", "user_id", "brand_id", "amount")


@register("multi_hot_separate", _TGT_SQL + "SELECT split, user_id, brand_id, brand_flag, amount FROM tcells")
def q_multi_hot_separate(spark, sf):
    return _prep(spark, sf).targets().select("split", "user_id", "brand_id", "brand_flag", "amount")


@register("raw_vs_scaled_target", _TGT_SQL + "SELECT split, user_id, brand_id, amount, amount_raw FROM tcells")
def q_raw_vs_scaled_target(spark, sf):
    return _prep(spark, sf).targets().select("split", "user_id", "brand_id", "amount", "amount_raw")


@register("target_recover", _TGT_SQL + """
SELECT split, user_id, brand_id, (amount - mm."offset") / mm.scale AS amount_inverse,
       (amount - CAST(n_rows AS DOUBLE) * mm."offset") / mm.scale AS amount_exact FROM tcells, mm""")
def q_target_recover(spark, sf):
    from ..operators.sequences import recover_target
    prep = _prep(spark, sf)
    return recover_target(prep.targets(), prep.encoders["amount"]).select(
        "split", "user_id", "brand_id", "amount_inverse", "amount_exact")


# Fixed value: slots per block of the registered query (the vocabulary has 23).
BLOCK = 8


@register("dense_blocks", _TGT_SQL + f"""
SELECT b.split, b.user_id, CAST(b.block AS INTEGER) AS block, CAST(i.i AS INTEGER) AS slot, coalesce(t.amount, 0.0::DOUBLE) AS amount
FROM (SELECT DISTINCT split, user_id, brand_id // {BLOCK} AS block FROM tcells) b
JOIN (SELECT range AS i FROM range({BLOCK})) i ON b.block * {BLOCK} + i.i < (SELECT v FROM vsize)
LEFT JOIN tcells t ON t.split = b.split AND t.user_id = b.user_id AND t.brand_id = b.block * {BLOCK} + i.i""")
def q_dense_blocks(spark, sf):
    """Target vectors as blocks of slots; blocks without a cell don't exist."""
    from ..operators.sequences import dense_blocks
    prep = _prep(spark, sf)
    blocks = dense_blocks(prep.targets(), prep.encoders["brand"].size, "amount", BLOCK)
    return blocks.select("split", "user_id", "block", F.posexplode("amount").alias("slot", "amount"))


@register("dense_target", _TGT_SQL + """
SELECT m.split, m.user_id, CAST(i.i AS INTEGER) AS brand_id, coalesce(t.amount, 0.0::DOUBLE) AS amount
FROM members m CROSS JOIN (SELECT range AS i FROM range((SELECT v FROM vsize))) i
LEFT JOIN tcells t ON t.split = m.split AND t.user_id = m.user_id AND t.brand_id = i.i""")
def q_dense_target(spark, sf):
    from ..operators.sequences import dense_vectors
    prep = _prep(spark, sf)
    dense = dense_vectors(prep.targets(), prep.members, prep.encoders["brand"].size, "amount")
    return dense.select("split", "user_id", F.posexplode("amount").alias("brand_id", "amount")).select(
        "split", "user_id", F.col("brand_id").cast("int").alias("brand_id"), "amount")


# ---------------------------------------------------------------- baseline / evaluation
def _baseline(prep: Prepared, denominator="all"):
    from ..operators.predict import average_spend
    return average_spend(prep.input_rows(), prep.encoders["brand"], prep.n_intervals(), denominator)


@register("baseline_avg_all", O.baseline_sql("tx", TX_CONFIG, "all") +
          "SELECT split, user_id, brand_id, predicted FROM pred")
def q_baseline_avg_all(spark, sf):
    return _baseline(_prep(spark, sf), "all")


@register("baseline_avg_active", O.baseline_sql("tx", TX_CONFIG, "active") +
          "SELECT split, user_id, brand_id, predicted FROM pred")
def q_baseline_avg_active(spark, sf):
    return _baseline(_prep(spark, sf), "active")


@register("scored_batches", O.baseline_sql("tx", TX_CONFIG, "all") + "SELECT split, user_id, brand_id, predicted FROM pred")
def q_scored_batches(spark, sf):
    """The baseline by a registered scorer that is given many whole users at once."""
    from ..operators.predict import PREDICTORS
    prep = _prep(spark, sf)
    return PREDICTORS.get("baseline.avg.batched")(prep.input_rows(), prep.encoders["brand"], prep.n_intervals(), "all")


def _aligned(prep):
    from ..operators.predict import average_and_actual
    return average_and_actual(prep.input_rows(), prep.target_rows(), prep.encoders["brand"], prep.n_intervals())


def _users_per_split(prep):
    return prep.members.groupBy("split").agg(F.count(F.lit(1)).alias("n_users"))


def _eval_sql(view="tx", cfg=TX_CONFIG) -> str:
    return O.baseline_sql(view, cfg, "all") + """
SELECT n.split, n.n_users, n.n_users * vsize.v AS n_cells, coalesce(a.n_positive, 0) AS n_positive,
       CAST(coalesce(a.fp, 0) AS DOUBLE) / CAST(n.n_users * vsize.v - coalesce(a.n_positive, 0) AS DOUBLE) AS false_positive_rate,
       CAST(coalesce(a.fn, 0) AS DOUBLE) / CAST(coalesce(a.n_positive, 0) AS DOUBLE) AS false_negative_rate,
       """ + O.settled("a.ae") + """ / CAST(a.n_positive AS DOUBLE) AS positive_mae,
       round(a.pe * 100.0::DOUBLE, 9) AS percentage_error
FROM nusers n CROSS JOIN vsize LEFT JOIN (
  SELECT split, count(*) FILTER (WHERE abs(t) > 0) AS n_positive,
         count(*) FILTER (WHERE abs(t) <= 0 AND abs(p) > 0) AS fp,
         count(*) FILTER (WHERE abs(t) > 0 AND abs(p) <= 0) AS fn,
         @AE@ AS ae,
         @PE@ AS pe
  FROM aligned GROUP BY split) a ON a.split = n.split"""


@register("eval_metrics", _eval_sql())
def q_eval_metrics(spark, sf):
    from ..operators.evaluate import cell_metrics
    prep = _prep(spark, sf)
    return cell_metrics(_aligned(prep), _users_per_split(prep), prep.encoders["brand"].size)


@register("eval_losses", O.baseline_sql("tx", TX_CONFIG, "all") + """
SELECT n.split, n.n_users,
       """ + O.settled("coalesce(a.l1, 0.0::DOUBLE)") + """ / CAST(n.n_users * vsize.v AS DOUBLE) AS l1,
       """ + O.settled("coalesce(a.l2, 0.0::DOUBLE)") + """ / CAST(n.n_users * vsize.v AS DOUBLE) AS l2,
       0.0::DOUBLE AS no_op
FROM nusers n CROSS JOIN vsize LEFT JOIN (
  SELECT split, @L1@ AS l1,
         @L2@ AS l2
  FROM aligned GROUP BY split) a ON a.split = n.split""")
def q_eval_losses(spark, sf):
    from ..operators.evaluate import cell_losses
    prep = _prep(spark, sf)
    return cell_losses(_aligned(prep), _users_per_split(prep), prep.encoders["brand"].size)


_NAMED = replace(TX_CONFIG, amount_encoder="no_op", output_type="multi_hot_separate", loss="l2")


@register("configured_loss", O.baseline_sql("tx", _NAMED, "all") + """
SELECT n.split, """ + O.settled("coalesce(a.l2, 0.0::DOUBLE)") + """ / CAST(n.n_users * vsize.v AS DOUBLE) AS loss
FROM nusers n CROSS JOIN vsize LEFT JOIN (SELECT split, @L2@ AS l2 FROM aligned GROUP BY split) a ON a.split = n.split""")
def q_configured_loss(spark, sf):
    """A plan built from names only: encoder, target builder, predictor, loss."""
    return _prep(spark, sf, cfg=_NAMED).configured_loss()


# ---------------------------------------------------------------- batching
_BATCH = TX_CONFIG.batch_size


def _batch_sql_ctes(epoch: int = 0):
    """Places in a split by hash; train users change places by the epoch's rounds of swaps."""
    from ..operators.batching import ROUNDS
    seed = TX_CONFIG.splits.seed
    out = f""",
s0 AS (SELECT split, user_id, row_number() OVER (PARTITION BY split
              ORDER BY md5('{seed}' || ':' || split || ':' || CAST(user_id AS VARCHAR)), user_id) - 1 AS x,
              count(*) OVER (PARTITION BY split) AS n FROM members)"""
    for i in range(ROUNDS):
        key = f"CAST(('0x' || substr(md5('{seed}:{epoch}:{i}'), 1, 13)) AS BIGINT)"
        other = f"((({key} - x) % n) + n) % n"
        out += f""",
s{i + 1} AS (SELECT split, user_id, n, CASE WHEN split = 'train' AND substr(md5('{seed}:{epoch}:{i}:' || CAST(greatest(x, y) AS VARCHAR)), 1, 1) < '8'
            THEN y ELSE x END AS x FROM (SELECT *, {other} AS y FROM s{i}))"""
    return out + f""",
batches AS (SELECT split, user_id, CAST(x // {_BATCH} AS INTEGER) AS batch, CAST(x % {_BATCH} AS INTEGER) AS slot FROM s{ROUNDS})
"""


# Padded sequences: every place up to the longest of the batch, from a plain list of places.
_PADDED_SQL = """,
lens2 AS MATERIALIZED (SELECT s.split, s.user_id, b.batch, max(s.pos) AS last FROM seq s
          JOIN batches b ON s.split = b.split AND s.user_id = b.user_id GROUP BY ALL),
bmax AS MATERIALIZED (SELECT *, max(last) OVER (PARTITION BY split, batch) AS mx FROM lens2),
places AS MATERIALIZED (SELECT CAST(range AS INTEGER) AS pos FROM range(0, (SELECT max(mx) + 1 FROM bmax))),
grid AS (SELECT b.split, b.batch, b.user_id, p.pos, least(p.pos, b.last) AS src, p.pos > b.last AS mask
         FROM bmax b JOIN places p ON p.pos <= b.mx),
padded AS (SELECT g.split, g.batch, g.user_id, g.pos, s.brand, s.amount, s.date, g.mask
           FROM grid g JOIN seq s ON s.split = g.split AND s.user_id = g.user_id AND s.pos = g.src)
"""


def _batches(prep, epoch: int = 0):
    from ..operators.batching import assign_batches
    return assign_batches(prep.members, _BATCH, prep.cfg.splits.seed, epoch)


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table that several steps read, written once to the shared folder."""
    import uuid
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, f"ledgerflow-{name}", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _padded(prep):
    from ..operators.batching import pad_and_mask
    return pad_and_mask(_written(prep.sequences(), "sequences"), _batches(prep), ["brand", "amount", "date"])


@register("batches", _SEQ_SQL + _batch_sql_ctes() + "SELECT split, user_id, batch, slot FROM batches")
def q_batches(spark, sf):
    return _batches(_prep(spark, sf, fit=False))


@register("batches_next_epoch", _SEQ_SQL + _batch_sql_ctes(1) + "SELECT split, user_id, batch, slot FROM batches")
def q_batches_next_epoch(spark, sf):
    """The next epoch's batches: train users change places, the others stay."""
    return _batches(_prep(spark, sf, fit=False), epoch=1)


@register("pad_mask", _SEQ_SQL + _batch_sql_ctes() + _PADDED_SQL +
          "SELECT split, batch, user_id, pos, brand, amount, date, mask FROM padded")
def q_pad_mask(spark, sf):
    return _padded(_prep(spark, sf))


@register("sequences_to_rows", _SEQ_SQL + "SELECT split, user_id, pos, brand, amount, date FROM seq")
def q_sequences_to_rows(spark, sf):
    from ..operators.batching import unbatch
    return unbatch(_padded(_prep(spark, sf)), ["brand", "amount", "date"])


@register("recover_features", _SEQ_SQL + """
SELECT p.split, p.user_id, p.pos, v.value AS brand, (p.amount - mm."offset") / mm.scale AS amount,
       ee.e + to_days(CAST(p.date AS INTEGER)) AS date
FROM seq p JOIN vocab v ON v.id = p.brand, mm, ee""")
def q_recover_features(spark, sf):
    from ..operators.batching import unbatch
    prep = _prep(spark, sf)
    rows = unbatch(_padded(prep), ["brand", "amount", "date"])
    return recover_rows(rows, prep.encoders).select(*_SEQ_COLS)


def recover_rows(rows: DataFrame, encoders: dict) -> DataFrame:
    """Inverse-transform every encoded feature of sequence rows (framing
    tokens included, as the reference does)."""
    out = rows
    for f in ("brand", "amount", "date"):
        if f in encoders and f in rows.columns:
            out = encoders[f].inverse(out, f)
    return out


@register("batch_mean_loss", O.baseline_sql("tx", TX_CONFIG, "all") + _batch_sql_ctes() + """
, pu AS (SELECT split, user_id, """ + O.settled(O.exact_sum("abs(p - t)")) + """ AS l1
         FROM aligned GROUP BY split, user_id),
pb AS (SELECT b.split, b.batch, """ + O.settled("coalesce(" + O.exact_sum("pu.l1") + ", 0.0::DOUBLE)") + """ AS l1, count(*) AS n
       FROM batches b LEFT JOIN pu ON pu.split = b.split AND pu.user_id = b.user_id GROUP BY ALL)
SELECT split, count(*) AS n_batches,
       round(@BM@ / CAST(count(*) AS DOUBLE), 9) AS mean_batch_l1
FROM pb GROUP BY split""")
def q_batch_mean_loss(spark, sf):
    from ..operators.evaluate import batch_mean_loss
    prep = _prep(spark, sf)
    return batch_mean_loss(_aligned(prep), _batches(prep), prep.encoders["brand"].size)


# ---------------------------------------------------------------- store / sinks
_FINGERPRINT_ROW = """md5(length(CAST(user_id AS VARCHAR)) || ':' || user_id
  || length(CAST(epoch_us(date) AS VARCHAR)) || ':' || epoch_us(date) || length(brand) || ':' || brand || length(a) || ':' || a)"""


@register("content_fingerprint", f"""WITH src AS ({O.SOURCES['tx']}),
m AS (SELECT *, round_even(amount * 1e6::DOUBLE, 0) AS near FROM src),
t AS (SELECT *, CAST(near AS BIGINT) || '/' || CAST(round_even((amount - near / 1e6::DOUBLE) * 1e18::DOUBLE, 0) AS BIGINT) AS a FROM m),
h AS (SELECT CAST(year(date) AS VARCHAR) AS part, {_FINGERPRINT_ROW} AS h FROM t),
p AS (SELECT part, count(*) AS n_rows, """ + ", ".join(
    f"sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS l{i}" for i in range(4)) + """ FROM h GROUP BY GROUPING SETS ((part), ()))
SELECT coalesce(part, 'all') AS part, n_rows, md5(n_rows || ':' || l0 || ':' || l1 || ':' || l2 || ':' || l3) AS fingerprint FROM p""")
def q_content_fingerprint(spark, sf):
    """Fingerprints per year of the transactions and, added up from these, of all of them."""
    from ..sources.store import fingerprint_parts, fold_parts, with_fingerprint
    tx = tx_view(spark, sf)
    parts = _written(fingerprint_parts(tx.withColumn("part", F.year("date").cast("string")), ["part"], tx.columns), "fingerprints")
    return with_fingerprint(parts).select("part", "n_rows", "fingerprint").unionByName(
        fold_parts(parts).select(F.lit("all").alias("part"), "n_rows", "fingerprint"))


@register("cache_roundtrip", _TGT_SQL + "SELECT split, user_id, brand_id, brand_flag, amount, amount_raw, n_rows FROM tcells")
def q_cache_roundtrip(spark, sf):
    """Targets from a cache hit, which must equal those of the build that it spares."""
    built, hit = _cached(spark, sf, keep=True)
    for name in built:
        if not _same_rows(built[name], hit[name]):
            raise AssertionError(f"the cache gives other {name} than were built")
        built[name].unpersist()
    return hit["targets"].select("split", "user_id", "brand_id", "brand_flag", "amount", "amount_raw", "n_rows")


def _cached(spark, sf, keep: bool = False) -> tuple[dict, dict]:
    """(what a build gives, what the cache gives on the next call).  The transactions are read by the
    build and by both calls: they are kept on disk, so that their joins are shuffled once.  ``keep``:
    so is what was built, for a comparison after the store; release it then."""
    from ..sources.store import ProcessedCache
    from .restore import state_tables
    tx, cache = tx_view(spark, sf).persist(StorageLevel.DISK_ONLY), ProcessedCache(spark)
    built = state_tables(prepare(tx, TX_CONFIG))
    if keep:
        built = {name: df.persist(StorageLevel.DISK_ONLY) for name, df in built.items()}
    cache.load_or_build(TX_CONFIG.to_json(), tx, lambda: built)
    hit, was_hit, _ = cache.load_or_build(TX_CONFIG.to_json(), tx, _no_build)
    tx.unpersist()
    return built, hit


def _no_build():
    raise AssertionError("a stored entry was not found")


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets, by fingerprint: no join, no sort."""
    from ..sources.store import content_fingerprint
    cols = sorted(a.columns)
    return content_fingerprint(a.select(cols)).first() == content_fingerprint(b.select(cols)).first()


@register("cache_restored_features", _SEQ_SQL + """
SELECT p.split, p.user_id, p.pos, v.value AS brand, (p.amount - mm."offset") / mm.scale AS amount,
       ee.e + to_days(CAST(p.date AS INTEGER)) AS date
FROM seq p JOIN vocab v ON v.id = p.brand, mm, ee""")
def q_cache_restored_features(spark, sf):
    """Features of cached sequences, recovered with encoders that a cache hit restores."""
    from .restore import restore
    state = restore(TX_CONFIG, _cached(spark, sf)[1])
    return recover_rows(state.sequences, state.encoders).select(*_SEQ_COLS)


@register("predictions", O.baseline_sql("tx", TX_CONFIG, "all") +
          "SELECT split, user_id, brand_id, p AS predicted, t AS actual FROM aligned")
def q_predictions(spark, sf):
    import uuid
    from ..session import scratch_path
    from ..sources.store import write_predictions
    prep = _prep(spark, sf)
    out = _aligned(prep).select("split", "user_id", "brand_id", F.col("p").alias("predicted"),
                                F.col("t").alias("actual"))
    return write_predictions(out, scratch_path(spark, "ledgerflow-predictions", uuid.uuid4().hex)).select(
        "split", "user_id", "brand_id", "predicted", "actual")


# ---------------------------------------------------------------- numeric encodings
# Supplied periodic-feature weights of the time_features query.
T2V_W, T2V_B, T2V_W0, T2V_B0 = (0.5, 0.25), (0.2, 0.1), 0.5, 0.1
N_BINS = 48


@register("time_features", _TX_CHAIN + f"""
, dd AS (SELECT user_id, k, brand, CAST({O.delta('date')} AS DOUBLE) AS tau FROM wcells, ee)
SELECT user_id, k, brand, 0 AS idx, round(sin(tau * {O.d(T2V_W[0])} + {O.d(T2V_B[0])}), 9) AS value FROM dd
UNION ALL SELECT user_id, k, brand, 1, round(sin(tau * {O.d(T2V_W[1])} + {O.d(T2V_B[1])}), 9) FROM dd
UNION ALL SELECT user_id, k, brand, 2, round(tau * {O.d(T2V_W0)} + {O.d(T2V_B0)}, 9) FROM dd""")
def q_time_features(spark, sf):
    from ..functions.scaling import time_features
    prep = _prep(spark, sf)
    d = prep.encoders["date"].transform(prep.buckets, "date", "tau")
    tf = time_features(F.col("tau"), T2V_W, T2V_B, T2V_W0, T2V_B0, "sin")
    return d.select("user_id", "k", "brand", F.posexplode(tf).alias("idx", "value")).select(
        "user_id", "k", "brand", F.col("idx").cast("int").alias("idx"), F.round("value", 9).alias("value"))


def _quantile_sql_ctes():
    return f"""
, qn AS (SELECT count(amount) AS n, least({N_BINS}, greatest(2, count(amount) - 1)) AS b FROM fitrows),
qv AS (SELECT CAST(amount AS DOUBLE) AS x, row_number() OVER (ORDER BY amount) - 1 AS rk FROM fitrows WHERE amount IS NOT NULL),
qp AS (SELECT i, CAST(i AS DOUBLE) / CAST(b AS DOUBLE) AS q, (n - 1) * (CAST(i AS DOUBLE) / CAST(b AS DOUBLE)) AS h, n
       FROM qn, range(0, (SELECT b FROM qn) + 1) t(i)),
qp2 AS (SELECT i, h, CAST(floor(h) AS BIGINT) AS lo, least(CAST(floor(h) AS BIGINT) + 1, n - 1) AS hi,
               h - floor(h) AS f FROM qp),
qval AS (SELECT a.x + (b.x - a.x) * qp2.f AS edge FROM qp2 JOIN qv a ON a.rk = qp2.lo JOIN qv b ON b.rk = qp2.hi),
edges AS (SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INTEGER) AS idx, edge FROM (SELECT DISTINCT edge FROM qval)),
nb AS (SELECT count(*) - 1 AS nb FROM edges)
"""


@register("quantile_bins", _TX_CHAIN + _quantile_sql_ctes() + "SELECT idx, edge FROM edges")
def q_quantile_bins(spark, sf):
    from ..operators.quantiles import quantile_bin_edges
    prep = _prep(spark, sf, fit=False)
    edges = quantile_bin_edges(prep.fit_rows(), "amount", N_BINS)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "idx int, edge double")


@register("piecewise_linear", _TX_CHAIN + _quantile_sql_ctes() + """
, bins AS (SELECT a.idx, a.edge AS lo, b.edge AS hi FROM edges a JOIN edges b ON b.idx = a.idx + 1)
SELECT f.user_id, f.k, f.brand, bins.idx,
       CASE WHEN bins.idx < nb.nb - 1 THEN least(r, 1.0::DOUBLE) ELSE r END AS value
FROM (SELECT f.*, bins.idx AS bidx, CASE WHEN bins.idx > 0 THEN greatest((f.amount - bins.lo) / (bins.hi - bins.lo), 0.0::DOUBLE)
             ELSE (f.amount - bins.lo) / (bins.hi - bins.lo) END AS r
      FROM fitrows f CROSS JOIN bins) f
JOIN bins ON bins.idx = f.bidx, nb""")
def q_piecewise_linear(spark, sf):
    from ..functions.scaling import piecewise_linear
    from ..operators.quantiles import quantile_bin_edges
    prep = _prep(spark, sf, fit=False)
    rows = prep.fit_rows()
    edges = quantile_bin_edges(rows, "amount", N_BINS)
    ple = piecewise_linear(F.col("amount"), F.array(*[F.lit(float(e)) for e in edges]))
    return rows.select("user_id", "k", "brand", F.posexplode(ple).alias("idx", "value")).select(
        "user_id", "k", "brand", F.col("idx").cast("int").alias("idx"), "value")


# ---------------------------------------------------------------- sweep
# The registered search space, trial count and seed.
SWEEP_SPACE = {
    "data": {
        "top_n": {"type": "int", "min": 5, "max": 25},
        "lookback": {"type": "int", "min": 3, "max": 40},
        "denominator": {"type": "categorical", "options": ["all", "active"]},
    },
}
TRIAL_SPACE = {
    **SWEEP_SPACE,
    "train": {"learning_rate": {"type": "loguniform", "min": 1e-5, "max": 1e-2}},
    "model": {"dropout": {"type": "float", "min": 0.0, "max": 0.5}},
}
N_TRIALS, SWEEP_SEED = 16, 42


def _u_sql(name):
    return (f"(CAST(CAST(('0x' || substr(md5('{SWEEP_SEED}' || ':' || CAST(r.t AS VARCHAR) || ':' || '{name}'), 1, 13)) "
            f"AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)")


def _trials_sql(space) -> str:
    from ..operators.sweep import flatten_space
    cols = []
    for p in flatten_space(space):
        u = _u_sql(p.name)
        if p.kind == "int":
            e = f"CAST({int(p.min)} + floor({u} * {O.d(int(p.max) - int(p.min) + 1)}) AS BIGINT)"
        elif p.kind == "float":
            e = f"{O.d(p.min)} + {u} * ({O.d(float(p.max) - float(p.min))})"
        elif p.kind == "loguniform":
            e = O.settled(f"exp(ln({O.d(p.min)}) + {u} * (ln({O.d(p.max)}) - ln({O.d(p.min)})))")
        else:
            arr = "[" + ", ".join(f"'{o}'" for o in p.options) + "]"
            e = f"{arr}[CAST(floor({u} * {O.d(len(p.options))}) AS INTEGER) + 1]"
        cols.append(f"{e} AS {p.column}")
    return f"SELECT CAST(r.t AS BIGINT) AS trial, {', '.join(cols)} FROM range({N_TRIALS}) r(t)"


@register("trial_table", _TX_CHAIN + ", tt AS (" + _trials_sql(TRIAL_SPACE) + """)
SELECT tt.*, 3 + least(tt.data_top_n, (SELECT count(*) FROM bstats)) AS vocab_size,
       least(tt.data_lookback, (SELECT n_all FROM nall WHERE split = 'train')) AS train_intervals FROM tt""")
def q_trial_table(spark, sf):
    """Trials with what they mean on the data: the vocabulary size a trial's
    ``top_n`` yields on the train input window, and the intervals its
    lookback covers there."""
    from ..operators.sweep import trial_table
    prep = _prep(spark, sf, fit=False)
    n_brands = prep.fit_rows().select("brand").distinct().agg(F.count(F.lit(1))).scalar()
    n_train = prep.spec.count_in_window(TX_CONFIG.cutoffs.in_start, TX_CONFIG.cutoffs.train)
    trials = trial_table(spark, TRIAL_SPACE, N_TRIALS, SWEEP_SEED)
    return trials.select(
        *trials.columns,
        (F.lit(3) + F.least(F.col("data_top_n"), n_brands)).alias("vocab_size"),
        F.least(F.col("data_lookback"), F.lit(n_train).cast("bigint")).alias("train_intervals"))


def _sweep_sql() -> str:
    W = 28 * 86_400_000_000
    c = TX_CONFIG.cutoffs
    kl = []
    for s in ("train", "val", "test"):
        e = O.ts(dt.datetime.fromisoformat(c.target_start(s)) - dt.timedelta(microseconds=1))
        kl.append(f"SELECT '{s}' AS split, least({O.bucket_idx(e, W)}, spec.m) AS k_last FROM spec")
    return O.targets_sql("tx", TX_CONFIG) + f""",
nall2 AS (SELECT * FROM nall),
trials AS ({_trials_sql(SWEEP_SPACE)}),
brank AS (SELECT brand, row_number() OVER (ORDER BY cnt DESC, fu, fk, brand) AS brank FROM bstats),
nbr AS (SELECT count(*) AS nbr FROM bstats),
kl AS ({' UNION ALL '.join(kl)}),
sin AS (SELECT i.split, i.user_id, i.k, i.brand, i.amount, kl.k_last - i.k + 1 AS back, br.brank
        FROM inrows i JOIN kl ON kl.split = i.split LEFT JOIN brank br ON br.brand = i.brand),
sp AS (SELECT t.trial, s.split, s.user_id, CASE WHEN s.brank <= t.data_top_n THEN s.brand ELSE '<UNK>' END AS slot,
              {O.exact_sum('s.amount')} AS s, count(DISTINCT s.k) AS active,
              first(t.data_lookback) AS lookback, first(t.data_denominator) AS denominator
       FROM sin s JOIN trials t ON s.back <= t.data_lookback GROUP BY ALL),
spred AS (SELECT sp.trial, sp.split, sp.user_id, sp.slot,
                 {O.settled('sp.s')} / CAST(CASE WHEN sp.denominator = 'all'
                      THEN least(sp.lookback, nall2.n_all) ELSE sp.active END AS DOUBLE) AS p
          FROM sp JOIN nall2 ON nall2.split = sp.split),
sact AS (SELECT t.trial, r.split, r.user_id, CASE WHEN br.brank <= t.data_top_n THEN r.brand ELSE '<UNK>' END AS slot,
                {O.settled(O.exact_sum('r.amount'))} AS t
         FROM trows r LEFT JOIN brank br ON br.brand = r.brand CROSS JOIN trials t GROUP BY ALL),
sal AS (SELECT coalesce(a.trial, b.trial) AS trial, coalesce(a.split, b.split) AS split,
               coalesce(a.p, 0.0::DOUBLE) AS p, coalesce(b.t, 0.0::DOUBLE) AS t
        FROM spred a FULL OUTER JOIN sact b ON a.trial = b.trial AND a.split = b.split
             AND a.user_id = b.user_id AND a.slot = b.slot),
scells AS (SELECT t.trial, n.split, n.n_users, 3 + least(t.data_top_n, nbr.nbr) AS vocab_size
           FROM trials t CROSS JOIN nusers n CROSS JOIN nbr),
sm AS (
SELECT c.trial, c.split, c.n_users, c.n_users * c.vocab_size AS n_cells, coalesce(a.n_positive, 0) AS n_positive,
       CAST(coalesce(a.fp, 0) AS DOUBLE) / CAST(c.n_users * c.vocab_size - coalesce(a.n_positive, 0) AS DOUBLE) AS false_positive_rate,
       CAST(coalesce(a.fn, 0) AS DOUBLE) / CAST(coalesce(a.n_positive, 0) AS DOUBLE) AS false_negative_rate,
       {O.settled('a.ae')} / CAST(a.n_positive AS DOUBLE) AS positive_mae,
       round(a.pe * 100.0::DOUBLE, 9) AS percentage_error
FROM scells c LEFT JOIN (
  SELECT trial, split, count(*) FILTER (WHERE abs(t) > 0) AS n_positive,
         count(*) FILTER (WHERE abs(t) <= 0 AND abs(p) > 0) AS fp,
         count(*) FILTER (WHERE abs(t) > 0 AND abs(p) <= 0) AS fn,
         @AE@ AS ae,
         @PE@ AS pe
  FROM sal GROUP BY trial, split) a ON a.trial = c.trial AND a.split = c.split)
"""


def _sweep(spark, sf):
    from ..operators.sweep import sweep_metrics, trial_table
    prep = _prep(spark, sf, fit=False)
    trials = trial_table(spark, SWEEP_SPACE, N_TRIALS, SWEEP_SEED)
    return sweep_metrics(prep, trials), trials


_SWEEP_COLS = ["trial", "split", "n_users", "n_cells", "n_positive", "false_positive_rate",
               "false_negative_rate", "positive_mae", "percentage_error"]


@register("sweep_metrics", _sweep_sql() + "SELECT * FROM sm")
def q_sweep_metrics(spark, sf):
    return _sweep(spark, sf)[0].select(*_SWEEP_COLS)


@register("best_trial", _sweep_sql() + """
SELECT b.trial, b.value, t.data_top_n, t.data_lookback, t.data_denominator
FROM (SELECT trial, positive_mae AS value FROM sm WHERE split = 'val' AND positive_mae IS NOT NULL
      ORDER BY positive_mae, trial LIMIT 1) b JOIN trials t ON t.trial = b.trial""")
def q_best_trial(spark, sf):
    from ..operators.sweep import best_trial
    m, trials = _sweep(spark, sf)
    return best_trial(m, trials).select("trial", "value", "data_top_n", "data_lookback", "data_denominator")


@register("trial_log", _sweep_sql() + " " + " UNION ALL ".join(
    f"SELECT 'sweep' AS run, trial, split, CAST(0 AS BIGINT) AS step, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM sm"
    for m in _SWEEP_COLS[2:]))
def q_trial_log(spark, sf):
    import uuid
    from ..session import scratch_path
    from ..sources.store import TrialLog, melt_metrics
    m, _ = _sweep(spark, sf)
    log = TrialLog(spark, scratch_path(spark, "ledgerflow-trials", uuid.uuid4().hex))
    log.append(melt_metrics(m.select(*_SWEEP_COLS), "sweep"))
    return log.read("sweep").select(*TrialLog.COLS)


# ---------------------------------------------------------------- streaming
@register("stream_bucket", O.chain("ev", EV_CONFIG, interval=EV_BUCKET_INTERVAL) + _CELLS)
def q_stream_bucket(spark, sf):
    """ev_bucket computed by Structured Streaming over the events file with
    the batch origin fixed.  ``complete`` output mode gives the final state
    of a bounded input, written by the executors; a live stream uses
    ``append`` with the watermark."""
    import os
    from ..sources.views import normalize
    from ..streaming.buckets import run_to_table, stream_bucket_aggregate
    ev = ev_view(spark, sf)
    spec = fit_buckets(ev, EV_BUCKET_INTERVAL)
    path = os.path.join(sf, "events.parquet")
    # a file stream watches a directory; the glob filter picks the events file
    raw = (spark.readStream.schema(spark.read.parquet(path).schema)
           .option("pathGlobFilter", "events.parquet").parquet(sf))
    stream = normalize(raw, date="ts", brand="event_type", amount="value")
    agg = stream_bucket_aggregate(stream, spec.origin, EV_BUCKET_INTERVAL, "3650 days", spec.n_buckets)
    return run_to_table(spark, agg, "complete")


# ---------------------------------------------------------------- event view (µs timestamps)
_EV_SEQ_SQL = O.sequences_sql("ev", EV_CONFIG)


@register("ev_input_sequences", _EV_SEQ_SQL + "SELECT split, user_id, pos, brand, amount, date FROM seq")
def q_ev_input_sequences(spark, sf):
    return _prep(spark, sf, "ev", EV_CONFIG).sequences().select(*_SEQ_COLS)


@register("ev_multi_hot_amount", O.targets_sql("ev", EV_CONFIG) +
          "SELECT split, user_id, brand_id, amount, amount_raw FROM tcells")
def q_ev_multi_hot_amount(spark, sf):
    return _prep(spark, sf, "ev", EV_CONFIG).targets().select(
        "split", "user_id", "brand_id", "amount", "amount_raw")


@register("ev_eval_metrics", _eval_sql("ev", EV_CONFIG))
def q_ev_eval_metrics(spark, sf):
    from ..operators.evaluate import cell_metrics
    prep = _prep(spark, sf, "ev", EV_CONFIG)
    return cell_metrics(_aligned(prep), _users_per_split(prep), prep.encoders["brand"].size)


# ---------------------------------------------------------------- strict window alignment
@register("input_sequences_strict", O.sequences_sql("tx", TX_CONFIG, strict=True) +
          "SELECT split, user_id, pos, brand, amount, date FROM seq")
def q_input_sequences_strict(spark, sf):
    """Input sequences when each window's cells come only from raw rows inside
    the window (``prepare(align='strict')``)."""
    return prepare(tx_view(spark, sf), TX_CONFIG, align="strict").sequences().select(*_SEQ_COLS)


@register("multi_hot_amount_strict", O.targets_sql("tx", TX_CONFIG, strict=True) +
          "SELECT split, user_id, brand_id, amount, amount_raw FROM tcells")
def q_multi_hot_amount_strict(spark, sf):
    return prepare(tx_view(spark, sf), TX_CONFIG, align="strict").targets().select(
        "split", "user_id", "brand_id", "amount", "amount_raw")


# ---------------------------------------------------------------- interval rescale (C9)
# Fixed value: a 7-day prediction interval over the 28-day input buckets.
PREDICTION_DAYS = 7
_RATIO = PREDICTION_DAYS / 28


@register("multi_hot_amount_rescaled", O.targets_sql("tx", TX_CONFIG) +
          f"SELECT split, user_id, brand_id, amount * {O.d(_RATIO)} AS amount, "
          f"amount_raw * {O.d(_RATIO)} AS amount_raw FROM tcells")
def q_multi_hot_amount_rescaled(spark, sf):
    """Targets with the prediction/input interval adjustment applied."""
    return _prep(spark, sf).targets(ratio=_RATIO).select(
        "split", "user_id", "brand_id", "amount", "amount_raw")
