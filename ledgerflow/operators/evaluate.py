"""Cell-level evaluation of predictions against actual next-interval spend.

Cells are users x vocabulary slots (special slots included).  Only cells with
a prediction or an actual value exist as rows (full outer join); all other
cells are zero on both sides and are counted arithmetically.  A cell is
positive when ``|value| > threshold`` (default: non-zero).

All sums are exact (``functions/fixedpoint.py``), so no result depends on
the order of the rows; sums are kept to 13 significant digits, percentage
errors and batch means to 9 decimals.  An empty denominator gives NULL (numpy gives NaN).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixedpoint import exact_sum, exact_sums, settled
from ..registry import Registry

LOSSES = Registry("loss")
KEYS = ["split", "user_id", "brand_id"]


def align(pred: DataFrame, actual: DataFrame, pred_col: str = "predicted",
          actual_col: str = "amount_raw", keys=KEYS) -> DataFrame:
    """``(keys, p, t)``: full outer join on the cell keys, missing = 0."""
    p = pred.select(*keys, F.col(pred_col).alias("_p"))
    t = actual.select(*keys, F.col(actual_col).alias("_t"))
    return p.join(t, list(keys), "full_outer").select(
        *keys, F.coalesce("_p", F.lit(0.0)).alias("p"), F.coalesce("_t", F.lit(0.0)).alias("t"))


# A registered loss is an unsettled aggregate over the cells' ``p`` and ``t``.
@LOSSES.register("l1")
def l1_sum():
    return exact_sum(F.abs(F.col("p") - F.col("t")))


@LOSSES.register("l2")
def l2_sum():
    d = F.col("p") - F.col("t")
    return exact_sum(d * d)


@LOSSES.register("no_op")
def no_op_sum():
    return F.lit(0.0)


def cell_metrics(aligned: DataFrame, users_per_split: DataFrame, vocab_size: int,
                 threshold: float = 0.0) -> DataFrame:
    """Per split: FPR, FNR, positive MAE, percentage error."""
    thr = F.lit(float(threshold))
    tpos = F.abs(F.col("t")) > thr
    ppos = F.abs(F.col("p")) > thr
    cells = aligned.select("split", tpos.alias("_tpos"), ppos.alias("_ppos"),
                           F.when(tpos, F.abs(F.col("p") - F.col("t"))).alias("_d"),
                           F.when(tpos & ppos, F.abs((F.col("t") - F.col("p")) / F.col("t"))).alias("_r"))
    agg = exact_sums(cells.groupBy("split"), {"_ae": F.col("_d"), "_re": F.col("_r")},
                     F.count(F.when(F.col("_tpos"), 1)).alias("n_positive"),
                     F.count(F.when(~F.col("_tpos") & F.col("_ppos"), 1)).alias("_fp"),
                     F.count(F.when(F.col("_tpos") & ~F.col("_ppos"), 1)).alias("_fn"),
                     F.count("_r").alias("_both"))
    j = users_per_split.join(agg, "split", "left").fillna(0, ["n_positive", "_fp", "_fn"])
    n_cells = F.col("n_users") * F.lit(vocab_size)
    neg = n_cells - F.col("n_positive")
    return j.select(
        "split", "n_users", n_cells.alias("n_cells"), "n_positive",
        F.try_divide(F.col("_fp").cast("double"), neg.cast("double")).alias("false_positive_rate"),
        F.try_divide(F.col("_fn").cast("double"), F.col("n_positive").cast("double")).alias("false_negative_rate"),
        F.try_divide(F.col("_ae"),
                     F.col("n_positive").cast("double")).alias("positive_mae"),
        F.round(F.try_divide(F.col("_re"), F.col("_both").cast("double")) * F.lit(100.0), 9).alias("percentage_error"),
    )


def cell_losses(aligned: DataFrame, users_per_split: DataFrame, vocab_size: int) -> DataFrame:
    """Per split: mean absolute (L1), mean squared (L2) and no-op losses over
    all cells."""
    agg = aligned.groupBy("split").agg(l1_sum().alias("_l1"), l2_sum().alias("_l2"))
    j = users_per_split.join(agg, "split", "left")
    n_cells = (F.col("n_users") * F.lit(vocab_size)).cast("double")
    return j.select(
        "split", "n_users",
        F.try_divide(F.coalesce(settled(F.col("_l1")), F.lit(0.0)), n_cells).alias("l1"),
        F.try_divide(F.coalesce(settled(F.col("_l2")), F.lit(0.0)), n_cells).alias("l2"),
        F.lit(0.0).alias("no_op"))


def batch_mean_loss(aligned: DataFrame, batches: DataFrame, vocab_size: int) -> DataFrame:
    """Epoch loss as the reference reports it: the mean over batches of each
    batch's mean absolute cell error (a short last batch weighs the same)."""
    cells = aligned.withColumn("_d", F.abs(F.col("p") - F.col("t")))
    per_user = exact_sums(cells.groupBy("split", "user_id"), {"_l1": F.col("_d")})
    b = batches.join(per_user, ["split", "user_id"], "left")
    per_batch = exact_sums(b.groupBy("split", "batch"), {"_l1": F.col("_l1")}, F.count(F.lit(1)).alias("_n"), zero=True)
    loss = (F.col("_l1") / (F.col("_n") * F.lit(vocab_size)).cast("double"))
    means = exact_sums(per_batch.withColumn("_l", loss).groupBy("split"), {"_l": F.col("_l")},
                       F.count(F.lit(1)).alias("n_batches"))
    return means.select("split", "n_batches",
                        F.round(F.col("_l") / F.col("n_batches").cast("double"), 9).alias("mean_batch_l1"))
