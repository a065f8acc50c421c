"""Parameter sweep over data parameters, all trials in one Spark job.

Trials are drawn deterministically from a search space: each (trial,
parameter) gets a uniform number from ``md5(seed:trial:name)`` (52 bits),
mapped through the parameter kind -- ``int`` (inclusive bounds), ``float``,
``loguniform`` or ``categorical``.  Nested names are joined with ``.``; the
column name replaces ``.`` with ``_``.

The swept parameters act on data: ``top_n`` (vocabulary size), ``lookback``
(the last L intervals of the input window feed the baseline) and
``denominator`` (``all`` / ``active``).  The scan, the bucket aggregate and the
one shuffle of its cells are shared by all trials; a trial's figures are read
off running sums over the buckets and cuts of the brand ranks (see
:func:`sweep_metrics`).  Brand slots are the brand itself when it is among the
trial's ``top_n`` or ``<UNK>``: the metrics do not depend on id labels, so
per-trial id tables are not needed.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixedpoint import LIMBS, limbs, settled, total_of
from .encoders import UNK, BrandVocab
from .joins import lookup, materialize_small, spread
from .ranking import global_row_number

TWO_52 = float(2 ** 52)


@dataclass(frozen=True)
class Param:
    name: str
    kind: str
    min: float | None = None
    max: float | None = None
    options: tuple | None = None

    def __post_init__(self):
        if self.kind in ("int", "float", "loguniform"):
            if self.min is None or self.max is None:
                raise ValueError(f"{self.name}: a {self.kind} range needs both bounds, got {self.min} to {self.max}")
        elif self.kind == "categorical":
            if not self.options:
                raise ValueError(f"{self.name}: a categorical parameter needs at least one option")
        else:
            raise ValueError(f"{self.name}: cannot sample a parameter of kind {self.kind!r}")

    @property
    def column(self) -> str:
        return self.name.replace(".", "_")


def flatten_space(space, prefix: str = "") -> list:
    """Nested ``{name: {type, min, max, options} | {...}}`` -> ``[Param]``."""
    if isinstance(space, (list, tuple)):
        return list(space)
    out = []
    for k, v in space.items():
        name = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict) and "type" in v:
            out.append(Param(name, v["type"], v.get("min"), v.get("max"),
                             tuple(v["options"]) if v.get("options") is not None else None))
        elif isinstance(v, dict):
            out.extend(flatten_space(v, name))
    return out


def uniform(seed: int, trial: Column, name: str) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), trial.cast("string"), F.lit(name)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)


def sample(p: Param, u: Column) -> Column:
    if p.kind == "int":
        return (F.lit(int(p.min)) + F.floor(u * F.lit(float(int(p.max) - int(p.min) + 1)))).cast("bigint")
    if p.kind == "float":
        return F.lit(float(p.min)) + u * F.lit(float(p.max) - float(p.min))
    if p.kind == "loguniform":
        lo, hi = F.log(F.lit(float(p.min))), F.log(F.lit(float(p.max)))
        return settled(F.exp(lo + u * (hi - lo)))  # 13 digits: exp differs between libraries in its last
    opts = F.array(*[F.lit(o) for o in p.options])
    return F.element_at(opts, (F.floor(u * F.lit(float(len(p.options)))) + 1).cast("int"))


def trial_table(spark: SparkSession, space, n_trials: int, seed: int = 42) -> DataFrame:
    params = flatten_space(space)
    t = spark.range(n_trials).withColumnRenamed("id", "trial")
    return t.select("trial", *[sample(p, uniform(seed, F.col("trial"), p.name)).alias(p.column)
                               for p in params])


def brand_ranks(fit_rows: DataFrame) -> tuple[DataFrame, int]:
    """``(brand, brank)`` ranked by count desc, first appearance (the top-N
    order) over the distinct brand table, and the number of brands."""
    stats, n = materialize_small(BrandVocab.brand_stats(fit_rows, "brand", ("user_id", "k")))
    ranks = global_row_number(stats, [F.col("cnt").desc(), F.col("first_seen"), F.col("brand")],
                              "brank", n_rows=n).select("brand", "brank")
    return ranks.persist(), n


def _rows_of(rows: list, kind: str) -> Column:
    """Rows known to the driver (parameters) as one literal array of structs; a single JSON text,
    so that the plan does not grow with thousands of trials."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def sweep_metrics(prep, trials: DataFrame, top_n="data_top_n", lookback="data_lookback",
                  denominator="data_denominator") -> DataFrame:
    """Per (trial, split): FPR, FNR, positive MAE, percentage error of the
    average baseline under each trial's data parameters.

    What is shuffled does not depend on the trials: the input and target cells, once, by
    (split, user).  Each (user, brand) then has a running spend over its buckets from the newest
    back, and the value at a lookback is read off the bucket where that lookback ends.  A trial's
    vocabulary cuts the brand ranks: brands up to the cut stand for themselves, so their cells are
    counted once per (first cut that holds the brand, lookback, denominator) and a trial adds up
    the cuts below its own; the rest meet in ``<UNK>``, whose spend per user is first summed per
    (first cut, bucket) and then cut twice, by rank and by lookback, inside the user's partition."""
    from ..plans.prepare import split_case
    spec, c = prep.spec, prep.cfg.cutoffs
    k_last, n_all = {}, {}
    for s in ("train", "val", "test"):
        lo, hi = spec.bucket_range(c.in_start, c.target_start(s))
        k_last[s], n_all[s] = hi, max(0, hi - lo + 1)
    longest = max(1, *n_all.values())
    ranks, n_brands = brand_ranks(prep.fit_rows())
    # one row per trial: parameters, not data.  Beyond all intervals or all brands nothing changes.
    settings = [(int(t["trial"]), min(int(t["n"]), n_brands), min(int(t["l"]), longest), str(t["d"]))
                for t in trials.select("trial", F.col(top_n).alias("n"), F.col(lookback).alias("l"),
                                       F.col(denominator).alias("d")).collect()]
    cuts = sorted({n for _, n, _, _ in settings})
    at = {n: i for i, n in enumerate(cuts)}
    reads = [{"look": look, "den": d} for look, d in sorted({(look, d) for _, _, look, d in settings})]
    unknown = [{"cut": at[n], "look": look, "den": d} for n, look, d in sorted({s[1:] for s in settings})]
    first_cut = F.size(F.filter(F.array(*[F.lit(n) for n in cuts]), lambda n: n < F.col("brank")))
    held = ranks.select(F.col("brand").alias("_brand"), first_cut.alias("_cut"))
    oldest = max(r["look"] for r in reads) if reads else 0

    cols = ["split", "user_id", "brand", "k", "amount"]
    rows = (prep.input_rows().select(*cols, F.lit(False).alias("_goal"))
            .unionByName(prep.target_rows().select(*cols, F.lit(True).alias("_goal"))))
    back = F.when(F.col("_goal"), F.lit(0)).otherwise(split_case(k_last) - F.col("k") + 1).cast("int")
    rows = (lookup(rows.where(F.col("_goal") | (back <= F.lit(oldest))), held, "brand", "_brand")
            .withColumn("cut", F.coalesce("_cut", F.lit(len(cuts)))).drop("_cut"))
    rows = spread(rows, prep.partitions, "split", "user_id").withColumn("back", back)

    spent = limbs(F.when(~F.col("_goal"), F.col("amount")))
    goal = limbs(F.when(F.col("_goal"), F.col("amount")))
    named = {**{f"s_{n}": x for n, x in spent.items()}, **{f"t_{n}": x for n, x in goal.items()}}

    def totals(df: DataFrame) -> DataFrame:
        s, t = (settled(total_of({n: F.col(f"{side}_{n}") for n in LIMBS})) for side in "st")
        return df.withColumns({"_s": s, "_t": F.coalesce(t, F.lit(0.0))}).drop(*named)

    def cells(df: DataFrame, unk: bool) -> DataFrame:
        den = F.when(F.col("den") == "all", F.least(F.col("look"), split_case(n_all))).otherwise(F.col("_active"))
        return df.select("split", F.lit(unk).alias("unk"), "cut", "look", "den", F.col("_t").alias("t"),
                         F.coalesce(F.col("_s") / den.cast("double"), F.lit(0.0)).alias("p"))

    # brands that stand for themselves: running sums, targets (back 0) first
    run = Window.partitionBy("split", "user_id", "brand").orderBy("back", "k")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select(
        "split", "cut", "back", F.coalesce(F.lead("back").over(run), F.lit(oldest + 1)).alias("_next"),
        *[F.sum(x).over(so_far).alias(n) for n, x in named.items()],
        F.sum(F.when(F.col("_goal"), 0).otherwise(1)).over(so_far).alias("_active")).where(F.col("cut") < len(cuts))
    covered = F.filter(_rows_of(reads, "look int, den string"),
                       lambda r: (r["look"] >= F.col("back")) & (r["look"] < F.col("_next")))
    own = cells(totals(own).withColumn("_r", F.explode(covered)).select("*", "_r.*"), False)

    # <UNK>: a bucket counts as active for every cut below its rarest brand, so that brand carries it
    rarest = Window.partitionBy("split", "user_id", "k").orderBy("_goal", F.col("cut").desc(), "brand")
    rare = (rows.withColumn("_top", ((F.row_number().over(rarest) == 1) & ~F.col("_goal")).cast("int"))
            .where(F.col("cut") > 0).groupBy("split", "user_id", "cut", "back")
            .agg(*[F.sum(x).alias(n) for n, x in named.items()], F.sum("_top").alias("_active")))
    reached = F.filter(_rows_of(unknown, "cut int, look int, den string"),
                       lambda r: (r["cut"] < F.col("cut")) & (r["look"] >= F.col("back")))
    unk = (rare.withColumn("_r", F.explode(reached)).drop("cut").select("*", "_r.*")
           .groupBy("split", "user_id", "cut", "look", "den")
           .agg(*[F.sum(n).alias(n) for n in named], F.sum("_active").alias("_active")))
    unk = cells(totals(unk), True)

    tpos, ppos = F.abs(F.col("t")) > 0, F.abs(F.col("p")) > 0
    error = limbs(F.when(tpos, F.abs(F.col("p") - F.col("t"))))
    ratio = limbs(F.when(tpos & ppos, F.abs((F.col("t") - F.col("p")) / F.col("t"))))
    sums = {"n_positive": F.when(tpos, 1).otherwise(0), "_fp": F.when(~tpos & ppos, 1).otherwise(0),
            "_fn": F.when(tpos & ~ppos, 1).otherwise(0), "_both": F.when(tpos & ppos, 1).otherwise(0),
            **{f"e_{n}": x for n, x in error.items()}, **{f"r_{n}": x for n, x in ratio.items()}}
    counted = own.unionByName(unk).groupBy("split", "unk", "cut", "look", "den").agg(
        *[F.sum(x).alias(n) for n, x in sums.items()])

    # at most splits x cuts x (lookback, denominator) pairs of rows are left
    tried = _rows_of([{"trial": i, "top": n, "mine": at[n], "l": look, "d": d} for i, n, look, d in settings],
                     "trial bigint, top bigint, mine int, l int, d string")
    uses = F.filter(tried, lambda r: (r["l"] == F.col("look")) & (r["d"] == F.col("den"))
                    & F.when(F.col("unk"), r["mine"] == F.col("cut")).otherwise(r["mine"] >= F.col("cut")))
    agg = counted.withColumn("trial", F.explode(F.transform(uses, lambda r: r["trial"]))).groupBy("trial", "split").agg(
        *[F.sum(n).alias(n) for n in sums])
    users = prep.members.groupBy("split").agg(F.count(F.lit(1)).alias("n_users"))
    size = (users.withColumn("_r", F.explode(tried))
            .select("split", "n_users", "_r.trial", (F.lit(3) + F.col("_r.top")).alias("vocab_size")))
    return _metrics_by_trial(agg, size)


def _metrics_by_trial(agg: DataFrame, size: DataFrame) -> DataFrame:
    j = size.join(agg, ["trial", "split"], "left").fillna(0, ["n_positive", "_fp", "_fn", "_both"])
    n_cells = F.col("n_users") * F.col("vocab_size")
    error = total_of({n: F.col(f"e_{n}") for n in LIMBS})
    ratio = total_of({n: F.col(f"r_{n}") for n in LIMBS})
    return j.select(
        "trial", "split", "n_users", n_cells.alias("n_cells"), "n_positive",
        F.try_divide(F.col("_fp").cast("double"), (n_cells - F.col("n_positive")).cast("double")).alias("false_positive_rate"),
        F.try_divide(F.col("_fn").cast("double"), F.col("n_positive").cast("double")).alias("false_negative_rate"),
        F.try_divide(settled(error), F.col("n_positive").cast("double")).alias("positive_mae"),
        F.round(F.try_divide(ratio, F.col("_both").cast("double")) * F.lit(100.0), 9).alias("percentage_error"))


def best_trial(metrics: DataFrame, trials: DataFrame, split: str = "val",
               metric: str = "positive_mae") -> DataFrame:
    """The trial with the smallest metric on ``split`` (ties: lowest trial)."""
    m = metrics.where((F.col("split") == split) & F.col(metric).isNotNull())
    best = m.agg(F.min_by(F.struct("trial", F.col(metric).alias("value")),
                          F.struct(F.col(metric), F.col("trial"))).alias("b")).select("b.*")
    return best.join(trials, "trial")


def resume_sweep(prep, space, n_trials: int, log, run: str, seed: int = 42,
                 split: str = "val", metric: str = "positive_mae") -> DataFrame:
    """Continue a logged sweep: evaluate only trials missing from the log
    (anti join), append them, and return the best trial over all logged ones.

    Trials are deterministic in (seed, trial), so trial ``i`` of a resumed
    run has the same parameters as in the first run."""
    from ..sources.store import melt_metrics
    spark = prep.buckets.sparkSession
    trials = trial_table(spark, space, n_trials, seed)
    done = log.read(run).select("trial").distinct()
    todo = trials.join(done, "trial", "left_anti").persist()
    ids = sorted(r.trial for r in todo.select("trial").collect())  # <= n_trials ids
    if ids:
        m = sweep_metrics(prep, todo)
        log.append(melt_metrics(m, run, metric_cols=[c for c in m.columns if c not in ("trial", "split")]),
                   chunk=f"{ids[0]}-{ids[-1]}-{len(ids)}")
    todo.unpersist()
    logged = log.read(run).where((F.col("split") == split) & (F.col("metric") == metric))
    wide = logged.select("trial", F.col("value").alias(metric), F.lit(split).alias("split"))
    return best_trial(wide, trials, split, metric)
