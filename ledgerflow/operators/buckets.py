"""Tumbling-bucket aggregation of transactions.

Edges are ``origin + k * W`` for k = 0..m, with ``origin`` the earliest date
(or, for week intervals, the first Sunday on or after it, keeping its time of
day) and ``m = (latest - origin) div W``.  Bucket k is right-closed,
``(e[k-1], e[k]]``, and bucket 1 also holds ``e[0]``.  Rows after the last
edge (and, for weeks, before the first Sunday) fall outside every bucket.

Calendar intervals (``'MS'``, ``'2M'``, ``'QS'``, ``'Y'``, ``'W-MON'`` ...) have their edges on first
or last days or weekdays from the earliest date on, with the same rules (:class:`CalendarSpec`).

Per (user, bucket, brand) the aggregate keeps the amount sum (exact; a
null amount counts as 0) and the first (earliest) date.  Only
non-empty cells are produced; the dense users x buckets x brands grid is
summarised arithmetically by :func:`dense_grid_summary` instead of being
materialised.
"""
from __future__ import annotations

import bisect
import datetime as dt
import json
from dataclasses import dataclass
from typing import Optional, Tuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixedpoint import exact_sums
from ..functions.timecols import (add_micros, advance, calendar_edges, calendar_interval, micros_between,
                                  parse_interval, ts_lit, ts_text)

_ONE_US = dt.timedelta(microseconds=1)


@dataclass(frozen=True)
class BucketSpec:
    """Fitted bucket edges; the edges are plain literals in every plan, so
    window filters on raw dates reach the parquet scan."""
    origin: Optional[dt.datetime]
    width_us: int
    n_buckets: int
    interval: str

    def advance(self, when: dt.datetime) -> dt.datetime:
        """One interval after ``when``."""
        return advance(when, self.interval)

    def edge(self, k: int) -> dt.datetime:
        return self.origin + dt.timedelta(microseconds=self.width_us * k)

    def index_of(self, ts: dt.datetime) -> int:
        """Bucket index of a timestamp, clamped to [1, n_buckets]."""
        d = (ts - self.origin) // _ONE_US
        k = max(1, -(-d // self.width_us))
        return min(k, self.n_buckets)

    def bucket_range(self, start, end) -> Tuple[int, int]:
        """Buckets that can hold a first date inside ``[start, end)``."""
        s, e = _as_dt(start), _as_dt(end) - _ONE_US
        if self.n_buckets <= 0 or e < self.origin or s > self.edge(self.n_buckets) or e < s:
            return 1, 0
        return self.index_of(max(s, self.origin)), self.index_of(e)

    def count_in_window(self, start, end) -> int:
        lo, hi = self.bucket_range(start, end)
        return max(0, hi - lo + 1)

    # Column expressions -------------------------------------------------
    def origin_col(self) -> Column:
        return ts_lit(self.origin)

    def index_col(self, date: str = "date") -> Column:
        """``greatest(1, ceil((date - origin) / W))`` in exact integer µs."""
        w = self.width_us
        return F.expr(
            f"greatest(1L, (timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{self.origin.isoformat(sep=' ')}', "
            f"`{date}`) + {w - 1}L) div {w}L)")

    def edge_col(self, k: Column) -> Column:
        return add_micros(self.origin_col(), k.cast("bigint") * F.lit(self.width_us))


@dataclass(frozen=True)
class CalendarSpec(BucketSpec):
    """Buckets between calendar days, of unequal width: edges are a literal array, and a row's bucket
    is found in it by binary search."""
    edges: tuple = ()

    def edge(self, k: int) -> dt.datetime:
        return self.edges[k]

    def index_of(self, ts: dt.datetime) -> int:
        return min(max(1, bisect.bisect_left(self.edges, ts)), self.n_buckets)

    def _micros(self) -> Column:
        first = self.edges[0]
        return F.from_json(F.lit(json.dumps([(e - first) // _ONE_US for e in self.edges])), "array<bigint>")

    def index_col(self, date: str = "date") -> Column:
        """The number of edges before the date, 1 at least: steps of halving length over the array."""
        n = len(self.edges)
        steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
        after = F.struct(micros_between(ts_lit(self.origin), F.col(date)).alias("t"), self._micros().alias("e"))

        def search(x):
            return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
                (at + step <= n) & (F.try_element_at(x["e"], at + step) < x["t"]), at + step).otherwise(at))
        return F.greatest(F.lit(1), F.element_at(F.transform(F.array(after), search), 1)).cast("bigint")

    def edge_col(self, k: Column) -> Column:
        return add_micros(self.origin_col(), F.element_at(self._micros(), k.cast("int") + 1))


def _as_dt(x) -> dt.datetime:
    if isinstance(x, dt.datetime):
        return x
    if isinstance(x, dt.date):
        return dt.datetime(x.year, x.month, x.day)
    return dt.datetime.fromisoformat(str(x))


def fit_buckets(df: DataFrame, interval: str, origin=None, end=None) -> BucketSpec:
    """Bucket edges from the data's date range.

    One global min/max aggregate (two scalars reach the driver) unless both
    ``origin`` and ``end`` are supplied, which skips the scan entirely.
    """
    width, weekly = (0, False) if calendar_interval(interval) else parse_interval(interval)
    if origin is None or end is None:
        row = df.where(F.col("date").isNotNull()).agg(
            F.min("date").alias("lo"), F.max("date").alias("hi")).first()
        lo = _as_dt(origin) if origin is not None else row["lo"]
        hi = _as_dt(end) if end is not None else row["hi"]
    else:
        lo, hi = _as_dt(origin), _as_dt(end)
    if lo is None or hi is None:
        return BucketSpec(None, width, 0, interval)
    if calendar_interval(interval):
        edges = tuple(calendar_edges(lo, hi, interval))
        if len(edges) < 2:
            return BucketSpec(None, width, 0, interval)
        return CalendarSpec(edges[0], width, len(edges) - 1, interval, edges)
    if weekly:
        # first Sunday on or after the earliest date (weekday(): Monday=0)
        lo = lo + dt.timedelta(days=(6 - lo.weekday()) % 7)
    m = (hi - lo) // dt.timedelta(microseconds=width) if hi >= lo else 0
    return BucketSpec(lo, width, int(m), interval)


def clean(df: DataFrame) -> DataFrame:
    """Rows with a null key (user, brand or date) never reach a bucket."""
    return df.where(F.col("user_id").isNotNull() & F.col("brand").isNotNull()
                    & F.col("date").isNotNull())


def bucketize(df: DataFrame, spec: BucketSpec, keep_tail: bool = False) -> DataFrame:
    """Add bucket index ``k``; drop rows outside the edges (unless
    ``keep_tail``, which keeps rows after the last edge in bucket k > m)."""
    if spec.origin is None:
        return clean(df).withColumn("k", F.lit(None).cast("bigint")).where(F.lit(False))
    out = clean(df).where(F.col("date") >= spec.origin_col())
    out = out.withColumn("k", spec.index_col("date"))
    if not keep_tail:
        out = out.where(F.col("k") <= F.lit(spec.n_buckets))
    return out


def window_prefilter(df: DataFrame, spec: BucketSpec, start, end) -> DataFrame:
    """Keep raw rows of the buckets that can have a first date in
    ``[start, end)``.  A bucket is kept or dropped as a whole, so filtering
    the raw rows first is exact, and the literal date range is pushed down to
    the scan (Catalyst cannot push a filter on ``min(date)`` below the
    aggregate by itself)."""
    k_lo, k_hi = spec.bucket_range(start, end)
    if k_hi < k_lo:
        return df.where(F.lit(False))
    lo_edge = spec.edge(k_lo - 1)
    hi_edge = spec.edge(k_hi)
    lower = (F.col("date") >= ts_lit(lo_edge)) if k_lo == 1 else (F.col("date") > ts_lit(lo_edge))
    return df.where(lower & (F.col("date") <= ts_lit(hi_edge)))


def bucket_aggregate(df: DataFrame, spec: BucketSpec, window=None,
                     keep_tail: bool = False) -> DataFrame:
    """Sparse bucket table ``(user_id, k, brand, amount, date)``.

    ``window=(start, end)`` keeps only cells whose first date lies in the
    half-open window (the reference's date filter, applied after the
    aggregate) and prunes the raw rows to the candidate buckets first.
    Partial (map-side) aggregation runs before the shuffle on
    (user_id, k, brand), so a hot user costs at most intervals x brands rows.
    """
    src = df
    if window is not None:
        src = window_prefilter(src, spec, *window)
    rows = bucketize(src, spec, keep_tail=keep_tail)
    agg = exact_sums(rows.groupBy("user_id", "k", "brand"), {"amount": F.col("amount")},
                     F.min("date").alias("date"), zero=True).select("user_id", "k", "brand", "amount", "date")
    if window is not None:
        agg = date_window(agg, *window)
    return agg


def date_window(df: DataFrame, start, end, col: str = "date") -> DataFrame:
    """Half-open filter ``start <= date < end`` (null dates fail)."""
    return df.where((F.col(col) >= ts_lit(_as_dt(start))) & (F.col(col) < ts_lit(_as_dt(end))))


def bucket_label(df: DataFrame, spec: BucketSpec, k: str = "k",
                 out: str = "time_interval") -> DataFrame:
    """Interval text ``(e[k-1], e[k]]``; bucket 1 is labelled ``[e0, e1]``
    because it includes its lower edge (microsecond edges cannot express the
    reference's 1 ns earlier bound)."""
    kc = F.col(k)
    lo, hi = ts_text(spec.edge_col(kc - 1)), ts_text(spec.edge_col(kc))
    return df.withColumn(out, F.concat(
        F.when(kc == 1, F.lit("[")).otherwise(F.lit("(")), lo, F.lit(", "), hi, F.lit("]")))


def bucket_coverage(df: DataFrame, spec: BucketSpec) -> DataFrame:
    """One row: raw rows, rows inside the buckets, dropped rows, binned
    amount.  Reports what falls outside the edges instead of hiding it."""
    c = clean(df)
    if spec.origin is None:
        inside = F.lit(False)
    else:
        d = micros_between(spec.origin_col(), F.col("date"))
        inside = (d >= 0) & (spec.index_col("date") <= F.lit(spec.n_buckets))
    return exact_sums(
        c.select(inside.alias("inside"), F.when(inside, F.col("amount")).alias("amount")),
        {"amount_binned": F.col("amount")},
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("inside"), 1)).alias("n_binned"),
        F.count(F.when(~F.col("inside"), 1)).alias("n_dropped"), zero=True)


def dense_grid_summary(df: DataFrame, spec: BucketSpec) -> DataFrame:
    """Size of the dense users x buckets x brands grid without building it.

    The reference materialises every cell (empty ones with amount 0 and no
    date).  Nothing downstream needs an empty cell except the list of users,
    so the grid is only counted: users and brands are the distinct non-null
    raw keys, including those whose rows all fell outside the buckets."""
    inside, k = F.lit(False), F.lit(None).cast("bigint")
    if spec.origin is not None:
        k = spec.index_col("date")
        inside = (F.col("user_id").isNotNull() & F.col("brand").isNotNull() & (F.col("date") >= spec.origin_col())
                  & (k <= F.lit(spec.n_buckets)))
    # one pass: cells of the buckets, and beside them (bucket NULL) the keys of all other rows
    rows = df.select("user_id", "brand", F.when(inside, k).alias("k"), F.when(inside, F.col("amount")).alias("amount"))
    cells = exact_sums(rows.groupBy("user_id", "brand", "k"), {"amount": F.col("amount")}, zero=True)
    out = exact_sums(cells, {"amount": F.col("amount")}, F.countDistinct("user_id").alias("n_users"),
                     F.countDistinct("brand").alias("n_brands"), F.count("k").alias("n_nonempty"), zero=True
                     ).select("n_users", "n_brands", "n_nonempty", "amount")
    n_cells = F.col("n_users") * F.col("n_brands") * F.lit(spec.n_buckets)
    return out.select(
        "n_users", F.lit(spec.n_buckets).cast("bigint").alias("n_buckets"), "n_brands",
        n_cells.alias("n_cells"), "n_nonempty",
        (n_cells - F.col("n_nonempty")).alias("n_empty"), "amount")
