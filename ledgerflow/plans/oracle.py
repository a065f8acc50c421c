"""DuckDB oracle SQL for the registered queries.

Independent, plain-SQL restatements of each operator over the supplied
tables, used to check the Spark plans value by value.  One shared CTE chain
(source -> bounds -> cells -> split -> vocabulary / scalers -> windows) is
generated per configuration; each query is a SELECT on top of it.
"""
from __future__ import annotations

import datetime as dt

from ..config import DataConfig
from ..functions.timecols import advance, parse_interval

def ts(v) -> str:
    if not isinstance(v, dt.datetime):
        v = dt.datetime.fromisoformat(str(v))
    return f"TIMESTAMP '{v.isoformat(sep=' ')}'"


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


SOURCES = {
    "tx": ("SELECT CAST(o.o_custkey AS BIGINT) AS user_id, o.o_orderdate AS date, p.p_brand AS brand, "
           "l.l_extendedprice * (1.0 - l.l_discount) AS amount FROM lineitem l "
           "JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"),
    "ev": "SELECT CAST(user_id AS BIGINT) AS user_id, ts AS date, event_type AS brand, value AS amount FROM events",
}


def settled(x: str) -> str:
    """A finished sum kept to 13 significant digits, as the library keeps it."""
    unit = f"pow(10.0::DOUBLE, 12 - floor(log10(abs({x}))))"
    return f"(CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE round_even({x} * {unit}, 0) / {unit} END)"


def exact_sum(x: str) -> str:
    """The sum of the decimals that DOUBLE values print as, to 18 places."""
    return f"CAST(CAST(sum(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE)"


def money_sum(col: str) -> str:
    return settled(f"coalesce({exact_sum(col)}, 0.0::DOUBLE)")


def bucket_idx(t: str, W: int) -> str:
    return f"greatest(1, (epoch_us({t}) - epoch_us(spec.lo) + {W - 1}) // {W})"


def delta(t: str) -> str:
    return f"CAST(floor((epoch_us({t}) - epoch_us(ee.e)) / 86400000000.0) AS BIGINT)"


def chain(view: str, cfg: DataConfig, interval: str | None = None, top_n="cfg",
          freq_threshold="cfg", strict: bool = False) -> str:
    """The shared WITH-chain.  CTEs: src raw bnd spec cells users roles members
    wcells fitrows bstats kept vocab mm ee inrows trows nall."""
    monthly = (interval or cfg.interval) == "MS"  # edges are first days, as date_trunc gives them
    W, weekly = (0, False) if monthly else parse_interval(interval or cfg.interval)

    def idx(t: str) -> str:
        return (f"greatest(1, date_diff('month', spec.lo, date_trunc('month', {t})) + CASE WHEN {t} > date_trunc('month', {t}) THEN 1 ELSE 0 END)"
                if monthly else bucket_idx(t, W))

    c = cfg.cutoffs
    sp = cfg.splits
    tstart = {s: dt.datetime.fromisoformat(c.target_start(s)) for s in ("train", "val", "test")}
    tend = {s: advance(v, interval or cfg.interval) for s, v in tstart.items()}
    last_end = max(tend.values())
    in_start = dt.datetime.fromisoformat(c.in_start)
    top_n = cfg.brand.top_n if top_n == "cfg" else top_n
    freq_threshold = cfg.brand.freq_threshold if freq_threshold == "cfg" else freq_threshold
    lo_expr = ("lo0 + to_days(CAST((7 - dayofweek(lo0)) % 7 AS INTEGER))" if weekly else "lo0")
    if monthly:
        lo_expr = "CASE WHEN lo0 = date_trunc('month', lo0) THEN lo0 ELSE date_trunc('month', lo0) + INTERVAL 1 MONTH END"
    n_buckets = "date_diff('month', lo, date_trunc('month', hi))" if monthly else f"(epoch_us(hi) - epoch_us(lo)) // {W}"
    last_edge = "epoch_us(spec.lo + to_months(CAST(spec.m AS INTEGER)))" if monthly else f"epoch_us(spec.lo) + spec.m * {W}"

    def case(vals):
        return "CASE split " + " ".join(f"WHEN '{s}' THEN {ts(v)}" for s, v in vals.items()) + " END"

    if top_n is not None:
        kept = f"SELECT * FROM bstats ORDER BY cnt DESC, fu, fk, brand LIMIT {int(top_n)}"
    elif freq_threshold is not None:
        kept = (f"SELECT * FROM bstats WHERE cnt >= (SELECT count(*) FROM fitrows) * {d(freq_threshold)}")
    else:
        kept = "SELECT * FROM bstats"
    a, b = cfg.feature_range
    n_all = []
    for s in ("train", "val", "test"):
        e = ts(tstart[s] - dt.timedelta(microseconds=1))
        st = ts(in_start)
        n_all.append(
            f"SELECT '{s}' AS split, CASE WHEN spec.m <= 0 OR {e} < spec.lo "
            f"OR epoch_us({st}) > {last_edge} OR {e} < {st} THEN 0 ELSE "
            f"least({idx(e)}, spec.m) - least({idx(f'greatest({st}, spec.lo)')}, spec.m) + 1 "
            f"END AS n_all FROM spec")
    return f"""WITH src AS ({SOURCES[view]}),
raw AS (SELECT * FROM src WHERE user_id IS NOT NULL AND brand IS NOT NULL AND date IS NOT NULL),
bnd AS (SELECT min(date) AS lo0, max(date) AS hi FROM src),
spec0 AS (SELECT {lo_expr} AS lo, hi FROM bnd),
spec AS (SELECT lo, hi, CASE WHEN hi >= lo THEN {n_buckets} ELSE 0 END AS m FROM spec0),
bk AS (SELECT r.user_id, {idx('r.date')} AS k, r.brand, r.amount, r.date, spec.m
       FROM raw r, spec WHERE r.date >= spec.lo),
cells AS (SELECT user_id, k, brand, {money_sum('amount')} AS amount, min(date) AS date
          FROM bk WHERE k <= m GROUP BY user_id, k, brand),
users AS (SELECT DISTINCT user_id FROM src WHERE user_id IS NOT NULL),
nu AS (SELECT count(*) AS n FROM users),
q1 AS (SELECT n, CAST(ceil(({d(sp.val)} + {d(sp.test)}) * n) AS BIGINT) AS n_temp FROM nu),
q2 AS (SELECT n, n_temp, n - n_temp AS n_train,
              CAST(ceil({d(sp.test)} / ({d(sp.val)} + {d(sp.test)}) * n_temp) AS BIGINT) AS n_test FROM q1),
q AS (SELECT n, n_train, n_test, n_temp - n_test AS n_val,
             CAST(ceil({d(sp.train)} * {d(sp.overlap)} * n_train) AS BIGINT) AS n_ovl FROM q2),
ranked AS (SELECT user_id, row_number() OVER (ORDER BY md5('{sp.seed}' || ':' || CAST(user_id AS VARCHAR)), user_id) AS rank FROM users),
roles AS (SELECT user_id, CASE WHEN rank <= n_test THEN 'test' WHEN rank <= n_test + n_val THEN 'val'
                 WHEN rank <= n_test + n_val + n_ovl THEN 'train_overlap' ELSE 'train' END AS role, rank
          FROM ranked, q),
members AS (SELECT user_id, 'train' AS split FROM roles WHERE role IN ('train', 'train_overlap')
            UNION ALL SELECT user_id, 'val' FROM roles WHERE role IN ('val', 'train_overlap')
            UNION ALL SELECT user_id, 'test' FROM roles WHERE role IN ('test', 'train_overlap')),
wcells AS (SELECT * FROM cells WHERE date >= {ts(in_start)} AND date < {ts(last_end)}),
sraw AS (SELECT b.user_id, b.k, b.brand, b.amount, b.date, m.split FROM bk b JOIN members m ON b.user_id = m.user_id
         WHERE b.k <= b.m),
strict_in AS (SELECT split, user_id, k, brand, {money_sum('amount')} AS amount, min(date) AS date FROM sraw
        WHERE date >= {ts(in_start)} AND date < {case(tstart)} GROUP BY split, user_id, k, brand),
strict_tg AS (SELECT split, user_id, k, brand, {money_sum('amount')} AS amount, min(date) AS date FROM sraw
        WHERE date >= {case(tstart)} AND date < {case(tend)} GROUP BY split, user_id, k, brand),
fitrows AS ({"SELECT user_id, k, brand, amount, date FROM strict_in WHERE split = 'train'" if strict else
             f"""SELECT w.* FROM wcells w JOIN members m ON w.user_id = m.user_id AND m.split = 'train'
            WHERE w.date >= {ts(in_start)} AND w.date < {ts(tstart['train'])}"""}),
bfirst AS (SELECT brand, user_id AS fu, k AS fk,
                  row_number() OVER (PARTITION BY brand ORDER BY user_id, k) AS rn FROM fitrows),
bstats AS (SELECT f.brand, f.fu, f.fk, c.cnt FROM bfirst f
           JOIN (SELECT brand, count(*) AS cnt FROM fitrows GROUP BY brand) c ON f.brand = c.brand WHERE f.rn = 1),
kept AS ({kept}),
vocab AS (SELECT 0 AS id, '<SOS>' AS value UNION ALL SELECT 1, '<EOS>' UNION ALL SELECT 2, '<UNK>'
          UNION ALL SELECT CAST(row_number() OVER (ORDER BY fu, fk, brand) + 2 AS INTEGER), brand FROM kept),
vsize AS (SELECT count(*) AS v FROM vocab),
mm0 AS (SELECT CAST(min(amount) AS DOUBLE) AS lo, CAST(max(amount) AS DOUBLE) AS hi FROM fitrows),
mm1 AS (SELECT lo, hi, ({d(b)} - {d(a)}) / (CASE WHEN hi - lo <> 0 THEN hi - lo ELSE {d(1.0)} END) AS scale FROM mm0),
mm AS (SELECT lo, hi, scale, {d(a)} - lo * scale AS offset FROM mm1),
ee AS (SELECT min(date) AS e FROM fitrows),
inrows AS ({"SELECT user_id, k, brand, amount, date, split FROM strict_in" if strict else
            f"""SELECT w.*, m.split FROM wcells w JOIN members m ON w.user_id = m.user_id
           WHERE w.date >= {ts(in_start)} AND w.date < {case(tstart)}"""}),
trows AS ({"SELECT user_id, k, brand, amount, date, split FROM strict_tg" if strict else
           f"""SELECT w.*, m.split FROM wcells w JOIN members m ON w.user_id = m.user_id
          WHERE w.date >= {case(tstart)} AND w.date < {case(tend)}"""}),
nall AS ({' UNION ALL '.join(n_all)}),
nusers AS (SELECT split, count(*) AS n_users FROM members GROUP BY split)
"""


def sequences_sql(view: str, cfg: DataConfig, strict: bool = False, newest: int | None = None) -> str:
    c = cfg.cutoffs
    tstart = {s: c.target_start(s) for s in ("train", "val", "test")}
    eos_date = "CASE m.split " + " ".join(
        f"WHEN '{s}' THEN {delta(ts(v))}" for s, v in tstart.items()) + " END"
    kept = "inrows" if newest is None else f"""(SELECT * FROM inrows
        QUALIFY row_number() OVER (PARTITION BY split, user_id ORDER BY k DESC, brand DESC) <= {newest})"""
    return chain(view, cfg, strict=strict) + f""",
enc AS (SELECT i.split, i.user_id, i.k, i.brand AS bk, coalesce(v.id, 2) AS brand,
               i.amount * mm.scale + mm.offset AS amount, {delta('i.date')} AS date
        FROM {kept} i LEFT JOIN vocab v ON v.value = i.brand, mm, ee),
body AS (SELECT split, user_id, CAST(row_number() OVER (PARTITION BY split, user_id ORDER BY k, bk) AS INTEGER) AS pos,
                brand, amount, date FROM enc),
lens AS (SELECT split, user_id, count(*) AS n FROM {kept} GROUP BY split, user_id),
sos AS (SELECT m.split, m.user_id, 0 AS pos, 0 AS brand, {d(-1.0)} AS amount, {delta(ts(c.in_start))} AS date
        FROM members m, ee),
eos AS (SELECT m.split, m.user_id, CAST(coalesce(l.n, 0) + 1 AS INTEGER) AS pos, 1 AS brand, {d(2.0)} AS amount,
               {eos_date} AS date
        FROM members m LEFT JOIN lens l ON m.split = l.split AND m.user_id = l.user_id, ee),
seq AS MATERIALIZED (SELECT * FROM sos UNION ALL SELECT * FROM body UNION ALL SELECT * FROM eos)
"""


def targets_sql(view: str, cfg: DataConfig, strict: bool = False) -> str:
    return sequences_sql(view, cfg, strict) + f""",
tcells0 AS (SELECT t.split, t.user_id, CAST(coalesce(v.id, 2) AS INTEGER) AS brand_id,
                   {exact_sum("t.amount")} AS s, count(*) AS n
            FROM trows t LEFT JOIN vocab v ON v.value = t.brand GROUP BY ALL),
tcells AS (SELECT split, user_id, brand_id, 1 AS brand_flag,
                  {settled("s")} * mm.scale + CAST(n AS DOUBLE) * mm.offset AS amount,
                  {settled("s")} AS amount_raw, n AS n_rows FROM tcells0, mm)
"""


def baseline_sql(view: str, cfg: DataConfig, denominator: str = "all") -> str:
    den = "CAST(n_all AS DOUBLE)" if denominator == "all" else "CAST(active AS DOUBLE)"
    return targets_sql(view, cfg) + f""",
pred0 AS (SELECT i.split, i.user_id, CAST(coalesce(v.id, 2) AS INTEGER) AS brand_id,
                 {exact_sum("i.amount")} AS s, count(DISTINCT i.k) AS active
          FROM inrows i LEFT JOIN vocab v ON v.value = i.brand GROUP BY ALL),
pred AS (SELECT p.split, p.user_id, p.brand_id,
                {settled("p.s")} / {den} AS predicted
         FROM pred0 p JOIN nall USING (split)),
aligned AS (SELECT coalesce(p.split, t.split) AS split, coalesce(p.user_id, t.user_id) AS user_id,
                   coalesce(p.brand_id, t.brand_id) AS brand_id,
                   coalesce(p.predicted, 0.0::DOUBLE) AS p, coalesce(t.amount_raw, 0.0::DOUBLE) AS t
            FROM pred p FULL OUTER JOIN tcells t
              ON p.split = t.split AND p.user_id = t.user_id AND p.brand_id = t.brand_id)
"""
