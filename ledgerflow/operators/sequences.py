"""Per-user input sequences and next-interval targets.

Sequences are produced in LONG form, one row per element
``(split, user_id, pos, <features>)`` with the start token at ``pos = 0`` and
the end token last.  Elements are ordered by (bucket, brand) -- not date --
like the reference.  Positions come from one window per (split, user) when
the longest user is checked to fit a task; otherwise a per-(user, bucket)
count gives running offsets (a user has at most as many buckets as the time
range holds) and a rank inside each (user, bucket) gives the place within
it, so a user holding a third of all rows is spread over its buckets.
:func:`collect_sequences` builds the per-user arrays for consumers that need
them.

Targets are SPARSE cells ``(split, user_id, brand_id, ...)``: only non-zero
cells exist.  :func:`dense_blocks` holds them as arrays of ``BLOCK`` slots, blocks
without a cell left out; :func:`dense_vectors` puts those together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixedpoint import exact_sums
from .joins import spread
from ..registry import Registry

SEQUENCE_BUILDERS = Registry("sequence builder")

# Slots in a block of a dense vector.
BLOCK = 4_096


def _encode(rows: DataFrame, encoders: dict, features) -> DataFrame:
    """Encode features; features another encoder groups by (e.g. a per-brand
    scaler) are replaced last, so the group lookup sees the raw values."""
    groups = {getattr(e, "group_by", None) for e in encoders.values()}
    order = sorted(features, key=lambda f: f in groups)
    out = rows
    for f in order:
        if f in encoders:
            out = encoders[f].transform(out, f)
    return out


# Sequences up to this many elements are numbered by one window per user;
# longer ones are numbered per (user, bucket) so no task holds a whole user.
SINGLE_TASK_MAX = 2_000_000


@SEQUENCE_BUILDERS.register("continuous_time")
def sequence_rows(rows: DataFrame, members: DataFrame, encoders: dict, features,
                  start_of: Column, end_of: Column | dict,
                  single_task_max: int = SINGLE_TASK_MAX, longest: int | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Long-form sequences.

    ``rows``: ``(split, user_id, k, brand, amount, date)`` inside each split's
    input window.  ``members``: ``(split, user_id)``; every member gets a
    sequence, ``[SOS, EOS]`` when it has no rows.  ``start_of`` / ``end_of``
    map a split to its window bounds (python values per split).

    The per-user lengths (needed for the end token anyway) are aggregated
    first and their maximum checked: when every user fits ``single_task_max``
    a single window per (split, user) numbers the elements; otherwise
    positions are built from per-(user, bucket) counts and ranks, which
    spreads a hot user over its buckets.  ``longest``: a known upper bound of
    any user's length (e.g. the busiest user's raw row count), which spares
    the check when it is already small enough.  ``partitions``: over how many
    the window's rows are dealt out, where the session's number is too small.
    """
    features = list(features)
    keyed = rows.withColumn("_bk", F.col("brand"))
    enc = _encode(keyed, encoders, features)

    lengths = rows.groupBy("split", "user_id").agg(F.count(F.lit(1)).alias("_n"))
    if longest is None or longest > single_task_max:
        longest = lengths.agg(F.max("_n")).first()[0] or 0
    if longest <= single_task_max:
        w = Window.partitionBy("split", "user_id").orderBy("k", "_bk")
        if partitions:
            enc = spread(enc, partitions, "split", "user_id")
        body = enc.select("split", "user_id", F.row_number().over(w).cast("int").alias("pos"), *features)
    else:
        body = _two_level_positions(rows, enc, features)

    m = members.join(lengths, ["split", "user_id"], "left").fillna(0, ["_n"])

    def tokens(kind: str):
        cols = []
        for f in features:
            e = encoders[f]
            if kind == "sos":
                tok = _per_split(lambda s: e.sos(start_of[s]), start_of.keys())
            else:
                tok = _per_split(lambda s: e.eos(end_of[s]), end_of.keys())
            cols.append(tok.alias(f))
        return cols

    sos = m.select("split", "user_id", F.lit(0).alias("pos"), *tokens("sos"))
    eos = m.select("split", "user_id", (F.col("_n") + 1).cast("int").alias("pos"), *tokens("eos"))
    return sos.unionByName(body).unionByName(eos)


def _two_level_positions(rows: DataFrame, enc: DataFrame, features) -> DataFrame:
    """pos = 1 + (elements of the user in earlier buckets) + rank by brand
    inside the bucket.  The first term comes from a window over per-(user,
    bucket) counts -- at most one row per bucket of the time range."""
    per_k = rows.groupBy("split", "user_id", "k").agg(F.count(F.lit(1)).alias("_c"))
    w_user = Window.partitionBy("split", "user_id").orderBy("k")
    offsets = per_k.select(
        "split", "user_id", "k",
        (F.coalesce(F.sum("_c").over(w_user.rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0)) + F.lit(1)).alias("_off"))
    w_k = Window.partitionBy("split", "user_id", "k").orderBy("_bk")
    return (enc.withColumn("_r", F.row_number().over(w_k))
               .join(offsets, ["split", "user_id", "k"])
               .select("split", "user_id", (F.col("_off") + F.col("_r") - 1).cast("int").alias("pos"),
                       *features))


def _per_split(fn, splits) -> Column:
    expr = None
    for s in splits:
        v = fn(s)
        expr = F.when(F.col("split") == s, v) if expr is None else expr.when(F.col("split") == s, v)
    return expr


def collect_sequences(seq: DataFrame, features, max_len: int | None = None) -> DataFrame:
    """Arrays per (split, user): one ``ArrayType`` column per feature.

    ``max_len`` keeps the newest ``max_len`` elements (off by default; the
    reference never truncates)."""
    features = list(features)
    g = seq.groupBy("split", "user_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", *features))).alias("_e"))
    cols = []
    for f in features:
        a = F.transform("_e", _field(f))
        if max_len:
            a = F.slice(a, -max_len, max_len)
        cols.append(a.alias(f))
    return g.select("split", "user_id", *cols, F.size("_e").alias("length"))


def target_cells(rows: DataFrame, members: DataFrame, brand_enc, amount_enc=None,
                 ratio: float = 1.0) -> DataFrame:
    """Sparse multi-hot targets from the target-window rows of each split.

    One aggregate per (split, user, brand id) yields the flag, the raw amount
    sum (exact) and the scaled sum.  The scaled sum of a cell is
    ``scale * sum(x) + n * offset`` -- the sum of the per-row scaled values,
    computed from the exact raw sum.  ``ratio`` is the prediction/input
    interval adjustment.  ``rows`` are split members' rows (as produced by
    ``Prepared.target_rows``); unknown brands accumulate in the ``<UNK>``
    slot.
    """
    r = rows  # rows of split members only (Prepared.target_rows)
    grouped = amount_enc is not None and getattr(amount_enc, "group_by", None)
    if grouped:
        # one scaler per raw group value: scale per (user, brand) first, then
        # fold brands into ids (unknown brands share the <UNK> slot)
        per_b = exact_sums(r.groupBy("split", "user_id", "brand"), {"_s": F.col("amount")},
                           F.count(F.lit(1)).alias("_n"))
        per_b = amount_enc.with_params(per_b).withColumn(
            "_sx", F.col("_s") * F.col("_scale") + F.col("_n").cast("double") * F.col("_offset"))
        enc = brand_enc.transform(per_b, "brand", "brand_id")
        cells = exact_sums(enc.groupBy("split", "user_id", "brand_id"),
                           {"_s": F.col("_s"), "_sx": F.col("_sx")}, F.sum("_n").alias("_n"))
        scaled = F.col("_sx")
    else:
        enc = brand_enc.transform(r, "brand", "brand_id")
        cells = exact_sums(enc.groupBy("split", "user_id", "brand_id"), {"_s": F.col("amount")},
                           F.count(F.lit(1)).alias("_n"))
        scaled = None
    raw = F.col("_s")
    if scaled is None:
        if getattr(amount_enc, "params", None) is not None:
            scale, offset = amount_enc.params
            scaled = raw * F.lit(float(scale)) + F.col("_n").cast("double") * F.lit(float(offset))
        else:
            scaled = raw
    return cells.select(
        "split", "user_id", F.col("brand_id").cast("int").alias("brand_id"),
        F.lit(1).alias("brand_flag"),
        (scaled * F.lit(float(ratio))).alias("amount"),
        (raw * F.lit(float(ratio))).alias("amount_raw"),
        F.col("_n").alias("n_rows"))


def dense_blocks(cells: DataFrame, vocab_size: int, value_col: str, block: int = BLOCK) -> DataFrame:
    """``(split, user_id, block, <value_col>)``: slots ``block * size`` and on as an array; the last block
    of a vocabulary is shorter.  A block exists only where it has a cell, so the size follows the
    cells, not users x vocabulary, and one row never holds a whole vocabulary."""
    at = F.floor(F.col("brand_id") / F.lit(block)).cast("int")
    m = cells.groupBy("split", "user_id", at.alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(
        F.pmod("brand_id", F.lit(block)).cast("int").alias("slot"), F.col(value_col).cast("double").alias("v")))).alias("_m"))
    last = F.least(F.lit(block), F.lit(vocab_size) - F.col("block") * F.lit(block)) - 1
    vec = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return m.select("split", "user_id", "block", vec.alias(value_col))


def dense_vectors(cells: DataFrame, members: DataFrame, vocab_size: int, value_col: str, block: int = BLOCK) -> DataFrame:
    """Dense ``ArrayType(DOUBLE)`` of length ``vocab_size`` per (split, user), zeros where no cell
    exists: the user's blocks, with rows of zeros for those that are missing.  A row is 8 bytes times
    the vocabulary; for vocabularies whose vectors are too wide for a row use :func:`dense_blocks`."""
    m = dense_blocks(cells, vocab_size, value_col, block).groupBy("split", "user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("block", value_col))).alias("_b"))
    size = F.least(F.lit(block), F.lit(vocab_size))
    n_blocks = -(-vocab_size // block)
    vec = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda i: F.coalesce(
        F.try_element_at(F.col("_b"), i), F.array_repeat(F.lit(0.0), F.least(size, F.lit(vocab_size) - i * F.lit(block))))))
    return members.join(m, ["split", "user_id"], "left").select("split", "user_id", vec.alias(value_col))


def newest_rows(rows: DataFrame, max_len: int) -> DataFrame:
    """Of each (split, user) the newest ``max_len`` rows by (bucket, brand).  The limit on the row number
    is one on its group, which Spark applies before the shuffle: a task sends ``max_len`` rows a user
    at most, and no user's whole history meets anywhere."""
    w = Window.partitionBy("split", "user_id").orderBy(F.col("k").desc(), F.col("brand").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_len).drop("_rn")


def recover_target(cells: DataFrame, amount_enc) -> DataFrame:
    """Invert scaled target cells.  ``amount_inverse`` inverts the cell sum as
    one value (what the reference does; wrong unless the offset is 0);
    ``amount_exact`` uses the cell's row count: ``(s - n * offset) / scale``."""
    scale, offset = amount_enc.params
    sc, off = F.lit(float(scale)), F.lit(float(offset))
    return cells.select(
        "*", ((F.col("amount") - off) / sc).alias("amount_inverse"),
        ((F.col("amount") - F.col("n_rows").cast("double") * off) / sc).alias("amount_exact"))


def _field(name: str):
    """Element getter for ``transform`` (a two-argument lambda would be read
    as (element, index))."""
    return lambda x: x[name]


@SEQUENCE_BUILDERS.register("multi_hot_brand_only")
def multi_hot_brand_only(rows, members, brand_enc, amount_enc=None, ratio: float = 1.0) -> DataFrame:
    return target_cells(rows, members, brand_enc, amount_enc, ratio).select(
        "split", "user_id", "brand_id", "brand_flag")


@SEQUENCE_BUILDERS.register("multi_hot_brand_amount")
def multi_hot_brand_amount(rows, members, brand_enc, amount_enc=None, ratio: float = 1.0) -> DataFrame:
    return target_cells(rows, members, brand_enc, amount_enc, ratio).select(
        "split", "user_id", "brand_id", "amount", "amount_raw", "n_rows")


@SEQUENCE_BUILDERS.register("multi_hot_separate")
def multi_hot_separate(rows, members, brand_enc, amount_enc=None, ratio: float = 1.0) -> DataFrame:
    return target_cells(rows, members, brand_enc, amount_enc, ratio).select(
        "split", "user_id", "brand_id", "brand_flag", "amount", "amount_raw", "n_rows")
