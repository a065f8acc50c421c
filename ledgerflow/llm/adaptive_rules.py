"""Quality rules with adaptive thresholds per language and source, in DataFrame operations only.

``measure`` counts words, symbols, repeated lines and repeated five-word windows of each text, and
derives four shares in whole units. A sketch of a share in a group (language, source) is a
histogram: (group, share, bin, count) rows with bins of one unit and no upper end, so quartiles are
those of the shares themselves. Sketches merge by adding counts, so a group of any size is folded by
partial aggregation before the shuffle and has one row a distinct share after it: at most 1,001 of
shares per 1000, and of word lengths as many as differ; results do not depend on how rows are dealt out. Quartiles of a sketch give the group's thresholds, ``FENCE``
interquartile ranges and a slack outside the quartiles; a join on the group applies them. Texts of
less than ``LEAST_WORDS`` words, or with more than ``MOST_REPEATED`` percent of words in repeated
windows, fail in any case (and are left out of the sketches).

The measures are written once, so texts are read once; the few thresholds a group are joined by
Spark's choice (broadcast while small, else a shuffle in which AQE splits a hot group).

Defined results: null and empty texts have no words and fail; null languages or sources form their
own groups; a group with fewer than ``LEAST_DOCS`` texts uses the thresholds of all texts; repeated
rows each get their row; other columns pass through, whatever their names.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import table, written

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Where the SQL caps a share before it takes quartiles; it agrees while quartiles are no greater.
BINS = 4000
FENCE = 8.0
LEAST_DOCS = 20
#: Per share: unit, slack beyond the fence, and whether too low a value fails as well.
SHARES = {
    "symbols": ("symbols per 1000 characters of words", 60.0, False),
    "word_length": ("characters per 100 words", 300.0, True),
    "dup_lines": ("repeated lines per 1000 lines with a word", 400.0, False),
    "repeats": ("words in repeated windows per 1000 words", 200.0, False),
}

_WHITE = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]+"


def measure(docs: DataFrame, *, text: str = "text", name: str = "__q") -> DataFrame:
    """``docs`` plus a struct column ``name`` with the counts and shares of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size("__words")
    last = F.lit(WINDOW - 1)
    step1 = (docs
             .withColumn("__words", F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)))
             .withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, _WHITE, "") != "")))
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col("__words"), i + k) for k in range(WINDOW))))
    step2 = step1.withColumn("__hashes", hashed)
    # windows whose hashes are all different are all different; only other texts compare the windows
    twice = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    windows = F.array_sort(F.transform(at, lambda i: F.struct(
        F.array_join(F.slice("__words", i + 1, WINDOW), " ").alias("t"), i.alias("i"))))
    step3 = step2.withColumn("__windows", F.when(twice, windows))
    neighbour = lambda j: F.get(F.col("__windows"), j)["t"]
    found = F.array_sort(F.array_compact(F.transform("__windows", lambda x, j: F.when(
        x["t"].eqNullSafe(neighbour(j - 1)) | x["t"].eqNullSafe(neighbour(j + 1)), x["i"]))))
    covered = F.aggregate(
        found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda acc: acc["n"])
    chars = F.length(F.translate(t, _WHITE, ""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    counts = F.struct(
        n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    out = step3.withColumn("__c", counts).drop("__words", "__lines", "__hashes", "__windows")
    c = lambda x: F.col(f"__c.{x}")
    failed = (c("n_words") < LEAST_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * MOST_REPEATED)
    share = lambda a, scale, b: F.expr(f"__c.{a} * {scale}L div greatest(__c.{b}, 1L)")
    return out.withColumn(name, F.struct(
        "__c.*", failed.alias("base_failed"), share("n_symbols", 1000, "word_chars").alias("symbols"),
        share("word_chars", 100, "n_words").alias("word_length"), share("n_dup_lines", 1000, "n_lines").alias("dup_lines"),
        share("n_repeat_words", 1000, "n_words").alias("repeats"))).drop("__c")


def sketches(measured: DataFrame, *, groups: tuple[str, ...] = ("lang", "source"), name: str = "__q") -> DataFrame:
    """(group columns g0, g1, ..., share, bin, n) rows of the texts that pass the base rules."""
    bins = F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"{name}.{s}").alias("bin")) for s in SHARES))).alias("s")
    keys = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    return (measured.where(~F.col(f"{name}.base_failed")).select(*keys, bins)
            .groupBy(*(f"g{i}" for i in range(len(groups))), "s.share", "s.bin").agg(F.count(F.lit(1)).alias("n")))


def _limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group: its number of texts, and low and high limits of each share."""
    quartiles = lambda s: F.percentile(F.when(F.col("share") == s, F.col("bin")), F.array(F.lit(0.25), F.lit(0.75)), F.col("n"))
    wide = sketch.groupBy(*keys).agg(F.sum(F.when(F.col("share") == "symbols", F.col("n"))).alias("docs"),
                                     *(quartiles(s).alias(s) for s in SHARES))
    low = lambda s: F.get(F.col(s), 0)
    high = lambda s: F.get(F.col(s), 1)
    return wide.select(*keys, "docs", *(
        F.struct((low(s) - FENCE * (high(s) - low(s)) - slack).alias("low"),
                 (high(s) + FENCE * (high(s) - low(s)) + slack).alias("high")).alias(s)
        for s, (_, slack, _) in SHARES.items()))


def judge(measured: DataFrame, *, groups: tuple[str, ...] = ("lang", "source"), name: str = "__q",
          kept: str = "__kept") -> DataFrame:
    """``measured``, which should be a written table as it is read twice, plus the boolean column
    ``kept``."""
    keys = [f"g{i}" for i in range(len(groups))]
    sketch = written(sketches(measured, groups=groups, name=name), "sketches")
    # the sketch of all texts is the sum of the groups' sketches
    every = _limits(sketch.groupBy("share", "bin").agg(F.sum("n").alias("n")).withColumn("g", F.lit(0)), ["g"])
    whole = every.select(F.struct(*SHARES)).scalar()
    own = _limits(sketch, keys).select(*(F.col(k).alias(f"__{k}") for k in keys), "docs", F.struct(*SHARES).alias("own"))
    limits = own.select(*(f"__{k}" for k in keys), F.when(F.col("docs") >= LEAST_DOCS, F.col("own")).otherwise(whole).alias("__limits"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)))
    ok = F.lit(True)
    for s, (_, _, both) in SHARES.items():
        ok = ok & (F.col(f"{name}.{s}") <= F.col(f"__limits.{s}.high"))
        if both:
            ok = ok & (F.col(f"{name}.{s}") >= F.col(f"__limits.{s}.low"))
    return (measured.join(limits, same, "left")
            .withColumn(kept, ~F.col(f"{name}.base_failed") & F.coalesce(ok, F.lit(False)))
            .drop("__limits", *(f"__{k}" for k in keys)))


def keep(docs: DataFrame, *, text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    measured = written(measure(docs, text=text), "measured")
    return judge(measured, groups=groups).where("__kept").drop("__q", "__kept")


def op5_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = written(measure(docs).drop("text"), "measured")
    return judge(measured).select("doc_id", *(f"__q.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("__kept").alias("kept"))


def _oracle() -> str:
    limits = ", ".join(f"q[1] - {FENCE} * (q[2] - q[1]) - (CASE share {slacks} END) AS low, "
                       f"q[2] + {FENCE} * (q[2] - q[1]) + (CASE share {slacks} END) AS high"
                       for slacks in [" ".join(f"WHEN '{s}' THEN {slack}" for s, (_, slack, _) in SHARES.items())])
    long = " UNION ALL ".join(f"SELECT r, lang, source, '{s}' AS share, {s} AS v FROM x WHERE NOT base_failed" for s in SHARES)
    both = " OR ".join(f"share = '{s}'" for s, (_, _, b) in SHARES.items() if b)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g),
    unnest(range(i, i + 5)) AS u(p) WHERE c > 1 GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, cast(len(w) AS BIGINT) AS n_words,
    cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, cast(len(l) AS BIGINT) AS n_lines,
    cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
x AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    n_symbols * 1000 // greatest(word_chars, 1) AS symbols, word_chars * 100 // greatest(n_words, 1) AS word_length,
    n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats FROM c),
v AS ({long}),
own AS (SELECT lang, source, share, count(*) AS n, quantile_cont(least(v, {BINS}), [0.25, 0.75]) AS q FROM v GROUP BY ALL),
whole AS (SELECT share, quantile_cont(least(v, {BINS}), [0.25, 0.75]) AS q FROM v GROUP BY ALL),
lim AS (SELECT lang, source, share, {limits} FROM (SELECT own.lang, own.source, own.share,
    CASE WHEN n >= {LEAST_DOCS} THEN own.q ELSE whole.q END AS q FROM own JOIN whole USING (share))),
bad AS (SELECT DISTINCT r FROM v JOIN lim ON v.share = lim.share AND v.lang IS NOT DISTINCT FROM lim.lang
    AND v.source IS NOT DISTINCT FROM lim.source WHERE v > high OR (({both.replace("share", "v.share")}) AND v < low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND x.r NOT IN (SELECT r FROM bad) AS kept FROM x"""


ORACLE = _oracle()
