"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is parsed into a Boolean query over the trigrams that every match
must contain: an OR of clauses, each an AND of trigrams (letters lowered). The index posts, for
every trigram that some rule asks for, the documents whose lowered text contains it; a clause's
postings are intersected by one aggregate per document, and only the documents left are verified
with the rule's expression. A rule without mandatory trigrams (``hex``) scans every text.

The index holds (trigram bit, document key) rows; the key is a 64-bit hash of id and text, so a
collision could only add a candidate. Partial aggregation folds repeated rows before the shuffle.
Candidates are a written table of two numbers a row: Spark broadcasts it while it is small and
joins by shuffle beyond that. No texts are collected, and no key other than a repeated document can
be hot.

Defined results: null and empty texts have no spans; matches of one kind do not overlap (leftmost
first) while kinds may; repeated rows each get their row; other columns pass through. Positions
count code points, ends are exclusive.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import table, written

#: More alternatives than this in a run of literals end the run.
ALTERNATIVES = 40


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts if ``group`` has ``least`` characters or more."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three kinds and their patterns are fixed values; hex and access state their least
#: length as a repeat count, which finds the same matches since their runs are maximal.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULES = BASE + (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The clauses of a pattern: a match contains all trigrams of at least one. Empty: no mandatory
    trigram. Of the runs of literals in the pattern, the one with the longest shortest alternative
    is asked for."""
    runs: list[set[str]] = []

    def strings(items) -> set[str] | None:
        """All strings that items can match, lowered; None if there are too many."""
        now = {""}
        for op, arg in items:
            if op is C.LITERAL:
                each = {chr(arg).lower()}
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
                each = {chr(a).lower() for _, a in arg}
            elif op is C.SUBPATTERN:
                each = strings(arg[3])
            elif op is C.BRANCH:
                parts = [strings(one) for one in arg[1]]
                each = None if None in parts else set().union(*parts)
            elif op is C.MAX_REPEAT and arg[1] <= 3:
                one = strings(arg[2])
                each = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
            elif op is C.AT:
                each = {""}
            else:
                each = None
            if each is None or len(now) * len(each) > ALTERNATIVES:
                return None
            now = {a + b for a in now for b in each}
        return now

    def walk(items) -> None:
        run: list = []

        def end() -> None:
            if run:
                runs.append(strings(run))
                run.clear()

        for item in items:
            if strings([item]) is None or (run and strings([*run, item]) is None):
                end()
                if item[0] is C.SUBPATTERN:
                    walk(item[1][3])
                    continue
                if strings([item]) is None:
                    continue
            run.append(item)
        end()

    walk(P.parse(pattern))
    best = max((r for r in runs if r), key=lambda r: (min(map(len, r)), -len(r)), default={""})
    clauses = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in best}
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def _key(text: str, ids: list[str]) -> Column:
    return F.xxhash64(*ids, text)


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str, ids: list[str]) -> DataFrame:
    """(key, mask): bit i of mask says that rule i's trigram query holds for the document."""
    queries = [(i, clause) for i, rule in enumerate(rules) for clause in trigram_query(rule.pattern)]
    grams = sorted({g for _, clause in queries for g in clause})
    bit = {g: F.lit(1 << (k % 60)).cast("long") for k, g in enumerate(grams)}
    part = {g: k // 60 for k, g in enumerate(grams)}
    lowered = docs.select(_key(text, ids).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    index = lowered.select("key", F.explode(F.array_compact(F.array(*(
        F.when(F.contains("low", F.lit(g)), F.struct(F.lit(part[g]).alias("part"), bit[g].alias("gram")))
        for g in grams)))).alias("post")).select("key", "post.*")
    parts = range(max(part.values()) + 1)
    postings = index.groupBy("key").agg(*(
        F.bit_or(F.when(F.col("part") == p, F.col("gram")).otherwise(F.lit(0).cast("long"))).alias(f"grams{p}") for p in parts))

    def holds(clause: frozenset[str]) -> Column:
        out = F.lit(True)
        for p in parts:
            want = sum(1 << (grams.index(g) % 60) for g in clause if part[g] == p)
            if want:
                out = out & (F.col(f"grams{p}").bitwiseAND(F.lit(want).cast("long")) == F.lit(want).cast("long"))
        return out

    mask = F.lit(0)
    for i in range(len(rules)):
        mine = [holds(clause) for j, clause in queries if j == i]
        if mine:
            either = mine[0]
            for other in mine[1:]:
                either = either | other
            mask = mask + F.when(either, F.lit(1 << i)).otherwise(F.lit(0))
    return postings.select("key", mask.alias("mask")).where("mask > 0")


def _spans(rule: Rule, rank: int, text: str) -> Column:
    """The matches of a rule as (start, rank, end): the text between matches gives positions."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    counted = F.regexp_extract_all(F.col(text), pattern, F.lit(rule.group)) if rule.group else whole
    triples = F.arrays_zip(F.split(F.col(text), rule.pattern, -1).alias("gap"), whole.alias("whole"), counted.alias("counted"))
    kind = "struct<at:int,out:array<struct<start:int,rank:int,end:int>>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        found = F.when(F.length(x["counted"]) >= rule.least,
                       F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("end"))))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.coalesce(found, _none())).alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), _none().alias("out")).cast(kind)
    return F.aggregate(triples, zero, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int>>")


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text: str = "text", ids: tuple[str, ...] = ("doc_id",),
         name: str = "__spans") -> DataFrame:
    """``docs`` plus an array column ``name`` of structs start, rank (place in ``rules``), end,
    sorted by start, then rank."""
    found = written(candidates(docs, rules, text, list(ids)), "candidates")
    joined = (docs.withColumn("__key", _key(text, list(ids)))
              .join(found.select(F.col("key").alias("__key"), F.col("mask").alias("__mask")), "__key", "left")
              .withColumn("__text", F.coalesce(F.col(text), F.lit(""))))
    spans = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            wanted = F.col("__mask").bitwiseAND(F.lit(1 << rank)) != 0
        else:
            wanted = F.rlike("__text", F.lit(rule.pattern))
        spans.append(F.when(wanted, _spans(rule, rank, "__text")).otherwise(_none()))
    return joined.withColumn(name, F.array_sort(F.concat(*spans))).drop("__key", "__mask", "__text")


def redact(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[SECRET]",
           ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark`` (overlapping spans by one)."""
    found = scan(docs, rules=rules, text=text, ids=ids, name="__spans")
    kind = "struct<at:int,out:string>"

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"])
        fresh = F.concat(acc["out"], gap, F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"),
                        F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out")).cast(kind)

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind), step,
                        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return (found.withColumn(text, F.when(F.size("__spans") > 0, clean).otherwise(F.col(text))).drop("__spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("__spans", lambda x: x["rank"] == rank)).cast("long")
    base = F.filter("__spans", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("__spans"), RULES).alias("spans"))


def _oracle() -> str:
    each = []
    for rank, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        each.append(f"""SELECT r, {rank} AS k, '{rule.kind}' AS kind,
  list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0) AS s,
  length(regexp_extract_all(t, '{p}')[i]) AS n, length(regexp_extract_all(t, '{p}', {rule.group})[i]) AS g, {rule.least} AS least
FROM d, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS u(i) WHERE regexp_matches(t, '{p}')""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, k, cast(s AS BIGINT) AS s, kind || ':' || cast(s AS BIGINT) || ':' || cast(s + n AS BIGINT) AS span
  FROM ({" UNION ALL ".join(each)}) WHERE g >= least),
a AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
  count(*) FILTER (WHERE k = 2) AS n_hex, string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
  string_agg(span, ',' ORDER BY s, k) AS spans FROM m GROUP BY r)
SELECT doc_id, cast(coalesce(n_assign, 0) AS BIGINT) AS n_assign, cast(coalesce(n_access, 0) AS BIGINT) AS n_access,
  cast(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


ORACLE = _oracle()
