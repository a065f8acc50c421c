"""Conversation repair against a search over all edit strings."""
import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from ledgerflow.llm.turn_repair import op13_turn_repair, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BARE = re.compile(r"[^\x20\x09-\x0D]")
SHAPE = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = BARE.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def best(rows, faults):
    """Least (cost, edits, repaired rows) by trying every edit at every place."""
    @cache
    def go(i, shape, run):
        tries = []
        if i == len(rows) and SHAPE.fullmatch(shape):
            tries.append((0, "", ()))
        if run < 2:
            for role in ("user", "assistant"):
                if viable(shape + role[0]):
                    c, e, r = go(i, short(shape + role[0]), run + 1)
                    tries.append((c + 5, "I" + e, ((role, ""),) + r))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, r = go(i + 1, shape, 0)
            tries.append((c + 2, "D" + e, r))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for new, edit, cost in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if new[:1] and viable(shape + new[0]):
                        c, e, r = go(i + 1, short(shape + new[0]), 0)
                        tries.append((c + cost + extra, edit + e, ((new, text),) + r))
        return min(tries, default=(10 ** 9, "", ()))

    def viable(shape):
        return any(SHAPE.fullmatch(shape + end) for end in ("", "a", "ua"))

    def short(shape):  # what follows depends on the last letters only
        return shape if len(shape) < 4 else shape[-2:] if shape[-1] == "a" else shape[-3:]

    return go(0, "", 0)


def expected(rows):
    """What the query returns for one conversation's rows (turn, role, text), damaged here."""
    conv = rows[0][0]
    left = []
    key = (lambda r: (r[1] is not None, r[1] or 0, (r[2] or " ") if r[2] is not None else " ", r[3] if r[3] is not None else " "))
    changed = []
    for _, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        changed += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    left = [(t, r, x) for _, t, r, x in sorted(changed, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))]
    faults = faults_of(left)
    turns = [t for t, _, _ in left if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
    cost, audit, kept = best(tuple(left), tuple(faults))
    text = "\n".join(f"{r}:{x}" for r, x in kept)
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def conversations():
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "assistant", "user", "bot", "", None, "uploader"]
    texts = ["Hello.", "Yes!", "Why?", "cut off", "", " \t\n", None, "Same again.", "Same again.", "é.", "…", "x. \x0b"]
    rows = []
    for conv in [None, *range(150)]:
        n = rng.choice([1, 2, 3, 4, 6, 9])
        for turn in range(n):
            tidy = conv is not None and conv % 3 == 0
            role = ("system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]) if tidy else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, f"{turn} done." if tidy else rng.choice(texts)))
    return rows + [(7, 1, "user", "Same again.")] * 3


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("conv"))
    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/conversations.parquet")
    return rows, op13_turn_repair(spark, at)


def test_equals_search(found):
    rows, df = found
    want = [expected([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_repaired_rows(spark):
    """The general interface: undamaged rows, with the texts that stay."""
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 3, "user", "Bye."),
            (2, 5, "assistant", "Lone answer."), (3, 0, "system", "Be kind.")]
    df = repair(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS place", "1 AS cost"))
    got = [tuple(r) for r in df.orderBy("conv_id", "place").select("conv_id", "turn", "edit", "cost", "fault", "role", "text").collect()]
    assert got == [(1, 0, "K", 0, "none", "user", "Hi."), (1, 1, "D", 2, "duplicate", "user", "Hi."), (1, 2, "K", 0, "none", "assistant", "Yes."),
                   (1, 3, "D", 2, "none", "user", "Bye."), (2, 5, "D", 2, "none", "assistant", "Lone answer."),
                   (3, 0, "D", 2, "none", "system", "Be kind.")]


def test_giant_conversation_over_batches(spark):
    """A conversation over many Arrow batches: a row a turn in good order, one missing answer."""
    n = 30_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, '.') AS text").where("turn <> 15001")
    got = {r.edit: (r.n, r.c) for r in repair(df).groupBy("edit").agg(F.count("*").alias("n"), F.sum("cost").alias("c")).collect()}
    assert got == {"K": (n - 2, 0), "D": (1, 2)}


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_turn_repair(spark, str(tmp_path)).collect() == []
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
