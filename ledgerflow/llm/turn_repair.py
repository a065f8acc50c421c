"""Conversation structure repair: the cheapest edits that give a conversation the shape
``(system? (user assistant)+)?``.

Rows are kept (0), given the role user or assistant (1), deleted (2; a must for blank and duplicate
rows) or joined by inserted empty turns (5); a truncated row that stays costs 5 more. A row is blank
without a character other than white space, a duplicate if its role and text were seen earlier in
the conversation, truncated if its last character other than white space is not one of ``.!?``.

One shuffle, by conversation; all else happens inside its partitions, on Spark's spilling sorts:

1. rows sorted by (role, text) within conversations number the duplicates (a window);
2. sorted from the last turn to the first, they stream through :func:`_tables`, which carries four
   costs, one per state of the shape's automaton, over Arrow batches and gives every row one byte:
   the best next edit in each state. These bytes are the backpointers. They travel with the rows,
   so Spark's next sort spills them, and no task holds a conversation, however long it is;
3. sorted back, the rows stream through :func:`_edits`, which follows the bytes from the start.

Of equally cheap repairs the one whose initials (D, I, K, R in order) are least in ASCII is taken:
going backwards, the least first edit among the cheapest ones is known in each state, and the rest
of that string is the least of its own state.

A conversation is one chain of decisions and its digest one hash, so each is one task's stream; many
rows in one conversation make that task long, not large.

Defined results: nulls in role or text read as one space, a null conversation is one conversation of
its own, null turns come first; rows of one turn are ordered by role, text and copy, so repeated rows
give one result; empty texts are blank; very long texts pass through whole, one at a time; other
columns don't pass, so their names can't clash; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import table

SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 60
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
EDITS = "DIKR"
#: States: nothing yet, after system, after user, after assistant; the shape may end in 0 and 3.
NEXT = (2, 2, 3, 2)
ENDS = (0, FAR, FAR, 0)
ROLES = {2: "user", 3: "assistant"}


def _after(state: int, initial: str) -> int:
    """The state after a row with this role initial; -1 where the shape doesn't allow it."""
    if initial == "s":
        return 1 if state == 0 else -1
    if initial == "u":
        return -1 if state == 2 else 2
    return 3 if initial == "a" and state == 2 else -1


def _inserted(costs: list[int], choice: list[int]) -> None:
    """Insertions before a row: at most two in a row can pay, as after them the state repeats."""
    for _ in range(2):
        for state in range(4):
            cost = costs[NEXT[state]] + INSERT
            if cost < costs[state] or (cost == costs[state] and choice[state] > 1):
                costs[state], choice[state] = cost, 1


def _before(costs: list[int], initial: str, fault: str) -> tuple[list[int], int]:
    """Costs from before a row on, given those after it, and the best edits as two bits a state."""
    extra = CUT if fault == "truncated" else 0
    best, choice = [0] * 4, [0] * 4
    for state in range(4):
        best[state] = costs[state] + DELETE
        if fault in ("blank", "duplicate"):
            continue
        kept = _after(state, initial)
        if kept >= 0 and costs[kept] + extra < best[state]:
            best[state], choice[state] = costs[kept] + extra, 2
        if costs[NEXT[state]] + REROLE + extra < best[state]:
            best[state], choice[state] = costs[NEXT[state]] + REROLE + extra, 3
    _inserted(best, choice)
    return best, sum(c << 2 * s for s, c in enumerate(choice))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from last to first: their place from the end and their backpointers."""
    current, costs, at = object(), None, 0
    for batch in batches:
        rows = zip(batch["conv"].to_pylist(), batch["role"].to_pylist(), batch["fault"].to_pylist(), batch["here"].to_pylist())
        back, edits = [], []
        for conv, role, fault, here in rows:
            if conv != current:
                current, at = conv, 0
                costs, pad = list(ENDS), [9] * 4
                _inserted(costs, pad)  # turns inserted at the very end
            byte = 0
            if here:
                costs, byte = _before(costs, role[:1], fault)
            back.append(at)
            edits.append(byte)
            at += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.int64()), pa.array(edits, pa.int32())],
                                         [*batch.schema.names, "back", "edits"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The repaired rows of a partition in order: (conversation, turn, role, text, fault, edit, cost,
    role before or None for an insertion). A conversation starts with edit ``(`` and ends with ``)``."""
    open_, current, state = False, None, 0

    def closing():
        s = state
        while s in (1, 2):
            s = NEXT[s]
            yield (current, None, ROLES[s], "", None, "I", INSERT, None)
        yield (current, None, None, None, None, ")", 0, None)

    for batch in batches:
        names = ("conv", "turn", "role", "text", "fault", "here", "edits")
        for conv, turn, role, text, fault, here, byte in zip(*(batch[n].to_pylist() for n in names)):
            if not open_ or conv != current:
                if open_:
                    yield from closing()
                open_, current, state = True, conv, 0
                yield (conv, None, None, None, None, "(", 0, None)
            if not here:
                continue
            while True:
                edit = EDITS[byte >> 2 * state & 3]
                if edit != "I":
                    break
                state = NEXT[state]
                yield (conv, None, ROLES[state], "", None, "I", INSERT, None)
            extra = CUT if fault == "truncated" and edit != "D" else 0
            if edit == "D":
                yield (conv, turn, role, text, fault, "D", DELETE, role)
            elif edit == "K":
                state = _after(state, role[:1])
                yield (conv, turn, role, text, fault, "K", KEEP + extra, role)
            else:
                state = NEXT[state]
                yield (conv, turn, ROLES[state], text, fault, "R", REROLE + extra, role)
    if open_:
        yield from closing()


def _in_order(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copy, here) rows with fault and backpointers, each partition sorted
    by conversation and place."""
    same = Window.partitionBy("conv", "role", "text").orderBy(F.col("here").desc(), F.col("turn").asc_nulls_first(), "copy")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(bare == "", "blank").when(F.col("nth") > 1, "duplicate")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("none"))
    marked = rows.repartition("conv").withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)
    last = marked.sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("nth").desc())
    schema = T.StructType([*last.schema.fields, T.StructField("back", T.LongType()), T.StructField("edits", T.IntegerType())])
    return last.mapInArrow(_tables, schema).sortWithinPartitions("conv", F.col("back").desc())


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str, *more: Column) -> DataFrame:
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                                F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), *more)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per edit, in order by (conversation, place): conversation, place from 0, turn (null if
    inserted), the edit's initial, its cost, the fault, and the row's role and text; rows with edit D
    are those deleted."""
    rows = _rows(conversations, conv, turn, role, text, F.lit(0).alias("copy"), F.lit(True).alias("here"))
    return _repaired(_in_order(rows), conversations.schema[conv].dataType, conversations.schema[turn].dataType).select(
        F.col("conv").alias(conv), "place", F.col("turn").alias(turn), "edit", "cost", "fault", F.col("role").alias(role), F.col("text").alias(text))


def _repaired(ordered: DataFrame, conv: T.DataType, turn: T.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv", conv), T.StructField("place", T.LongType()), T.StructField("turn", turn), T.StructField("edit", T.StringType()),
                           T.StructField("cost", T.LongType()), T.StructField("fault", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, size, place = [], 0, 0
        for c, t, r, x, fault, edit, cost, _ in _edits(batches):
            if edit in "()":
                place = 0
                continue
            out.append((c, place, t, edit, cost, fault, r, x))
            place += 1
            size += len(x)
            if len(out) >= 10_000 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def _digest(edits: Iterator[tuple], faults: dict) -> Iterator[tuple]:
    """Per conversation: counts, cost, audit and the hash of the repaired rows, of a stream of edits."""
    pairs = ("su", "ua", "au")
    for conv, turn, role, text, fault, edit, cost, before in edits:
        if edit == "(":
            counts, turns, lo, hi, last = dict.fromkeys(faults, 0), 0, None, None, None
            illegal, total, audit, sha, first = 0, 0, [], hashlib.sha256(), True
        elif edit == ")":
            gaps = 0 if lo is None else hi - lo + 1 - turns
            yield (conv, gaps, *counts.values(), illegal, total, "".join(audit), sha.hexdigest())
        else:
            total += cost
            audit.append(edit)
            if edit != "D":
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if before is None:
                continue
            if fault in counts:
                counts[fault] += 1
            if turn is not None and turn != hi:  # rows come by turn
                lo, hi, turns = turn if lo is None else lo, turn, turns + 1
            if last is not None and last + before[:1] not in pairs:
                illegal += 1
            last = before[:1]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after a damage that their keys decide; rows that it drops stay
    as marks (``here`` false), so that their conversations do."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = _rows(conversations, "conv_id", "turn", "role", "text", kind)
    changed = (F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"),
                       F.explode(copies).alias("copy"), (F.col("kind") != 0).alias("here"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every damaged conversation, as counts, cost, edits and a hash."""
    source = table(spark, sf_dir, "conversations")
    conv = source.schema["conv_id"].dataType
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField("conv_id", conv), *(T.StructField(n, T.LongType()) for n in numbers),
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    kinds = [conv, *[T.LongType()] * 6, T.StringType(), T.StringType()]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        arrow, out = [to_arrow_type(k) for k in kinds], []
        for row in _digest(_edits(batches), {"blank": 0, "duplicate": 0, "truncated": 0}):
            out.append(row)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), arrow)], schema.names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), arrow)], schema.names)

    return _in_order(damaged(source)).mapInArrow(run, schema)
