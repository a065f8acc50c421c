"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of ``>`` in its leading run of blanks and ``>``. Lines of one
level, up to a blank line or a change of level, form a passage; passages and their single lines are
normalised (white space to one space, A-Z lowered) and hashed. Passages of level 0 are a message's
own; attribution lines before a quote ("... wrote:") and quoted lines are cut from its text. A
quoted passage of any level points to the message that it quotes: the first in the same conversation
with that own passage or line, else the first of all conversations, if that message comes before.
Passages shorter than ``LEAST`` point within their conversation only. Links of the shallowest level
that has any decide (as a rule level 1; deeper levels quote what the parent quoted) and are counted;
of several messages, the one with the most quoted characters is the parent, else the latest. A
message without a link replies to the turn numbered one less, if there is one. Following parents
gives each message its root and reply depth.

All in DataFrame operations. Originals are folded to one row per (conversation, hash) and per hash
by partial aggregation before they are joined, so a passage that a third of all messages share
joins as one row; joins are by hash or message key, with AQE splitting hot keys. Roots are found
by pointer doubling over a table written in each round, about log2 of the longest chain of replies.

Defined results: null and empty texts have no passages; a null conversation or turn has no parent
and is nobody's; messages that repeat (conversation, turn) share their parent, which is the one
with the most quoted characters among them, and each get their row; other columns don't pass.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import table, written

#: Shorter passages (in characters, normalised) are evidence in their own conversation only, shorter
#: quoted lines inside a passage none. The SQL drops both, and all levels but 1.
LEAST = 20
#: Lines that announce a quote.
ATTRIBUTION = r"(wrote|writes|schrieb|a écrit|escribió)[^\n]{0,40}:[ \t]*$"

_PASSAGES = "array<struct<level:int,text:string>>"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))


def parse(messages: DataFrame, *, text: str = "text") -> DataFrame:
    """``messages`` plus ``__lines`` (level, body, own: not a quote or attribution) and
    ``__passages`` (level, normalised text) of each text."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda line: F.struct(
        F.length(F.translate(F.regexp_extract(line, "^[ \t>]*", 0), " \t", "")).alias("level"), line.alias("line")))
    with_lines = messages.withColumn("__raw", lines)
    def is_own(x: Column, i: Column) -> Column:
        announces = F.rlike(x["line"], F.lit(ATTRIBUTION)) & (F.get(F.col("__raw"), i + 1)["level"] > 0)
        return (x["level"] == 0) & ~F.coalesce(announces, F.lit(False))
    cooked = F.transform("__raw", lambda x, i: F.struct(
        x["level"].alias("level"), F.when(x["level"] > 0, F.regexp_replace(x["line"], "^[ \t>]+", "")).otherwise(x["line"]).alias("body"),
        is_own(x, i).alias("own")))
    out = with_lines.withColumn("__lines", cooked).drop("__raw")
    kind = f"struct<done:{_PASSAGES},level:int,text:string>"

    def flush(acc: Column) -> Column:
        return F.when(acc["text"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["level"].alias("level"), acc["text"].alias("text")))))

    def step(acc: Column, x: Column) -> Column:
        body = _normal(x["body"])
        skip = (body == "") | ((x["level"] == 0) & ~x["own"])
        same = (x["level"] == acc["level"]) & (acc["text"] != "") & ~skip
        return F.struct(
            F.when(same, acc["done"]).otherwise(flush(acc)).alias("done"), x["level"].alias("level"),
            F.when(skip, F.lit("")).when(same, F.concat_ws(" ", acc["text"], body)).otherwise(body).alias("text")).cast(kind)

    zero = F.struct(F.array().cast(_PASSAGES).alias("done"), F.lit(-1).alias("level"), F.lit("").alias("text")).cast(kind)
    return out.withColumn("__passages", F.aggregate("__lines", zero, step, flush))


def _units(parsed: DataFrame, quoted: bool) -> DataFrame:
    """(conv, turn, level, hash, size): the distinct passages and lines of each quoted level, or
    of a message's own; quoted lines shorter than ``LEAST`` count as whole passages only."""
    lines = F.filter("__lines", (lambda x: x["level"] > 0) if quoted else (lambda x: x["own"]))
    single = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), _normal(x["body"]).alias("text")))
    whole = F.filter("__passages", lambda x: (x["level"] > 0) if quoted else (x["level"] == 0))
    if quoted:
        single = F.filter(single, lambda x: F.length(x["text"]) >= LEAST)
    units = F.filter(F.array_distinct(F.concat(whole, single)), lambda x: x["text"] != "")
    return (parsed.where("conv_id is not null and turn is not null")
            .select(F.col("conv_id").alias("conv"), "turn", F.explode(units).alias("u"))
            .select("conv", "turn", "u.level", F.md5("u.text").alias("hash"), F.length("u.text").alias("size")))


def parents(parsed: DataFrame) -> DataFrame:
    """(conv, turn, p_conv, p_turn, n_linked) of the messages that have a parent."""
    own, quoted = _units(parsed, False), _units(parsed, True)
    here = own.groupBy("conv", "hash").agg(F.min("turn").alias("turn"), F.max("size").alias("size"))
    first = (here.where(F.col("size") >= LEAST).groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("o"))
             .select("hash", "o.conv", "o.turn"))
    quotes = quoted.groupBy("conv", "turn", "level", "hash").agg(F.max("size").alias("size"))
    found = (quotes.join(here.select("conv", "hash", F.col("turn").alias("h_turn")), ["conv", "hash"], "left")
             .join(first.select("hash", F.col("conv").alias("f_conv"), F.col("turn").alias("f_turn")), "hash", "left"))
    near = F.col("h_turn") < F.col("turn")
    far = (F.col("f_conv") < F.col("conv")) | ((F.col("f_conv") == F.col("conv")) & (F.col("f_turn") < F.col("turn")))
    linked = (found.select("conv", "turn", "level", "size",
                           F.when(near, F.struct(F.col("conv").alias("conv"), F.col("h_turn").alias("turn")))
                           .when(far, F.struct(F.col("f_conv").alias("conv"), F.col("f_turn").alias("turn"))).alias("to"))
              .where("to is not null")
              .groupBy("conv", "turn", "level", "to").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
              .groupBy("conv", "turn", "level").agg(F.max(F.struct("size", "to")).alias("most"), F.sum("n").alias("n"))
              # the shallowest level that links
              .groupBy("conv", "turn").agg(F.min(F.struct("level", F.col("most.to").alias("to"), "n")).alias("best"))
              .select("conv", "turn", "best.to", F.col("best.n").alias("n_linked")))
    keys = parsed.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("conv"), "turn").distinct()
    before = keys.select("conv", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("b_turn"))
    return (keys.join(linked, ["conv", "turn"], "left").join(before, ["conv", "turn"], "left")
            .select("conv", "turn", F.coalesce("to.conv", F.when(F.col("b_turn").isNotNull(), F.col("conv"))).alias("p_conv"),
                    F.coalesce("to.turn", "b_turn").alias("p_turn"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")))


def roots(links: DataFrame) -> DataFrame:
    """``links`` plus r_conv, r_turn (the message that replies lead back to) and depth."""
    now = written(links.select("*", F.coalesce("p_conv", "conv").alias("r_conv"), F.coalesce("p_turn", "turn").alias("r_turn"),
                               F.when(F.col("p_conv").isNull(), 0).otherwise(1).cast("long").alias("depth"),
                               F.col("p_conv").isNotNull().alias("open")), "roots0")
    step = 0
    while not now.where("open").isEmpty():
        step += 1
        far = now.select(F.col("conv").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("r_conv").alias("n_conv"),
                         F.col("r_turn").alias("n_turn"), F.col("depth").alias("more"), F.col("open").alias("n_open"))
        # a message is settled once the message that it points to points to a root
        moved = now.where("open").join(far, ["r_conv", "r_turn"]).select(
            *links.columns, F.col("n_conv").alias("r_conv"), F.col("n_turn").alias("r_turn"),
            (F.col("depth") + F.col("more")).alias("depth"), F.col("n_open").alias("open"))
        now = written(now.where("not open").unionByName(moved), f"roots{step}")
    return now.drop("open")


def link(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) in reply order: by root, conversation and turn, with
    their parent, root, depth, numbers of quoted and linked passages, and their own text."""
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    own = F.regexp_replace(F.array_join(F.transform(F.filter("__lines", lambda x: x["own"]), lambda x: x["body"]), "\n"),
                           r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    cleaned = parsed.select("conv_id", "turn", "role", own.alias("text"),
                            F.size(F.filter("__passages", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))
    tree = roots(parents(parsed)).select(F.col("conv").alias("conv_id"), "turn", F.col("p_conv").alias("parent_conv"),
                                         F.col("p_turn").alias("parent_turn"), F.col("r_conv").alias("root_conv"),
                                         F.col("r_turn").alias("root_turn"), "depth", "n_linked")
    joined = cleaned.join(tree, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_conv", "parent_turn", F.coalesce("root_conv", "conv_id").alias("root_conv"),
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    ).orderBy("root_conv", "root_turn", "conv_id", "turn")


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``link`` on all conversations; a message without a parent is shown as its own."""
    linked = link(table(spark, sf_dir, "conversations"))
    return linked.withColumns({"parent_conv": F.coalesce("parent_conv", "conv_id"), "parent_turn": F.coalesce("parent_turn", "turn")})


_N = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"

ORACLE = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
a AS (SELECT r, i, string_split(t, chr(10))[i] AS line FROM m, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
b AS (SELECT r, i, line, length(translate(regexp_extract(line, '^[ \\t>]*', 0), ' ' || chr(9), '')) AS level FROM a),
l AS (SELECT r, i, level, CASE WHEN level > 0 THEN regexp_replace(line, '^[ \\t>]+', '') ELSE line END AS body,
    level = 0 AND NOT coalesce(regexp_matches(line, '{ATTRIBUTION}') AND lead(level) OVER w > 0, false) AS own
  FROM b WINDOW w AS (PARTITION BY r ORDER BY i)),
n AS (SELECT *, {_N.format("body")} AS norm FROM l),
k AS (SELECT *, norm = '' OR (level = 0 AND NOT own) AS skip FROM n),
h AS (SELECT *, skip OR lag(skip, 1, true) OVER w OR lag(level) OVER w <> level AS fresh FROM k WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM h),
p AS (SELECT r, level, string_agg(norm, ' ' ORDER BY i) AS t FROM g WHERE NOT skip GROUP BY r, run, level),
un AS (SELECT DISTINCT conv_id, turn, r, level, x.t FROM (SELECT r, level, t FROM p UNION ALL SELECT r, level, norm FROM k WHERE level > 0 OR own) x
  JOIN m USING (r) WHERE length(x.t) >= {LEAST} AND conv_id IS NOT NULL AND turn IS NOT NULL),
here AS (SELECT conv_id, t, min(turn) AS turn FROM un WHERE level = 0 GROUP BY ALL),
first AS (SELECT t, min((conv_id, turn)) AS o FROM here GROUP BY t),
q AS (SELECT DISTINCT conv_id, turn, t FROM un WHERE level = 1),
f AS (SELECT q.conv_id, q.turn, length(q.t) AS size, CASE WHEN here.turn < q.turn THEN (here.conv_id, here.turn)
    WHEN first.o < (q.conv_id, q.turn) THEN first.o END AS o
  FROM q LEFT JOIN here ON here.conv_id = q.conv_id AND here.t = q.t LEFT JOIN first ON first.t = q.t),
s AS (SELECT conv_id, turn, o, sum(size) AS size, count(*) AS n FROM f WHERE o IS NOT NULL GROUP BY ALL),
best AS (SELECT conv_id, turn, max((size, o))[2] AS o, sum(n) AS n FROM s GROUP BY ALL),
keys AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
par AS (SELECT keys.conv_id, keys.turn, coalesce(o[1], bef.conv_id) AS pc, coalesce(o[2], bef.turn) AS pt, coalesce(n, 0) AS n
  FROM keys LEFT JOIN best USING (conv_id, turn) LEFT JOIN keys bef ON bef.conv_id = keys.conv_id AND bef.turn + 1 = keys.turn),
up AS (SELECT conv_id, turn, conv_id AS c, turn AS t, 0 AS depth FROM keys
  UNION ALL SELECT up.conv_id, up.turn, pc, pt, depth + 1 FROM up JOIN par ON par.conv_id = c AND par.turn = up.t WHERE pc IS NOT NULL),
top AS (SELECT conv_id, turn, arg_max((c, t), depth) AS o, max(depth) AS depth FROM up GROUP BY ALL),
own AS (SELECT r, regexp_replace(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE own), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS text FROM l GROUP BY r)
SELECT m.conv_id, m.turn, role, coalesce(own.text, '') AS text,
  (SELECT count(*) FROM p WHERE p.r = m.r AND level > 0) AS n_quoted, cast(coalesce(n, 0) AS BIGINT) AS n_linked,
  coalesce(pc, m.conv_id) AS parent_conv, coalesce(pt, m.turn) AS parent_turn, coalesce(top.o[1], m.conv_id) AS root_conv, coalesce(top.o[2], m.turn) AS root_turn,
  cast(coalesce(top.depth, 0) AS BIGINT) AS depth
FROM m JOIN own USING (r) LEFT JOIN par ON par.conv_id = m.conv_id AND par.turn = m.turn
  LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn"""
