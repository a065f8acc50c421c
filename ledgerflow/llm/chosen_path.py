"""Near duplicates by a chosen-path set similarity join over word shingles.

Texts with the same set of shingles form a class, which joins as one. Each of ``TREES`` independent
trees branches the classes by minwise tokens: a node's classes share the tokens chosen so far. A
node of at most ``NODE`` classes is a leaf and is compared exhaustively; a larger one branches on
its next token, ``DEPTH`` at most. Two classes of similarity s meet in a leaf of depth d of one tree
with probability s^d, so at s = 0.8 all trees miss them with probability (1 - 0.8^d)^16: below 1e-7
at depth 1 or 2, 2e-4 at depth 4, and less where other links connect them.

Classes that still stand together at the greatest depth are, as a rule, copies of each other. There
all are compared with the smallest class; once these links are merged, only classes outside the
node's largest component are compared with the others, in blocks and on full sets, and one link to
each component is listed. So no pairs are listed within a large group, and no class is dropped.
Other comparisons are by size and by the share of equal minwise tokens (64; a pair at the threshold
passes but for 2e-6); what passes is confirmed on full sets. Links become components by large-star
and small-star steps.

Rows shuffled are tokens and keys, not texts; texts or sets move only for classes with a candidate.
Skew: classes fold copies by partial aggregation, nodes of any size are counted by partial
aggregation and joined with AQE's skew handling, blocks have a bounded size. Intermediate tables
are written to the shared folder.

Defined results: null, empty and word-less texts have no shingles and link with nothing; texts of
fewer words than a shingle have their whole sequence as the only shingle; repeated rows are copies
of each other; a null id counts as greater than all others. Shingles are 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import LOWER, SALT, SPACES, Words, mix, release, slices, strings, table, word_bytes, written
from ledgerflow.llm.components import components

WIDTH = 5
PERCENT = 80
TREES, DEPTH = 16, 4
NODE = 32
#: Shingles in a block of classes outside a region and in a part of all its classes, about.
BLOCK, PART = 100_000, 500_000
#: Row keys (16 bytes each) that are broadcast at most.
BROADCAST_ROWS = 2_000_000
SIGNS = TREES * DEPTH
#: A pair passes the comparison of tokens with so many of 64 equal: 51.2 - 4.7 * 3.2 at 0.8.
EQUAL = 36


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = strings(column)
    words = Words(LOWER[data], offsets, word_bytes(SPACES))
    h, n = words.hashes, len(words)
    joined = h.copy()
    for k in range(1, min(width, n)):
        joined[:n - k] = mix(joined[:n - k] * np.uint64(3) + h[k:])
    out = []
    for a, count in zip(words.first[:-1].tolist(), words.counts.tolist()):
        if count >= width:
            out.append(np.unique(joined[a:a + count - width + 1]))
        elif count:
            whole = np.uint64(count)
            for k in range(count):
                whole = mix(np.array([whole * np.uint64(3) + h[a + k]]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class_of(sets: list[np.ndarray]) -> pa.Array:
    """A 16-byte name of each set: its size and order-free sums of its hashes; null if empty."""
    names = []
    with np.errstate(over="ignore"):
        for s in sets:
            if len(s):
                a = mix(np.array([s.sum()]) + np.uint64(len(s)))
                b = mix(mix(s ^ np.uint64(SALT)).sum(keepdims=True))
                names.append(a.astype(">u8").tobytes() + b.astype(">u8").tobytes())
            else:
                names.append(None)
    return pa.array(names, pa.binary())


_SEEDS = mix(np.arange(1, 2 * SIGNS + 1, dtype=np.uint64) * np.uint64(SALT))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """``SIGNS`` minwise tokens (32 bits) of each set that isn't empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    start = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((len(start), SIGNS), np.uint32)
    for f in range(SIGNS if len(start) else 0):
        least = np.minimum.reduceat((flat ^ _SEEDS[2 * f]) * (_SEEDS[2 * f + 1] | np.uint64(1)), start)
        out[:, f] = mix(least) >> np.uint64(32)
    return out


def _row_key(text: str, key: str) -> Column:
    return F.xxhash64(key, text)


def _signed(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(doc, row, cls, n, tokens, sketch) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = np.zeros((len(sets), SIGNS), np.uint32)
            tokens[sizes > 0] = minwise(sets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SIGNS), pa.array(tokens.ravel().view(np.int32)))
            sketch = [row.tobytes() for row in (tokens & 255).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("row"), _class_of(sets), pa.array(sizes), lists, pa.array(sketch, pa.binary())],
                ["doc", "row", "cls", "n", "tokens", "sketch"])
        release()

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("doc"), _row_key(text, key).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .mapInArrow(run, f"doc {kind}, row long, cls binary, n long, tokens array<int>, sketch binary"))


def _sized(rows: DataFrame) -> DataFrame:
    """A written table of row keys, broadcast while it has at most ``BROADCAST_ROWS`` rows, so that
    texts need not move to be chosen; beyond that Spark joins by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _sets(docs: DataFrame, rows: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(cls, set) of the classes whose representative's row key is in ``rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            sizes = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("row"), _class_of(sets), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))],
                                             ["row", "cls", "set"])

    wanted = (docs.select(_row_key(text, key).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
              .join(_sized(rows.select("row")), "row", "left_semi"))
    # rows that share a key are repeated rows, or one in 2^64 others; their class tells them apart
    return (wanted.mapInArrow(run, "row long, cls binary, set array<long>")
            .join(rows, ["row", "cls"], "left_semi").dropDuplicates(["row", "cls"]).drop("row"))


def _compare(n1: np.ndarray, n2: np.ndarray, s1: np.ndarray, s2: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may reach the threshold, by sizes and sketches."""
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    fits[fits] = (s1[fits] == s2[fits]).sum(axis=1) >= EQUAL
    return fits


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNS)


def _star_filter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fits = _compare(batch.column("n0").to_numpy(), batch.column("n").to_numpy(), _matrix(batch.column("sketch0")), _matrix(batch.column("sketch")), percent)
                yield batch.filter(pa.array(fits)).select(["a", "b"])
    return run


def _leaf_pairs(percent: int):
    """All pairs of a leaf that pass; the rows come sorted by node, and a leaf has few."""
    def pairs(rows: pa.Table) -> pa.RecordBatch:
        node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
        cls, sketch = rows["cls"].to_pylist(), _matrix(rows["sketch"])
        a, b = [], []
        for k in range(1, len(node)):
            i = np.flatnonzero(node[:-k] == node[k:])
            if not len(i):
                break
            i = i[_compare(n[i], n[i + k], sketch[i], sketch[i + k], percent)]
            for x in i.tolist():
                a.append(min(cls[x], cls[x + k]))
                b.append(max(cls[x], cls[x + k]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            if not rows.num_rows:
                continue
            node = rows["node"].to_numpy()
            cut = int(np.flatnonzero(node == node[-1])[0])  # the last node may go on
            if cut:
                yield pairs(rows.slice(0, cut).combine_chunks())
            rest = rows.slice(cut)
        if rest is not None and rest.num_rows:
            yield pairs(rest.combine_chunks())
    return run


def _region_links(percent: int):
    """Links of a block of classes outside a region's component with a part of the region, sorted
    by place: as many as tie the labels that link there together, less than one a class."""
    def links(rows: pa.Table) -> pa.RecordBatch:
        mine = np.array(rows["mine"].to_pylist(), bool)
        cls, label = rows["cls"].to_pylist(), np.array(rows["label"].to_pylist(), object)
        sets = rows["set"].combine_chunks()
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        size = np.diff(at)
        others = np.flatnonzero(~mine)
        owner = np.repeat(np.arange(len(size)), size)
        keep = ~mine[owner]
        values, owner = flat[at[0]:at[-1]][keep], owner[keep]
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        tied = {x: x for x in label}

        def top(x: bytes) -> bytes:
            while tied[x] != x:
                tied[x] = x = tied[tied[x]]
            return x

        for i in np.flatnonzero(mine).tolist():
            own = flat[at[i]:at[i + 1]]
            low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = high - low
            hits = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            common = np.bincount(owner[hits], minlength=len(size))
            near = others[100 * common[others] >= percent * (size[others] + size[i] - common[others])]
            for j in dict(zip(label[near], near.tolist())).values():
                one, two = top(label[i]), top(label[j])
                if one != two:
                    tied[one] = two
                    a.append(min(cls[i], cls[j]))
                    b.append(max(cls[i], cls[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            if not rows.num_rows:
                continue
            at = rows["place"].to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()]
            for x, y in zip(edges, edges[1:]):
                yield links(rows.slice(x, y - x))
            rest = rows.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield links(rest)
    return run


def _leaves(classes: DataFrame) -> DataFrame:
    """(node, cls, size, deep) of the classes in leaves of two or more, written; deep: the node
    has more than NODE classes at the greatest depth."""
    keys = [F.xxhash64(F.lit(d), "tree", *(F.get(F.col("tokens"), F.col("tree") * DEPTH + k) for k in range(d + 1))).alias(f"k{d}")
            for d in range(DEPTH)]
    rows = (classes.select("cls", "tokens", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
            .select("cls", *keys))
    out = None
    for d in range(DEPTH):
        size = rows.groupBy(f"k{d}").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = written(rows.join(size, f"k{d}"), f"level{d}")
        last = d == DEPTH - 1
        leaf = (rows if last else rows.where(F.col("size") <= NODE)).select(
            F.col(f"k{d}").alias("node"), "cls", "size", (F.col("size") > NODE).alias("deep"))
        out = leaf if out is None else out.unionAll(leaf)
        rows = rows.where(F.col("size") > NODE).select("cls", *(f"k{x}" for x in range(d + 1, DEPTH)))
        if last or rows.isEmpty():
            break
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
            .where(F.col("i") * 100 >= percent * (F.col("s") - F.col("i"))).select("a", "b"))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = WIDTH,
                    percent: int = PERCENT) -> DataFrame:
    """(doc, row, n, component) of each document; ``row`` is a 64-bit hash of id and text."""
    signed = written(_signed(docs, text, key, width), "signed")
    classes = written(signed.where("n > 0").groupBy("cls").agg(
        F.min("doc").alias("doc"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("tokens").alias("tokens"),
        F.first("sketch").alias("sketch")), "classes")
    leaves = _leaves(classes)
    members = written(leaves.join(classes.select("cls", "n", "sketch"), "cls"), "members")

    small = (members.where("not deep").select("node", "cls", "n", "sketch").repartition("node").sortWithinPartitions("node")
             .mapInArrow(_leaf_pairs(percent), "a binary, b binary"))
    deep = members.where("deep")
    head = deep.groupBy("node").agg(F.min(F.struct("cls", "n", "sketch")).alias("h"))
    star = (deep.join(head, "node").where("cls != h.cls")
            .select(F.col("h.cls").alias("a"), F.col("cls").alias("b"), F.col("h.n").alias("n0"), "n", F.col("h.sketch").alias("sketch0"), "sketch")
            .mapInArrow(_star_filter(percent), "a binary, b binary"))
    pairs = written(small.unionAll(star).distinct(), "pairs")
    # of the candidates of a class, the smallest is confirmed first: these links join most copies
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")

    needed = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).unionAll(deep.select("cls")).distinct()
    rows = written(classes.join(needed, "cls", "left_semi").select("row", "cls"), "needed")
    sets = written(_sets(docs, rows, text, key, width), "sets")

    label = components(_confirmed(first, sets, percent))
    one, two = (label.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    across = (pairs.join(one, "a", "left").join(two, "b", "left")
              .where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"))
    links = written(_confirmed(across, sets, percent).unionAll(_across_deep(deep, label, sets, percent)), "links")
    label = components(label.where("id != label").select(F.col("id").alias("a"), F.col("label").alias("b")).unionAll(links))

    named = classes.join(label.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "doc", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("doc").alias("component"))
    final = written(named.join(least, "label").select("cls", "component"), "components")
    return (signed.select("doc", "row", "n", "cls").join(final, "cls", "left")
            .select("doc", "row", "n", F.coalesce("component", "doc").alias("component")))


def _across_deep(deep: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components in nodes that stay large. A node's region is its largest
    component; classes of the node outside it are compared, on full sets, with each other and with
    all classes of the region that stand in such nodes. Both sides are cut into blocks of bounded
    size, each pair of blocks is one small group of rows."""
    known = written(deep.join(label.withColumnRenamed("id", "cls"), "cls", "left")
                    .select("node", "cls", "n", F.coalesce("label", "cls").alias("label")), "known")
    many = known.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n_label"))
    main = (many.groupBy("node").agg(F.max(F.struct("n_label", "label")).alias("top"), F.sum("n_label").alias("all"))
            .where("all > top.n_label").select("node", F.col("top.label").alias("region")))
    outside = (known.join(main, "node").where("label != region").select("region", "cls", "label", "n")
               .distinct().withColumn("out", F.lit(True)))
    inside = (known.join(main.select("region").distinct(), F.col("label") == F.col("region"))
              .select("region", "cls", "label", "n").distinct().withColumn("out", F.lit(False)))
    rows = written(outside.unionAll(inside), "regions")
    total = rows.groupBy("region").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("out"), F.col("n"))).alias("outside"))
    rows = rows.join(total, "region").join(sets, "cls").select(
        "region", "cls", "label", "out", "set", F.ceil(F.col("outside") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("all") / PART).cast("int").alias("parts"))
    rows = rows.select("*", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"),
                       F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int").alias("part"))
    copies = F.when(F.col("out"), F.expr("concat(transform(sequence(0, parts - 1), q -> struct(true as mine, block as x, q as y)), "
                                         "transform(sequence(0, blocks - 1), p -> struct(false as mine, p as x, part as y)))")
                    ).otherwise(F.expr("transform(sequence(0, blocks - 1), p -> struct(false as mine, p as x, part as y))"))
    placed = (rows.withColumn("c", F.explode(copies))
              .select(F.xxhash64("region", "c.x", "c.y").alias("place"), "c.mine", "cls", "label", "set"))
    return (placed.repartition("place").sortWithinPartitions("place")
            .mapInArrow(_region_links(percent), "a binary, b binary"))


def deduplicate(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns; of repeated
    rows one stays."""
    found = near_duplicates(docs, text=text, key=key, width=width, percent=percent)
    stay = written(found.where(F.col("doc").eqNullSafe(F.col("component"))).groupBy("row").agg(F.count(F.lit(1)).alias("copies")), "stay")
    kept = docs.withColumn("__row", _row_key(text, key)).join(_sized(stay.select(F.col("row").alias("__row"), F.col("copies").alias("__copies"))), "__row")
    once = kept.where("__copies = 1")
    return once.unionAll(kept.where("__copies > 1").dropDuplicates(["__row"])).drop("__row", "__copies")


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w), 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id"""
