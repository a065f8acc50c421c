"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text (A-Z lowered, UTF-8) and an end symbol are spelled in bits by Huffman codes, one after each
byte, from the pairs of bytes in training texts, so the model gives every text a probability. For
each context of ``HASHED`` a table of fixed size counts the bits seen in training after the hash of
(context, place in the code); one more predictor is the place in the code alone.
Scoring mixes the tables' log odds with weights gated by which contexts have been seen; each
text's own weights, and the slope and shift that refine the mixed odds, start the same and are learned
online along the text: after every ``STEP`` symbols, from past bits only. The text's score is the sum of log10 probabilities: total bits per byte
are -score / log10(2) / bytes.

Three scans: pairs of bytes and words; context counts; scores. Context counts leave a task as the
non-empty slots of table pages and are summed page by page as a stream, so a page of any number of
tasks needs the memory of one page. The tables, six megabytes at any input, are broadcast.
Word counts of the base score are joined by hash range: each block of texts sends every word once
and gets its count back, so frequent words are no hot keys and no vocabulary meets in one task.

Defined results: a null or empty text is the end symbol alone; a null id is in no fold 2, so it
trains; with no training texts all counts are 0; repeated rows each train and get their row.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import LOWER, SPACES, Words, mix, slices, strings, table, with_struct, word_bytes, written

#: The hashed contexts: so many earlier bytes, each with a table of 2 ** bits slots.
HASHED = ((4, 21), (6, 22))
#: Predictors: the place in the code, which depends on one earlier byte, and the hashed contexts.
K = 1 + len(HASHED)
PAGE_BITS = 14
END = 256
SYMBOLS = 257
#: Pseudo-counts of a slot; log odds are kept in bytes, ``SCALE`` to the unit.
PRIOR, SCALE = 0.15, 16.0
#: Symbols between two updates of a text's weights, and the rates of updates.
STEP = 256
RATE, REFINE_RATE = 1.0, 0.3
#: The gate: starting weights of the predictors, by which have been seen (bit k for predictor k).
SHARES = (0.15, 0.6, 0.4)


def _gates() -> np.ndarray:
    out = np.zeros((1 << K, K), np.float32)
    for g in range(1, 1 << K):
        seen = [k for k in range(K) if g >> k & 1]
        for k in seen:
            out[g, k] = 1.1 * SHARES[k] / sum(SHARES[j] for j in seen) / SCALE
    return out


GATES = _gates()


def _levels(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds of a 1 as bytes; 0 says never seen."""
    level = np.clip(np.rint(np.log((n1 + PRIOR) / (n0 + PRIOR)) * SCALE), -127, 127).astype(np.int8)
    level[(n0 + n1 > 0) & (level == 0)] = 1
    return level


class Code:
    """For each earlier symbol a Huffman code of symbols 0-256, from counts of pairs: per pair the
    inner nodes passed and the bits taken, and per node the log odds of a 1."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64).reshape(SYMBOLS, SYMBOLS)
        nodes, bits, size = [], [], []
        n = np.zeros((SYMBOLS * END, 2), np.float64)
        for before in range(SYMBOLS):
            heap = [(c + 1, s, s) for s, c in enumerate(counts[before].tolist())]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            for node in range(SYMBOLS, 2 * SYMBOLS - 1):
                (x, _, left), (y, _, right) = heapq.heappop(heap), heapq.heappop(heap)
                name = before * END + node - SYMBOLS
                parent[left], parent[right] = (name, 0), (name, 1)
                heapq.heappush(heap, (x + y, node, node))
            for s in range(SYMBOLS):
                path, at = [], s
                while at in parent:
                    path.append(parent[at])
                    at = parent[at][0] - before * END + SYMBOLS
                nodes += [x for x, _ in path[::-1]]
                bits += [x for _, x in path[::-1]]
                size.append(len(path))
        self.nodes, self.bits = np.array(nodes, np.uint32), np.array(bits, np.uint8)
        self.size = np.array(size, np.int64)
        self.start = np.cumsum(self.size) - self.size
        np.add.at(n, (self.nodes, self.bits), np.repeat(counts.ravel(), self.size))
        self.level = _levels(n[:, 0], n[:, 1])


def symbols_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each with its end, and the n + 1 offsets."""
    data, offsets = strings(column)
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.empty(len(data) + n, np.uint16)
    ends = at[1:] - 1
    out[ends] = END
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = LOWER[data]
    return out, at


def pairs_of(symbols: np.ndarray) -> np.ndarray:
    """Each symbol with the one before it, which is an end where a text starts."""
    before = np.empty(len(symbols), np.int32)
    before[:1], before[1:] = END, symbols[:-1]
    return before * np.int32(SYMBOLS) + symbols


def _hash32(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(32)).astype(np.uint32)


def context_hashes(symbols: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each hashed context, its hash at every symbol, from earlier symbols of the text only."""
    n = len(symbols)
    place = np.arange(n, dtype=np.int32) - np.repeat(at[:-1], np.diff(at)).astype(np.int32)
    packed, out = np.zeros(n, np.uint64), []
    for j in range(1, max(size for size, _ in HASHED) + 1):
        before = np.zeros(n, np.uint64)
        before[j:] = symbols[:max(n - j, 0)] + np.uint64(1)
        before[place < j] = 0
        packed = (packed << np.uint64(9)) | before
        out += [_hash32(packed) for size, _ in HASHED if size == j]
    return out


def decisions(code: Code, pairs: np.ndarray, hashes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The table slot of each hashed context at each bit, the nodes of the code, the bits, and how
    many bits each symbol has."""
    reps = code.size[pairs]
    base = np.cumsum(reps) - reps
    total = int(reps.sum())
    which = np.repeat((code.start[pairs] - base).astype(np.int32), reps)
    which += np.arange(total, dtype=np.int32)
    nodes = code.nodes[which]
    salt = nodes * np.uint32(0x9E3779B1)
    slots = []
    for h, (_, size) in zip(hashes, HASHED):
        x = np.repeat(h, reps)
        x ^= salt
        x *= np.uint32(0x85EBCA6B)
        x >>= np.uint32(32 - size)
        slots.append(x)
    return slots, nodes, code.bits[which], reps


def _count(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 << size, np.uint32) for _, size in HASHED]
        one = np.uint32(1)
        any_ = False
        for part in slices(batches, "text", 1 << 19):
            any_ = True
            symbols, at = symbols_of(part.column("text"))
            slots, _, bits, _ = decisions(code.value, pairs_of(symbols), context_hashes(symbols, at))
            for k, slot in enumerate(slots):
                slot <<= one
                slot |= bits
                np.add.at(counts[k], slot, one)
        size = 2 << PAGE_BITS
        for k in range(len(HASHED) if any_ else 0):
            for page in range(len(counts[k]) // size):
                mine = counts[k][page * size:(page + 1) * size]
                used = np.flatnonzero(mine)
                if len(used):
                    yield pa.RecordBatch.from_pydict({
                        "context": pa.array([k], pa.int32()), "page": pa.array([page], pa.int32()),
                        "used": pa.array([used.astype(np.uint16).tobytes()], pa.binary()),
                        "n": pa.array([mine[used].tobytes()], pa.binary())})
    return run


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums pages that come sorted by (context, page); yields each page's log odds as bytes."""
    now, counts = None, None

    def done() -> pa.RecordBatch:
        n = counts.reshape(-1, 2).astype(np.float64)
        return pa.RecordBatch.from_pydict({"context": pa.array([now[0]], pa.int32()), "page": pa.array([now[1]], pa.int32()),
                                           "level": pa.array([_levels(n[:, 0], n[:, 1]).tobytes()], pa.binary())})

    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("context", "page", "used", "n")}
            key = (row["context"], row["page"])
            if key != now:
                if now is not None:
                    yield done()
                now, counts = key, np.zeros(2 << PAGE_BITS, np.int64)
            counts[np.frombuffer(row["used"], np.uint16)] += np.frombuffer(row["n"], np.uint32)
    if now is not None:
        yield done()


def score_texts(code: Code, levels: list[np.ndarray], column: pa.Array) -> np.ndarray:
    """The log10 probability of each text. All texts go in step: symbols are put in the order of
    (step, text), so that a step is one run of bits in which each text has one segment."""
    symbols, at = symbols_of(column)
    hashes = context_hashes(symbols, at)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")  # the texts still running are always the first ones
    steps = -(-size[order] // STEP)
    live = [int((steps > s).sum()) for s in range(int(steps.max(initial=0)))]
    text = np.concatenate([order[:n] for n in live])
    step = np.repeat(np.arange(len(live)), live)
    start = at[text] + step * STEP
    length = np.minimum(size[text] - step * STEP, STEP)
    first = np.cumsum(length) - length
    move = np.repeat(start - first, length) + np.arange(len(symbols))
    slots, nodes, bits, reps = decisions(code, pairs_of(symbols)[move], [h[move] for h in hashes])
    level = [code.level[nodes], *(levels[k][slot] for k, slot in enumerate(slots))]
    gate = np.zeros(len(bits), np.uint8)
    for k in range(K):
        gate |= (level[k] != 0).view(np.uint8) << np.uint8(k)
    x = [level[k] * GATES[:, k][gate] for k in range(K)]
    sign = bits.astype(np.float32) * 2 - 1
    ends = np.cumsum(reps)
    segment = np.r_[0, ends[first[1:] - 1], len(bits)] if len(first) else np.zeros(1, np.int64)
    weights = np.ones((K, len(size)), np.float32)
    slope, shift = np.ones(len(size), np.float32), np.zeros(len(size), np.float32)
    total = np.zeros(len(size))
    at_segment = 0
    for n in live:
        cut = segment[at_segment:at_segment + n + 1]
        a, b = cut[0], cut[-1]
        each, begin = np.diff(cut), cut[:-1] - a
        at_segment += n
        xs = [x[k][a:b] for k in range(K)]
        mixed = np.repeat(weights[0, :n], each)
        mixed *= xs[0]
        for k in range(1, K):
            part = np.repeat(weights[k, :n], each)
            part *= xs[k]
            mixed += part
        final = mixed * np.repeat(slope[:n], each)
        final += np.repeat(shift[:n], each)
        final *= sign[a:b]
        np.clip(final, -12, 12, out=final)
        miss = np.exp(-final)
        total[:n] -= np.add.reduceat(np.log1p(miss), begin)
        # what these bits teach holds from the next step on
        error = miss / (1 + miss)
        error *= sign[a:b]
        for k in range(K):
            weights[k, :n] += RATE / (STEP * 4) * np.add.reduceat(error * xs[k], begin)
        slope[:n] += REFINE_RATE / (STEP * 4) * np.add.reduceat(error * mixed, begin)
        shift[:n] += REFINE_RATE / (STEP * 4) * np.add.reduceat(error, begin)
    out = np.empty(len(size))
    out[order] = total / np.log(10)
    return out


def _fold(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def fit(texts: DataFrame, counts: np.ndarray) -> tuple[Code, list[np.ndarray]]:
    """The codes and the tables of log odds, from a ``text`` column and its counts of pairs."""
    code = Code(counts)
    shared = texts.sparkSession.sparkContext.broadcast(code)
    pages = (texts.mapInArrow(_count(shared), "context int, page int, used binary, n binary")
             .repartition("context", "page").sortWithinPartitions("context", "page")
             .mapInArrow(_pages, "context int, page int, level binary"))
    levels = [np.zeros(1 << size, np.int8) for _, size in HASHED]
    size = 1 << PAGE_BITS
    for row in pages.toLocalIterator():  # a byte a slot of the tables in all
        levels[row["context"]][row["page"] * size:(row["page"] + 1) * size] = np.frombuffer(row["level"], np.int8)
    return code, levels


def score(docs: DataFrame, model: tuple[Code, list[np.ndarray]], *, text: str = "text", name: str = "__lm",
          drop: bool = False) -> DataFrame:
    """``docs`` plus a struct column ``name``: score (log10 probability) and bits_per_byte; ``drop``
    leaves the text out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def work(column: pa.Array) -> dict[str, pa.Array]:
        parts = []
        for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text", 1 << 19):
            parts.append(score_texts(*shared.value, part.column("text")))
        got = np.concatenate(parts) if parts else np.zeros(0)
        size = np.diff(strings(column)[1])
        return {"score": pa.array(got), "bits_per_byte": pa.array(-got / np.log10(2) / np.maximum(size, 1))}

    return with_struct(docs, text, name, kind, work, drop)


# The base score: word counts by blocks of texts and ranges of word hashes.

_END_HASH = np.uint64(0)
BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(T.LongType())),
    T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("tokens", T.BinaryType()),
    T.StructField("words", T.BinaryType()), T.StructField("train", T.BinaryType()),
    T.StructField("n_train", T.LongType()), T.StructField("pairs", T.ArrayType(T.IntegerType())),
    T.StructField("n_pairs", T.ArrayType(T.LongType()))])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with all first bytes first, then all second ones, ...: they compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice of texts: its distinct word hashes, how often each occurs in training
    texts, the words of each text as places in that list, and counts of pairs of symbols in training
    texts."""
    is_word = word_bytes(SPACES)
    for number, part in enumerate(slices(batches, "text")):
        data, offsets = strings(part.column("text"))
        low = LOWER[data]
        words = Words(low, offsets, is_word)
        n = part.num_rows
        train = ~np.array(part.column("held_out").to_pylist(), bool)
        size = words.counts + 1
        ends = np.cumsum(size) - 1
        token = np.full(int(size.sum()), _END_HASH)
        inside = np.ones(len(token), bool)
        inside[ends] = False
        token[inside] = np.maximum(words.hashes, np.uint64(1))
        unique, place = np.unique(token, return_inverse=True)
        learns = np.repeat(train, size)
        counts = np.bincount(place[learns], minlength=len(unique))
        symbols, _ = symbols_of(part.filter(pa.array(train)).column("text"))
        pair = np.bincount(pairs_of(symbols), minlength=1)
        used = np.flatnonzero(pair)
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId() * (1 << 32) + number]), pa.array([part.column("row").to_pylist()], pa.list_(pa.int64())),
            pa.array([size.tolist()], pa.list_(pa.int64())), pa.array([_planes(place)], pa.binary()),
            pa.array([unique.tobytes()], pa.binary()), pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
            pa.array([int(learns.sum())]), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([pair[used].tolist()], pa.list_(pa.int64()))],
            BLOCK.names)


def _ranges(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, train in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "train"))):
                h, n = np.frombuffer(words, np.uint64), np.frombuffer(train, np.uint32)
                cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(h)])
                rows = [(r, h[a:b].tobytes(), n[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    ["block", "range", "words", "train"])
    return run


def _total(rows: pa.Table) -> pa.Table:
    """All blocks' words of one hash range: each block gets the total counts of its words back."""
    parts = [np.frombuffer(w, np.uint64) for w in rows["words"].to_pylist()]
    counts = np.concatenate([np.frombuffer(w, np.uint32) for w in rows["train"].to_pylist()])
    unique, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, counts, len(unique)).astype(np.int64)
    sizes = np.cumsum([0, *map(len, parts)])
    known = [int((total > 0).sum())] + [0] * (len(parts) - 1)
    return pa.table({"block": rows["block"], "range": rows["range"], "distinct": pa.array(known, pa.int64()),
                     "total": pa.array([total[place[a:b]].tobytes() for a, b in zip(sizes, sizes[1:])], pa.binary())})


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            total = np.concatenate([np.frombuffer(x["total"], np.int64) for x in row["ranges"]])
            c = total[_from_planes(row["tokens"])]
            size = np.array(row["n_tokens"], np.int64)
            first = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays([
                pa.array(row["rows"], pa.int64()), pa.array(size), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(np.log10(c + 1.0), first))], ["row", "n_tokens", "n_known", "log_counts"])


#: Words that meet in one task of the base score's count, about.
RANGE_WORDS = 2_000_000


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _fold("doc_id").alias("held_out"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    blocks = written(docs.select("row", "held_out", "text").mapInArrow(_blocks, BLOCK), "blocks")
    sums = blocks.agg(F.sum("n_train").alias("n"), F.sum(F.octet_length("words") / 8).alias("words")).first()
    counts = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    seen = blocks.select(F.explode(F.arrays_zip("pairs", "n_pairs")).alias("x")).groupBy("x.pairs").agg(F.sum("x.n_pairs").alias("n"))
    for row in seen.collect():  # at most SYMBOLS ** 2 rows
        counts[row["pairs"]] = row["n"]
    bits = max(0, int(np.ceil(np.log2(max(1.0, (sums["words"] or 0) / RANGE_WORDS * 4)))))
    bits = max(bits, int(np.ceil(np.log2(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    totals = written(blocks.select("block", "words", "train")
                     .mapInArrow(_ranges(bits), "block long, range int, words binary, train binary")
                     .groupBy("range").applyInArrow(_total, "block long, range int, distinct long, total binary"), "totals")
    distinct = totals.agg(F.sum("distinct")).first()[0] or 0
    ranges = totals.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "total"))).alias("ranges"))
    base = (blocks.select("block", "rows", "n_tokens", "tokens").join(ranges, "block")
            .mapInArrow(_base, "row long, n_tokens long, n_known long, log_counts double"))
    # rows with one key have one text: any of them stands for all
    base = base.groupBy("row").agg(*(F.min(c).alias(c) for c in ("n_tokens", "n_known", "log_counts")))

    model = fit(docs.where(~F.col("held_out")).select("text"), counts)
    scored = score(docs, model, drop=True).select("doc_id", "row", "held_out", "__lm.score", "__lm.bits_per_byte")
    n = int(sums["n"] or 0)
    return scored.join(base, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(n + distinct + 1)))).alias("base_score"),
        "score", "bits_per_byte")
