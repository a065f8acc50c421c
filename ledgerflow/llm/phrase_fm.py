"""Phrase collocations by an FM-index per shard over word ids.

A task gathers the texts of a language into shards of about ``SHARD`` bytes and indexes each: words
get ids by order of their hashes, pieces of text are divided by id 0, and the shard's suffixes are
sorted by their first ``depth`` ids, forwards and backwards. Of both orders the Burrows-Wheeler
transform is kept, its symbol counts and its last-to-first map. A phrase is an interval in both. All
phrases of one length are extended at once: the symbols before the rows of an interval are its left
extensions, those that follow (the transform of the reversed text) its right ones; an extension's
interval in the one index is found by the last-to-first map, in the other one by the number of
extensions with lesser symbols. Extension goes left and right in turn, to ``depth`` words, and gives
each phrase's occurrences, and of these those with a word on the left and on the right. Numbers are
summed across shards by (language, word hashes).

Only phrases with ``least`` occurrences are asked for, so three passes narrow the work. Words are
counted first; a word that a Bloom filter of the frequent ones lacks is id 1 in a shard, which no
phrase extends over. Then phrases are counted by one 64-bit key each, and a Bloom filter holds the
frequent keys. The last pass gives the phrases that this filter lets through, with their words, and
sums them by words, so that neither shared keys nor false hits change a result. A filter has 16 bits
a key, at most 2^``BLOOM`` (16 MB) at any input; when it fills it lets rare words or phrases pass,
which costs time only.

Word hashes have 64 bits. Words that share one are found in the table of words, and counted anew
under other hashes until none do.

Work: passes over the texts in tasks of bounded memory (a shard, about 25 times its bytes); one
shuffle of distinct words, one of the keys of distinct phrases per shard (a hot phrase is a row a
shard), one of the frequent phrases. Tables of frequent words and phrases are written and joined by
hash.

Defined results: null and empty texts hold no words; a null language is ``und``; a text is taken
whole, also one longer than a shard; repeated rows count each; scores are exact (decimal) with ties
broken by occurrences and then the phrase's bytes; an empty table has no phrases; extra columns
don't pass.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import LOWER, Words, mix, release, slices, strings, table, word_bytes, written

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
IS_WORD = word_bytes(BREAKS + b"\x20\x09")
IS_BREAK = np.zeros(256, bool)
IS_BREAK[np.frombuffer(BREAKS, np.uint8)] = True

#: Bytes of one language that are indexed at once, and bytes of all languages that a task keeps as hashes.
SHARD, OPEN = 4 << 20, 16 << 20
#: A filter has at most 2^BLOOM bits and asks for HASHES of them.
BLOOM, HASHES = 27, 3


class Index:
    """One direction of a shard: suffixes of ``ids`` sorted by their first ``depth`` symbols."""

    def __init__(self, ids: np.ndarray, depth: int, size: int):
        n = len(ids)
        rank = ids.astype(np.int64)
        for k in range(1, depth):  # rank: the order of the first k symbols
            after = np.zeros(n, np.int64)
            after[:n - k] = ids[k:] + 1
            keys = rank * (size + 1) + after
            if k < depth - 1:
                rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            else:
                rank = keys
        order = np.argsort(rank, kind="stable")
        self.bwt = ids[order - 1].astype(np.int32)  # the text begins and ends with 0, so that it may be read as a ring
        counts = np.bincount(ids, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        del order, rank
        self.to_first = np.empty(n, np.int32)
        self.to_first[np.argsort(self.bwt, kind="stable")] = np.arange(n, dtype=np.int32)
        self.breaks = np.concatenate([[0], np.cumsum(self.bwt == 0)]).astype(np.int32)


def _extended(here: Index, lo: np.ndarray, other: np.ndarray, size: np.ndarray, symbols: int):
    """All extensions of intervals by one symbol on the side that ``here`` knows: the pattern's row,
    the symbol, the interval's start in ``here`` and in the other direction, and its size."""
    pattern = np.repeat(np.arange(len(lo)), size)
    begins = np.cumsum(size) - size
    rows = np.arange(len(pattern)) - np.repeat(begins - lo, size)
    keys = pattern * symbols + here.bwt[rows]
    found, at, counts = np.unique(keys, return_index=True, return_counts=True)
    pattern, symbol = found // symbols, found % symbols
    lesser = np.cumsum(counts) - counts
    lesser -= begins[pattern]  # extensions by lesser symbols, breaks included
    start = here.to_first[rows[at]].astype(np.int64)
    keep = symbol > 1
    return pattern[keep], symbol[keep], start[keep], (other[pattern] + lesser)[keep], counts[keep]


def phrases_of(ids: np.ndarray, depth: int, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a shard's ids (0 divides pieces, 1 is no word, at both ends stands 0): for each length from 1
    the phrases as rows of ids, their occurrences, and those with any word on the left and on the right."""
    left, right = Index(ids, depth, symbols), Index(ids[::-1], depth, symbols)
    words = np.arange(2, symbols)
    size = left.first[words + 1] - left.first[words]
    words, size = words[size > 0], size[size > 0]
    grams, lo, back = words[:, None], left.first[words], right.first[words]
    for length in range(1, depth + 1):
        yield (grams, size, size - (left.breaks[lo + size] - left.breaks[lo]), size - (right.breaks[back + size] - right.breaks[back]))
        if length == depth:
            return
        if length % 2:
            row, symbol, lo, back, size = _extended(left, lo, back, size, symbols)
            grams = np.concatenate([symbol[:, None], grams[row]], axis=1)
        else:
            row, symbol, back, lo, size = _extended(right, back, lo, size, symbols)
            grams = np.concatenate([grams[row], symbol[:, None]], axis=1)


class Shard:
    """The words of some texts of one language, in order: hashes, and where pieces end."""

    def __init__(self, clashes: frozenset[int] = frozenset()):
        self.clashes = clashes
        self.hashes, self.ends, self.size = [], [], 0
        self.spelling: dict[int, bytes] = {}

    def add(self, texts: pa.Array, spell: bool) -> None:
        data, at = strings(texts)
        data = LOWER[data]
        words = Words(data, at, IS_WORD)
        hashes = words.hashes.view(np.int64)
        if self.clashes:
            hashes = hashes.copy()
            for i in np.flatnonzero(np.isin(hashes, list(self.clashes))):
                hashes[i] = int.from_bytes(blake2b(words.word(i), digest_size=8).digest(), "little", signed=True)
        if len(hashes):
            broken = np.concatenate([[0], np.cumsum(IS_BREAK[data])])
            ends = np.ones(len(hashes), bool)
            ends[:-1] = broken[words.starts[1:]] > broken[words.ends[:-1]]
            ends[words.first[1:][words.counts > 0] - 1] = True
            self.hashes.append(hashes)
            self.ends.append(ends)
            if spell:
                new, where = np.unique(hashes, return_index=True)
                for h, i in zip(new.tolist(), where):
                    if h not in self.spelling:
                        self.spelling[h] = words.word(i)
        self.size += len(data)

    def ids(self, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The shard's ids and the hash of each id from 2."""
        hashes, ends = np.concatenate(self.hashes), np.concatenate(self.ends)
        known, which = np.unique(hashes, return_inverse=True)
        wanted = np.ones(len(known), bool) if frequent is None else holds(frequent, known)
        number = np.where(wanted, np.cumsum(wanted) + 1, 1)
        at = np.arange(len(hashes)) + np.cumsum(ends) - ends + 1  # behind each end stands a 0
        out = np.zeros(len(hashes) + int(ends.sum()) + 1, np.int64)
        out[at] = number[which]
        return out, known[wanted]


def _places(hashes: np.ndarray, n_words: int) -> list[np.ndarray]:
    shift = np.uint64(64 - 5 - n_words.bit_length())  # filters have 64 * 2^k bits
    return [mix(hashes.view(np.uint64) + np.uint64(k + 1)) >> shift for k in range(HASHES)]


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold."""
    out = np.ones(len(hashes), bool)
    for place in _places(hashes, len(bits)):
        out &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter of a table's only column, put together from the tasks' bits: 16 bits a row, 2^BLOOM at most."""
    n_words = 1 << min(BLOOM - 6, max(8, (keys.count() >> 2).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_words, np.uint64)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy(zero_copy_only=False), n_words):
                np.bitwise_or.at(bits, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(bits)
        for a in range(0, len(at), 10_000):
            part = at[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bits[part].view(np.int64))], ["at", "bits"])
        release()

    rows = keys.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(n_words, np.uint64)
    found = rows.toArrow()  # at most 2^(BLOOM - 6) rows, 32 MB, at any input
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _per_shard(docs: DataFrame, schema: str, work, clashes: frozenset[int], spell: bool) -> DataFrame:
    """``work`` on every shard of (lang, text) rows; it makes batches of ``schema``'s columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            shard = open_.pop(lang)
            if shard.hashes:
                for columns in work(shard):
                    n = len(columns[0])
                    for a in range(0, n, 100_000):
                        cut = [c[a:a + 100_000] for c in columns]
                        yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(cut[0]), np.int32))), *cut], names)

        names = ["lang", *(f.split()[0] for f in schema.split(", ")[1:])]
        for part in slices(batches, "text"):
            langs = part["lang"].dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(langs.indices.to_numpy(zero_copy_only=False) == i)
                open_.setdefault(lang, Shard(clashes)).add(part["text"].take(pa.array(rows)), spell)
                if open_[lang].size > SHARD:
                    yield from close(lang)
            while sum(s.size for s in open_.values()) > OPEN:
                yield from close(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            yield from close(lang)
        release()

    return docs.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_table(docs: DataFrame, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """(lang, w1, word, f): every word with its hash and occurrences."""
    def work(shard: Shard):
        known, f = np.unique(np.concatenate(shard.hashes), return_counts=True)
        yield [pa.array(known), pa.array([shard.spelling[h] for h in known.tolist()], pa.binary()).cast(pa.string()), pa.array(f)]

    found = _per_shard(_texts(docs), "lang string, w1 long, word string, f long", work, clashes, True)
    return found.groupBy("lang", "w1", "word").agg(F.sum("f").alias("f"))


def sound_words(docs: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """The word table, written, under hashes that no two words of a language share, and the hashes
    that had to be given up for that (next to none: 64 bits)."""
    clashes: frozenset[int] = frozenset()
    while True:
        words = written(word_table(docs, clashes), "words")
        shared = words.groupBy("lang", "w1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1").distinct()
        new = {r["w1"] for r in shared.collect()}
        if not new:
            return words, clashes
        if new <= clashes:
            raise ValueError("words share two hashes")
        clashes |= new


def phrases(docs: DataFrame, least: int = 10, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Words (lang, w1, word, f) and phrases of 2 to ``depth`` words with ``least`` occurrences or more:
    (lang, w1 .. w<depth> as hashes, f, and how many have a word on their left and right)."""
    words, clashes = sound_words(docs)
    keys = [f"w{i + 1}" for i in range(depth)]
    context = docs.sparkSession.sparkContext
    filters = []  # two numpy arrays of at most 16 MB each

    def grams_of(shard: Shard):
        ids, known = shard.ids(filters[0].value if filters else None)
        for grams, *numbers in phrases_of(ids, depth, len(known) + 2):
            if grams.shape[1] > 1:
                words_ = [known[grams[:, i] - 2] for i in range(grams.shape[1])]
                key = np.zeros(len(grams), np.uint64)
                for w in words_:
                    key = mix(key * np.uint64(3) + w.view(np.uint64))
                yield words_, key.view(np.int64), numbers

    def keyed(shard: Shard):
        for _, key, numbers in grams_of(shard):
            yield [pa.array(key), pa.array(numbers[0])]

    def spelled(shard: Shard):
        for words_, key, numbers in grams_of(shard):
            keep = holds(filters[1].value, key) if filters else np.ones(len(key), bool)
            named = [pa.array(words_[i][keep]) if i < len(words_) else pa.nulls(int(keep.sum()), pa.int64()) for i in range(depth)]
            yield [*named, *(pa.array(x[keep]) for x in numbers)]

    texts = _texts(docs)
    if least > 1:
        filters.append(context.broadcast(bloom(words.where(F.col("f") >= least).select("w1"))))
        found = _per_shard(texts, "lang string, key long, f long", keyed, clashes, False)
        # a shard's rows are distinct: dealt out at once, they are summed where they meet
        often = found.select("key", "f").repartition("key").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        filters.append(context.broadcast(bloom(written(often.select("key"), "often"))))
    schema = ", ".join(["lang string", *(f"{k} long" for k in keys), "f long", "on_left long", "on_right long"])
    found = _per_shard(texts, schema, spelled, clashes, False)
    sums = [F.sum(c).alias(c) for c in ("f", "on_left", "on_right")]
    return words, found.groupBy("lang", *keys).agg(*sums).where(F.col("f") >= least)


def _ratio(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits: exact for a below 10^16."""
    wide = [x.cast("decimal(19,0)") for x in (a, l, r)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """The ``top`` phrases of 2 to 3 words per language by score."""
    words, found = phrases(docs, least, 3)
    grams = written(found.select("lang", "w1", "w2", "w3", F.col("f").alias("a")), "phrases")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    common = words.where(F.col("f") >= least)
    pairs, triples = grams.where("w3 IS NULL").drop("w3"), grams.where("w3 IS NOT NULL")

    def word(i: int) -> DataFrame:
        return common.select("lang", F.col("w1").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"))

    # a pair goes if a triple around it has its share of the pair's occurrences
    around = triples.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    around = around.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("longer"))
    two = (pairs.join(around, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
           .join(word(1), ["lang", "w1"]).join(word(2), ["lang", "w2"])
           .select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                   _ratio(F.col("a"), F.col("f1"), F.col("f2")).alias("score")))
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = (triples.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
             .join(word(1), ["lang", "w1"]).join(word(2), ["lang", "w2"]).join(word(3), ["lang", "w3"])
             .withColumn("s1", _ratio(F.col("a"), F.col("f1"), F.col("f23"))).withColumn("s2", _ratio(F.col("a"), F.col("f12"), F.col("f3"))))
    late = F.col("s2") < F.col("s1")
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
                         F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS p FROM t),
l AS (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT d, lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY d, p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, a.f AS l, b.f AS r,
              c.f::HUGEINT * c.f * 1000000 // (a.f::HUGEINT * b.f) AS score
       FROM f2 c JOIN f1 a ON a.lang = c.lang AND a.w1 = c.w1 JOIN f1 b ON b.lang = c.lang AND b.w1 = c.w2
       WHERE NOT EXISTS (SELECT 1 FROM f3 x WHERE x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 AND 100 * x.f >= 50 * c.f)
         AND NOT EXISTS (SELECT 1 FROM f3 x WHERE x.lang = c.lang AND x.w2 = c.w1 AND x.w3 = c.w2 AND 100 * x.f >= 50 * c.f)),
c3 AS (SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, a.f AS l1, yz.f AS r1, xy.f AS l2, b.f AS r2,
              c.f::HUGEINT * c.f * 1000000 // (a.f::HUGEINT * yz.f) AS s1, c.f::HUGEINT * c.f * 1000000 // (xy.f::HUGEINT * b.f) AS s2
       FROM f3 c JOIN f1 a ON a.lang = c.lang AND a.w1 = c.w1 JOIN f1 b ON b.lang = c.lang AND b.w1 = c.w3
       JOIN f2 xy ON xy.lang = c.lang AND xy.w1 = c.w1 AND xy.w2 = c.w2 JOIN f2 yz ON yz.lang = c.lang AND yz.w1 = c.w2 AND yz.w2 = c.w3),
u AS (SELECT lang, phrase, a, l, r, score FROM c2 UNION ALL
      SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank FROM u)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, CAST(k.score AS BIGINT) AS score FROM k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000
"""
