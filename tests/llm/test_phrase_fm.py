"""Phrases of the index against plain counting."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm.phrase_fm import Shard, bloom, collocations, holds, op11_phrase_fm, _places, phrases, phrases_of, word_table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW))]


def counted(texts, depth):
    f, left, right = Counter(), Counter(), Counter()
    for text in texts:
        for ws in pieces(text):
            for i in range(len(ws)):
                for n in range(1, min(depth, len(ws) - i) + 1):
                    g = tuple(ws[i:i + n])
                    f[g] += 1
                    left[g] += i > 0
                    right[g] += i + n < len(ws)
    return f, left, right


def prose(seed, n=40):
    rng = random.Random(seed)
    words = ["A", "b", "cC", "dé", "漢", "e-f", "\x00", "g\xa0h"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ":"]) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", None, " \t", "..."]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_index_equals_counting(depth):
    texts = prose(depth)
    shard = Shard()
    for a in range(0, len(texts), 7):  # a shard grows slice by slice
        shard.add(pa.array(texts[a:a + 7], pa.string()), True)
    ids, known = shard.ids(None)
    f, left, right = counted(texts, depth)
    got = {}
    for grams, n, on_left, on_right in phrases_of(ids, depth, len(known) + 2):
        for g, *numbers in zip(grams, n.tolist(), on_left.tolist(), on_right.tolist()):
            got[tuple(shard.spelling[known[i - 2]].decode() for i in g)] = tuple(numbers)
    assert got == {g: (f[g], left[g], right[g]) for g in f}


def test_rare_words_are_not_crossed():
    """Words outside the filter take part in no phrase, but stand on a phrase's left and right."""
    shard = Shard()
    shard.add(pa.array(["x a b y", "a b"]), True)
    bits = np.zeros(1 << 20, np.uint64)
    for h, word in shard.spelling.items():
        if word in (b"a", b"b"):
            for place in _places(np.array([h]), len(bits)):
                bits[place >> np.uint64(6)] |= np.uint64(1) << (place & np.uint64(63))
    ids, known = shard.ids(bits)
    assert len(known) == 2 and (ids == 1).sum() == 2
    found = {tuple(shard.spelling[known[i - 2]] for i in g): (n, l, r)
             for grams, size, on_left, on_right in phrases_of(ids, 3, 4) for g, n, l, r in zip(grams, size.tolist(), on_left.tolist(), on_right.tolist())}
    assert found == {(b"a",): (2, 1, 2), (b"b",): (2, 2, 1), (b"a", b"b"): (2, 1, 1)}


def best(rows, least=10, top=2000, share=50):
    out = []
    langs = {}
    for text, lang in rows:
        langs.setdefault(lang or "und", []).append(text)
    for lang, texts in langs.items():
        f, _, _ = counted(texts, 3)
        n = sum(v for g, v in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        scored = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h))) and 100 * b >= share * a for h, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def test_collocations_equal_counting(spark):
    rows = [(t, lang) for seed, lang in ((1, "en"), (2, None), (3, "de"), (4, "en")) for t in prose(seed, 60)] + [("é é é é " * 30, "fr")]
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, w1 string, f int").repartition(5)
    got = sorted(tuple(r) for r in collocations(docs).collect())
    assert got == best(rows) and len(got) > 60
    assert sorted(tuple(r) for r in collocations(docs, least=1, top=5).collect()) == best(rows, 1, 5)


@pytest.mark.parametrize("which", ["rows", "none"])
def test_query(spark, folders, which):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{folders[which]}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op11_phrase_fm(spark, folders[which]).collect()) == best(rows)


def test_phrases_of_any_depth(spark):
    texts = prose(8, 80)
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)
    words, found = phrases(docs, 5, 4)
    spelling = {r.w1: r.word for r in words.collect()}
    f, left, right = counted(texts, 4)
    got = {tuple(spelling[r[k]] for k in ("w1", "w2", "w3", "w4") if r[k] is not None): (r.f, r.on_left, r.on_right) for r in found.collect()}
    assert got == {g: (f[g], left[g], right[g]) for g in f if len(g) > 1 and f[g] >= 5}


def test_clashing_hashes_are_replaced(spark):
    docs = spark.createDataFrame([("One two two", "en"), ("two one", "en")], "text string, lang string")
    plain = {r.word: (r.w1, r.f) for r in word_table(docs).collect()}
    other = {r.word: (r.w1, r.f) for r in word_table(docs, frozenset([plain["one"][0]])).collect()}
    assert other["two"] == plain["two"] and other["one"][0] != plain["one"][0] and other["one"][1] == 2


def test_filter_holds_what_it_was_given(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("w1")).repartition(4)
    inside = np.array([r.w1 for r in hashes.collect()])
    outside = np.array([r.w1 for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("w1")).collect()])
    bits = bloom(hashes)
    assert holds(bits, inside).all() and holds(bits, outside).mean() < 0.01
