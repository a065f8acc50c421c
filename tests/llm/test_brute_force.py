"""Operators against plain Python, sentencepiece, exact round trips and held-out accuracy."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from ledgerflow.llm import chosen_path, context_mixing, ftrl, html_mss, kneser_ney, piece_bpe, quote_links, trigram_secrets, wu_manber
from ledgerflow.llm.common import SPACES, Words, strings, word_bytes

ASCII = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def sentences(seed, n, size=40, vocabulary=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(vocab) for _ in range(r.randint(1, size))) for _ in range(n)]


def test_words():
    data, offsets = strings(pa.array(["a bc", None, "", " \t", "é\x00x y", "a bc"]))
    w = Words(data, offsets, word_bytes(SPACES))
    assert [w.word(i).decode() for i in range(len(w))] == ["a", "bc", "é\x00x", "y", "a", "bc"]
    assert w.counts.tolist() == [2, 0, 0, 0, 2, 2]
    assert w.hashes[0] == w.hashes[4] and w.hashes[1] == w.hashes[5] and len(set(w.hashes.tolist())) == 4


# 2: context mixing

def test_score_is_a_probability():
    """Over all texts of at most two symbols of a tiny alphabet, first symbol probabilities sum to 1."""
    counts = np.zeros(257 * 257, np.int64)
    column = pa.array(["abab", "ba", ""])
    symbols, at = context_mixing.symbols_of(column)
    np.add.at(counts, context_mixing.pairs_of(symbols), 1)
    code = context_mixing.Code(counts)
    # Kraft: each code is complete, so a path through it is a distribution
    size = code.size.reshape(257, 257)
    assert np.allclose((0.5 ** size).sum(axis=1), 1)
    levels = [np.zeros(1 << bits, np.int8) for _, bits in context_mixing.HASHED]
    empty = 10 ** context_mixing.score_texts(code, levels, pa.array([""]))[0]
    firsts = [10 ** context_mixing.score_texts(code, levels, pa.array([c]))[0] for c in ("a", "b")]
    assert 0 < empty < 1 and all(0 < p < 1 for p in firsts) and empty + sum(firsts) < 1


def test_base_score_and_held_out_gain(spark, tmp_path):
    texts = sentences(3, 400, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (401, None), (7, texts[7])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = context_mixing.op2_context_mixing(spark, str(tmp_path)).toPandas()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted(((-1 if i is None else i), held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in rows)
    have = sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in got.itertuples())
    assert want == have
    out = got[got.held_out]
    letters = Counter("".join(texts))
    order0 = -sum(n / letters.total() * math.log2(n / letters.total()) for n in letters.values())
    assert out.bits_per_byte.mean() < 0.6 * order0
    assert (got.score < 0).all()


# 3: Kneser-Ney

def test_kneser_ney(spark):
    texts = sentences(5, 60) + ["", None, "### $$$ %%%"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = [i for i in range(40)]
    got = {r.doc: r for r in kneser_ney.perplexities(docs, spark.createDataFrame([(i,) for i in trusted], "doc long")).collect()}
    top = Counter()
    for i in trusted:
        b = (0, 0, 0, *(c + 1 for c in texts[i].encode()))
        top.update(b[j - 3:j + 1] for j in range(3, len(b)))
    tables = {4: top}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount, context = {}, {}
    for k, t in tables.items():
        n = [sum(c == m for c in t.values()) for m in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        of = lambda q, a, b: min(q, max(0.05, q - (q + 1) * y * b / a)) if a else 0.5 * q
        discount[k] = (of(1, n[0], n[1]), of(2, n[1], n[2]), of(3, n[2], n[3]))
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            context[k][g[:-1]][0] += c
            context[k][g[:-1]][1] += discount[k][min(c, 3) - 1]

    @lru_cache(None)
    def p(g):
        if not g:
            return 1 / 256
        k, c = len(g), tables[len(g)].get(g, 0)
        if g[:-1] not in context[k]:
            return p(g[1:])
        total, mass = context[k][g[:-1]]
        return (max(c - discount[k][min(c, 3) - 1], 0) / total if c else 0) + mass / total * p(g[1:])

    for i, t in enumerate(texts):
        b = (0, 0, 0, *(c + 1 for c in (t or "").encode()))
        assert got[i].score == pytest.approx(sum(math.log10(p(b[j - 3:j + 1])) for j in range(3, len(b))), rel=1e-4, abs=1e-4)
        assert got[i].trusted == (i in trusted) and got[i].n_bytes == len(b) - 3
    kept = {r.doc: r.kept for r in kneser_ney.judge(kneser_ney.perplexities(docs, spark.createDataFrame([(i,) for i in trusted], "doc long"))).collect()}
    assert not kept[60] and not kept[61] and not kept[62] and all(kept[i] for i in range(40))


# 4: secrets

def test_trigram_queries():
    q = {r.kind: trigram_secrets.trigram_query(r.pattern) for r in trigram_secrets.RULES}
    assert q["access"] == [frozenset({"aki", "kia"})] and q["hex"] == []
    assert frozenset({"tok", "oke", "ken"}) in q["assign"] and frozenset({"api", "ike", "pik", "key"}) in q["assign"]
    assert all(len(g) == 3 for clauses in q.values() for c in clauses for g in c)
    assert trigram_secrets.trigram_query("ab?") == []


def test_secrets_against_re(spark):
    r = random.Random(2)
    parts = ["password=", "passwd : ", "Secret='", 'API_KEY="', "apikey=", "token=secret=abcdefgh", "AKIA", "AKIA0123456789ABCD", "deadbeef" * 4, "0" * 31,
             "ABCDEFGH12345", "abcdefghi", " ", "\n", "é😀", "=", "x", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "short7"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.start, s.rank, s.end) for s in x["__spans"]] for x in trigram_secrets.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), rank, m.end()) for rank, rule in enumerate(trigram_secrets.RULES)
                      for m in re.finditer(rule.pattern, t) if len(m[rule.group]) >= rule.least)
        assert got[i] == want, t
    for x in trigram_secrets.redact(docs).collect():
        t, at, out = texts[x.doc_id], 0, ""
        for a, _, b in got[x.doc_id]:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert x.text == out + t[at:]


# 6: near duplicates

def brute_components(sets):
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(sets))]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("width, deep", [(2, True), (5, False)])
def test_near_duplicates(spark, monkeypatch, width, deep):
    """Copies with edits around the threshold; ``deep`` makes nearly all nodes large."""
    if deep:
        monkeypatch.setattr(chosen_path, "NODE", 3)
        monkeypatch.setattr(chosen_path, "BLOCK", 300)
        monkeypatch.setattr(chosen_path, "PART", 900)
    r = random.Random(width)
    texts = []
    for base in sentences(9, 12, 80, 400):
        base = (base + " ") * 1 + " ".join(sentences(len(base), 1, 60, 300))
        for _ in range(12):
            w = base.split(" ")
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = f"new{r.random()}"
            texts.append(" ".join(w))
    texts += ["", None, "one", "ONE", "one two", "a b c", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc: x for x in chosen_path.near_duplicates(docs, width=width).collect()}
    sets = [shingles(t, width) for t in texts]
    want = brute_components(sets)
    assert [got[i].component for i in range(len(texts))] == want
    assert [got[i].n for i in range(len(texts))] == [len(s) for s in sets]


def test_deduplicate_keeps_one(spark, docs):
    kept = chosen_path.deduplicate(docs).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id in (1, 2, 12)) == [1]
    assert [x.doc_id for x in kept].count(6) == 1 and 11 not in {x.doc_id for x in kept}


# 7: toxicity

def test_ftrl_held_out(spark):
    texts = sentences(11, 900)
    r = random.Random(4)
    rows, labels = [], []
    for i, t in enumerate(texts):
        toxic = r.random() < 0.2
        rows.append((i, t + (" you utter numpty " if toxic else " ") + t[:30]))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ftrl.fit(docs, lab, lab["doc_id"] % 3 != 1)
    got = {x.doc_id: x["__toxic"].score for x in ftrl.score(docs, model).collect()}
    held = [i for i in got if i % 3 == 1]
    right = sum((got[i] >= 0.7) == bool(labels[i][2]) for i in held)
    assert right / len(held) > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert len(model[1]) < 200  # L1 keeps few weights


# 8: extraction

def test_extraction(spark, folders):
    got = {x.page_id: x.text for x in html_mss.op8_html_mss(spark, folders["rows"]).collect()}
    assert got[3] == "Head & shoulders\n\none two three four. five six\n\nseven eight nine"
    assert got[1] == got[2] == got[4] == got[5] == "" and got[None] == "plain words only"


@pytest.mark.parametrize("scores", [[1, -2, 3, 4, -1, 2, -9, 5], [-1, -2], [2, -1, 2, -3, 3], []])
def test_best_region(scores):
    page = "".join("a " * s if s > 0 else f"<t{-s}>" for s in scores)
    weights = {f"t{k}": -float(k) for k in range(1, 10)}
    found = sum(weights[t] if t else len(x.split()) for t, x in html_mss.region(page, weights))
    best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])
    assert found == best


# 9: Wu-Manber

def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


@pytest.mark.parametrize("block_chars", [wu_manber.BLOCK_CHARS, 200])
def test_wu_manber(spark, block_chars):
    r = random.Random(8)
    texts = [t.upper().replace(" ", r.choice([" ", ", ", "\n"])) for t in sentences(21, 80, 60, 40)]
    items = [(k, " ".join(bench_words(r.choice(texts))[a:a + n])) for k in range(25) for a, n in [(r.randrange(20), r.choice([1, 3, 10, 14]))]]
    items += [(99, None), (98, "..."), (3, items[0][1])]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    marked = wu_manber.mark(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars)
    for x in marked.collect():
        w = bench_words(x.text)
        hit, found = set(), set()
        for k, t in items:
            b = bench_words(t)
            n = min(10, len(b))
            for s in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == b[s:s + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(k))
        h = x["__hits"]
        assert h.n_words == len(w) and h["items"] == sorted(found)
        assert sum(bin(c).count("1") for c in h.bits) == len(hit)


# 10: SentencePiece

def test_pieces_against_the_library():
    path = piece_bpe.default_model()
    library = piece_bpe.vocabulary(path).library
    r = random.Random(1)
    alphabet = [*"abc  \n\té漢😀▁ﬁ</s>0x41\x00", "  ", "the", "  the", "▁▁"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 300, "ab" * 500, " " * 100, "x" + " " * 37 + "y", "漢" * 200, "", "  ", None, "<0x0A>", "▁"]
    got = piece_bpe.encode_struct(path, pa.array(texts))
    want = library.encode([t or "" for t in texts])
    assert got["ids"].to_pylist() == want
    assert got["decoded"].to_pylist() == [library.decode(x) for x in want]
    assert [piece_bpe.vocabulary(path).decode(x) for x in want] == got["decoded"].to_pylist()


def test_long_and_short_chunks_agree():
    v = piece_bpe.vocabulary(piece_bpe.default_model())
    chunks = ["▁" + w for w in ["international", "zzzz", "aaaaaaa", "été", "x" * 40, "\n\n\n"]]
    assert v.many(chunks) == [v.one(c) for c in chunks]


# 1: quotation

def test_quotes(spark):
    a = "This is the first long message of all.\nIt has two lines in it, really."
    rows = [(1, 0, "u", a),
            (1, 1, "v", "> This is the first long message of all.\n> It has two lines in it, really.\n\nI agree with the first message entirely."),
            (1, 2, "u", "Bob wrote:\n> > This is the first long message of all.\n> I agree with the first message entirely.\nNo I do not agree."),
            (2, 0, "u", ">  It has TWO lines in it, really.\nindeed that was nice"), (2, 5, "u", "nothing quoted")]
    got = {(x.conv_id, x.turn): x for x in quote_links.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    parent = {k: (x.parent_conv, x.parent_turn) for k, x in got.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 0), (2, 5): (None, None)}
    assert got[1, 2].text == "No I do not agree." and got[1, 2].depth == 2 and (got[2, 0].root_conv, got[2, 0].root_turn) == (1, 0)
