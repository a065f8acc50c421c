"""Token files against the tokenizers library on whole texts."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as po
import pytest

from ledgerflow.llm import token_orc
from ledgerflow.llm.token_orc import Encoder, lookup, op12_token_orc, read, token_range, vocabulary, write


LIBRARY = vocabulary()


def whole(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def awkward():
    rng = random.Random(9)
    parts = ["Hello", "WORLD's", "don't", "ΣΑΣ", "ΟΔΟΣ", "été", "́x", "😀👍🏽", "漢字かな", "x_1.5,2", "<|endoftext|>", "<|startoftext|>x", " ",
             " ", "\u0085", "‍", "ﬁ", "İI", "a" * 300, "1234567", "\x1c", "\x00", "'s", "they'LL", "﻿", "ＡＢ", "नमस्ते", "가"]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", ""]
    return ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(30))) for _ in range(1500)]


def test_words_make_the_text():
    texts = ["", " ", "\n\n", *awkward(), " ".join(awkward())]
    ids, at = Encoder()(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole(t) for t in texts]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_orc, "KNOWN", 5)
    encoder = Encoder()
    for text in ["a b c", "c d e f g h i j", "a k", "l m n o"]:  # one slice's parts may be more
        ids, _ = encoder(pa.array([text]))
        assert ids.tolist() == whole(text) and len(encoder.known) <= max(5, len(text.split()))


@pytest.mark.parametrize("which", ["rows", "none"])
def test_query(spark, folders, which):
    rows = spark.read.parquet(f"{folders[which]}/documents.parquet").select("doc_id", "text").collect()
    got = op12_token_orc(spark, folders[which]).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(w), zlib.crc32(np.array(w, "<u4").tobytes()))
                  for r in rows for w in [whole(r.text)])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, (False, 0)
    for r in sorted(got, key=lambda r: r.start):  # places follow each other in order of ids
        assert r.start == at and (r.doc_id is not None, r.doc_id or 0) >= last
        at, last = at + r.n_tokens, (r.doc_id is not None, r.doc_id or 0)


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_orc, "STRIPE", 1 << 14)
    monkeypatch.setattr(token_orc, "SLICE", 1 << 14)
    n = 100_000
    docs = spark.range(n).selectExpr("id * 3 AS doc_id", "concat('document number ', id, repeat(' again', cast(id % 7 as int))) AS text",
                                     "'x' AS start", "'y' AS ids").repartition(6)
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write(docs, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "t" / "ids").glob("part-*.orc"))
    stripes = [po.ORCFile(str(f)).nstripes for f in files]
    assert len(files) > 1 and max(stripes) > 1
    ids = [po.ORCFile(str(f)).read(["doc_id"]).column(0).to_pylist() for f in files]
    flat = [i for part in ids for i in part]
    assert flat == sorted(flat) == [3 * i for i in range(n)]  # files and rows ascend

    stream = [t for r in read(spark, path).orderBy("start").collect() for t in r.ids]
    assert len(stream) == sum(r.n_tokens for r in read(spark, path).select("n_tokens").collect())
    found = lookup(spark, path, [0, 3, 4, 29_997, 10 ** 9])
    assert sorted((r.doc_id, list(r.ids)) for r in found.collect()) == [(i, whole(f"document number {i // 3}" + " again" * (i // 3 % 7))) for i in (0, 3, 29_997)]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(doc_id" in plan
    for first, last in ((0, 10), (1234, 5678), (len(stream) - 5, len(stream)), (len(stream) // 3, 2 * len(stream) // 3)):
        rows = sorted(token_range(spark, path, first, last).collect(), key=lambda r: r.start)
        tokens = [t for r in rows for t in r.ids]
        assert tokens[rows[0].skip:][:last - first] == stream[first:last]
        assert rows[0].start <= first < rows[0].start + rows[0].n_tokens


def test_unfinished_folder_is_not_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    write(docs, str(tmp_path / "t"))
    (tmp_path / "t" / "offsets").rename(tmp_path / "offsets")
    with pytest.raises(Exception, match="(?i)offsets"):
        read(spark, str(tmp_path / "t")).collect()
