import pytest
from pyspark.sql import functions as F

from helpers import D
from ledgerflow.operators.batching import assign_batches, collate_arrays, pad_and_mask, shuffled_place, unbatch
from ledgerflow.operators.encoders import BrandVocab, NoOpEncoder, TimeDeltaEncoder
from ledgerflow.operators.sequences import (BLOCK, collect_sequences, dense_blocks, dense_vectors, newest_rows, sequence_rows,
                                            target_cells)

FEATS = ["brand", "amount", "date"]


def seq_fixture(spark, extra_users=()):
    raw = [(1, "A", 100, "2020-01-01"), (1, "B", 200, "2020-01-02"),
           (2, "A", 150, "2020-01-01"), (2, "B", 250, "2020-01-03")]
    rows = spark.createDataFrame([("test", u, 1, b, float(a), D(d)) for u, b, a, d in raw],
                                 "split string, user_id long, k long, brand string, amount double, date timestamp_ntz")
    members = spark.createDataFrame([("test", u) for u in (1, 2, *extra_users)], "split string, user_id long")
    enc = {"brand": BrandVocab().fit(rows, "brand"), "amount": NoOpEncoder("amount"),
           "date": TimeDeltaEncoder().fit(rows, "date")}
    start, end = {"test": D("2020-01-01")}, {"test": D("2020-01-04")}
    return rows, members, enc, sequence_rows(rows, members, enc, FEATS, start, end)


def arrays(seq):
    return {r.user_id: (r.brand, r.amount, r.date) for r in collect_sequences(seq, FEATS).collect()}


def test_sequences_literal(spark):
    _, _, _, seq = seq_fixture(spark)
    got = arrays(seq)
    assert got[1] == ([0, 3, 4, 1], [-1.0, 100.0, 200.0, 2.0], [0, 0, 1, 3])
    assert got[2] == ([0, 3, 4, 1], [-1.0, 150.0, 250.0, 2.0], [0, 0, 2, 3])


def test_collate_no_padding_and_rows(spark):
    _, members, _, seq = seq_fixture(spark)
    b = assign_batches(members, batch_size=32)
    padded = pad_and_mask(seq, b, FEATS)
    assert padded.where("mask").count() == 0
    rows = unbatch(padded, FEATS)
    assert rows.count() == 8 and rows.columns == ["split", "user_id", "pos", *FEATS]


def test_empty_user_and_padding(spark):
    _, members, _, seq = seq_fixture(spark, extra_users=(3,))
    got = arrays(seq)
    assert got[3][0] == [0, 1]
    b = assign_batches(members, batch_size=32)
    arr = {r.user_id: r for r in collate_arrays(pad_and_mask(seq, b, FEATS), FEATS).collect()}
    assert arr[3].brand == [0, 1, 1, 1]
    assert arr[3].mask == [False, False, True, True]
    assert arr[1].mask == [False] * 4


def test_max_len_keeps_newest(spark):
    _, _, _, seq = seq_fixture(spark)
    got = {r.user_id: r.brand for r in collect_sequences(seq, FEATS, max_len=2).collect()}
    assert got[1] == [4, 1]


def multi_hot(spark):
    raw = [(1, "A", 100), (1, "B", 200), (2, "A", 150), (2, "C", 300)]
    rows = spark.createDataFrame([("test", u, 1, b, float(a)) for u, b, a in raw],
                                 "split string, user_id long, k long, brand string, amount double")
    members = spark.createDataFrame([("test", 1), ("test", 2)], "split string, user_id long")
    vocab = BrandVocab().fit(rows, "brand")
    return rows, members, vocab


def test_multi_hot_vectors(spark):
    rows, members, vocab = multi_hot(spark)
    assert vocab.size == 6
    cells = target_cells(rows, members, vocab, None)
    flag = {r.user_id: r.brand_flag for r in dense_vectors(cells, members, vocab.size, "brand_flag").collect()}
    amt = {r.user_id: r.amount for r in dense_vectors(cells, members, vocab.size, "amount").collect()}
    assert flag[1] == [0, 0, 0, 1, 1, 0] and flag[2] == [0, 0, 0, 1, 0, 1]
    assert amt[1] == [0, 0, 0, 100, 200, 0] and amt[2] == [0, 0, 0, 150, 0, 300]


def test_dense_vectors_of_any_width(spark):
    """300,000 slots: two blocks hold cells, the vector is put together from blocks."""
    cells = spark.createDataFrame([("train", 1, 5, 1.5), ("train", 1, 299_999, 2.5)], "split string, user_id long, brand_id int, amount double")
    members = spark.createDataFrame([("train", 1), ("train", 2)], "split string, user_id long")
    blocks = {r.block: r.amount for r in dense_blocks(cells, 300_000, "amount").collect()}
    assert sorted(blocks) == [0, 299_999 // BLOCK] and len(blocks[0]) == BLOCK and blocks[0][5] == 1.5
    assert len(blocks[299_999 // BLOCK]) == 300_000 % BLOCK and blocks[299_999 // BLOCK][-1] == 2.5
    got = {r.user_id: r.amount for r in dense_vectors(cells, members, 300_000, "amount").collect()}
    assert {u: len(v) for u, v in got.items()} == {1: 300_000, 2: 300_000}
    assert {i: v for i, v in enumerate(got[1]) if v} == {5: 1.5, 299_999: 2.5} and not any(got[2])


def test_newest_rows(spark):
    rows = spark.createDataFrame([("train", 1, k, b) for k in range(50) for b in "AB"] + [("val", 1, 3, "C")], "split string, user_id long, k long, brand string")
    kept = newest_rows(rows.repartition(7), 3)
    assert sorted(map(tuple, kept.collect())) == [("train", 1, 48, "B"), ("train", 1, 49, "A"), ("train", 1, 49, "B"), ("val", 1, 3, "C")]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 257])
def test_epochs_are_permutations(spark, n):
    base = spark.range(n).select(F.col("id"), F.lit(n).cast("bigint").alias("n"))
    orders = [[r.p for r in base.select("id", shuffled_place(F.col("id"), F.col("n"), 42, e).alias("p")).orderBy("id").collect()] for e in (0, 1, 2)]
    for order in orders:
        assert sorted(order) == list(range(n))
    if n >= 100:
        assert orders[0] != orders[1] != orders[2] and sum(a == b for a, b in zip(*orders[:2])) < n / 5


def test_only_train_is_shuffled(spark):
    members = spark.createDataFrame([(s, u) for s in ("train", "val") for u in range(200)], "split string, user_id long")
    by_epoch = [{(r.split, r.user_id): (r.batch, r.slot) for r in assign_batches(members, 32, epoch=e).collect()} for e in (0, 1)]
    changed = {s for (s, u), at in by_epoch[0].items() if by_epoch[1][s, u] != at}
    assert changed == {"train"}
    assert sorted(by_epoch[1].values()) == sorted(by_epoch[0].values())


def test_unknown_brands_share_unk_slot(spark):
    rows, members, _ = multi_hot(spark)
    vocab = BrandVocab(top_n=1).fit(rows, "brand")  # keeps A only
    cells = {(r.user_id, r.brand_id): r.amount for r in target_cells(rows, members, vocab, None).collect()}
    assert cells[(1, 2)] == 200 and cells[(2, 2)] == 300 and cells[(1, 3)] == 100


def test_two_level_positions_equal_single_window(spark):
    import datetime as dt
    import random
    from ledgerflow.operators.sequences import sequence_rows
    rnd = random.Random(2)
    raw = [("test", rnd.randint(1, 4), rnd.randint(1, 6), rnd.choice("ABCDE"), float(rnd.randint(1, 9)),
            D("2020-01-01") + dt.timedelta(days=rnd.randint(0, 30))) for _ in range(200)]
    rows = spark.createDataFrame(raw, "split string, user_id long, k long, brand string, amount double, date timestamp_ntz")
    rows = rows.dropDuplicates(["split", "user_id", "k", "brand"])
    members = spark.createDataFrame([("test", u) for u in range(1, 6)], "split string, user_id long")
    enc = {"brand": BrandVocab().fit(rows, "brand"), "amount": NoOpEncoder("amount"),
           "date": TimeDeltaEncoder().fit(rows, "date")}
    start, end = {"test": D("2020-01-01")}, {"test": D("2020-02-01")}
    a = sequence_rows(rows, members, enc, FEATS, start, end)
    b = sequence_rows(rows, members, enc, FEATS, start, end, single_task_max=0)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(a) == key(b)


def test_pandas_predictor(spark):
    import pandas as pd
    from ledgerflow.operators.predict import pandas_predictor
    rows = spark.createDataFrame([("test", 1, "A", 10.0), ("test", 1, "A", 30.0), ("test", 2, "B", 5.0)],
                                 "split string, user_id long, brand string, amount double")
    vocab = BrandVocab(order_by=("user_id",)).fit(rows, "brand")

    def mean_by_brand(pdf):
        g = pdf.groupby("brand_id", as_index=False)["amount"].mean()
        return pd.DataFrame({"split": pdf["split"].iloc[0], "user_id": pdf["user_id"].iloc[0],
                             "brand_id": g["brand_id"].astype("int32"), "predicted": g["amount"]})

    out = sorted(tuple(r) for r in pandas_predictor(mean_by_brand)(rows, vocab).collect())
    assert out == [("test", 1, 3, 20.0), ("test", 2, 4, 5.0)]


def test_batches_are_full(spark):
    members = spark.createDataFrame([("train", u) for u in range(1000)] + [("val", u) for u in range(33)], "split string, user_id long")
    rows = assign_batches(members, batch_size=32).collect()
    for split, n in (("train", 1000), ("val", 33)):
        mine = [r for r in rows if r.split == split]
        assert sorted(r.batch * 32 + r.slot for r in mine) == list(range(n))
        assert {r.slot for r in mine} <= set(range(32))
