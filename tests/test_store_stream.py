import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import D
from ledgerflow.config import DataConfig, Cutoffs
from ledgerflow.operators.buckets import bucket_aggregate, fit_buckets
from ledgerflow.plans.prepare import prepare
from ledgerflow.sources.store import (FingerprintLedger, ProcessedCache, TrialLog, content_fingerprint,
                                      fingerprint_parts, fold_parts)
from ledgerflow.sources.views import read_transactions
from ledgerflow.streaming.buckets import run_to_table, stream_bucket_aggregate


def test_csv_with_leading_blanks(spark, tmp_path):
    p = tmp_path / "tx.csv"
    p.write_text("user_id,date,brand,amount\n 1, 2024-01-01 00:00:00, A, 100\n 2, 2024-01-08 00:00:00, B, 200.5\n")
    df = read_transactions(spark, str(p))
    assert sorted(tuple(r) for r in df.collect()) == [(1, D("2024-01-01"), "A", 100.0), (2, D("2024-01-08"), "B", 200.5)]


def test_csv_by_header_name(spark, tmp_path):
    p = tmp_path / "tx.csv"
    p.write_text("amount, note,brand ,date,user_id\n100,x,7,2024-01-01,1\n0.00004,y,8,2024-01-02 10:00:00,2\n")
    got = sorted(tuple(r) for r in read_transactions(spark, str(p)).collect())
    assert got == [(1, D("2024-01-01"), "7", 100.0), (2, D("2024-01-02 10:00:00"), "8", 0.00004)]
    p.write_text("amount,brand,date\n1,2,2024-01-01\n")
    with pytest.raises(ValueError, match="user_id"):
        read_transactions(spark, str(p))


def test_fingerprint_is_order_free(tx):
    a = tx([(1, "2024-01-01", "A", 1), (2, "2024-01-02", "B", 2)])
    b = tx([(2, "2024-01-02", "B", 2), (1, "2024-01-01", "A", 1)])
    c = tx([(2, "2024-01-02", "B", 3), (1, "2024-01-01", "A", 1)])
    fa, fb, fc = (content_fingerprint(x).first().fingerprint for x in (a, b, c))
    assert fa == fb != fc


def test_cache_hit_and_miss(spark, tx, tmp_path):
    rows = [(1, "2024-01-01", "A", 1), (2, "2024-01-09", "B", 2), (1, "2024-01-20", "A", 3)]
    cache = ProcessedCache(spark, str(tmp_path / "c"))
    calls = []

    def build(df):
        def inner():
            calls.append(1)
            return {"cells": bucket_aggregate(df, fit_buckets(df, "7D"))}
        return inner

    df = tx(rows)
    _, hit, key = cache.load_or_build("{}", df, build(df))
    assert not hit
    again = tx(list(reversed(rows)))  # same content, other layout
    t, hit, key2 = cache.load_or_build("{}", again, build(again))
    assert hit and key2 == key and t["cells"].count() == 2 and len(calls) == 1
    changed = tx(rows[:-1] + [(1, "2024-01-20", "A", 4)])
    _, hit, key3 = cache.load_or_build("{}", changed, build(changed))
    assert not hit and key3 != key
    _, hit, _ = ProcessedCache(spark, str(tmp_path / "c"), version="other").load_or_build("{}", df, build(df))
    assert not hit
    _, hit, key4 = cache.load_or_build('{"x": 1}', df, build(df))
    assert not hit and key4 != key


def test_half_written_entry_is_a_miss(spark, tx, tmp_path):
    """Tables without a manifest, as a build leaves them that dies, and two writers of one key."""
    df = tx([(1, "2024-01-01", "A", 1)])
    cache = ProcessedCache(spark, str(tmp_path / "c"))
    key = cache.key("{}", df)
    df.write.parquet(str(tmp_path / "c" / key / "tables-dead" / "cells"))
    (tmp_path / "c" / key / ".manifest-tables-dead").write_text('{"version": "1", "fold')
    assert cache.lookup(key) is None
    first = cache.store(key, "{}", {"cells": df})
    second = cache.store(key, "{}", {"cells": df})  # the later writer of the same key
    assert first["cells"].collect() == second["cells"].collect() == cache.lookup(key)["cells"].collect() == df.collect()
    assert len(list((tmp_path / "c" / key).glob("manifest-*"))) == 1


@pytest.mark.parametrize("group_by", [None, "brand"])
def test_restored_encoders_invert(spark, tx, tmp_path, group_by):
    from dataclasses import replace
    from ledgerflow.config import BrandParams, Cutoffs, DataConfig, Splits
    from ledgerflow.plans.catalog import recover_rows
    from ledgerflow.plans.prepare import prepare
    from ledgerflow.plans.restore import restore, state_tables
    cfg = DataConfig("7D", Cutoffs("2024-01-01", "2024-02-01", "2024-02-08", "2024-02-15"), Splits(), BrandParams(), amount_group_by=group_by)
    rows = [(u, f"2024-01-{1 + (u * 7 + i * 5) % 28:02d}", "ABC"[i % 3], 10.0 * i + u + 1) for u in range(20) for i in range(6)]
    prep = prepare(tx(rows + [(0, "2024-02-20", "A", 3.0)]), cfg)
    cache = ProcessedCache(spark, str(tmp_path / "c"))
    state = restore(cfg, cache.store("k", cfg.to_json(), state_tables(prep)))
    cols = ["split", "user_id", "pos", "brand", "amount", "date"]
    want, got = (sorted(map(tuple, recover_rows(s, e).select(*cols).collect()), key=str)
                 for s, e in ((prep.sequences(), prep.encoders), (state.sequences, state.encoders)))
    assert got == want and len(got) > 40
    assert sorted(map(tuple, state.members.collect())) == sorted(map(tuple, prep.members.collect()))
    with pytest.raises(ValueError, match="table form"):
        from ledgerflow.operators.encoders import ENCODERS, TimeDeltaEncoder
        restore(replace(cfg, amount_encoder="time_delta"), cache.lookup("k"))


def test_fingerprint_ledger(spark, tx, tmp_path):
    """Parts are added, replaced and dropped without reading the others."""
    one, two = [(1, "2024-01-01", "A", 0.1)] * 2, [(2, "2024-01-02", None, 1e-9), (3, "2024-01-03", "B", None)]
    ledger = FingerprintLedger(spark, str(tmp_path / "f"))
    ledger.put("one", tx(one))
    ledger.put("two", tx([(9, "2024-01-02", "B", 1)]))
    ledger.put("two", tx(two))
    whole = content_fingerprint(tx(one + two)).first()
    assert tuple(ledger.whole().first()) == tuple(whole)
    ledger.drop("one")
    assert tuple(ledger.whole().first()) == tuple(content_fingerprint(tx(two)).first())
    parts = fingerprint_parts(tx(one + two)).withColumn("sign", F.lit(1)).unionByName(fingerprint_parts(tx(two)).withColumn("sign", F.lit(-1)))
    assert tuple(fold_parts(parts).first()) == tuple(content_fingerprint(tx(one)).first())
    assert content_fingerprint(tx(one[:1])).first().fingerprint != content_fingerprint(tx(one)).first().fingerprint


@pytest.mark.parametrize("interval", ["3D", "1W"])
def test_streaming_equals_batch(spark, tx, tmp_path, interval):
    import random
    rnd = random.Random(5)
    base = D("2024-01-01 03:00")
    data = [(rnd.randint(1, 4), base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 30)), rnd.choice("AB"),
             rnd.randint(1, 50)) for _ in range(300)]
    df = tx(data)
    src = tmp_path / "in"
    df.write.parquet(str(src))
    spec = fit_buckets(df, interval)
    batch = sorted(tuple(r) for r in bucket_aggregate(df, spec).collect())
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    # the stream takes the raw earliest date and anchors weeks itself
    raw_lo = df.agg(F.min("date")).first()[0]
    out = run_to_table(spark, stream_bucket_aggregate(stream, raw_lo, interval, "365 days", spec.n_buckets),
                       "complete")
    assert sorted(tuple(r) for r in out.select("user_id", "k", "brand", "amount", "date").collect()) == batch


def test_trial_log_chunks(spark, tmp_path):
    log = TrialLog(spark, str(tmp_path / "log"))
    mk = lambda t, v: spark.createDataFrame([("r", t, "val", 0, "positive_mae", v)],
                                             "run string, trial long, split string, step long, metric string, value double")
    log.append(mk(0, 1.0), chunk="a")
    log.append(mk(1, 2.0), chunk="b")
    log.append(mk(1, 2.0), chunk="b")  # retried append replaces its chunk
    assert sorted((r.trial, r.value) for r in log.read("r").collect()) == [(0, 1.0), (1, 2.0)]


def test_resume_sweep(spark, tx, tmp_path):
    from ledgerflow.operators.sweep import resume_sweep
    import random
    rnd = random.Random(11)
    base = D("2024-01-01")
    data = [(u, base + dt.timedelta(hours=rnd.randint(0, 24 * 40)), rnd.choice("ABCD"), rnd.randint(1, 90))
            for u in range(40) for _ in range(40)]
    cfg = DataConfig(interval="2D", cutoffs=Cutoffs("2024-01-01", "2024-01-25", "2024-01-29", "2024-02-02"))
    prep = prepare(tx(data), cfg)
    space = {"data": {"top_n": {"type": "int", "min": 1, "max": 4},
                      "lookback": {"type": "int", "min": 1, "max": 12},
                      "denominator": {"type": "categorical", "options": ["all", "active"]}}}
    log = TrialLog(spark, str(tmp_path / "log"))
    first = resume_sweep(prep, space, 3, log, "run1").collect()
    assert log.read("run1").select("trial").distinct().count() == 3
    resumed = resume_sweep(prep, space, 6, log, "run1").collect()
    assert log.read("run1").select("trial").distinct().count() == 6
    full = resume_sweep(prep, space, 6, TrialLog(spark, str(tmp_path / "log2")), "run1").collect()
    assert resumed == full and len(first) == 1


def test_prepare_with_per_brand_scaler(spark, tx):
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(4)
    base = D("2024-01-01")
    data = [(u, base + dt.timedelta(hours=rnd.randint(0, 24 * 40)), rnd.choice("ABC"), rnd.randint(1, 90))
            for u in range(30) for _ in range(20)]
    cfg = DataConfig(interval="2D", cutoffs=Cutoffs("2024-01-01", "2024-01-25", "2024-01-29", "2024-02-02"),
                     amount_group_by="brand")
    prep = prepare(tx(data), cfg)
    fit = prep.fit_rows()
    bounds = {r.brand: (r.lo, r.hi) for r in fit.groupBy("brand").agg(F.min("amount").alias("lo"),
                                                                        F.max("amount").alias("hi")).collect()}
    vocab = {r.id: r.value for r in prep.encoders["brand"].vocab.collect()}
    seq = prep.sequences().where("pos > 0 AND brand > 2").collect()
    assert seq
    # every body element's scaled amount lies in [0, 1] on the train input window of train users
    train_seq = [r for r in seq if r.split == "train"]
    assert all(-1e-9 <= r.amount <= 1 + 1e-9 for r in train_seq)
    tgt = prep.targets().collect()
    raw = {(r.split, r.user_id, r.brand_id): r for r in tgt}
    for r in tgt:
        if r.brand_id > 2:
            lo, hi = bounds[vocab[r.brand_id]]
            expect = (r.amount_raw - r.n_rows * lo) / (hi - lo)
            assert abs(r.amount - expect) < 1e-9
    assert raw


def test_stream_append_respects_watermark(spark, tx, tmp_path):
    """Append mode emits a bucket once the watermark passes its end; a row
    arriving later than the watermark is dropped, earlier buckets stay exact."""
    from ledgerflow.streaming.buckets import stream_to_parquet
    src = tmp_path / "in"
    first = tx([(1, "2024-01-01", "A", 1), (1, "2024-01-02", "A", 2), (1, "2024-01-05", "A", 4),
                (2, "2024-01-09", "B", 8)])
    first.write.parquet(str(src / "b1"))
    origin, out = D("2024-01-01"), str(tmp_path / "out")
    ckpt = str(tmp_path / "ckpt")

    def run():
        stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(str(src))
        q = stream_to_parquet(stream_bucket_aggregate(stream, origin, "3D", "1 day"), out, ckpt)
        q.awaitTermination()

    run()
    # late row for bucket 1 (ends 2024-01-04) and a far-future row that moves the watermark
    tx([(1, "2024-01-03", "A", 100), (3, "2024-01-30", "C", 16)]).write.parquet(str(src / "b2"))
    run()
    got = sorted((r.user_id, r.k, r.brand, r.amount) for r in spark.read.parquet(out).collect())
    assert (1, 1, "A", 3.0) in got            # bucket 1 kept its on-time amount
    assert all(a != 103.0 for *_, a in got)    # the late row did not reopen it
    assert (1, 2, "A", 4.0) in got and (2, 3, "B", 8.0) in got


def test_prepare_checkpointed_equals_persisted(spark, tx):
    import random
    rnd = random.Random(9)
    base = D("2024-01-01")
    data = [(u, base + dt.timedelta(hours=rnd.randint(0, 24 * 40)), rnd.choice("ABCD"), rnd.randint(1, 90))
            for u in range(25) for _ in range(15)]
    cfg = DataConfig(interval="2D", cutoffs=Cutoffs("2024-01-01", "2024-01-25", "2024-01-29", "2024-02-02"))
    df = tx(data)
    a = prepare(df, cfg, materialize="persist")
    b = prepare(df, cfg, materialize="checkpoint")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(a.sequences()) == key(b.sequences())
    assert key(a.targets()) == key(b.targets())


def test_strict_alignment_splits_a_straddling_bucket(spark, tx):
    # 4-day buckets from 2024-01-01; the train target starts inside bucket 3 (01-09 .. 01-13]
    rows = [(u, "2024-01-01", "A", 1) for u in range(1, 11)]
    rows += [(u, "2024-01-10", "A", 10) for u in range(1, 11)]   # bucket 3, before the cutoff
    rows += [(u, "2024-01-12", "A", 100) for u in range(1, 11)]  # bucket 3, after the cutoff
    rows += [(u, "2024-01-30", "B", 1) for u in range(1, 11)]
    cfg = DataConfig(interval="4D", cutoffs=Cutoffs("2024-01-01", "2024-01-11", "2024-01-11", "2024-01-11"))
    loose = prepare(tx(rows), cfg)
    strict = prepare(tx(rows), cfg, align="strict")
    amounts = lambda p: sorted({r.amount for r in p.input_rows().where("k = 3").collect()})
    assert amounts(loose) == [110.0]      # whole bucket on the side of its first date
    assert amounts(strict) == [10.0]      # only the rows before the cutoff
    tgt = {r.amount_raw for r in strict.targets().collect()}
    assert tgt == {100.0}                 # the rest lands in the target window
    assert {r.amount_raw for r in loose.targets().collect()} == set()


def test_unpersist_releases_storage(spark, tx):
    from ledgerflow.config import Cutoffs, DataConfig
    from ledgerflow.plans.prepare import prepare
    spark.catalog.clearCache()
    df = tx([(u, f"2024-01-{1 + u % 28:02d}", "AB"[u % 2], u) for u in range(60)])
    prep = prepare(df, DataConfig("7D", Cutoffs("2024-01-01", "2024-01-10", "2024-01-15", "2024-01-20")))
    assert prep.sequences().count() > 0 and prep.targets().count() >= 0
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    prep.unpersist()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() < held
    assert not prep.buckets.is_cached and not any(d.is_cached for d in prep.held)
