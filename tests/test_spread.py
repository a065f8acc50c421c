"""Work dealt out over more partitions than the session says, by the size of the input."""
import pytest

from helpers import D
from ledgerflow.config import TX_CONFIG
from ledgerflow.operators import joins
from ledgerflow.plans import catalog, prepare
from ledgerflow.sources import views

LINES = "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double"


@pytest.fixture
def sales(spark, tmp_path):
    """Small tables, with keys that repeat, are null or meet nothing."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("lineitem", [(i % 61 if i % 17 else None, i % 13, 10.0 + i, 0.1) for i in range(600)], LINES)
    put("orders", [(i % 60, i % 9, D("1996-03-01 00:00:00").replace(month=1 + i % 12, year=1996 + i % 5)) for i in range(70)],
        "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    put("part", [(i, f"Brand#{i % 4}") for i in range(12)], "p_partkey long, p_brand string")
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.collect()))


def test_partitions_follow_the_size(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert joins.partitions_for(spark, own * 10, 10) is None
    assert joins.partitions_for(spark, own * 10 + 1, 10) == own + 1
    assert joins.partitions_for(spark, 0, 10) is None


def test_join_is_dealt_out_by_the_files_size(spark, sales, monkeypatch):
    # the planner may not broadcast tables as small as these
    monkeypatch.setattr(views, "JOIN_BYTES", 1 << 40)
    before = rows(views.tx_view(spark, sales))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size = joins.planned_bytes(views.read_table(spark, sales, "lineitem"))
        monkeypatch.setattr(views, "JOIN_BYTES", -(-size // 37))
        n = -(-size // views.JOIN_BYTES)
        tx = views.tx_view(spark, sales)
        plan = tx._jdf.queryExecution().toString()
        assert "hashpartitioning(o_orderkey" in plan and f", {n})" in plan
        assert rows(tx) == before and len(before) > 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_sweep_and_sequences_are_dealt_out_by_rows(spark, sales, monkeypatch):
    from ledgerflow.operators.sweep import sweep_metrics, trial_table
    from ledgerflow.plans.catalog import N_TRIALS, SWEEP_SEED, SWEEP_SPACE
    trials = trial_table(spark, SWEEP_SPACE, N_TRIALS, SWEEP_SEED)
    found = []
    for share in (1 << 40, 20):
        monkeypatch.setattr(prepare, "TASK_ROWS", share)
        prep = prepare.prepare(views.tx_view(spark, sales), TX_CONFIG)
        swept, seq = sweep_metrics(prep, trials), prep.sequences()
        found.append((prep.partitions, rows(swept), rows(seq), swept._jdf.queryExecution().toString(), seq._jdf.queryExecution().toString()))
        prep.unpersist()
    (none, *small, _, _), (n, *spread, swept, seq) = found
    assert none is None and n > 8 and small == spread
    assert all(f", {n})" in plan for plan in (swept, seq))


def test_transactions_of_a_cache_are_computed_once(spark, sales, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(spark, sf):
        def run(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b
        tx = views.tx_view(spark, sf)
        return tx.mapInArrow(run, tx.schema)

    monkeypatch.setattr(catalog, "tx_view", counted)
    n = views.tx_view(spark, sales).count()
    assert catalog.q_cache_roundtrip(spark, sales).count() >= 0
    assert read.value == n
