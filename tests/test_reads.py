"""Receipts, log filters, lookups, and as-of reads on the literal fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chainlake.errors import HeightOutOfRange, NoBlocks, TooManyLogs
from chainlake.functions.u256 import encode
from chainlake.operators import asof, ingest, reads
from chainlake.operators.filters import LogFilter
from tests.chain import A, B, O, P, S, T, addr, bundle, bundles, h, headers, log, rows


@pytest.fixture(scope="module")
def chain(spark):
    blocks = [
        bundle(700, [(21_000, [log(A, [T], 0)] * 2), (42_000, [log(A, [T], 0)] * 3), (63_000, [log(A, [T], 0)])]),
        bundle(800, [(21_000, [log(A, [T, S], 1), log(B, [P], 2)]), (42_000, [log(A, [T, O], 3)])], events=2),
        bundle(801, [(21_000, [log(B, [T], 4)])], events=1),
        bundle(802, []),
    ]
    made = ingest.explode_blocks(bundles(spark, blocks))
    return {n: df.persist() for n, df in made.items()}


def test_receipt_derivation(chain):
    got = rows(chain["receipts"].where("block_number = 700"), "tx_index", "gas_used", "first_log_index")
    assert got == [(0, 21_000, 0), (1, 21_000, 2), (2, 21_000, 5)]


FILTERS = [
    (LogFilter(900, 999), 0), (LogFilter(800, 801), 4), (LogFilter(800, 800), 3), (LogFilter(800, 801, address=(A,)), 2), (LogFilter(800, 801, address=(A, B)), 4),
    (LogFilter(800, 801, topics=((T,),)), 3), (LogFilter(800, 801, topics=((T, P),)), 4), (LogFilter(800, 801, topics=((T,), (S,))), 1), (LogFilter(800, 801, topics=((), (S,))), 1), (LogFilter(800, 801, address=(A,), topics=((T,),)), 2),
]


@pytest.mark.parametrize("f, n", FILTERS)
def test_log_filter_matrix(chain, f, n):
    assert reads.get_logs(chain, f, 100).count() == n


def test_logs_are_ordered_with_block_wide_index(chain):
    got = reads.get_logs(chain, LogFilter(800, 801), 4).collect()
    assert [r["block_log_index"] for r in got] == [0, 1, 2, 0]
    assert [r["tx_index"] for r in got] == [0, 0, 1, 0]
    assert [r["timestamp"] for r in got] == [9600, 9600, 9600, 9612]


def test_log_limit_is_all_or_nothing(chain):
    with pytest.raises(TooManyLogs) as e:
        reads.get_logs(chain, LogFilter(800, 801), 2)
    assert e.value.limit == 2
    assert reads.get_logs(chain, LogFilter(800, 801), 4).count() == 4


def test_a_limit_is_checked_by_counts(chain, monkeypatch):
    """No task gathers the rows of a limit, none are kept, and only too many logs make joined rows be counted."""
    joined = []
    monkeypatch.setattr(reads, "logs", lambda t, f, *a, f0=reads.logs, **b: joined.append(b) or f0(t, f, *a, **b))
    found = reads.get_logs(chain, LogFilter(800, 801), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and found.storageLevel.useMemory is False
    assert found.count() == 4 and joined == [{"ordered": True, "few": True}]
    lonely = {**chain, "headers": chain["headers"].where("block_number <> 801")}  # a log of an unknown block isn't a result
    assert reads.get_logs(lonely, LogFilter(800, 801), 3).count() == 3
    with pytest.raises(TooManyLogs):
        reads.get_logs(lonely, LogFilter(800, 801), 2)


def test_few_logs_are_sent_to_their_transactions(spark, chain):
    """Transactions and receipts aren't shuffled for a handful of logs, whatever the planner guesses."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reads.get_logs(chain, LogFilter(800, 801), 4)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and found.count() == 4


def test_logs_by_block_hash_and_open_end(chain):
    assert reads.get_logs(chain, LogFilter(at_hash=h(801)), 10).count() == 1
    assert reads.get_logs(chain, LogFilter(from_block=800), 10).count() == 4


def test_point_lookups(chain):
    assert reads.by_key(chain["headers"], block_hash=h(800)).first()["block_number"] == 800
    assert reads.transactions(chain, tx_hash=encode(800 * 100 + 8)).first()["block_hash"] == h(800)
    assert reads.transactions(chain, block_hash=h(800), tx_index=1).count() == 1
    assert reads.transactions(chain, tx_hash=encode(0)).count() == 0
    assert reads.transaction_count(chain, 801).first()[0] == 1
    assert reads.transaction_count(chain, 5).first()[0] == 0
    assert rows(reads.tip(chain["headers"])) == [(802, h(802))]
    r = reads.receipts_in_block(chain, 800).collect()
    assert [len(x["logs"]) for x in r] == [2, 1] and r[1]["logs"][0]["log_index"] == 2
    assert reads.receipts_in_block(chain, 802).count() == 0
    assert reads.events_in_range(chain, 800, 801).count() == 3
    assert reads.rollup_headers(chain, 800, 802).count() == 2


def test_specs_keep_order_and_gaps(spark, chain):
    specs = spark.createDataFrame([(0, 801), (1, 5), (2, 700), (3, 801)], "pos int, block_number long")
    got = reads.by_specs(chain["headers"], specs, ["block_number"]).collect()
    assert [(r["pos"], r["block_number"]) for r in got] == [(0, 801), (1, None), (2, 700), (3, 801)]


def test_unequal_transactions_and_receipts_raise(spark):
    bad = bundle(1, [(21_000, [])])
    bad["transactions"] = []
    with pytest.raises(Exception, match="differ in number"):
        ingest.explode_blocks(bundles(spark, [bad]))["receipts"].collect()


def test_decreasing_gas_raises(spark):
    with pytest.raises(Exception, match="decreases"):
        ingest.explode_blocks(bundles(spark, [bundle(1, [(42_000, []), (21_000, [])])]))["receipts"].collect()


@pytest.fixture(scope="module")
def history(spark):
    who, slot = addr(1), encode(0x42)
    account = spark.createDataFrame([(who, 10, encode(1000))], "address binary, nonce long, balance binary")
    changes = spark.createDataFrame([(5, who, 1, encode(100)), (10, who, 5, encode(500))], "block_number long, address binary, pre_nonce long, pre_balance binary")
    slots = spark.createDataFrame([(who, slot, encode(200))], "address binary, slot binary, value binary")
    slot_changes = spark.createDataFrame([(5, who, slot, encode(0)), (10, who, slot, encode(100))], "block_number long, address binary, slot binary, pre_value binary")
    return account, changes, slots, slot_changes


CASES = [(3, 1, 0), (5, 5, 100), (7, 5, 100), (10, 10, 200), (15, 10, 200), (None, 10, 200)]


@pytest.mark.parametrize("height, nonce, value", CASES)
def test_state_at_height(history, height, nonce, value):
    account, changes, slots, slot_changes = history
    assert asof.state_at(account, changes, ["address"], ["nonce", "balance"], height).first()["nonce"] == nonce
    assert asof.state_at(slots, slot_changes, ["address", "slot"], ["value"], height).first()["value"] == encode(value)


def test_batch_state_at(spark, history):
    _, _, slots, slot_changes = history
    asked = spark.createDataFrame([(addr(1), encode(0x42), x) for x, _, _ in CASES if x] + [(addr(9), encode(1), 5)], "address binary, slot binary, height long")
    got = {(bytes(r["address"]), r["height"]): r["value"] for r in asof.batch_state_at(asked, slots, slot_changes, ["address", "slot"], ["value"]).collect()}
    assert got == {(addr(1), x): encode(v) for x, _, v in CASES if x} | {(addr(9), 5): None}


def test_batches_across_block_buckets(spark):
    """A key that changes in every third block over several buckets, asked at many heights."""
    blocks = list(range(0, 45_000, 3_001))
    changes = spark.createDataFrame([(b, 1, i) for i, b in enumerate(blocks)], "block_number long, k long, pre_v long")
    current = spark.createDataFrame([(1, len(blocks))], "k long, v long")
    heights = [0, 1, 2_999, 3_000, 3_001, 9_999, 10_000, 19_999, 20_000, 41_999, 42_013, 42_014, 60_000]
    asked = spark.createDataFrame([(1, x) for x in heights], "k long, height long")
    got = {r["height"]: r["v"] for r in asof.batch_state_at(asked, current, changes, ["k"], ["v"]).collect()}
    assert got == {x: sum(b <= x for b in blocks) for x in heights}
    spans = sorted((-1 if r["valid_from"] is None else r["valid_from"], r["valid_to"], r["v"]) for r in asof.intervals(current, changes, ["k"], ["v"]).collect())
    assert [(a, b) for a, b, _ in spans] == list(zip([-1, *blocks], [*blocks, None], strict=True))


def test_height_check(spark):
    hs = headers(spark, [1, 15])
    reads.check_height(hs, 15)
    reads.check_height(hs, None)
    for bad in (0, 20):
        with pytest.raises(HeightOutOfRange) as e:
            reads.check_height(hs, bad)
        assert (e.value.first, e.value.last) == (1, 15)
    with pytest.raises(NoBlocks):
        reads.check_height(hs.where(F.lit(False)), 5)
