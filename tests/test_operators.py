"""Cursors, history shards, lists, wide numbers, hashes and chain checks."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlake.errors import EmptyRange, NonContiguous, ParentMismatch, SchemaError, UnsortedInput
from chainlake.functions import intlist, u256
from chainlake.functions.keccak import EMPTY, keccak, keccak256
from chainlake.operators import cursor, history, ingest, reorg
from chainlake.schema import OPEN_SHARD, TABLES, conform
from tests.chain import addr, encode, header_row, headers, rows


def test_single_key_cursor(spark):
    df = headers(spark, [10, 20, 30])
    at = lambda d: [r["block_number"] for r in d.collect()]
    assert at(cursor.lower_bound(df, ["block_number"], [15])) == [20]
    assert at(cursor.lower_bound(df, ["block_number"], [31])) == []
    assert at(cursor.first(df, "block_number")) == [10] and at(cursor.last(df, "block_number")) == [30]
    assert at(cursor.scan_from(df, ["block_number"], [20])) == [20, 30]
    assert rows(cursor.neighbours(df, "block_number"), "block_number", "previous_key", "next_key") == [(10, None, 20), (20, 10, 30), (30, 20, None)]


def test_dual_key_cursor(spark):
    df = spark.createDataFrame([(a, k, 0) for a, ks in ((1, (1, 2, 3)), (2, (1, 2)), (3, (1,))) for k in ks], "a long, k long, v long")
    one = lambda d: [(r["a"], r["k"]) for r in d.collect()]
    assert one(cursor.next_k1(df, "a", "k", 1)) == [(2, 1)]
    assert one(cursor.next_k1(df, "a", "k", 2)) == [(3, 1)]
    assert one(cursor.next_k1(df, "a", "k", 3)) == []
    assert one(cursor.previous_k1(df, "a", "k", 3)) == [(2, 2)]
    assert one(cursor.lower_bound(df, ["a", "k"], [1, 4])) == [(2, 1)]
    assert sorted(one(cursor.last_of_k1(df, "a", "k"))) == [(1, 3), (2, 2), (3, 1)]
    assert [r["is_new_k1"] for r in cursor.items(df, "a", "k").collect()] == [True, False, False, True, False, True]
    taken, kept = cursor.take_range(df, ["a", "k"], [1, 2], [2, 1])
    assert one(taken) == [(1, 2), (1, 3), (2, 1)] and kept.count() == 3


@pytest.mark.parametrize("low, high, inclusive, left", [(5, 9, True, [*range(5), *range(10, 15)]), (5, 9, False, [*range(5), *range(9, 15)]), (100, 200, True, [*range(15)]), (8, 8, True, [x for x in range(15) if x != 8])])
def test_delete_range(spark, low, high, inclusive, left):
    got = cursor.delete_range(headers(spark, range(15)), ["block_number"], [low], [high], inclusive)
    assert sorted(r["block_number"] for r in got.collect()) == left


def test_history_shards_and_appends(spark):
    many = spark.range(4501).select(F.lit(1).alias("k"), F.col("id").alias("block_number"))
    got = {r["highest"]: len(r["blocks"]) for r in history.shards(many, ["k"]).collect()}
    assert got == {1999: 2000, 3999: 2000, OPEN_SHARD: 501}
    parts = history.append(history.shards(many.where("block_number < 1990"), ["k"]), many, ["k"], 1990, 4500)
    assert {r["highest"]: len(r["blocks"]) for r in parts.collect()} == got
    # trimming crosses shard boundaries
    cut = history.trim(parts, ["k"], 2100)
    assert {r["highest"]: (len(r["blocks"]), r["is_open"]) for r in cut.collect()} == {1999: (2000, False), OPEN_SHARD: (101, True)}
    with pytest.raises(Exception, match="must ascend"):
        history.append(parts, many, ["k"], 10, 20).collect()


def test_history_shards_across_block_buckets(spark):
    many = spark.range(0, 50_000, 7).select(F.lit(1).alias("k"), F.col("id").alias("block_number"))
    got = sorted((r["highest"], r["blocks"]) for r in history.shards(many, ["k"], cap=1000).collect())
    every = list(range(0, 50_000, 7))
    want = [every[i : i + 1000] for i in range(0, len(every), 1000)]
    assert got == [(b[-1] if b is not want[-1] else OPEN_SHARD, b) for b in want]


def test_history_by_key(spark):
    rows_ = [(1, "a1"), (2, "a1"), (2, "a2"), (3, "a2"), (4, "a1"), (5, "a1")]
    df = spark.createDataFrame(rows_, "block_number long, k string")
    first = history.append(history.shards(df.limit(0), ["k"]), df, ["k"], 1, 3)
    assert {r["k"]: r["blocks"] for r in history.append(first, df, ["k"], 4, 5).collect()} == {"a1": [1, 2, 4, 5], "a2": [2, 3]}
    assert {r["k"]: r["blocks"] for r in history.changed(df, ["k"], 2, 4).collect()} == {"a1": [2, 4], "a2": [2, 3]}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1000)))
def test_sorted_lists(values):
    if values == sorted(set(values)):
        assert intlist.new(values) == values
    else:
        with pytest.raises(UnsortedInput):
            intlist.new(values)


def test_rank_select(spark):
    df = spark.createDataFrame([([10, 20, 30],)], "l array<long>")
    got = df.select(intlist.rank("l", 20), intlist.rank("l", 5), intlist.select("l", 0), intlist.select("l", 3), intlist.is_sorted("l"), intlist.length("l"), intlist.contains("l", 30)).first()
    assert tuple(got) == (2, 0, 10, None, True, 3, True)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, u256.MAX), st.integers(0, u256.MAX))
def test_binary_order_is_numeric_order(a, b):
    assert (u256.encode(a) < u256.encode(b)) == (a < b)
    assert u256.decode(u256.encode(a)) == a


def test_wide_sums(spark):
    values = [u256.MAX - 10, 7, 2, 1 << 200, 5]
    df = spark.createDataFrame([("a", encode(v)) for v in values[:3]] + [("b", encode(v)) for v in values[3:]], "k string, v binary")
    got = {r["k"]: u256.decode(r["total"]) for r in u256.sums(df, ["k"], "v").collect()}
    assert got == {"a": u256.MAX - 1, "b": (1 << 200) + 5}
    x = spark.createDataFrame([(encode(5), encode(3))], "a binary, b binary")
    got = x.select(u256.add("a", "b"), u256.subtract("a", "b")).first()
    assert [u256.decode(v) for v in got] == [8, 2]
    d = spark.createDataFrame([(encode(v),) for v in (0, 12345678901234567890123, 10**37)], "v binary").select(u256.to_decimal("v").alias("d")).collect()
    assert [int(r["d"]) for r in d] == [0, 12345678901234567890123, 10**37]
    assert spark.range(3).select(u256.of_long("id").alias("b")).collect()[2]["b"] == encode(2)
    with pytest.raises(SchemaError):
        u256.encode(1 << 256)


def test_keccak(spark):
    assert keccak256(b"") == EMPTY
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert len({keccak256(b"a" * n) for n in range(130, 140)}) == 10
    assert [r[0] for r in spark.createDataFrame([(b"abc",), (None,)], "b binary").select(keccak("b")).collect()] == [keccak256(b"abc"), None]


def test_chain_extension(spark):
    none, base = headers(spark, []), headers(spark, [0, 1, 2])
    assert ingest.validate_extension(none, base) == (0, 2)
    assert ingest.validate_extension(base, headers(spark, [3, 4])) == (3, 4)
    with pytest.raises(EmptyRange):
        ingest.validate_extension(base, none)
    with pytest.raises(NonContiguous):
        ingest.validate_extension(base, headers(spark, [4]))
    with pytest.raises(NonContiguous):
        ingest.validate_extension(base, headers(spark, [3, 5]))
    with pytest.raises(ParentMismatch):
        ingest.validate_extension(base, headers(spark, [3], salt=5))
    bad = spark.createDataFrame([header_row(3), header_row(4, encode(77))], base.schema)
    with pytest.raises(ParentMismatch):
        ingest.validate_extension(base, bad)


def test_lag_and_gaps(spark):
    hot, cold = headers(spark, range(10)), headers(spark, [0, 1, 3, 4])
    assert reorg.lag(hot, cold).first()[0] == 5
    assert reorg.lag(hot, cold.limit(0)).first()[0] == 0
    assert reorg.lag(hot, hot).first()[0] is None
    assert reorg.lag(hot.limit(0), hot.limit(0)).first()[0] is None
    assert [r["block_number"] for r in reorg.gaps(hot, cold).collect()] == [2, 5, 6, 7, 8, 9]
    assert rows(reorg.number_gaps(cold)) == [(2, 2)]
    wide = spark.createDataFrame([(9_999,), (10_005,), (30_000,)], "block_number long")
    assert rows(reorg.number_gaps(wide)) == [(10000, 10004), (10006, 29999)]


def test_conform_rejects_bad_rows(spark):
    t = TABLES["account_state"]
    good = spark.createDataFrame([(addr(1), 0, encode(0))], "address binary, nonce long, balance binary")
    assert conform(good, t).columns == t.schema.names
    for row in ((None, 0, encode(0)), (addr(1), -1, encode(0)), (b"x", 0, encode(0))):
        with pytest.raises(Exception, match="bad key"):
            conform(spark.createDataFrame([row], good.schema), t).collect()
    with pytest.raises(SchemaError):
        conform(good.withColumn("other", F.lit(1)), t)


def test_events_in_order_in_one_window_or_many(spark):
    """A short run of blocks is ordered by one window, a long one bucket by bucket; state and changes are the same."""
    events = spark.createDataFrame([(3, "a", (7,)), (9, "a", None), (25_000, "a", (8,)), (4, "b", None), (5, "c", None), (25_001, "d", (1,))], "block_number long, k string, after struct<v: long>")
    current = spark.createDataFrame([("a", 6), ("b", 2), ("e", 5)], "k string, v long")
    for blocks in (7, 25_002):
        ordered = ingest.in_order(events, current, ["k"], ["v"], blocks)
        assert {tuple(r) for r in ingest.state_after(ordered, ["k"], ["v"]).collect()} == {("a", 8), ("d", 1), ("e", 5)}
        got = {tuple(r) for r in ingest.changes(ordered, ["k"], ["v"], {"v": F.lit(0)}).collect()}
        assert got == {(3, "a", True, 6), (9, "a", True, 7), (25_000, "a", False, 0), (4, "b", True, 2), (25_001, "d", False, 0)}
