"""Store, engine, genesis, configuration and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chainlake.engine import Dispatcher, Engine, StateFeed, append_state, unwind_state
from chainlake.errors import Backpressure, ConfigError, HeightOutOfRange, KeyOrder, MissingField, NotEmpty, ReadOnly, Reorganised, SchemaError, StreamDeadline, TaskTerminated, TooManyLogs, UnknownTable, WriteLocked
from chainlake.functions import rlp
from chainlake.functions.keccak import keccak256
from chainlake.functions.u256 import encode
from chainlake.operators.filters import LogFilter
from chainlake.operators.ingest import BlockBuilder
from chainlake.schema import COLD, HOT
from chainlake.schema import TABLES as COLD_SCHEMA
from chainlake.sources import genesis
from chainlake.sources.cache import LookupCache
from chainlake.sources.config import COLD_PATH, COLD_SQL, HOT_PATH, EngineConfig
from chainlake.sources.jdbc import JdbcSource
from chainlake.sources.store import Store
from chainlake.sources.tier import HistoryTier, TierView
from chainlake.streaming.logs import follow, stream_logs
from tests.chain import A, B, P, T, addr, bundle, bundles, h, header_row, headers, log, rows


def slots(spark, values):
    return spark.createDataFrame([(addr(a), encode(s), encode(v)) for a, s, v in values], "address binary, slot binary, value binary")


def test_store_versions_and_isolation(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", HOT).init().init()
    with store.writer() as w:
        w.append("headers", headers(spark, range(3)))
        w.upsert("slot_state", slots(spark, [(1, 1, 5), (2, 1, 6)]))
        assert w.read("headers").count() == 3  # its own writes
        assert store.snapshot()["headers"].count() == 0
        assert w.commit() == 1
    old = store.snapshot()
    with store.writer() as w:
        with pytest.raises(KeyOrder):
            w.append("headers", headers(spark, [2]))
        w.append("headers", headers(spark, [3, 4]))
        w.upsert("slot_state", slots(spark, [(1, 1, 50), (3, 1, 0)]))
        w.truncate("headers", 3)
        w.commit()
    assert old["headers"].count() == 3 and store.snapshot()["headers"].count() == 4
    assert rows(store.snapshot()["slot_state"]) == rows(slots(spark, [(1, 1, 50), (2, 1, 6), (3, 1, 0)]))
    assert store.snapshot(1)["slot_state"].count() == 2
    with store.writer() as w:
        w.clear("headers")  # dropped: never committed
    assert store.snapshot()["headers"].count() == 4
    with store.writer() as w:
        w.delete("slot_state", slots(spark, [(1, 1, 0)]).select("address"))
        w.commit()
    assert store.snapshot()["slot_state"].count() == 2
    assert store.vacuum(keep=1) and store.versions() == [3] and store.snapshot()["headers"].count() == 4


def test_one_writer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", HOT).init()
    w = store.writer()
    with pytest.raises(WriteLocked):
        store.writer()
    w.abort()
    with store.writer():
        pass
    (tmp_path / "s" / "LOCK").write_text(json.dumps({"host": __import__("socket").gethostname(), "pid": 2**22 + 5, "started": "1"}))
    store.writer().abort()  # the owner is gone
    with pytest.raises(ReadOnly):
        Store(spark, f"file://{tmp_path}/s", HOT, read_only=True).writer()
    with pytest.raises(UnknownTable):
        store.table("nothing")


def test_snapshot_prunes_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", HOT).init()
    with store.writer() as w:
        w.append("headers", headers(spark, range(3)))
        w.append("headers", headers(spark, range(20_000, 20_003)))
        w.commit()
    part = store.snapshot().read("headers", 20_001)
    assert part.count() == 2 and all("bucket=2" in f for f in part.inputFiles())


def test_log_filters_reach_the_scan(spark, cold):
    from chainlake.operators import reads

    df = reads.logs(cold.snapshot(), LogFilter(850, 851, address=(A, B), topics=((T,),)), 10)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "TakeOrderedAndProject" in plan
    pushed = [x for x in plan.splitlines() if x.startswith("PushedFilters") and "address" in x]
    assert pushed and all("In(address" in x and "GreaterThanOrEqual(block_number,850)" in x and "EqualTo(topic0" in x for x in pushed)


def feed(spark, accounts=(), slots=(), wiped=()):
    return StateFeed(
        spark,
        accounts=spark.createDataFrame([(b, addr(a), n, encode(v), None, d) for b, a, n, v, d in accounts], StateFeed.SCHEMAS["accounts"]),
        slots=spark.createDataFrame([(b, addr(a), encode(s), encode(v)) for b, a, s, v in slots], StateFeed.SCHEMAS["slots"]),
        wiped=spark.createDataFrame([(b, addr(a)) for b, a in wiped], StateFeed.SCHEMAS["wiped"]),
    )


def engine(spark, path):
    return Engine(spark, Store(spark, f"file://{path}/hot", HOT, state_buckets=4).init(), Store(spark, f"file://{path}/cold", COLD).init())


CHAIN = [bundle(n, [(21_000 * (k + 1), [log(A if n % 2 else B, [T], k)] * (n % 3)) for k in range(2)], encode(0) if n == 0 else None, events=n % 2) for n in range(5)]
ACCOUNTS = [(0, 1, 1, 100, False), (0, 2, 1, 50, False), (1, 1, 2, 90, False), (2, 3, 1, 10, False), (3, 1, 3, 80, False), (3, 2, 2, 40, False), (4, 4, 1, 1, False), (4, 3, 2, 0, False)]
SLOTS = [(0, 1, 1, 5), (1, 1, 1, 6), (1, 1, 2, 7), (2, 2, 1, 8), (3, 1, 1, 9), (3, 1, 3, 1), (4, 2, 1, 0), (4, 1, 2, 3)]


def upto(last, items):
    return [x for x in items if x[0] <= last]


def run(spark, path, last):
    e = engine(spark, path)
    e.append_blocks(bundles(spark, CHAIN[: last + 1]), feed(spark, upto(last, ACCOUNTS), upto(last, SLOTS)), wait=True)
    assert not e.dispatcher.failures
    return e


def test_differential_unwind(spark, tmp_path):
    whole, part = run(spark, tmp_path / "a", 4), run(spark, tmp_path / "b", 1)
    whole.unwind_above(1)
    whole.dispatcher.wait()
    for name in HOT:
        if name != "bytecodes":
            a, b = whole.reader()[name], part.reader()[name]
            assert rows(a) == rows(b.select(*a.columns)), name
    for name in COLD:
        assert rows(whole.cold_reader()[name]) == rows(part.cold_reader()[name]), name
    whole.close()
    part.close()


def test_history_views(spark, tmp_path):
    e = run(spark, tmp_path, 4)
    for height in range(5):
        want = {}
        for _, a, s, v in upto(height, SLOTS):
            want[addr(a), encode(s)] = encode(v)
        got = {(bytes(r["address"]), bytes(r["slot"])): bytes(r["value"]) for r in e.slots_at(height).collect()}
        assert {k: v for k, v in got.items() if k in want} == want
        assert all(v == encode(0) for k, v in got.items() if k not in want)  # not there yet: reads as zero
    assert e.accounts_at(0).where(F.col("address") == F.lit(bytearray(addr(1)))).first()["nonce"] == 1
    e.close()


def test_appending_in_steps_equals_at_once(spark, tmp_path):
    whole = run(spark, tmp_path / "a", 4)
    steps = run(spark, tmp_path / "b", 2)
    later = lambda items: [x for x in items if x[0] > 2]
    steps.append_blocks(bundles(spark, CHAIN[3:]), feed(spark, later(ACCOUNTS), later(SLOTS)), wait=True)
    for name in HOT:
        assert rows(whole.reader()[name]) == rows(steps.reader()[name]), name
    whole.close()
    steps.close()


def test_wipe_keeps_preimages_and_new_slots(spark, tmp_path):
    e = run(spark, tmp_path, 2)
    e.append_blocks(bundles(spark, CHAIN[3:4]), feed(spark, [(3, 1, 9, 9, False)], [(3, 1, 7, 70)], wiped=[(3, 1)]), wait=True)
    now = {(bytes(r["address"]), bytes(r["slot"])): bytes(r["value"]) for r in e.reader()["slot_state"].collect()}
    assert now == {(addr(1), encode(7)): encode(70), (addr(2), encode(1)): encode(8)}
    before = {bytes(r["slot"]): bytes(r["value"]) for r in e.slots_at(2).where(F.col("address") == F.lit(bytearray(addr(1)))).collect()}
    assert before == {encode(1): encode(6), encode(2): encode(7), encode(7): encode(0)}
    e.unwind_above(2)
    e.dispatcher.wait()
    back = {(bytes(r["address"]), bytes(r["slot"])): bytes(r["value"]) for r in e.reader()["slot_state"].collect()}
    assert back == {(addr(1), encode(1)): encode(6), (addr(1), encode(2)): encode(7), (addr(2), encode(1)): encode(8)}
    e.close()


def test_drain(spark, tmp_path):
    e = run(spark, tmp_path, 4)
    got = e.drain_above(2).collect()
    assert [(r["block_number"], len(r["receipts"])) for r in got] == [(3, 2), (4, 2)]
    assert e.reader()["headers"].count() == 3 and e.cold_reader()["headers"].count() == 3
    assert e.drain_above(2).count() == 0
    e.close()


def test_drain_when_history_lags(spark, tmp_path):
    e = run(spark, tmp_path, 1)
    with e.hot.writer() as w:
        w.append("headers", headers(spark, [2, 3]))
        w.commit()
    assert e.cold_lag() == 2
    assert [r["block_number"] for r in e.find_gaps().collect()] == [2, 3]
    assert [(r["block_number"], len(r["receipts"])) for r in e.drain_above(0).collect()] == [(1, 2), (2, 0), (3, 0)]
    e.close()


def test_views_and_plain_commits(spark, tmp_path):
    e = run(spark, tmp_path, 2)
    new = slots(spark, [(1, 1, 77), (9, 9, 1)])
    e.commit_state(spark.createDataFrame([(addr(9), 4, encode(4))], "address binary, nonce long, balance binary"), new)
    v = e.view()
    asked = slots(spark, [(1, 1, 0), (9, 9, 0), (9, 8, 0)]).drop("value")
    assert {bytes(r["address"])[-1] * 10 + bytes(r["slot"])[-1]: int.from_bytes(r["value"], "big") for r in v.values(asked).collect()} == {11: 77, 99: 1, 98: 0}
    assert v.with_code().where(F.length("code") == 0).count() == v.accounts.count() == 4
    hashes = {r["block_number"]: bytes(r["block_hash"]) for r in v.block_hashes(spark.createDataFrame([(1,), (50,)], "block_number long")).collect()}
    assert hashes[50] == encode(0) and hashes[1] != encode(0)
    assert e.reader()["slot_changes"].count() == 4
    with pytest.raises(HeightOutOfRange):
        e.view(50)
    e.close()


def test_block_builder():
    with pytest.raises(MissingField):
        BlockBuilder().header(block_number=1).build()
    with pytest.raises(MissingField):
        BlockBuilder().body([], []).build()
    with pytest.raises(MissingField):
        BlockBuilder().header(block_number=1).body([{}], []).build()
    made = BlockBuilder().header(block_number=1).body([], []).rollup_header(block_data_hash=b"").build()
    assert made["events"] == [] and made["rollup_header"] == {"block_data_hash": b""}


def test_replay(spark, tmp_path):
    e = run(spark, tmp_path, 1)
    with e.hot.writer() as w:
        w.append("headers", headers(spark, [2]))
        w.commit()
    e.replay_to_cold(bundles(spark, CHAIN[2:3]))
    assert e.cold_lag() is None
    e.close()


def test_empty_append(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.append_blocks(bundles(spark, []), StateFeed(spark))
    assert e.cold_lag() is None and e.hot.versions() == [0]
    e.close()


def test_genesis(spark, tmp_path):
    doc = {"number": "0x0", "timestamp": "0x10", "gasLimit": "0x1", "alloc": {"0x" + "11" * 20: {"nonce": "0x1", "balance": "0xff", "code": "0x6001", "slots": {"0x01": "0x0a"}}, "22" * 20: {"balance": "7", "code": "0x6001"}}}
    path = tmp_path / "genesis.json"
    path.write_text(json.dumps(doc, indent=1))
    e = engine(spark, tmp_path)
    e.load_genesis(genesis.read(spark, f"file://{path}"), headers(spark, [0]))
    s = e.reader()
    code = keccak256(bytes.fromhex("6001"))
    assert set(rows(s["account_state"])) == {(b"\x11" * 20, 1, encode(255), code), (b"\x22" * 20, 0, encode(7), code)}
    assert rows(s["bytecodes"]) == [(code, bytes.fromhex("6001"))]
    assert rows(s["slot_state"]) == [(b"\x11" * 20, encode(1), encode(10))]
    assert s["account_changes"].count() == 0 and s["account_history"].count() == 2
    with pytest.raises(NotEmpty):
        e.load_genesis(genesis.read(spark, f"file://{path}"), headers(spark, [0]))
    e.close()


def test_config():
    for env in ({}, {HOT_PATH: "h"}, {HOT_PATH: "h", COLD_PATH: "c", COLD_SQL: "u"}):
        with pytest.raises(ConfigError):
            EngineConfig.from_env(env)
    assert EngineConfig.from_env({HOT_PATH: "h", COLD_PATH: "c"}) == EngineConfig("h", "c")
    assert EngineConfig.from_env({HOT_PATH: "h", COLD_SQL: "jdbc:x"}).cold_sql_url == "jdbc:x"


def test_jdbc_options(spark):
    src = JdbcSource(spark, "jdbc:x", {"user": "u"}, partitions=4, first=0, last=100)
    got = src.reader_options("logs")
    assert got["dbtable"] == "logs" and got["partitionColumn"] == "block_number" and got["user"] == "u"
    with pytest.raises(UnknownTable):
        src.reader_options("nothing")


def test_dispatcher():
    import threading

    d, gate = Dispatcher(size=1), threading.Event()
    started = threading.Event()
    d.send(lambda: (started.set(), gate.wait()))
    started.wait()
    d.send(lambda: None)
    with pytest.raises(Backpressure):
        d.send(lambda: None)
    gate.set()
    d.wait()
    d.stop()
    with pytest.raises(TaskTerminated):
        d.send(lambda: None)


@pytest.fixture(scope="module")
def cold(spark, tmp_path_factory):
    e = engine(spark, tmp_path_factory.mktemp("stream"))
    blocks = [bundle(850, [(21_000, [log(A, [T], 1), log(B, [P], 2)]), (42_000, [log(A, [T], 3)])]), bundle(851, [(21_000, [log(B, [T], 4)])])]
    e.write_history(bundles(spark, blocks))
    yield e.cold
    e.close()


@pytest.mark.parametrize("f", [LogFilter(), LogFilter(850, 850), LogFilter(address=(A,)), LogFilter(topics=((T,),)), LogFilter(900, 901), LogFilter(850, 851, address=(B,), topics=((P, T),))])
def test_stream_equals_query(cold, f):
    from chainlake.operators import reads

    want = [tuple(r) for r in reads.get_logs(cold.snapshot(), f, 100).collect()]
    assert [tuple(r) for r in stream_logs(cold, f, 100, span=1)] == want


def test_stream_limits(cold, spark, tmp_path):
    sent = []
    with pytest.raises(TooManyLogs) as e:
        for r in stream_logs(cold, LogFilter(), 3, span=1):
            sent.append(r)
    assert e.value.limit == 3 and len(sent) == 3  # also at a block boundary
    with pytest.raises(StreamDeadline):
        list(stream_logs(cold, LogFilter(), 100, deadline=-1))
    assert list(stream_logs(Store(spark, f"file://{tmp_path}/e", COLD).init(), LogFilter(), 5)) == []


def test_stream_notices_reorganisation(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.write_history(bundles(spark, [bundle(n, [(21_000, [log(A, [T], n)])]) for n in (1, 2)]))
    pinned = e.cold.snapshot()
    s = stream_logs(e.cold, LogFilter(), 10, span=1)
    next(s)
    e.truncate_history(1)
    with pytest.raises(Reorganised):
        list(s)
    assert len(list(stream_logs(e.cold, LogFilter(), 10, pinned=pinned))) == 2
    e.close()


def spans(spark, path, n):
    e = engine(spark, path)
    e.write_history(bundles(spark, [bundle(k, [(21_000, [log(A, [T], k)]), (42_000, [log(B, [P], k), log(A, [P], k)])], None if k else encode(0)) for k in range(n)]))
    return e


def test_follow(spark, cold, tmp_path):
    got = []
    q = follow(spark, cold, LogFilter(from_block=850, address=(A,)), 851, lambda df, n: got.extend(df.collect()), f"file://{tmp_path}/ck", per_batch=1)
    q.awaitTermination(60)
    assert [r["block_log_index"] for r in got] == [0, 2]


def test_follow_many_spans_killed_and_restarted(spark, tmp_path):
    e = spans(spark, tmp_path, 21)
    got, calls = {}, []

    def sink(df, n):
        calls.append(n)
        if n == 4 and calls.count(4) == 1:
            raise RuntimeError("the sink is killed")
        got[n] = [(r["block_number"], r["block_log_index"]) for r in df.collect()]

    f, ck = LogFilter(address=(A,)), f"file://{tmp_path}/ck"
    q = follow(spark, e.cold, f, 18, sink, ck, per_batch=2)
    with pytest.raises(Exception, match="the sink is killed"):
        q.awaitTermination(120)
    assert sorted(got) == [0, 1, 2, 3]
    for last in (18, 18, 20):  # restarted, restarted with nothing left, and carried on to a later end
        follow(spark, e.cold, f, last, sink, ck, per_batch=2).awaitTermination(120)
        want = [(k, i) for k in range(last + 1) for i in (0, 2)]
        assert [x for n in sorted(got) for x in got[n]] == want
    assert len(got) == 11 and len(calls) == 12  # one span a batch, and one of them twice
    e.close()


# -- appends with wipes, deletions and re-creations, against a plain replay ------------------------


def random_chain(seed, blocks=7):
    """Accounts, slots and wipes of blocks 0..blocks-1; in a block a wipe comes before the writes."""
    import random

    r = random.Random(seed)
    accounts, slots, wiped = [], [], []
    for b in range(blocks):
        for a in (1, 2, 3):
            if r.random() < 0.6:
                gone = r.random() < 0.35
                accounts.append((b, a, b + 1, 10 * b + a, gone))
            if r.random() < 0.3:
                wiped.append((b, a))
            for s in (1, 2, 3):
                if r.random() < 0.4:
                    slots.append((b, a, s, r.choice([0, 100 * b + s])))
    return accounts, slots, wiped


def replayed(accounts, slots, wiped, upto):
    """(accounts, slots) after block upto: {address: (nonce, balance)}, {(address, slot): value}."""
    have, held = {}, {}
    for b in range(upto + 1):
        for x, a, n, v, gone in accounts:
            if x == b:
                have.pop(addr(a), None) if gone else have.update({addr(a): (n, encode(v))})
        for x, a in wiped:
            if x == b:
                held = {k: v for k, v in held.items() if k[0] != addr(a)}
        held |= {(addr(a), encode(s)): encode(v) for x, a, s, v in slots if x == b}
    return have, held


def preimages_of(accounts, slots, wiped, blocks):
    """Every change row by replay: the state before each block of what the block changes."""
    out_a, out_s = set(), set()
    for b in range(blocks):
        have, held = replayed(accounts, slots, wiped, b - 1)
        for x, a, _, _, gone in accounts:
            if x == b and not (gone and addr(a) not in have):
                out_a.add((b, addr(a), addr(a) in have, *have.get(addr(a), (0, encode(0)))))
        touched = {(addr(a), encode(s)) for x, a, s, _ in slots if x == b} | {k for k in held if any(x == b and k[0] == addr(a) for x, a in wiped)}
        out_s |= {(b, *k, k in held, held.get(k, encode(0))) for k in touched}
    return out_a, out_s


@pytest.mark.parametrize(("seed", "steps"), [(1, (7,)), (1, (1, 1, 1, 1, 3)), (2, (3, 4))])
def test_appends_against_replay(spark, tmp_path, seed, steps):
    accounts, slots_, wiped = random_chain(seed)
    e, at = engine(spark, tmp_path), 0
    for n in steps:
        part = [[x for x in items if at <= x[0] < at + n] for items in (accounts, slots_, wiped)]
        with e.hot.writer() as w:
            append_state(w, headers(spark, range(at, at + n)), feed(spark, *part))
            w.commit()
        at += n
    s = e.reader()
    want_a, want_s = preimages_of(accounts, slots_, wiped, 7)
    assert set(rows(s["account_changes"], "block_number", "address", "existed", "pre_nonce", "pre_balance")) == want_a
    assert set(rows(s["slot_changes"], "block_number", "address", "slot", "existed", "pre_value")) == want_s
    index = {(a, k): tuple(sorted(b for b, a2, k2, *_ in want_s if (a2, k2) == (a, k))) for _, a, k, *_ in want_s}
    assert {(a, k): tuple(b) for a, k, b in rows(s["slot_history"], "address", "slot", "blocks")} == index
    for height in (0, 3, 5, 6):
        have, held = replayed(accounts, slots_, wiped, height)
        got = {(a, k): v for a, k, v in rows(e.slots_at(height), "address", "slot", "value")}
        assert {k: v for k, v in got.items() if v != encode(0)} == {k: v for k, v in held.items() if v != encode(0)}
        got = {a: (n, v) for a, n, v in rows(e.accounts_at(height), "address", "nonce", "balance")}
        assert {k: v for k, v in got.items() if v != (0, encode(0))} == have
    with e.hot.writer() as w:
        unwind_state(w, 3)
        w.commit()
    have, held = replayed(accounts, slots_, wiped, 3)
    s = e.reader()
    assert {a: (n, v) for a, n, v in rows(s["account_state"], "address", "nonce", "balance")} == have
    got = {(a, k): v for a, k, v in rows(s["slot_state"], "address", "slot", "value")}
    assert {k: v for k, v in got.items() if v != encode(0)} == {k: v for k, v in held.items() if v != encode(0)}
    assert {x[0] for x in rows(s["slot_changes"], "block_number")} <= {0, 1, 2, 3}
    e.close()


def test_an_append_rewrites_only_its_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", HOT, state_buckets=32).init()
    assert Store(spark, f"file://{tmp_path}/s", HOT).state_buckets == 32
    with store.writer() as w:
        append_state(w, headers(spark, [0]), feed(spark, [(0, a, 1, a, False) for a in range(200)], [(0, a, 1, a) for a in range(200)]))
        w.commit()
    before = {n: {p["path"] for p in store.snapshot().manifest[n]} for n in ("account_state", "slot_state", "account_history", "slot_history")}
    with store.writer() as w:
        append_state(w, headers(spark, [1]), feed(spark, [(1, 5, 2, 7, False)], [(1, 5, 1, 9)]))
        w.commit()
    for n, old in before.items():
        now = {p["path"] for p in store.snapshot().manifest[n]}
        assert len(old) > 20 and len(old - now) == len(now - old) == 1, n
    assert not [x for x in store.files.names() if x.startswith("stage-")]
    assert store.snapshot()["slot_state"].count() == 200 and store.snapshot()["headers"].count() == 2


def test_truncation_deals_nothing_anew(spark, tmp_path, monkeypatch):
    """Rows of the store's own files lie by blocks already; what is kept of a file is written where it is read."""
    store = Store(spark, f"file://{tmp_path}/s", COLD).init()
    with store.writer() as w:
        w.append("headers", headers(spark, range(30)))
        w.commit()

    def refuse(*_):
        raise AssertionError("shuffled")

    monkeypatch.setattr(type(store.snapshot()["headers"]), "repartitionByRange", refuse)
    with store.writer() as w:
        w.truncate("headers", 11)
        w.commit()
    s = store.snapshot()
    assert sorted(r[0] for r in rows(s["headers"], "block_number")) == list(range(12)) and s.manifest["headers"][0]["last"] == 11


# -- a database as the history tier --------------------------------------------------------------


@pytest.fixture(params=["store", "database"])
def tiers(request, spark, tmp_path):
    """An engine over either history tier; the database is an embedded one."""
    hot = Store(spark, f"file://{tmp_path}/hot", HOT, state_buckets=4).init()
    if request.param == "store":
        cold = Store(spark, f"file://{tmp_path}/cold", COLD).init()
    else:
        cold = JdbcSource(spark, f"jdbc:derby:memory:{tmp_path.name}{id(tmp_path)};create=true").init()
    assert isinstance(cold, HistoryTier) and isinstance(cold.snapshot(), TierView)
    e = Engine(spark, hot, cold)
    yield e
    e.close()


def test_either_tier(spark, tiers):
    e = tiers
    e.append_blocks(bundles(spark, CHAIN[:4]), feed(spark, upto(3, ACCOUNTS), upto(3, SLOTS)), wait=True)
    assert not e.dispatcher.failures and e.cold_lag() is None and e.find_gaps().count() == 0
    t = e.cold_reader()
    assert t.read("headers", 1, 2).count() == 2 and t["transactions"].count() == 8 and t["bridge_events"].count() == 2
    assert t["transactions"].schema == COLD_SCHEMA["transactions"].schema
    found = e.get_logs(LogFilter(1, 3, address=(A,), topics=((T,),)), 10).collect()
    assert [(r["block_number"], r["block_log_index"]) for r in found] == [(1, 0), (1, 1)]
    assert [tuple(r) for r in e.stream_logs(LogFilter(1, 3, address=(A,)), 10, span=1)] == [tuple(r) for r in found]
    with pytest.raises(TooManyLogs):
        e.get_logs(LogFilter(0, 3), 2)
    at = e.header(2)
    assert bytes(at["block_hash"]) == h(2) and e.header(2) is at and e.header(77) is None
    assert e.receipt(2, 1)["gas_used"] == 21_000 and len(e.receipt(2, 1)["logs"]) == 2
    assert bytes(e.transaction(3, 0)["block_hash"]) == h(3)
    from chainlake.operators import reads

    assert [r["tx_index"] for r in reads.transactions(t, block_hash=h(2), tx_index=1).collect()] == [1]
    assert reads.receipts(t, tx_hash=encode(208)).first()["block_number"] == 2 and reads.receipts(t, tx_hash=encode(9)).count() == 0
    got = e.drain_above(1).collect()
    assert [(r["block_number"], len(r["receipts"])) for r in got] == [(2, 2), (3, 2)]
    assert e.cold_lag() is None and e.cold_reader()["logs"].where("block_number > 1").count() == 0 and e.header(2) is None
    e.append_blocks(bundles(spark, CHAIN[2:4]), feed(spark), wait=True)
    assert not e.dispatcher.failures and e.header(3) is not None
    with pytest.raises(KeyOrder):
        e.write_history(bundles(spark, CHAIN[3:4]))
    assert e.cold_reader()["receipts"].count() == 8


def test_nested_columns_in_a_database(spark):
    src = JdbcSource(spark, "jdbc:derby:memory:nested;create=true").init().init()
    t = src.table("transactions")
    row = {"block_number": 1, "tx_index": 0, "tx_hash": encode(5), "access_list": [{"address": A, "slot_keys": [encode(1), encode(2)]}], "blob_versioned_hashes": [encode(3)], "tx_type": 2}
    df = spark.createDataFrame([{f.name: row.get(f.name) for f in t.schema}], t.schema)
    with src.writer() as w:
        w.append("transactions", df)
        assert src["transactions"].count() == 0
        w.commit()
    assert src["transactions"].collect() == df.collect()
    with src.writer() as w:
        w.truncate("transactions", 0)
    assert src["transactions"].count() == 1  # never committed


def test_at_most_eight_streams(spark, cold):
    e = Engine(spark, Store(spark, cold.path + "-hot", HOT).init(), cold)
    running = [e.stream_logs(LogFilter(), 100) for _ in range(8)]
    for s in running:
        next(s)
    with pytest.raises(Backpressure):
        next(e.stream_logs(LogFilter(), 100, deadline=0.1))
    running[0].close()
    assert len(list(e.stream_logs(LogFilter(), 100))) == 4
    for s in running:
        s.close()
    assert e.into_hot() is e.hot
    with pytest.raises(TaskTerminated):
        e.dispatcher.send(lambda: None)


def test_cancelled_dispatcher():
    import threading

    cancel = threading.Event()
    d = Dispatcher(cancel=cancel)
    cancel.set()
    with pytest.raises(TaskTerminated):
        d.send(lambda: None)
    d.stop()


def test_lookups_are_remembered():
    c, loads = LookupCache(2), []
    load = lambda k: lambda: loads.append(k) or k
    for k in (1, 2, 1, 3, 1, 2):
        assert c.get("header", (k,), load(k)) == k
    assert loads == [1, 2, 3, 2]
    c.drop_above(1)
    c.get("header", (2,), load(2))
    c.get("header", (1,), load(1))
    assert loads == [1, 2, 3, 2, 2]


# -- hashes and the genesis block ------------------------------------------------------------------


def test_public_hashes():
    """Published values: the first block of the public main network, and a trie of four words."""
    first = {"parent_hash": bytes(32), "ommers_hash": rlp.NO_OMMERS, "beneficiary": bytes(20), "state_root": bytes.fromhex("d7f8974fb5ac78d9ac099b9ad5018bedc2ce0a72dad1827a1709da30580f0544"), "transactions_root": rlp.EMPTY_ROOT, "receipts_root": rlp.EMPTY_ROOT, "logs_bloom": bytes(256), "difficulty": encode(0x400000000), "block_number": 0, "gas_limit": 5000, "gas_used": 0, "timestamp": 0, "extra_data": bytes.fromhex("11bbe8db4e347b4e8c937c1c8370e4b5ed33adb3db69cbdb7a38e1e50b1b82fa"), "mix_hash": bytes(32), "nonce": bytes.fromhex("0000000000000042")}
    assert rlp.header_hash(first).hex() == "d4e56740f876aef8c010b86a40d5f56745a118d0906a34e69aec8c0db1cb8fa3"
    assert rlp.trie_root({b"do": b"verb", b"dog": b"puppy", b"doge": b"coin", b"horse": b"stallion"}).hex() == "5991bb8c6514148a29db676a14ac506cd2cd5775ace63c30a4fe457715e9ac84"
    assert rlp.trie_root({}) == rlp.EMPTY_ROOT == keccak256(rlp.encode(b"")) and rlp.NO_OMMERS == keccak256(rlp.encode([]))


def test_genesis_header_and_large_balances(spark, tmp_path):
    doc = {"timestamp": "0x5", "gasLimit": "30000000", "extraData": "0x", "difficulty": "0x20000", "alloc": {"0x" + "11" * 20: {"balance": "1000000000000000000000"}, "22" * 20: {"balance": str(2**255 + 7), "nonce": "9007199254740993"}}}
    path = tmp_path / "genesis.json"
    path.write_text(json.dumps(doc))
    read = genesis.read(spark, f"file://{path}")
    e = engine(spark, tmp_path)
    e.load_genesis(read, forks=("cancun",))
    s = e.reader()
    assert rows(s["account_state"].orderBy("address"), "address", "nonce", "balance")[::-1] == [(b"\x11" * 20, 0, encode(10**21)), (b"\x22" * 20, 9007199254740993, encode(2**255 + 7))]
    head = s["headers"].first().asDict()
    assert head["base_fee_per_gas"] == 10**9 and head["blob_gas_used"] == 0 and head["requests_hash"] is None and head["difficulty"] == encode(0x20000)
    assert bytes(head["block_hash"]) == rlp.header_hash(head)
    assert bytes(head["state_root"]) == rlp.state_root([(b"\x11" * 20, 0, 10**21, None, {}), (b"\x22" * 20, 9007199254740993, 2**255 + 7, None, {})])
    assert genesis.header(read).first()["base_fee_per_gas"] is None
    with pytest.raises(Exception, match="fit"):
        genesis.tables(spark.createDataFrame([({"11": {"balance": str(2**256)}},)], "alloc map<string,map<string,string>>"))["account_state"].collect()
    with pytest.raises(SchemaError):
        genesis.header(read, ("mars",))
    e.close()


def test_header_hashes_are_verified(spark, tmp_path):
    true = header_row(0, encode(0)) | {"block_hash": rlp.header_hash(header_row(0, encode(0)))}
    e = engine(spark, tmp_path)
    e.verify_hashes = True
    with pytest.raises(Exception, match="isn't that of its header"):
        e.write_history(bundles(spark, CHAIN[:1]))
    e.write_history(bundles(spark, [{**CHAIN[0], "header": true}]))
    assert e.cold_reader()["headers"].count() == 1
    e.close()
