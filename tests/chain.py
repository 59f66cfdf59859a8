"""Small chains for tests."""

from __future__ import annotations

from chainlake.functions.u256 import encode
from chainlake.schema import TABLES

A, B = b"\xaa" * 20, b"\xbb" * 20
T, P, S, O = (encode(n) for n in (1, 2, 0x10, 0x11))


def h(n: int, salt: int = 0) -> bytes:
    return encode(n * 1000 + salt + 1)


def addr(n: int) -> bytes:
    return encode(n, 20)


def header_row(n: int, parent: bytes | None = None, salt: int = 0) -> dict:
    return {"block_number": n, "block_hash": h(n, salt), "parent_hash": h(n - 1, salt) if parent is None else parent, "timestamp": 12 * n, "gas_limit": 30_000_000, "gas_used": 0}


def headers(spark, numbers, salt: int = 0):
    rows = [header_row(n, salt=salt) if n else header_row(0, encode(0)) for n in numbers]
    kinds = "block_number BIGINT, block_hash BINARY, parent_hash BINARY, timestamp BIGINT, gas_limit BIGINT, gas_used BIGINT"
    return spark.createDataFrame(rows, kinds)


_LOG = "STRUCT<address: BINARY, topic0: BINARY, topic1: BINARY, topic2: BINARY, topic3: BINARY, data: BINARY>"
BUNDLE = (
    "header STRUCT<block_number: BIGINT, block_hash: BINARY, parent_hash: BINARY, timestamp: BIGINT, gas_limit: BIGINT, gas_used: BIGINT>, "
    "transactions ARRAY<STRUCT<tx_hash: BINARY, tx_type: TINYINT, nonce: BIGINT, gas_limit: BIGINT, value: BINARY, from_address: BINARY>>, "
    f"receipts ARRAY<STRUCT<tx_type: TINYINT, success: BOOLEAN, cumulative_gas_used: BIGINT, logs: ARRAY<{_LOG}>>>, "
    "events ARRAY<STRUCT<event_type: TINYINT, order_index: BIGINT, rollup_chain_id: BINARY, value: BINARY>>, "
    "rollup_header STRUCT<host_block_number: BINARY, rollup_chain_id: BINARY, gas_limit: BINARY, reward_address: BINARY, block_data_hash: BINARY>"
)


def log(address: bytes, topics: list[bytes], n: int) -> dict:
    t = [*topics, None, None, None, None][:4]
    return {"address": address, "topic0": t[0], "topic1": t[1], "topic2": t[2], "topic3": t[3], "data": bytes([n])}


def bundle(n: int, txs: list[tuple[int, list[dict]]], parent: bytes | None = None, events: int = 0) -> dict:
    """A block of transactions given as (cumulative gas, logs)."""
    head = header_row(n, parent)
    return {
        "header": head,
        "transactions": [{"tx_hash": encode(n * 100 + i + 7), "tx_type": 2, "nonce": i, "gas_limit": 100_000, "value": encode(i), "from_address": addr(i + 1)} for i in range(len(txs))],
        "receipts": [{"tx_type": 2, "success": True, "cumulative_gas_used": g, "logs": ls} for g, ls in txs],
        "events": [{"event_type": i % 3, "order_index": i, "rollup_chain_id": encode(9), "value": encode(i)} for i in range(events)],
        "rollup_header": {"host_block_number": encode(n), "rollup_chain_id": encode(9), "gas_limit": encode(1), "reward_address": A, "block_data_hash": encode(n)} if n % 2 == 0 else None,
    }


def bundles(spark, rows: list[dict]):
    return spark.createDataFrame(rows, BUNDLE)


def rows(df, *columns: str) -> list[tuple]:
    """Rows as plain tuples, bytes for binaries, sorted."""
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return sorted((tuple(plain(v) for v in r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


assert TABLES
