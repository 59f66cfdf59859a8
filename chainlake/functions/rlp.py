"""Recursive length prefixes, the hexary trie's root, and header hashes: public formats of the ledger.

Hashing runs in Arrow batches behind reads and checks, never inside a join or an aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keccak import keccak256

#: Hashes of an empty list of ommers, of an empty trie, and of no requests.
NO_OMMERS = bytes.fromhex("1dcc4de8dec75d7aab85b567b6ccd41ad312451b948a7413f0a142fd40d49347")
EMPTY_ROOT = bytes.fromhex("56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421")
NO_REQUESTS = bytes.fromhex("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")

#: The header's fields in hashing order, and which of them are numbers; the last six came one after another.
HEADER = (
    "parent_hash", "ommers_hash", "beneficiary", "state_root", "transactions_root", "receipts_root", "logs_bloom", "difficulty", "block_number", "gas_limit", "gas_used", "timestamp", "extra_data", "mix_hash", "nonce",
    "base_fee_per_gas", "withdrawals_root", "blob_gas_used", "excess_blob_gas", "parent_beacon_block_root", "requests_hash",
)
NUMBERS = frozenset(("difficulty", "block_number", "gas_limit", "gas_used", "timestamp", "base_fee_per_gas", "blob_gas_used", "excess_blob_gas"))


def number(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _sized(short: int, body: bytes) -> bytes:
    if len(body) < 56:
        return bytes([short + len(body)]) + body
    size = number(len(body))
    return bytes([short + 55 + len(size)]) + size + body


def encode(item: bytes | Sequence) -> bytes:
    """A byte string, or a list of items."""
    if isinstance(item, bytes):
        return item if len(item) == 1 and item[0] < 0x80 else _sized(0x80, item)
    return _sized(0xC0, b"".join(map(encode, item)))


def header_hash(row: dict) -> bytes:
    """The hash of a header given by column; trailing fields that are null aren't part of it."""
    fields: list[bytes] = []
    last = max((i for i, f in enumerate(HEADER) if row.get(f) is not None), default=-1)
    for f in HEADER[: max(last + 1, 15)]:
        v = row.get(f)
        if f in NUMBERS:
            fields.append(number(v if isinstance(v, int) else int.from_bytes(v or b"", "big")))
        else:
            fields.append(bytes(v or b""))
    return keccak256(encode(fields))


# -- the trie ---------------------------------------------------------------------------------


def _path(nibbles: Sequence[int], leaf: bool) -> bytes:
    odd = len(nibbles) % 2
    head = [2 * leaf + odd, *([] if odd else [0]), *nibbles]
    return bytes(16 * a + b for a, b in zip(head[::2], head[1::2], strict=True))


def _node(items: list[tuple[list[int], bytes]], depth: int) -> list:
    if len(items) == 1:
        return [_path(items[0][0][depth:], True), items[0][1]]
    low, high = items[0][0], items[-1][0]
    shared = depth
    while shared < min(len(low), len(high)) and low[shared] == high[shared]:
        shared += 1
    if shared > depth:
        return [_path(low[depth:shared], False), _reference(items, shared)]
    branch: list = [b""] * 17
    for n in range(16):
        mine = [x for x in items if len(x[0]) > depth and x[0][depth] == n]
        if mine:
            branch[n] = _reference(mine, depth + 1)
    branch[16] = next((v for k, v in items if len(k) == depth), b"")
    return branch


def _reference(items: list[tuple[list[int], bytes]], depth: int) -> bytes | list:
    node = _node(items, depth)
    coded = encode(node)
    return node if len(coded) < 32 else keccak256(coded)


def trie_root(entries: dict[bytes, bytes]) -> bytes:
    """The root over keys and (already encoded) values."""
    if not entries:
        return EMPTY_ROOT
    items = sorted(([n for b in k for n in (b >> 4, b & 15)], v) for k, v in entries.items())
    return keccak256(encode(_node(items, 0)))


def state_root(accounts: Sequence[tuple[bytes, int, int, bytes | None, dict[bytes, int]]]) -> bytes:
    """The root over (address, nonce, balance, code hash, slots); slots of value 0 aren't there."""
    top = {}
    for address, nonce, balance, code_hash, slots in accounts:
        inner = trie_root({keccak256(s): encode(number(v)) for s, v in slots.items() if v})
        top[keccak256(address)] = encode([number(nonce), number(balance), inner, code_hash or keccak256(b"")])
    return trie_root(top)


# -- headers in tables ------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for p in parts:
        rows = p.astype(object).where(p.notna(), None).to_dict("records")
        yield pd.Series([header_hash({k: int(v) if k in NUMBERS and not isinstance(v, (bytes, bytearray, type(None))) else v for k, v in r.items()}) for r in rows], dtype=object)


def with_hash(headers: DataFrame, out: str) -> DataFrame:
    """Adds the hash of each header's own fields; columns that headers lacks count as null."""
    kinds = {f: "long" if f in NUMBERS and f != "difficulty" else "binary" for f in HEADER}
    there = F.struct(*((F.col(f) if f in headers.columns else F.lit(None).cast(kinds[f])).alias(f) for f in HEADER))
    return headers.withColumn(out, _hashed(there))
