"""The genesis document: its allocation as state tables, and its header."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions import rlp
from ..functions.keccak import keccak, keccak256
from ..schema import TABLES

_TOP = "number timestamp gasLimit gasUsed nonce extraData difficulty mixHash coinbase parentHash baseFeePerGas blobGasUsed excessBlobGas"
#: Hard forks that add fields to the header, in order.
FORKS = ("london", "shanghai", "cancun", "prague")
FIRST_BASE_FEE = 1_000_000_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row of a genesis JSON file: its header's fields as text, and alloc.

    An account's fields are kept as text by name; the one that is an object itself holds the slots.
    """
    fields = ", ".join(f"{c} STRING" for c in _TOP.split())
    return spark.read.schema(f"{fields}, alloc MAP<STRING, MAP<STRING, STRING>>").json(path, multiLine=True)


def _bytes(text: str | None, size: int) -> bytes | None:
    """A number or address written 0x... or in decimal, as size big-endian bytes."""
    if text is None:
        return None
    t = text.strip().lower()
    n = int(t[2:] or "0", 16) if t.startswith("0x") else int(t or "0")
    if n >> (8 * size) or n < 0:
        raise SchemaError(f"{text} doesn't fit {size} bytes")
    return n.to_bytes(size, "big")


def hexed(c: Column, size: int) -> Column:
    """A number written 0x... or in decimal, of any length that fits, as big-endian bytes; null is 0."""

    @F.pandas_udf(T.BinaryType())
    def go(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([_bytes("0" if v is None else v, size) for v in p], dtype=object)

    return go(c)


def number(c: Column) -> Column:
    """The same as a 64-bit number; what doesn't fit raises."""
    return F.conv(F.hex(hexed(c, 8)), 16, 10).cast("long")


def _parts(genesis: DataFrame) -> DataFrame:
    """(address, nonce, balance, code, slots) of the allocation."""
    alloc = genesis.select(F.explode("alloc").alias("k", "a"))
    address = F.unhex(F.lpad(F.regexp_replace(F.lower("k"), "^0x", ""), 40, "0"))
    inner = F.element_at(F.map_values(F.map_filter("a", lambda _, v: F.ltrim(v).startswith("{"))), 1)
    code = F.regexp_replace(F.col("a")["code"], "^0[xX]", "")
    return alloc.select(
        address.alias("address"),
        F.col("a")["nonce"].alias("nonce"),
        F.col("a")["balance"].alias("balance"),
        F.when(F.length(code) > 0, F.unhex(code)).alias("code"),
        F.from_json(F.when(F.size(F.map_filter("a", lambda _, v: F.ltrim(v).startswith("{"))) > 0, inner), "MAP<STRING, STRING>").alias("slots"),
    )


def tables(genesis: DataFrame) -> dict[str, DataFrame]:
    """account_state, slot_state and bytecodes of an allocation; equal codes are stored once."""
    coded = _parts(genesis).withColumn("code_hash", keccak("code"))
    return {
        "account_state": coded.select("address", number(F.col("nonce")).alias("nonce"), hexed(F.col("balance"), 32).alias("balance"), F.col("code_hash").alias("bytecode_hash")),
        "slot_state": coded.select("address", F.explode("slots").alias("s", "v")).select("address", hexed(F.col("s"), 32).alias("slot"), hexed(F.col("v"), 32).alias("value")),
        "bytecodes": coded.where("code IS NOT NULL").groupBy("code_hash").agg(F.min("code").alias("code")),
    }


def _header(row: Mapping, alloc: Iterable[Mapping], forks: frozenset[str]) -> dict:
    n = lambda key, least=0: int.from_bytes(_bytes(row.get(key), 8) or least.to_bytes(8, "big"), "big")
    made = [(bytes(a["address"]), int.from_bytes(_bytes(a["nonce"] or "0", 8), "big"), int.from_bytes(_bytes(a["balance"] or "0", 32), "big"), keccak256(bytes(a["code"])) if a["code"] is not None else None, {_bytes(k, 32): int.from_bytes(_bytes(v, 32), "big") for k, v in dict(a["slots"] or {}).items()}) for a in alloc]
    extra = (row.get("extraData") or "").lower().removeprefix("0x")
    out = {
        "block_number": n("number"),
        "parent_hash": _bytes(row.get("parentHash") or "0x0", 32),
        "ommers_hash": rlp.NO_OMMERS,
        "beneficiary": _bytes(row.get("coinbase") or "0x0", 20),
        "state_root": rlp.state_root(made),
        "transactions_root": rlp.EMPTY_ROOT,
        "receipts_root": rlp.EMPTY_ROOT,
        "logs_bloom": bytes(256),
        "difficulty": _bytes(row.get("difficulty") or "0", 32),
        "gas_limit": n("gasLimit"),
        "gas_used": n("gasUsed"),
        "timestamp": n("timestamp"),
        "extra_data": bytes.fromhex(extra),
        "mix_hash": _bytes(row.get("mixHash") or "0x0", 32),
        "nonce": _bytes(row.get("nonce") or "0x0", 8),
        "base_fee_per_gas": n("baseFeePerGas", FIRST_BASE_FEE) if "london" in forks else None,
        "withdrawals_root": rlp.EMPTY_ROOT if "shanghai" in forks else None,
        "blob_gas_used": n("blobGasUsed") if "cancun" in forks else None,
        "excess_blob_gas": n("excessBlobGas") if "cancun" in forks else None,
        "parent_beacon_block_root": bytes(32) if "cancun" in forks else None,
        "requests_hash": rlp.NO_REQUESTS if "prague" in forks else None,
    }
    return out | {"block_hash": rlp.header_hash(out)}


def header(genesis: DataFrame, forks: Iterable[str] = ()) -> DataFrame:
    """The genesis block's header, with its state root and hash; forks name which fields it has (FORKS, each with those before).

    The document is one row of one file, so its allocation is hashed in one task.
    """
    named = set(forks)
    if unknown := named - set(FORKS):
        raise SchemaError(f"unknown forks {sorted(unknown)}")
    active = frozenset(FORKS[: max((FORKS.index(f) + 1 for f in named), default=0)])
    schema = TABLES["headers"].schema

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.to_dict("records"):
                made = _header(r, list(r["accounts"]), active)
                yield pd.DataFrame({f.name: pd.Series([made[f.name]], dtype=object) for f in schema})

    alloc = _parts(genesis).agg(F.collect_list(F.struct("address", "nonce", "balance", "code", "slots")).alias("accounts"))
    one = genesis.select(*_TOP.split()).crossJoin(alloc)  # one row each
    return one.mapInPandas(go, schema)
