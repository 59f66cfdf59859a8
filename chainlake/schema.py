"""Table schemas and keys. Numbers of 64 bits are BIGINT, wider ones fixed-length big-endian BINARY."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

#: Blocks to a partition of the block tables; hash partitions of the state tables, unless a store says otherwise.
BLOCKS_PER_BUCKET, STATE_BUCKETS = 10_000, 64
#: Block numbers to a shard of the history index, and the key of the open shard.
SHARD_CAP, OPEN_SHARD = 2000, (1 << 63) - 1


@dataclass(frozen=True)
class Table:
    name: str
    ddl: str
    key: tuple[str, ...]
    #: Column that places a row in a partition: block numbers by range, others by hash.
    bucket_by: str = "block_number"
    #: Fixed lengths of binary columns.
    lengths: tuple[tuple[str, int], ...] = ()
    #: Columns that get Parquet bloom filters.
    blooms: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def by_block(self) -> bool:
        return self.bucket_by == "block_number"


def _table(name: str, ddl: str, key: str, bucket_by: str = "block_number", lengths: str = "", blooms: str = "") -> Table:
    sizes = tuple((c, int(n)) for c, n in (x.split(":") for x in lengths.split()))
    return Table(name, ddl, tuple(key.split()), bucket_by, sizes, tuple(blooms.split()))


_ACCESS = "ARRAY<STRUCT<address: BINARY, slot_keys: ARRAY<BINARY>>>"
_AUTH = "ARRAY<STRUCT<chain_id: BINARY, address: BINARY, nonce: BIGINT, y_parity: TINYINT, r: BINARY, s: BINARY>>"

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        _table(
            "headers",
            "block_number BIGINT, block_hash BINARY, parent_hash BINARY, ommers_hash BINARY, beneficiary BINARY, state_root BINARY, transactions_root BINARY, receipts_root BINARY, logs_bloom BINARY, difficulty BINARY, gas_limit BIGINT, gas_used BIGINT, timestamp BIGINT, extra_data BINARY, mix_hash BINARY, nonce BINARY, base_fee_per_gas BIGINT, withdrawals_root BINARY, blob_gas_used BIGINT, excess_blob_gas BIGINT, parent_beacon_block_root BINARY, requests_hash BINARY",
            "block_number", lengths="block_hash:32 parent_hash:32 beneficiary:20 difficulty:32", blooms="block_hash",
        ),
        _table(
            "transactions",
            f"block_number BIGINT, tx_index BIGINT, tx_hash BINARY, tx_type TINYINT, sig_y_parity TINYINT, sig_r BINARY, sig_s BINARY, chain_id BIGINT, nonce BIGINT, gas_limit BIGINT, to_address BINARY, value BINARY, input BINARY, gas_price BINARY, max_fee_per_gas BINARY, max_priority_fee_per_gas BINARY, max_fee_per_blob_gas BINARY, blob_versioned_hashes ARRAY<BINARY>, access_list {_ACCESS}, authorization_list {_AUTH}, from_address BINARY",
            "block_number tx_index", lengths="tx_hash:32 to_address:20 from_address:20 value:32", blooms="tx_hash",
        ),
        _table("receipts", "block_number BIGINT, tx_index BIGINT, tx_type TINYINT, success BOOLEAN, cumulative_gas_used BIGINT, first_log_index BIGINT, gas_used BIGINT, tx_hash BINARY, from_address BINARY", "block_number tx_index", lengths="tx_hash:32 from_address:20", blooms="tx_hash"),
        _table("logs", "block_number BIGINT, tx_index BIGINT, log_index BIGINT, address BINARY, topic0 BINARY, topic1 BINARY, topic2 BINARY, topic3 BINARY, data BINARY", "block_number tx_index log_index", lengths="address:20 topic0:32 topic1:32 topic2:32 topic3:32", blooms="address topic0"),
        _table("bridge_events", "block_number BIGINT, event_index BIGINT, event_type TINYINT, order_index BIGINT, rollup_chain_id BINARY, sender BINARY, to_address BINARY, value BINARY, gas BINARY, max_fee_per_gas BINARY, data BINARY, rollup_recipient BINARY, amount BINARY, token BINARY", "block_number event_index", lengths="rollup_chain_id:32"),
        _table("rollup_headers", "block_number BIGINT, host_block_number BINARY, rollup_chain_id BINARY, gas_limit BINARY, reward_address BINARY, block_data_hash BINARY", "block_number", lengths="reward_address:20 block_data_hash:32"),
        _table("account_state", "address BINARY, nonce BIGINT, balance BINARY, bytecode_hash BINARY", "address", "address", "address:20 balance:32 bytecode_hash:32"),
        _table("slot_state", "address BINARY, slot BINARY, value BINARY", "address slot", "address", "address:20 slot:32 value:32"),
        _table("account_changes", "block_number BIGINT, address BINARY, existed BOOLEAN, pre_nonce BIGINT, pre_balance BINARY, pre_bytecode_hash BINARY", "block_number address", lengths="address:20 pre_balance:32 pre_bytecode_hash:32"),
        _table("slot_changes", "block_number BIGINT, address BINARY, slot BINARY, existed BOOLEAN, pre_value BINARY", "block_number address slot", lengths="address:20 slot:32 pre_value:32"),
        _table("account_history", "address BINARY, highest BIGINT, is_open BOOLEAN, blocks ARRAY<BIGINT>", "address highest", "address", "address:20"),
        _table("slot_history", "address BINARY, slot BINARY, highest BIGINT, is_open BOOLEAN, blocks ARRAY<BIGINT>", "address slot highest", "address", "address:20 slot:32"),
        _table("bytecodes", "code_hash BINARY, code BINARY", "code_hash", "code_hash", "code_hash:32"),
    )
}

HOT = ("headers", "bytecodes", "account_state", "slot_state", "account_history", "account_changes", "slot_history", "slot_changes")
COLD = ("headers", "transactions", "receipts", "logs", "bridge_events", "rollup_headers")


def conform(df: DataFrame, table: Table) -> DataFrame:
    """df with exactly the table's columns and types; missing nullable columns are null.

    Rows with a null key, a negative 64-bit number or a binary of wrong length raise when read.
    """
    extra = set(df.columns) - set(table.schema.names)
    if extra:
        raise SchemaError(f"{table.name} has no columns {sorted(extra)}")
    out = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema))
    wrong = F.lit(False)
    for k in table.key:
        wrong = wrong | F.col(k).isNull()
    for f in table.schema:
        if isinstance(f.dataType, T.LongType):
            wrong = wrong | (F.coalesce(F.col(f.name), F.lit(0)) < 0)
    for c, n in table.lengths:
        wrong = wrong | (F.coalesce(F.octet_length(c), F.lit(n)) != n)
    first = table.schema.names[0]
    checked = F.when(wrong, F.raise_error(F.lit(f"{table.name}: bad key, negative number or wrong length"))).otherwise(F.col(first))
    return out.withColumn(first, checked.cast(table.schema[0].dataType))
