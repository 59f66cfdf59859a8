"""The star-schema tables seen as a chain, in DataFrames and, for comparison, in SQL.

Days are blocks, orders transactions, line items logs, and events state changes. The SQL text defines
the same tables; both are kept side by side here.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SQL = """
tx AS (
  SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS block_number,
         row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1 AS tx_index,
         o_orderkey AS tx_hash, o_custkey AS from_address, o_custkey % 100 AS to_address,
         CAST(round(o_totalprice * 100) AS BIGINT) AS value
  FROM orders),
headers AS (
  SELECT block_number, block_number * 7919 + 13 AS block_hash,
         (block_number - 1) * 7919 + 13 + CASE WHEN block_number % 97 = 0 THEN 1 ELSE 0 END AS parent_hash, block_number * 12 AS timestamp
  FROM (SELECT DISTINCT block_number FROM tx)),
logs AS (
  SELECT block_number, tx_index,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS log_index,
         l_suppkey AS address, l_returnflag AS topic0, l_linestatus AS topic1, l_partkey AS topic2,
         CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS topic3, CAST(l_quantity AS BIGINT) AS data
  FROM lineitem JOIN tx ON l_orderkey = tx_hash),
gas AS (
  SELECT block_number, tx_index, tx_hash, from_address, 21000 + CAST(coalesce(s, 0) AS BIGINT) AS used, coalesce(n, 0) AS n_logs
  FROM tx LEFT JOIN (SELECT block_number, tx_index, sum(data) AS s, count(*) AS n FROM logs GROUP BY ALL) USING (block_number, tx_index)),
receipts AS (
  SELECT block_number, tx_index, tx_hash, from_address,
         CAST(sum(used) OVER w AS BIGINT) AS cumulative_gas_used, used AS gas_used,
         CAST(coalesce(sum(n_logs) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_log_index
  FROM gas WINDOW w AS (PARTITION BY block_number ORDER BY tx_index)),
ev AS (SELECT *, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS block_number, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
written AS (SELECT block_number, user_id AS address, event_type AS slot, arg_max(cents, event_id) AS value FROM ev GROUP BY ALL),
slot_changes AS (SELECT block_number, address, slot, lag(value) OVER (PARTITION BY address, slot ORDER BY block_number) AS pre_value FROM written),
slot_state AS (SELECT address, slot, arg_max(value, block_number) AS value FROM written GROUP BY ALL),
moved AS (
  SELECT block_number, address, CAST(sum(n) OVER w AS BIGINT) AS nonce, CAST(sum(c) OVER w AS BIGINT) AS balance
  FROM (SELECT block_number, user_id AS address, count(*) AS n, sum(cents) AS c FROM ev GROUP BY ALL) WINDOW w AS (PARTITION BY address ORDER BY block_number)),
account_changes AS (
  SELECT block_number, address, lag(nonce) OVER w AS pre_nonce, lag(balance) OVER w AS pre_balance
  FROM moved WINDOW w AS (PARTITION BY address ORDER BY block_number)),
account_state AS (SELECT address, max(nonce) AS nonce, arg_max(balance, block_number) AS balance FROM moved GROUP BY ALL),
bridge_events AS (
  SELECT block_number, row_number() OVER (PARTITION BY block_number ORDER BY event_id) - 1 AS event_index, event_type, user_id AS sender, cents AS value FROM ev),
rollup_headers AS (SELECT CAST(n_nationkey AS BIGINT) AS block_number, CAST(n_regionkey AS BIGINT) AS rollup_chain_id, n_name AS reward_address FROM nation)
"""


def sql(body: str, **more: str) -> str:
    """body over the chain tables; more are further named queries."""
    return "WITH " + ",\n".join([SQL.strip(), *(f"{n} AS ({q})" for n, q in more.items())]) + "\n" + body


class View(Mapping[str, DataFrame]):
    """The chain tables by name, each built when it is first asked for."""

    #: Line items of an order are its logs in this order.
    LOG_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    NAMES = ("headers", "transactions", "receipts", "logs", "bridge_events", "rollup_headers", "account_state", "slot_state", "account_changes", "slot_changes")

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def transactions(self) -> DataFrame:
        day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
        o = self.raw("orders").select(
            day.alias("block_number"), F.col("o_orderkey").alias("tx_hash"), F.col("o_custkey").alias("from_address"), (F.col("o_custkey") % 100).alias("to_address"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value")
        )
        index = F.row_number().over(Window.partitionBy("block_number").orderBy("tx_hash")).cast("long") - 1
        return o.withColumn("tx_index", index)

    @cached_property
    def headers(self) -> DataFrame:
        day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
        b = self.raw("orders").select(day.alias("block_number")).distinct()
        n = F.col("block_number")
        return b.select("block_number", (n * 7919 + 13).alias("block_hash"), ((n - 1) * 7919 + 13 + F.when(n % 97 == 0, 1).otherwise(0)).alias("parent_hash"), (n * 12).alias("timestamp"))

    @cached_property
    def logs(self) -> DataFrame:
        tx = self.transactions.select("block_number", "tx_index", "tx_hash")
        # numbered behind the join and by block, so that a filter on blocks goes all the way to the orders
        place = F.row_number().over(Window.partitionBy("block_number", "tx_index").orderBy(*self.LOG_ORDER)).cast("long") - 1
        return self.raw("lineitem").join(tx, F.col("l_orderkey") == F.col("tx_hash")).withColumn("log_index", place).select(
            "block_number", "tx_index", "log_index", F.col("l_suppkey").alias("address"), F.col("l_returnflag").alias("topic0"), F.col("l_linestatus").alias("topic1"), F.col("l_partkey").alias("topic2"),
            F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("long")).alias("topic3"), F.col("l_quantity").cast("long").alias("data"),
        )

    @cached_property
    def gas(self) -> DataFrame:
        """Transactions with the cumulative gas and number of logs: what a receipt is derived from."""
        per_tx = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("tx_hash")).agg(F.sum(F.col("l_quantity").cast("long")).alias("s"), F.count(F.lit(1)).alias("n_logs"))
        tx = self.transactions.select("block_number", "tx_index", "tx_hash", "from_address").join(per_tx, "tx_hash", "left")
        used = F.lit(21000) + F.coalesce("s", F.lit(0))
        w = Window.partitionBy("block_number").orderBy("tx_index")
        return tx.select("block_number", "tx_index", "tx_hash", "from_address", F.sum(used).over(w).alias("cumulative_gas_used"), F.coalesce("n_logs", F.lit(0)).alias("n_logs"))

    @cached_property
    def receipts(self) -> DataFrame:
        from ..operators.reads import derive_receipts

        return derive_receipts(self.gas).drop("n_logs")

    @cached_property
    def _events(self) -> DataFrame:
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
        return self.raw("events").select("event_id", "event_type", "user_id", day.alias("block_number"), F.round(F.col("value") * 100).cast("long").alias("cents"))

    @cached_property
    def _written(self) -> DataFrame:
        return self._events.groupBy("block_number", F.col("user_id").alias("address"), F.col("event_type").alias("slot")).agg(F.max_by("cents", "event_id").alias("value"))

    @cached_property
    def slot_changes(self) -> DataFrame:
        w = Window.partitionBy("address", "slot").orderBy("block_number")
        return self._written.select("block_number", "address", "slot", F.lag("value").over(w).alias("pre_value"))

    @cached_property
    def slot_state(self) -> DataFrame:
        return self._written.groupBy("address", "slot").agg(F.max_by("value", "block_number").alias("value"))

    @cached_property
    def _moved(self) -> DataFrame:
        per = self._events.groupBy("block_number", F.col("user_id").alias("address")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("c"))
        w = Window.partitionBy("address").orderBy("block_number")
        return per.select("block_number", "address", F.sum("n").over(w).alias("nonce"), F.sum("c").over(w).alias("balance"))

    @cached_property
    def account_changes(self) -> DataFrame:
        w = Window.partitionBy("address").orderBy("block_number")
        return self._moved.select("block_number", "address", F.lag("nonce").over(w).alias("pre_nonce"), F.lag("balance").over(w).alias("pre_balance"))

    @cached_property
    def account_state(self) -> DataFrame:
        return self._moved.groupBy("address").agg(F.max("nonce").alias("nonce"), F.max_by("balance", "block_number").alias("balance"))

    @cached_property
    def bridge_events(self) -> DataFrame:
        index = F.row_number().over(Window.partitionBy("block_number").orderBy("event_id")).cast("long") - 1
        return self._events.select("block_number", index.alias("event_index"), "event_type", F.col("user_id").alias("sender"), F.col("cents").alias("value"))

    @cached_property
    def rollup_headers(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("block_number"), F.col("n_regionkey").cast("long").alias("rollup_chain_id"), F.col("n_name").alias("reward_address"))
