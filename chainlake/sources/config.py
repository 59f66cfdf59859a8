"""Which stores to open, from settings or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import ConfigError
from ..schema import COLD, HOT, STATE_BUCKETS
from .jdbc import JdbcSource
from .store import Store
from .tier import HistoryTier

HOT_PATH, COLD_PATH, COLD_SQL = "LEDGER_HOT_PATH", "LEDGER_COLD_PATH", "LEDGER_COLD_SQL_URL"


@dataclass(frozen=True)
class EngineConfig:
    """A state store, and a history tier that is either a store or a database."""

    hot_path: str
    cold_path: str | None = None
    cold_sql_url: str | None = None
    read_only: bool = False
    state_buckets: int = STATE_BUCKETS
    bucket_files: int = 1
    sql_options: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        """Raises ConfigError if the state path is missing, or if not exactly one history tier is named."""
        env = os.environ if env is None else env
        hot, cold, sql = (env.get(k) or None for k in (HOT_PATH, COLD_PATH, COLD_SQL))
        if not hot:
            raise ConfigError(f"{HOT_PATH} is not set")
        if not cold and not sql:
            raise ConfigError(f"neither {COLD_PATH} nor {COLD_SQL} is set")
        if cold and sql:
            raise ConfigError(f"both {COLD_PATH} and {COLD_SQL} are set")
        return cls(hot, cold, sql)

    def connect_hot(self, spark: SparkSession) -> Store:
        return Store(spark, self.hot_path, HOT, self.read_only, state_buckets=self.state_buckets, bucket_files=self.bucket_files).init()

    def connect_cold(self, spark: SparkSession) -> HistoryTier:
        if self.cold_sql_url:
            return JdbcSource(spark, self.cold_sql_url, dict(self.sql_options), read_only=self.read_only).init()
        return Store(spark, self.cold_path, COLD, self.read_only).init()
