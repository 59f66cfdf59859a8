"""One exception tree for the whole engine."""

from __future__ import annotations


class LedgerError(Exception):
    """Root of all engine errors."""


class SchemaError(LedgerError):
    """A value or column doesn't fit the table."""


class MissingField(SchemaError):
    """A block bundle lacks a required part."""


class ConfigError(LedgerError):
    """The environment doesn't name exactly one usable set of stores."""


class StoreError(LedgerError):
    """Root of store errors."""


class ReadOnly(StoreError):
    """A write on a store or version opened for reading."""


class WriteLocked(StoreError):
    """Another writer holds the store."""


class UnknownTable(StoreError):
    """A table that the store doesn't have."""


class KeyOrder(StoreError):
    """An append whose keys don't exceed those present."""


class HistoryError(LedgerError):
    """Root of chain and history errors."""


class EmptyRange(HistoryError):
    """No blocks to append."""


class NonContiguous(HistoryError):
    """A block number that doesn't follow the tip or its predecessor."""


class ParentMismatch(HistoryError):
    """A parent hash that isn't the predecessor's hash."""


class NoBlocks(HistoryError):
    """A height asked of an empty store."""


class HeightOutOfRange(HistoryError):
    """A height outside the stored blocks."""

    def __init__(self, height: int, first: int, last: int) -> None:
        super().__init__(f"height {height} outside {first}..{last}")
        self.height, self.first, self.last = height, first, last


class NotEmpty(HistoryError):
    """A genesis load into a store that has blocks."""


class UnsortedInput(HistoryError):
    """A list that must ascend strictly and doesn't."""


class ColdError(LedgerError):
    """Root of history-tier errors."""


class TooManyLogs(ColdError):
    """More logs match than the caller allows; none are returned."""

    def __init__(self, limit: int) -> None:
        super().__init__(f"more than {limit} logs match")
        self.limit = limit


class StreamDeadline(ColdError):
    """A log stream ran past its deadline."""


class Reorganised(ColdError):
    """The block a stream was anchored to is no longer the same."""


class Backpressure(ColdError):
    """The dispatch queue is full."""


class TaskTerminated(ColdError):
    """The dispatcher has been stopped."""
