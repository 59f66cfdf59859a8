"""Recently looked-up rows, least recently used ones first to go."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

#: Rows remembered of each kind.
CAPACITY = 2048


class LookupCache:
    """Rows by kind and key; a key begins with its block number, so a rollback can drop what it undoes."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.rows: dict[str, OrderedDict[tuple[int, ...], Any]] = {}
        self.lock = threading.Lock()
        self.epoch = 0

    def get(self, kind: str, key: tuple[int, ...], load: Callable[[], Any]) -> Any:
        """The row, loaded unless it is there. What isn't found (None), or was loaded while a rollback ran, isn't kept."""
        with self.lock:
            held = self.rows.setdefault(kind, OrderedDict())
            if key in held:
                held.move_to_end(key)
                return held[key]
            epoch = self.epoch
        row = load()
        with self.lock:
            if row is not None and epoch == self.epoch:
                held[key] = row
                while len(held) > self.capacity:
                    held.popitem(last=False)
        return row

    def drop_above(self, block: int) -> None:
        with self.lock:
            self.epoch += 1
            for held in self.rows.values():
                for key in [k for k in held if k[0] > block]:
                    del held[key]
