"""Keccak-256 as an Arrow-batched function; code hashes are verified with it, never in a hot path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = (1 << 64) - 1
#: hash of no bytes: an account without code.
EMPTY = bytes.fromhex("c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470")


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants from the degree-8 register, rotations from the walk over the lanes."""
    rounds, state = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if state & 1:
                c |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state >> 7 else 0)
        rounds.append(c)
    turn = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        turn[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turn


_ROUNDS, _TURN = _constants()


def _rotate(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def _permute(a: list[list[int]]) -> None:
    for constant in _ROUNDS:
        c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        d = [c[x - 1] ^ _rotate(c[(x + 1) % 5], 1) for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _rotate(a[x][y] ^ d[x], _TURN[x][y])
        for x in range(5):
            for y in range(5):
                a[x][y] = b[x][y] ^ (~b[(x + 1) % 5][y] & _MASK & b[(x + 2) % 5][y])
        a[0][0] ^= constant


def keccak256(data: bytes) -> bytes:
    rate = 136
    padded = data + b"\x01" + b"\0" * ((-len(data) - 1) % rate)
    padded = padded[:-1] + bytes([padded[-1] | 0x80])
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        _permute(a)
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


@F.pandas_udf(T.BinaryType())
def keccak(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Keccak-256 of a binary column; null stays null."""
    for p in parts:
        yield pd.Series([None if v is None else keccak256(bytes(v)) for v in p])
