"""Connected components and key-sorted streaming, shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, written

#: Graphs of so many edges at most are solved in one go; what takes rounds is left to larger ones.
AT_ONCE = 300_000


class Forest:
    """Union-find over anything hashable; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def absorb(self, a, b) -> tuple | None:
        """Joins two members: (the root that stays, the root that is one no more), or None if they were joined."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return None
        self.up[max(a, b)] = min(a, b)
        return min(a, b), max(a, b)

    def join(self, a, b) -> bool:
        return self.absorb(a, b) is not None


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of equal values in the first columns of key-sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        rows = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        lo = 0
        for i in range(1, n + 1):
            if i == n or rows[i] != rows[lo]:
                if held and rows[lo] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(lo, i - lo))
                last, lo = rows[lo], i
    if held:
        yield last, pa.Table.from_batches(held)


def _contract(edges: DataFrame) -> DataFrame:
    """Within each partition the same components by fewer edges: every node to its smallest."""
    kind = edges.schema["a"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, schema = Forest(), None
        for b in batches:
            schema = b.schema
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f.join(x, y)
                if len(f.up) >= 1_000_000:
                    yield _pairs(f, schema)
                    f = Forest()
        if f.up:
            yield _pairs(f, schema)

    return edges.select("a", "b").mapInArrow(go, f"a {kind}, b {kind}")


def _pairs(f: Forest, schema: pa.Schema) -> pa.RecordBatch:
    nodes = list(f.up)
    return pa.RecordBatch.from_arrays([pa.array([f.find(x) for x in nodes], schema.field(0).type), pa.array(nodes, schema.field(1).type)], names=["a", "b"])


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of few edges, by one task that reads the table as it lies."""
    kind = edges.schema["a"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, nodes, schema = Forest(), set(), None
        for b in batches:
            schema = b.schema
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f.join(x, y)
                nodes.update((x, y))
        every = list(nodes)
        for lo in range(0, len(every), 50_000):
            some = every[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, schema.field(0).type), pa.array([f.find(x) for x in some], schema.field(0).type)], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(go, f"node {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Edges are first made fewer within each partition. Up to AT_ONCE that are left one task joins all, in
    one forest; beyond, rounds make them fewer, until they are that few or done.

    Rounds are alternating large and small stars: edges are re-hung on smaller neighbours until nothing
    changes, after some log(nodes) rounds. A round is two aggregations with partial sums and two joins with what they
    found, a row a node. The first is where a hub's edges would meet: what is joined there is a table by then,
    broadcast if counted small, and beyond that both sides come straight from tables, so that AQE may split
    the hub. Behind it edges hang on their smallest neighbours, and no node has many smaller ones.
    """
    now = written(_contract(edges.where("a <> b")).where("a <> b"), "edges")
    if now.count() <= AT_ONCE:
        return _at_once(now)
    last, now = now, written(now.distinct(), "edges")
    discard(last)
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] <= AT_ONCE:
            return _at_once(now)
        if (state["n"], state["s"]) == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        seen = (state["n"], state["s"])
        # large star: the larger neighbours of each node to its smallest neighbour or itself
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(lookup(least), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours to the smallest of these
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        small = small.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        last, now = now, written(small.distinct(), "edges")
        discard(least, last)
