"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. A table hashes a vector by PROJECTIONS Gaussian
projections, each shifted and cut into cells of WIDTH; vectors that agree in all cells of one of
TABLES tables are compared by cosine, exactly and in double precision. At cosine 0.98 two vectors
meet in some table with probability 0.9999 (with 16 tables 0.992); unrelated ones (cosine 0) meet in
one table with 1e-5.

Equal vectors with equal labels are one class with a count. Buckets of one class drop out before any
vector is moved, and of buckets of several tables that hold the same classes all but the first: its
pairs have met there. Large buckets are compared in pairs of blocks; a pair counts only in the first
table in which it meets, so links are counted once; of a bucket's links only the counts and a
spanning forest leave the task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, read_table, shuffle_parts, tune, written
from .graph import Forest, components, sorted_groups
from .near_text import in_blocks

LEAST_COSINE = 0.98
TABLES, PROJECTIONS, WIDTH = 32, 16, 2.0
#: Members of a block of a bucket.
BLOCK = 250

_planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The projections and shifts for vectors of a dimension; the same wherever they are drawn."""
    if dim not in _planes:
        if len(_planes) > 16:
            _planes.clear()
        rng = np.random.default_rng([20240229, dim])
        _planes[dim] = rng.normal(size=(dim, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    return _planes[dim]


def unit(column: pa.Array) -> tuple[list[np.ndarray | None], dict[int, list[int]]]:
    """Unit vectors in double precision (None: null, zero or not finite), and the rows of each dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    ends = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    rows: dict[int, list[int]] = defaultdict(list)
    for i, ok in enumerate(valid):
        v = values[ends[i] : ends[i + 1]] if ok else values[:0]
        most = np.abs(v).max() if len(v) else 0.0
        if not np.isfinite(most) or most == 0:
            out.append(None)
            continue
        v = v / most
        out.append(v / np.sqrt((v * v).sum()))
        rows[len(v)].append(i)
    return out, rows


def hashes(vectors: np.ndarray) -> np.ndarray:
    """The cells of each row, (rows, TABLES, PROJECTIONS)."""
    a, shift = planes(vectors.shape[1])
    return np.floor((vectors @ a + shift) / WIDTH).astype(np.int32).reshape(len(vectors), TABLES, PROJECTIONS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, vector, label as text) to (key, cls, vector in double precision, a hash for each table)."""
    for b in batches:
        units, rows = unit(b.column(1))
        labels = b.column(2).to_pylist()
        n = b.num_rows
        cls, vec, tok = [None] * n, [None] * n, [None] * n
        for mine in rows.values():
            cells = hashes(np.stack([units[i] for i in mine]))
            for i, c in zip(mine, cells, strict=True):
                if labels[i] is None:
                    continue
                name = f"{labels[i]}\0{len(units[i])}\0".encode()
                vec[i] = units[i].tobytes()
                cls[i] = xxhash.xxh3_128_digest(name + vec[i])
                tok[i] = [xxhash.xxh3_64_intdigest(name + c[t].tobytes(), seed=t + 1) - (1 << 63) for t in range(TABLES)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(vec, pa.binary()), pa.array(tok, pa.list_(pa.int64()))], names=["key", "cls", "vec", "tokens"])


def _links(least: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (token, x, y, cls, members, vec, tokens, mine) to (cls, other, links): counts, and forest edges with links 0."""
        links: dict[bytes, int] = defaultdict(int)
        edges: list[tuple[bytes, bytes]] = []

        def flush() -> pa.RecordBatch:
            rows = [(c, None, n) for c, n in links.items()] + [(a, b, 0) for a, b in edges]
            links.clear()
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["cls", "other", "links"])

        for (token, x, y), t in sorted_groups(batches, 3):
            names, own, members = t["cls"].to_pylist(), t["mine"].to_numpy(), t["members"].to_numpy()
            v = np.stack([np.frombuffer(s, np.float64) for s in t["vec"].to_pylist()])
            tok = np.concatenate([c.flatten().to_numpy() for c in t["tokens"].chunks]).reshape(len(names), -1)
            table = int(np.flatnonzero(tok[0] == token)[0])
            near = v @ v.T >= least
            near &= own[:, None] != own if x != y else ~np.eye(len(names), dtype=bool)
            for e in range(table):
                near &= tok[:, None, e] != tok[None, :, e]
            f = Forest()
            for i in np.flatnonzero(near.any(1)):
                js = np.flatnonzero(near[i])
                links[names[i]] += int(members[js].sum())
                edges += [(names[j], names[i]) for j in js[js < i] if f.join(int(j), int(i))]
            if len(links) + len(edges) > 50_000:
                yield flush()
        yield flush()

    return go


def group(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """(key, cls, n_links, component_id) for every row of vectors.

    Rows are compared where labels and dimensions are equal. n_links counts the other rows linked
    directly, copies included; component_id is the smallest key reachable, the row's own if it has no
    link. Null labels, and vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing. Null keys are linked but don't name a component unless all its keys are null.
    Repeated rows are rows of their own, linked with one another; an empty table gives an empty result.
    Only the three columns are read.
    """
    spark = vectors.sparkSession
    tune(spark)
    parts = shuffle_parts(spark)
    base = vectors.select(F.col(key).alias("key"), vector, F.col(label).cast("string"))
    kind = vectors.schema[key].dataType.simpleString()
    hashed = base.mapInArrow(_hashed, f"key {kind}, cls binary, vec binary, tokens array<long>")
    rows = written(hashed, "vectors")
    valid = rows.where("cls IS NOT NULL")
    classes = written(valid.groupBy("cls").agg(F.min("vec").alias("vec"), F.min("tokens").alias("tokens"), F.count(F.lit(1)).alias("members"), F.min("key").alias("least")), "classes")
    posted = classes.select("cls", F.posexplode("tokens").alias("nth", "token"))
    # two sums of hashes name a bucket's classes
    name = [F.sum(F.xxhash64("cls", F.lit(k)).cast("decimal(38,0)")).alias(f"name{k}") for k in (1, 2)]
    buckets = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("nth"), *name).where("n > 1")
    first = buckets.groupBy("n", "name1", "name2").agg(F.min_by("token", F.struct("nth", "token")).alias("token")).select("token")
    met = written(posted.select("cls", "token").join(first, "token"), "met")
    blocks = in_blocks(met, "token", parts, BLOCK).join(classes.select("cls", "vec", "tokens", F.col("members").alias("members")), "cls")
    keys = ["token", "x", "y"]
    blocks = blocks.select(*keys, "cls", "members", "vec", "tokens", "mine").repartition(parts, *keys).sortWithinPartitions(*keys)
    found = written(blocks.mapInArrow(_links(least), "cls binary, other binary, links long"), "links")
    linked = components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    counts = found.where("other IS NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.select("cls", "members", "least").join(counts, "cls", "left").join(linked, F.col("cls") == F.col("node"), "left")
    named = written(named.select("cls", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "cls").alias("root")), "named")
    smallest = lookup(written(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest"))
    by_class = lookup(written(named.join(smallest, "root").select(F.col("cls").alias("of"), "n_links", "component_id"), "by-class"), most=100_000)
    out = rows.select("key", "cls").join(by_class, F.col("cls") == F.col("of"), "left")
    return out.select(
        F.col("key").alias(key),
        "cls",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    found = group(read_table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"))


def brute(rows: list[tuple[int, list | None, int | None]], least: float = LEAST_COSINE) -> dict[int, tuple[int, int, bool]]:
    """The same result by comparing all pairs."""
    units = []
    for key, v, label in rows:
        a = np.array([np.nan if x is None else x for x in v] if v is not None else [], np.float64)
        ok = label is not None and len(a) and np.isfinite(a).all() and a.any()
        units.append((key, a / np.sqrt((a * a).sum()) if ok else None, label))
    f, links = Forest(), {u[0]: 0 for u in units}
    by: dict = defaultdict(list)
    for key, v, label in units:
        if v is not None:
            by[label, len(v)].append((key, v))
    for mine in by.values():
        m = np.stack([v for _, v in mine])
        near = m @ m.T >= least
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near), strict=True):
            links[mine[i][0]] += 1
            f.join(mine[i][0], mine[j][0])
    return {k: (links[k], f.find(k), f.find(k) == k) for k, _, _ in units}


SQL6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id WHERE r.root < l.b),
c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
