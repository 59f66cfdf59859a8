"""Shared pieces: table access, scratch tables, word rules, distributed running sums."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Only A-Z are lower-cased, whatever the locale or script.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Lower-cases A-Z and turns everything but 0-9, a-z and bytes from 0x80 into blanks.
_ALNUM = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)
#: Native counterparts of the two word rules: a word by blanks with the gap behind it (its first character is the group) or a gap before all words; a gap.
SPACE_RUNS = r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_scratch_roots: dict[str, str] = {}
_writing = threading.Lock()
_writers: dict[str, list] = {}


def tune(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers, by rows and by bytes, so that long texts don't add up."""
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name, None) or "")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, with a worker's free memory given back to the machine as batches go by: workers live on behind a task."""

    def go(batches: Iterator) -> Iterator:
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        for n, b in enumerate(work(batches), 1):
            yield b
            if n % 16 == 0:
                pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)

    return go


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 text with A-Z lower-cased."""
    return text.translate(_ASCII_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text with A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as bytes; null becomes the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def crc_mod(key: str, n: int) -> Column:
    """crc32 of a column's text form, modulo n; null if the column is null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


_HASHES = 1 << 30


def share_below(wanted: int, rows: int) -> int:
    """The bound under which about `wanted` of so many rows' hashes fall (all, if there are fewer)."""
    return _HASHES if rows <= wanted else max(1, _HASHES * wanted // rows)


def place(h: Column) -> Column:
    """What `below` holds against a bound."""
    return F.pmod(h, F.lit(_HASHES))


def below(h: Column, bound: Column) -> Column:
    """Whether a hash falls under a bound: a sample that doesn't depend on order or partitioning."""
    return place(h) < bound


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def scratch_root(spark: SparkSession) -> str:
    """The session's folder for intermediate tables, under spark.checkpoint.dir.

    Where that is unset a temporary folder is chosen and set, on one machine only: on a cluster its
    executors wouldn't see it, so there the setting is asked for.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch_roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="scratch-")
            spark.sparkContext.setCheckpointDir(base)
        _scratch_roots[app] = f"{base.rstrip('/')}/tables-{app}-{os.getpid()}"
    return _scratch_roots[app]


#: Small tables are broadcast up to so many rows; beyond, joins shuffle.
BROADCAST_ROWS = 300_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and lost executors cost no recomputation.

    The shuffle files that writing it took are given back as soon as it is there: a setting of the session
    that holds while any thread writes, and is as it was when the last one is done.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    with _writing:
        held = _writers.setdefault(app, [0, None])
        if not held[0]:
            held[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        held[0] += 1
    try:
        return _write(spark, df, path)
    finally:
        with _writing:
            held[0] -= 1
            if not held[0]:
                if held[1] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, held[1])


def _write(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once all that was made from them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


def lookup(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table (of so many rows, if that is known) that `written` made, to join with: broadcast if it is counted to be small, so that the other side stays where it is.

    Beyond that both sides are shuffled, and as both come straight from tables AQE may split a hot key.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def remembered(spark: SparkSession, name: str, make: Callable[[], bytes]) -> bytes:
    """Bytes that are made once for all sessions that share a folder: read from there, or made and put there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{os.path.dirname(scratch_root(spark))}/made-{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()
    data = make()
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    stream.write(bytearray(data))
    stream.close()
    if fs.exists(path) or not fs.rename(part, path):
        fs.delete(part, False)
    return data


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the session's intermediate tables. Call it once results have been consumed."""
    _delete(spark, scratch_root(spark))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(df: DataFrame, *extra: tuple[str, T.DataType]) -> T.StructType:
    """The columns of df with further ones behind."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in extra)])


def with_columns(batch: pa.RecordBatch, arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays.values()], names=[*batch.schema.names, *arrays])


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the inclusive running sum of value by group, along order, without a task per group.

    Rows are range-sorted by group and order; each partition sums its own stretch, and the stretch
    totals (one row for each partition and group at most) are then added up. value must not be negative.
    Rows equal in group and order may swap their sums. Null groups form one group.
    """
    spark = df.sparkSession
    part, local, before = fresh(df, "rs_part"), fresh(df, "rs_local"), fresh(df, "rs_before")
    keys = [*group, *order]

    def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = list(zip(*(b.column(g).to_pylist() for g in group), strict=True)) if group else [()] * n
            starts = [0, *(i for i in range(1, n) if rows[i] != rows[i - 1])]
            sums = np.empty(n, np.int64)
            for lo, hi in zip(starts, [*starts[1:], n], strict=True):
                if rows[lo] != last:
                    last, total = rows[lo], 0
                sums[lo:hi] = np.cumsum(v[lo:hi]) + total
                total = int(sums[hi - 1])
            yield with_columns(b, {part: pa.array(np.full(n, at, np.int32)), local: pa.array(sums)})

    ranged = df.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    summed = written(ranged.mapInArrow(local_sums, arrow_schema(df, (part, T.IntegerType()), (local, T.LongType()))), "sums")
    totals = summed.groupBy(*group, part).agg(F.max(local).alias(before))
    w = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(before, F.coalesce(F.sum(before).over(w), F.lit(0)))
    names = {g: fresh(summed, f"rs_{g}") for g in [*group, part]}
    offsets = offsets.select(*(F.col(a).alias(b) for a, b in names.items()), before)
    match = F.lit(True)
    for a, b in names.items():
        match = match & F.col(a).eqNullSafe(F.col(b))
    return summed.join(offsets, match, "left").withColumn(out, F.col(local) + F.col(before)).select(*df.columns, out)
