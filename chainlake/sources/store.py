"""A versioned store of Parquet tables: immutable files, one manifest a version, one writer at a time.

A commit first writes new files and then puts a new manifest in place, the only step that readers
can see; it names the live files of all tables, so a commit is atomic across them, and a reader that
has pinned a version keeps its snapshot whatever is written later. Files go through Hadoop's file
systems, so a store may lie wherever Spark can read.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import KeyOrder, ReadOnly, StoreError, UnknownTable, WriteLocked
from ..operators.filters import block_range
from ..schema import BLOCKS_PER_BUCKET, STATE_BUCKETS, TABLES, Table, conform


LAYOUT = "layout.json"


class Files:
    """The few file operations a store needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        p = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file unless it exists: first under another name, then moved into place."""
        if self.fs.exists(self._path(name)):
            return False
        staged = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(staged), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # a rename onto an existing file fails on HDFS; locally the writer's lock rules it out
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(staged), self._path(name)):
            self.fs.delete(self._path(staged), False)
            return False
        return True

    def exclusive(self, name: str, text: str) -> bool:
        """Creates a file that must not exist, in one step."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception:
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Snapshot(Mapping[str, DataFrame]):
    """The tables of one version, by name."""

    def __init__(self, store: Store, version: int, manifest: dict) -> None:
        self.store, self.version, self.manifest = store, version, manifest

    def __getitem__(self, name: str) -> DataFrame:
        return self.read(name)

    def __iter__(self):
        return iter(self.manifest)

    def __len__(self) -> int:
        return len(self.manifest)

    def read(self, name: str, first: int | None = None, last: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or its blocks first..last; files without such blocks, or of other buckets, aren't opened."""
        table = self.store.table(name)
        wanted = None if buckets is None else set(buckets)
        parts = [
            p for p in self.manifest[name]
            if (wanted is None or p["bucket"] in wanted) and (first is None or p["last"] is None or p["last"] >= first) and (last is None or p["first"] is None or p["first"] <= last)
        ]
        df = self.store.open(table, [p["path"] for p in parts])
        return block_range(df, first, last) if table.by_block else df

    def tail(self, name: str) -> DataFrame:
        """The rows of a block table's last files: enough to find its highest block."""
        top = max((p["last"] for p in self.manifest[name]), default=None)
        return self.read(name, top)

    def of_keys(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of some keys, given by a prefix of the key columns; only their buckets are opened."""
        table = self.store.table(name)
        on = [k for k in table.key if k in keys.columns]
        rows = self.read(name, buckets=self.store.touched(table, keys))
        return rows.join(keys.select(*on).distinct(), on, "left_semi")


class Store:
    """Tables under one path. Open it read-only to look at versions without ever taking the lock.

    state_buckets and bucket_files say into how many hash partitions the state tables are dealt, and
    into how many files each of these; a store keeps what it was made with.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        tables: Iterable[str] = TABLES,
        read_only: bool = False,
        more: Mapping[str, Table] | None = None,
        state_buckets: int = STATE_BUCKETS,
        bucket_files: int = 1,
    ) -> None:
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.tables = {n: TABLES[n] for n in tables} | dict(more or {})
        self.files = Files(spark, self.path)
        self.state_buckets, self.bucket_files = state_buckets, bucket_files
        if LAYOUT in self.files.names():
            made = json.loads(self.files.read(LAYOUT))
            self.state_buckets, self.bucket_files = made["state_buckets"], made["bucket_files"]

    def table(self, name: str) -> Table:
        try:
            return self.tables[name]
        except KeyError:
            raise UnknownTable(name) from None

    def init(self) -> Store:
        """Creates what isn't there; an existing store stays as it is."""
        if not self.versions():
            if self.read_only:
                raise ReadOnly(self.path)
            self.files.create(LAYOUT, json.dumps({"state_buckets": self.state_buckets, "bucket_files": self.bucket_files}))
            self.files.create("manifest-0.json", json.dumps({n: [] for n in self.tables}))
        return self

    def bucket_of(self, table: Table) -> Column:
        if table.by_block:
            return F.floor(F.col("block_number") / BLOCKS_PER_BUCKET).cast("int")
        return F.pmod(F.xxhash64(table.bucket_by), F.lit(self.state_buckets)).cast("int")

    def touched(self, table: Table, keys: DataFrame) -> set[int] | None:
        """The buckets that some keys lie in; None (any) if the keys don't tell. At most a number a bucket reaches the driver."""
        if table.bucket_by not in keys.columns:
            return None
        return {r[0] for r in keys.select(self.bucket_of(table).alias("b")).distinct().collect()}

    def versions(self) -> list[int]:
        found = (n.removeprefix("manifest-").removesuffix(".json") for n in self.files.names() if n.startswith("manifest-"))
        return sorted(int(v) for v in found)

    def snapshot(self, version: int | None = None) -> Snapshot:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise StoreError(f"no version {version} in {self.path}")
        version = known[-1] if version is None else version
        manifest = json.loads(self.files.read(f"manifest-{version}.json"))
        return Snapshot(self, version, {n: manifest.get(n, []) for n in self.tables})

    def open(self, table: Table, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], table.schema).limit(0)  # known to be empty by the planner: joins with it fall away
        return self.spark.read.schema(table.schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def keep(self, df: DataFrame) -> DataFrame:
        """df as files of their own beside the tables, until the next vacuum: a result that outlives what it was read from."""
        where = f"{self.path}/kept-{uuid.uuid4().hex[:16]}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def writer(self) -> Writer:
        if self.read_only:
            raise ReadOnly(self.path)
        return Writer(self)

    def vacuum(self, keep: int = 10) -> list[str]:
        """Deletes all but the last versions and the data that none of these names. Readers of older ones fail."""
        with self.writer():
            kept = self.versions()[-keep:]
            live = {p["path"].split("/")[0] for v in kept for parts in self.snapshot(v).manifest.values() for p in parts}
            gone = [n for n in self.files.names() if n.startswith(("data-", "stage-", "kept-")) and n not in live]
            gone += [f"manifest-{v}.json" for v in self.versions() if v not in kept]
            for n in gone:
                self.files.delete(n)
            return gone


def _alive(owner: dict) -> bool:
    """Whether a lock's owner may still run: another host's always may."""
    if owner.get("host") != socket.gethostname():
        return True
    try:
        os.kill(owner["pid"], 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return _started(owner["pid"]) == owner.get("started")


def _started(pid: int) -> str | None:
    try:
        with open(f"/proc/{pid}/stat") as f:
            return f.read().rpartition(")")[2].split()[19]
    except OSError:
        return None


class Writer:
    """Staged changes of one commit; reads see them. Leaving the block without commit drops them all."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.id = uuid.uuid4().hex
        self._lock()
        try:
            self.base = store.snapshot()
        except BaseException:
            store.files.delete("LOCK")
            raise
        self.manifest = {n: list(p) for n, p in self.base.manifest.items()}
        self.staged: list[str] = []
        self.open = True

    def _lock(self) -> None:
        files = self.store.files
        me = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "started": _started(os.getpid()), "id": self.id, "at": time.time()})
        if files.exclusive("LOCK", me):
            return
        try:
            owner = json.loads(files.read("LOCK"))
        except Exception:
            owner = {}
        if owner and not _alive(owner):
            files.delete("LOCK")
            if files.exclusive("LOCK", me):
                return
        raise WriteLocked(f"{self.store.path} is held by {owner.get('host')}:{owner.get('pid')}")

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.abort()

    def read(self, name: str, first: int | None = None, last: int | None = None) -> DataFrame:
        return self._now().read(name, first, last)

    def of_keys(self, name: str, keys: DataFrame) -> DataFrame:
        return self._now().of_keys(name, keys)

    def tail(self, name: str) -> DataFrame:
        return self._now().tail(name)

    def touched(self, name: str, keys: DataFrame) -> set[int] | None:
        return self.store.touched(self.store.table(name), keys)

    def of_buckets(self, name: str, buckets: Iterable[int] | None) -> DataFrame:
        return self._now().read(name, buckets=buckets)

    def _now(self) -> Snapshot:
        return Snapshot(self.store, -1, self.manifest)

    def snapshot(self) -> Snapshot:
        """What the tables would be if committed now."""
        return Snapshot(self.store, -1, {n: list(p) for n, p in self.manifest.items()})

    def stage(self, df: DataFrame) -> DataFrame:
        """df as a table of this commit only, for what is read more than once; it goes when the commit ends."""
        where = f"stage-{self.id}-{len(self.staged)}"
        self.staged.append(where)
        df.write.option("compression", "zstd").parquet(f"{self.store.path}/{where}")
        return self.store.spark.read.schema(df.schema).parquet(f"{self.store.path}/{where}")

    # -- staging --------------------------------------------------------------------------

    def _write(self, table: Table, df: DataFrame, arranged: bool = False) -> list[dict]:
        """Writes rows in partition folders, and tells what each holds.

        The span of blocks is observed while writing; inside it a bucket's own span is taken as whole. Rows of
        a block table that lie by stretches of blocks already (arranged) are sorted where they are.
        """
        df = conform(df, table)
        where = f"data-{table.name}-{uuid.uuid4().hex[:16]}"
        placed = df.withColumn("bucket", self.store.bucket_of(table))
        if table.by_block and not arranged:
            placed = placed.repartitionByRange(*table.key)
        elif not table.by_block:
            part = F.pmod(F.xxhash64(*table.key, F.lit(1)), F.lit(self.store.bucket_files))
            placed = placed.repartition("bucket", part) if self.store.bucket_files > 1 else placed.repartition("bucket")
        seen = Observation()
        n = F.col("block_number") if table.by_block else F.lit(None).cast("long")
        placed = placed.observe(seen, F.min(n).alias("first"), F.max(n).alias("last"))
        out = placed.sortWithinPartitions("bucket", *table.key).write.partitionBy("bucket").option("compression", "zstd")
        for c in table.blooms:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.store.path}/{where}")
        buckets = sorted(int(x.removeprefix("bucket=")) for x in self.store.files.names(where) if x.startswith("bucket="))
        first, last = (seen.get["first"], seen.get["last"]) if buckets and table.by_block else (None, None)
        size = BLOCKS_PER_BUCKET
        return [{"path": f"{where}/bucket={b}", "bucket": b, "first": None if first is None else max(first, b * size), "last": None if last is None else min(last, (b + 1) * size - 1)} for b in buckets]

    def append(self, name: str, df: DataFrame, arranged: bool = False) -> None:
        """Adds rows whose keys all exceed those present. arranged: df's tasks have a stretch or a few of blocks each, so nothing is dealt anew."""
        table = self.store.table(name)
        parts = self._write(table, df, arranged)
        if table.by_block:
            tip = max((p["last"] for p in self.manifest[name]), default=None)
            if tip is not None and any(p["first"] <= tip for p in parts):
                raise KeyOrder(f"{name}: rows at or below block {tip}")
        elif self.manifest[name] and parts:
            top = self.read(name).agg(F.max(F.struct(*table.key))).first()[0]
            low = self.store.open(table, [p["path"] for p in parts]).agg(F.min(F.struct(*table.key))).first()[0]
            if top is not None and tuple(map(_plain, low)) <= tuple(map(_plain, top)):
                raise KeyOrder(f"{name}: keys at or below the last one")
        self.manifest[name] += parts

    def rewrite(self, name: str, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the rows of some keys, given by a prefix of the key columns, by what make says of them.

        Only buckets with such keys are read and written again, once. keys and what make takes its rows
        from are read twice: stage them first if they are dear.
        """
        table = self.store.table(name)
        on = [k for k in table.key if k in keys.columns]
        touched = self.store.touched(table, keys)
        mine = [p for p in self.manifest[name] if touched is None or p["bucket"] in touched]
        old = self.store.open(table, [p["path"] for p in mine])
        named = keys.select(*on).distinct()
        new = conform(make(old.join(named, on, "left_semi")), table)
        if mine:
            new = old.join(named, on, "left_anti").unionByName(new)
        written = self._write(table, new)
        self.manifest[name] = [p for p in self.manifest[name] if p not in mine] + written

    def replace_buckets(self, name: str, buckets: Iterable[int] | None, df: DataFrame) -> None:
        """Puts df in place of all rows of some buckets (None: any)."""
        wanted = None if buckets is None else set(buckets)
        written = self._write(self.store.table(name), df)
        self.manifest[name] = [p for p in self.manifest[name] if wanted is not None and p["bucket"] not in wanted] + written

    def upsert(self, name: str, df: DataFrame) -> None:
        """Puts rows by key over those present; rows are unique by key."""
        table = self.store.table(name)
        rows = conform(df, table)
        self.rewrite(name, rows.select(*table.key), lambda _: rows)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Deletes rows by key; keys may be a prefix of the key columns."""
        self.rewrite(name, keys, lambda old: old.limit(0))

    def replace(self, name: str, df: DataFrame) -> None:
        self.manifest[name] = self._write(self.store.table(name), df)

    def clear(self, name: str) -> None:
        self.manifest[name] = []

    def truncate(self, name: str, above: int) -> None:
        """Drops blocks above: whole files where possible; only those across the boundary are rewritten."""
        table = self.store.table(name)
        keep = [p for p in self.manifest[name] if p["last"] <= above]
        cut = [p["path"] for p in self.manifest[name] if p["first"] <= above < p["last"]]
        if cut:
            keep += self._write(table, block_range(self.store.open(table, cut), None, above), arranged=True)
        self.manifest[name] = keep

    # -- ending ---------------------------------------------------------------------------

    def commit(self) -> int:
        version = self.base.version + 1
        try:
            if not self.store.files.create(f"manifest-{version}.json", json.dumps(self.manifest)):
                raise StoreError(f"version {version} exists already")
        finally:
            self._unlock()
        return version

    def abort(self) -> None:
        live = {p["path"].split("/")[0] for parts in self.base.manifest.values() for p in parts}
        for parts in self.manifest.values():
            for where in {p["path"].split("/")[0] for p in parts} - live:
                self.store.files.delete(where)
        self._unlock()

    def _unlock(self) -> None:
        self.open = False
        for where in self.staged:
            self.store.files.delete(where)
        self.store.files.delete("LOCK")


def _plain(v):
    return bytes(v) if isinstance(v, bytearray) else v

