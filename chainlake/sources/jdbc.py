"""The history tier in a SQL database, through Spark's JDBC source. The driver jar is the user's to add.

Executors write a commit's rows into staging tables; one transaction on the driver's connection then
moves them into place, together with every truncation, so readers see all of a commit or nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KeyOrder, ReadOnly, StoreError, UnknownTable
from ..operators.filters import block_range
from ..schema import COLD, TABLES, Table, conform

#: Column types by the first word of the URL's scheme: fixed-length bytes, long bytes, text, booleans, small numbers.
_KINDS = {
    "derby": ("VARCHAR({n}) FOR BIT DATA", "BLOB", "CLOB", "BOOLEAN", "SMALLINT"),
    "postgresql": ("BYTEA", "BYTEA", "TEXT", "BOOLEAN", "SMALLINT"),
    "mysql": ("VARBINARY({n})", "LONGBLOB", "LONGTEXT", "BOOLEAN", "SMALLINT"),
    "sqlite": ("BLOB", "BLOB", "TEXT", "INTEGER", "INTEGER"),
}
_INDEXED = ("block_hash", "tx_hash", "address", "topic0")


def _nested(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.ArrayType)


class JdbcView(Mapping[str, DataFrame]):
    """The tables as they are now: a database has no pinned versions here, so streams check their anchor block instead.

    Filters and column choices are pushed into the database by Spark. With partitions over 1, a table is
    read by ranges of block numbers between the given bounds.
    """

    version = None

    def __init__(self, source: JdbcSource) -> None:
        self.source = source

    def __getitem__(self, name: str) -> DataFrame:
        return self.read(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.source.tables)

    def __len__(self) -> int:
        return len(self.source.tables)

    def read(self, name: str, first: int | None = None, last: int | None = None) -> DataFrame:
        s = self.source
        raw = s.spark.read.format("jdbc").options(**s.reader_options(name)).load()
        made = [(F.from_json(F.col(f.name), f.dataType) if _nested(f) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in s.table(name).schema]
        return block_range(raw.select(*made), first, last)

    def tail(self, name: str) -> DataFrame:
        """The rows of the highest block."""
        top = self.read(name).agg(F.max("block_number")).first()[0]
        return self.read(name, top)


class JdbcSource(Mapping[str, DataFrame]):
    """The history tables of a database; it can be read by name, and offers what any history tier does."""

    def __init__(self, spark: SparkSession, url: str, options: Mapping[str, str] | None = None, partitions: int = 1, first: int = 0, last: int = 0, tables: Iterable[str] = COLD, read_only: bool = False) -> None:
        self.spark, self.url, self.options = spark, url, dict(options or {})
        self.partitions, self.first, self.last = partitions, first, last
        self.tables = {n: TABLES[n] for n in tables}
        self.read_only = read_only

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise UnknownTable(name)
        return self.tables[name]

    def reader_options(self, name: str) -> dict[str, str]:
        self.table(name)
        out = {"url": self.url, "dbtable": name, "fetchsize": "10000", **self.options}
        if self.partitions > 1:
            out |= {"partitionColumn": "block_number", "numPartitions": str(self.partitions), "lowerBound": str(self.first), "upperBound": str(self.last)}
        return out

    def __getitem__(self, name: str) -> DataFrame:
        return self.snapshot()[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    # -- the tier -------------------------------------------------------------------------

    def init(self) -> JdbcSource:
        """Creates the tables and indexes that aren't there."""
        if not self.read_only:
            with _Connection(self) as c:
                for t in self.tables.values():
                    if not c.has(t.name):
                        c.run(self.ddl(t, t.name, keyed=True))
                        for column in _INDEXED:
                            if column in t.schema.names:
                                c.run(f'CREATE INDEX ix_{t.name}_{column} ON {t.name} ({self.quoted(column)})')
        return self

    def snapshot(self, version: int | None = None) -> JdbcView:
        if version is not None:
            raise StoreError("a database keeps no versions")
        return JdbcView(self)

    def writer(self) -> JdbcWriter:
        if self.read_only:
            raise ReadOnly(self.url)
        return JdbcWriter(self)

    @property
    def dialect(self) -> str:
        return self.url.removeprefix("jdbc:").split(":")[0]

    def quoted(self, column: str) -> str:
        mark = "`" if self.dialect == "mysql" else '"'
        return f"{mark}{column}{mark}"

    def hollow(self, t: Table) -> list[str]:
        """Columns whose nulls are staged as no bytes: Spark binds a null of fixed-length bytes in a way that one dialect refuses."""
        return [c for c, _ in t.lengths if c not in t.key] if self.dialect == "derby" else []

    def ddl(self, t: Table, name: str, keyed: bool = False) -> str:
        fixed, long, text, boolean, small = _KINDS.get(self.dialect, _KINDS["postgresql"])
        sizes, parts = dict(t.lengths), []
        for f in t.schema:
            kind = text
            if isinstance(f.dataType, T.LongType):
                kind = "BIGINT"
            elif isinstance(f.dataType, T.BooleanType):
                kind = boolean
            elif isinstance(f.dataType, T.ByteType):
                kind = small
            elif isinstance(f.dataType, T.BinaryType):
                kind = fixed.format(n=sizes[f.name]) if f.name in sizes else long
            parts.append(f"{self.quoted(f.name)} {kind}{' NOT NULL' if f.name in t.key else ''}")
        if keyed:
            parts.append(f"PRIMARY KEY ({', '.join(map(self.quoted, t.key))})")
        return f"CREATE TABLE {name} ({', '.join(parts)})"


class _Connection:
    """A driver-side connection, one transaction: committed at the end, rolled back on an error."""

    def __init__(self, source: JdbcSource) -> None:
        jvm = source.spark._jvm
        if "driver" in source.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(source.options["driver"])
        props = jvm.java.util.Properties()
        for k, v in source.options.items():
            props.setProperty(k, v)
        self.jdbc = jvm.java.sql.DriverManager.getConnection(source.url, props)
        self.jdbc.setAutoCommit(False)

    def __enter__(self) -> _Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            self.jdbc.rollback() if kind else self.jdbc.commit()
        finally:
            self.jdbc.close()

    def run(self, sql: str) -> None:
        s = self.jdbc.createStatement()
        try:
            s.execute(sql)
        finally:
            s.close()

    def number(self, sql: str) -> int | None:
        s = self.jdbc.createStatement()
        try:
            r = s.executeQuery(sql)
            r.next()
            n = r.getLong(1)
            return None if r.wasNull() else n
        finally:
            s.close()

    def has(self, table: str) -> bool:
        found = self.jdbc.getMetaData().getTables(None, None, "%", None)
        while found.next():
            if found.getString("TABLE_NAME").lower() == table:
                return True
        return False


class JdbcWriter:
    """Staged rows and truncations, put in place by commit in one transaction."""

    def __init__(self, source: JdbcSource) -> None:
        self.source = source
        self.staged: dict[str, str] = {}
        self.cuts: dict[str, int] = {}
        self.open = True

    def __enter__(self) -> JdbcWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.open:
            self.abort()

    def read(self, name: str, first: int | None = None, last: int | None = None) -> DataFrame:
        return self.source.snapshot().read(name, first, last)

    def append(self, name: str, df: DataFrame) -> None:
        """Stages rows whose blocks all exceed those present once the commit's truncations are done; commit checks that."""
        s = self.source
        t = s.table(name)
        where = f"{name}_{uuid.uuid4().hex[:12]}"
        with _Connection(s) as c:
            c.run(s.ddl(t, where))
        self.staged[where] = name
        flat = conform(df, t).select(*(F.to_json(f.name).alias(f.name) if _nested(f) else f.name for f in t.schema))
        for c in s.hollow(t):
            flat = flat.withColumn(c, F.coalesce(c, F.lit(bytearray())))
        flat.write.format("jdbc").options(**{"url": s.url, "dbtable": where, **s.options}).mode("append").save()

    def truncate(self, name: str, above: int) -> None:
        self.source.table(name)
        self.cuts[name] = min(above, self.cuts.get(name, above))

    def commit(self) -> None:
        s, n = self.source, self.source.quoted("block_number")
        try:
            with _Connection(s) as c:
                for name, above in self.cuts.items():
                    c.run(f"DELETE FROM {name} WHERE {n} > {int(above)}")
                for where, name in self.staged.items():
                    top, low = c.number(f"SELECT max({n}) FROM {name}"), c.number(f"SELECT min({n}) FROM {where}")
                    if top is not None and low is not None and low <= top:
                        raise KeyOrder(f"{name}: rows at or below block {top}")
                    t = s.table(name)
                    columns, hollow = ", ".join(map(s.quoted, t.schema.names)), s.hollow(t)
                    taken = ", ".join(f"NULLIF({s.quoted(x)}, X'')" if x in hollow else s.quoted(x) for x in t.schema.names)
                    c.run(f"INSERT INTO {name} ({columns}) SELECT {taken} FROM {where}")
        finally:
            self._drop()

    def abort(self) -> None:
        self._drop()

    def _drop(self) -> None:
        self.open = False
        with _Connection(self.source) as c:
            for where in self.staged:
                c.run(f"DROP TABLE {where}")
        self.staged = {}
