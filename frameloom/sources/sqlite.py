"""SQLite files as a Python data source, read and written: spark.read.format("sqlite"), df.write.format("sqlite").

Options of a read: path, table (or the first that exists of a comma-separated
list), partitions (ranges of rowid read in parallel, 8 unless given), columns
(a JSON list; all unless given). Columns come with _rowid, the insertion order.
`where`, a JSON list of (column, operator, value), is evaluated inside SQLite.
Both are options, as what Spark 4.1 pushes into a Python source stays with the
table: a later read of the same DataFrame without the filter would lose rows.
The file must be visible to the executors.

A write makes one file for each partition in a folder. A task writes a file of
its own name aside; only what the commit names is renamed into the folder, so a
task that dies, or runs twice, leaves nothing there. `gather` joins these files
into one inside SQLite and puts it in place by one rename.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import sys
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import islice

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

OPS = ("=", "<>", "<", "<=", ">", ">=")


def _open(path: str) -> closing:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """Names of all tables but the system's."""
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def columns(path: str, table: str) -> list[tuple[str, str, bool]]:
    """Name, declared type and whether it is part of the primary key, of each column."""
    with _open(path) as db:
        return [(r[1], r[2] or "", r[5] > 0) for r in db.execute(f"PRAGMA table_info({quoted(table)})")]


def surrogate_keys(path: str, table: str) -> list[str]:
    """Columns of the primary key that say nothing but the row's number: all but animal and frame."""
    return [c for c, _, key in columns(path, table) if key and c not in ("ANIMALID", "FRAMENUMBER")]


def with_rowid(have: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    """The columns, after _rowid unless the table has one of its own."""
    return have if any(c[0] == "_rowid" for c in have) else [("_rowid", "INTEGER", False), *have]


def _kind(declared: str) -> str:
    d = declared.upper()
    return "bigint" if "INT" in d else "double" if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "binary" if "BLOB" in d else "string"


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, partitions: int, where: list[tuple], wanted: list[str] | None) -> None:
        self.path, self.table, self.parts = path, table, partitions
        have = [c for c in with_rowid(columns(path, table)) if wanted is None or c[0] in wanted]
        self.names, self.kinds = [c[0] for c in have], [_kind(c[1]) for c in have]
        self.own_rowid = any(c[0] == "_rowid" for c in columns(path, table))
        self.where, self.values = [], []
        for name, op, value in where:
            if name not in [c[0] for c in with_rowid(columns(path, table))] or op not in OPS:
                raise ValueError(f"cannot filter by {name} {op}")
            self.where.append(f"{self.column(name)} {op} ?")
            self.values.append(value)

    def column(self, name: str) -> str:
        return "rowid" if name == "_rowid" and not self.own_rowid else quoted(name)

    def partitions(self) -> list[Range]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(1, 0)]  # of no rows; without any, Spark reads one that is None
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        cast = {"bigint": int, "double": float, "string": str, "binary": bytes}
        make = [cast[k] for k in self.kinds]
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {', '.join(map(self.column, self.names))} FROM {quoted(self.table)} WHERE {where}", [partition.low, partition.high, *self.values]):
                yield tuple(None if v is None else f(v) for f, v in zip(make, row, strict=True))


@dataclass
class Shard(WriterCommitMessage):
    """A file that a task has written, and the partition that it holds."""

    path: str
    partition: int


class SqliteWriter(DataSourceWriter):
    def __init__(self, folder: str, table: str, ddl: str, width: int, overwrite: bool) -> None:
        self.folder, self.table, self.ddl, self.overwrite = folder, table, ddl, overwrite
        self.insert = f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * width)})"
        self.aside = os.path.join(folder, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Shard:
        os.makedirs(self.aside, exist_ok=True)
        own = os.path.join(self.aside, f"{uuid.uuid4().hex}.sqlite")
        with closing(sqlite3.connect(own)) as db:
            db.execute(self.ddl)
            rows = (tuple(r) for r in iterator)
            while some := list(islice(rows, 10_000)):
                db.executemany(self.insert, some)
            db.commit()
        return Shard(own, TaskContext.get().partitionId())

    def commit(self, messages: list[Shard | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
                if name.endswith(".sqlite"):
                    os.remove(os.path.join(self.folder, name))
        write = uuid.uuid4().hex[:8]
        for m in messages:
            if m is not None:
                os.replace(m.path, os.path.join(self.folder, f"part-{m.partition:05d}-{write}.sqlite"))
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[Shard | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> str:
        wanted = [t.strip() for t in self.options["table"].split(",")]
        have = tables(self.options["path"])
        for t in wanted:
            if t in have:
                return t
        raise ValueError(f"none of the tables {wanted} in {self.options['path']}")

    def schema(self) -> str:
        wanted = json.loads(self.options.get("columns", "null"))
        return ", ".join(f"`{n}` {_kind(k)}" for n, k, _ in with_rowid(columns(self.options["path"], self._table())) if wanted is None or n in wanted)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self._table(), int(self.options.get("partitions", 8)), json.loads(self.options.get("where", "[]")), json.loads(self.options.get("columns", "null")))

    def writer(self, schema, overwrite: bool) -> SqliteWriter:
        kinds = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        return SqliteWriter(self.options["path"], self.options["table"], self.options.get("ddl") or created(self.options["table"], kinds), len(kinds), overwrite)


def _register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.dataSource.register(Sqlite)


def read(spark: SparkSession, path: str, table: str, require: tuple[str, ...] = (), not_empty: bool = False, where: tuple[tuple, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """A table, or the first that exists of several, or its columns `only`; missing columns or rows are an error where asked for."""
    _register(spark)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("where", json.dumps(where))
    df = (reader if only is None else reader.option("columns", json.dumps(only))).load()
    if missing := [c for c in require if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    if not_empty and not df.limit(1).count():
        raise ValueError(f"{table} is empty")
    return df


def created(table: str, kinds: list[tuple[str, str]]) -> str:
    """The statement that makes a table of Spark's columns."""
    of = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER", "binary": "BLOB"}
    other = "TEXT"
    return f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(n)} {of.get(k, other)}' for n, k in kinds)})"


def definitions(path: str, table: str) -> list[str]:
    """The statements that make a table, then those of its indexes."""
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT sql FROM sqlite_master WHERE tbl_name = ? AND type IN ('table', 'index') AND sql IS NOT NULL ORDER BY type DESC, name", [table])]


def gather(shards: dict[str, str], path: str, ddl: dict[str, list[str]], replace: tuple[str, ...] = ()) -> None:
    """One file of the tables in folders of shards: beside what `path` has already, without the tables of `replace`; in place by one rename, so a failure leaves the file as it was.

    Rows pass from file to file inside SQLite, not through Python.
    """
    new = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        if os.path.exists(path):
            shutil.copyfile(path, new)
        with closing(sqlite3.connect(new, isolation_level=None)) as db:
            for table in replace:
                db.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
            for table, folder in shards.items():
                make, *indexes = ddl[table]
                db.execute(make)
                for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
                    if name.endswith(".sqlite"):
                        db.execute("ATTACH DATABASE ? AS shard", [os.path.join(folder, name)])
                        db.execute(f"INSERT INTO main.{quoted(table)} SELECT * FROM shard.{quoted(table)}")
                        db.execute("DETACH DATABASE shard")
                for index in indexes:
                    db.execute(index)
        os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.remove(new)


def save(df: DataFrame, folder: str, table: str, ddl: str | None = None, overwrite: bool = False) -> None:
    """A table as one SQLite file per partition, in a folder that driver and executors share."""
    _register(df.sparkSession)
    out = df.write.format("sqlite").option("path", folder).option("table", table).mode("overwrite" if overwrite else "append")
    (out.option("ddl", ddl) if ddl else out).save()


def write(df: DataFrame, path: str, table: str, overwrite: bool = False) -> None:
    """A table of one SQLite file: tasks write shards beside it, which are joined and removed. A table that is there is an error unless overwritten."""
    if os.path.exists(path) and table in tables(path) and not overwrite:
        raise ValueError(f"{path} has a table {table}")
    make = created(table, df.dtypes)
    _copied(path, {table: (df, [make])}, (table,) if overwrite else ())


def _copied(path: str, parts: dict[str, tuple[DataFrame, list[str]]], replace: tuple[str, ...] = ()) -> None:
    """Writes tables, each with its statements, to shards and gathers them."""
    aside = f"{path}.shards-{uuid.uuid4().hex}"
    try:
        folders = {t: os.path.join(aside, str(k)) for k, t in enumerate(parts)}
        for t, (df, ddl) in parts.items():
            save(df, folders[t], t, ddl[0])
        gather(folders, path, {t: ddl for t, (_, ddl) in parts.items()}, replace)
    finally:
        shutil.rmtree(aside, ignore_errors=True)


def cut_file(spark: SparkSession, source: str, target: str, first: int, last: int) -> dict[str, int]:
    """A file with all tables of another, as they were made, with the rows from one frame to another; tables without frames stay whole. Rows of each table.

    Ranges of rows are read by tasks, where SQLite itself leaves out other frames; keys, types and indexes are those of the source.
    """
    if int(first) > int(last):
        raise ValueError("the first frame is after the last")
    if os.path.exists(target):
        raise ValueError(f"{target} exists")
    parts = {}
    for t in tables(source):
        names = [c[0] for c in columns(source, t)]
        frames = (("FRAMENUMBER", ">=", int(first)), ("FRAMENUMBER", "<=", int(last))) if "FRAMENUMBER" in names else ()
        parts[t] = (read(spark, source, t, where=frames, only=tuple(names)).select(*[f"`{n}`" for n in names]), definitions(source, t))
    _copied(target, parts)
    with _open(target) as db:
        return {t: db.execute(f"SELECT count(*) FROM {quoted(t)}").fetchone()[0] for t in parts}
