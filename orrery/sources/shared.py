"""A warehouse in one file of a folder that the driver and all executors share, by Python's DB-API.

An embedded JDBC database lives in the one JVM that opened it; executors of their own can't reach it.
SQLite's file can be opened by any process, and its locks order them: tasks write and read it themselves,
a partition in a transaction. The folder must be a file system (or a mount of one) that has locks."""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import LoadError

#: Columns that are stored, by their types here; others are an error.
TYPES = {"int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "string": "TEXT"}
#: Seconds that a task waits for another one's transaction, and rows read at a time.
PATIENCE, ROWS = 3600, 20_000


def _listed(column: pa.Array) -> list:
    """A column's values; numpy's way is many times faster, but has no numbers that are null."""
    if column.null_count and not pa.types.is_string(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


@contextlib.contextmanager
def _opened(path: str) -> Iterator[sqlite3.Connection]:
    found = sqlite3.connect(path, timeout=PATIENCE, isolation_level=None)
    try:
        yield found
    finally:
        found.close()


@contextlib.contextmanager
def _transaction(path: str) -> Iterator[sqlite3.Connection]:
    """All that is written in it, or nothing."""
    with _opened(path) as found:
        found.execute("BEGIN IMMEDIATE")
        try:
            yield found
        except BaseException:
            found.execute("ROLLBACK")
            raise
        found.execute("COMMIT")


def local_path(uri: str) -> str:
    """The path of a folder that is given with or without file:."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: a database file needs a folder in a file system that all processes mount")
    return unquote(parts.path)


@dataclass(frozen=True)
class Warehouse:
    """The database in the file at path."""

    path: str

    def run(self, statement: str) -> list[tuple]:
        with _opened(self.path) as found:
            return found.execute(statement).fetchall()

    def is_there(self, name: str) -> bool:
        return bool(self.run(f"SELECT 1 FROM sqlite_master WHERE name = '{name}'"))

    def schema(self, source: str) -> T.StructType:
        named = {stored: kind for kind, stored in TYPES.items()}
        return T.StructType.fromDDL(", ".join(f"`{c[1]}` {named[c[2].upper()]}" for c in self.run(f"PRAGMA table_info({source})")))

    def load(self, df: DataFrame, name: str) -> int:
        """Replace a table's rows, keeping the table. The number of rows, counted as tasks write them,
        each its partition in one transaction; a NaN, which the database lacks, is an error."""
        columns = ", ".join(f'"{f.name}" {TYPES[f.dataType.simpleString()]}' for f in df.schema.fields)
        with _transaction(self.path) as found:
            found.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
            found.execute(f"DELETE FROM {name}")
        path, statement = self.path, f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})"

        def write(batches):
            batches = (b for b in batches if b.num_rows)
            first = next(batches, None)  # what comes before it is done outside the lock
            if first is None:
                return
            rows = 0
            with _transaction(path) as found:
                for batch in chain([first], batches):
                    for column in batch.columns:
                        if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
                            raise ValueError(f"{name}: NaN can't be stored")
                    found.executemany(statement, zip(*map(_listed, batch.columns), strict=True))
                    rows += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

        return df.mapInArrow(write, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def load_whole(self, df: DataFrame, name: str) -> int:
        """Replace a table's rows, all or none, as sinks.load_whole does: readers see a view over two
        tables, and one statement, after the rows of the other one are counted, makes them count."""
        slot = f"{name}_slot"
        if not self.is_there(slot):
            with _transaction(self.path) as found:
                found.execute(f"CREATE TABLE IF NOT EXISTS {slot} AS SELECT 0 AS slot")
        now = self.run(f"SELECT slot FROM {slot}")[0][0]
        other = 1 - now
        wrote = self.load(df, f"{name}_{other}")
        there = self.run(f"SELECT count(*) FROM {name}_{other}")[0][0]
        if there != wrote:
            raise LoadError(f"{name}: {wrote} rows went out, {there} are there; the old rows still count")
        if not self.is_there(f"{name}_{now}"):
            self.load(df.limit(0), f"{name}_{now}")
        with _transaction(self.path) as found:
            sides = [f"SELECT * FROM {name}_{k} WHERE EXISTS (SELECT 1 FROM {slot} WHERE slot = {k})" for k in (0, 1)]
            found.execute(f"CREATE VIEW IF NOT EXISTS {name} AS {' UNION ALL '.join(sides)}")
            found.execute(f"UPDATE {slot} SET slot = {other}")
        return wrote

    def read(self, spark: SparkSession, source: str, predicates: Sequence[str] = ("1 = 1",), columns: str = "*") -> DataFrame:
        """A table's or view's rows, a task for each predicate; or some of its columns."""
        schema = self.schema(source)
        if columns != "*":
            schema = T.StructType([schema[c.strip('" ')] for c in columns.split(",")])
        path, held = self.path, [f"SELECT {columns} FROM {source} WHERE {p}" for p in predicates]
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        fields = [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields]

        def fetch(batches):
            for number in (n for b in batches for n in b.column(0).to_pylist()):
                with _opened(path) as found:
                    cursor = found.execute(held[number])
                    while some := cursor.fetchmany(ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*some, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        return spark.range(0, len(held), 1, len(held)).mapInArrow(fetch, schema)

    def row_ranges(self, table: str, readers: int) -> list[str]:
        """Conditions that share out a table's rows by their numbers, none twice."""
        most = self.run(f"SELECT coalesce(max(rowid), 0) FROM {table}")[0][0]
        steps = [most * k // readers for k in range(readers + 1)]
        return [f"rowid > {a} AND rowid <= {b}" for a, b in zip(steps, steps[1:], strict=False)]
