"""Records that span lines, read by many tasks: CSV with line breaks in quotes, JSON arrays.

Spark's text source deals a file out by byte ranges, and ends each at a separator; but a separator
may lie within a record. Whether a range begins inside quotes depends on all before it. So a first
pass finds, for each range, what it makes of either state that it may begin in; these functions,
a few numbers a range, are composed in the file's order; and a second pass, in which every task knows the
state that it begins in, cuts records at their true ends. What a range holds of records that begin
before it or end after it is put together in a third step, from those fragments alone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges whose states the driver composes: at Spark's usual 128 MB, some 100 TB.
MOST_RANGES = 1_000_000


class CsvRecords:
    """Units are lines. A field is quoted if it begins with a quote; inside quotes a backslash
    escapes, and two quotes stand for one."""

    separator, glue, nested = "\n", "\n", False
    _closing = re.compile(r'[^"\\]*+(?:\\.?+[^"\\]*+)*+"', re.S)

    def step(self, unit: str, inside: bool) -> tuple[bool, int]:
        """Whether what follows the unit is inside quotes, if what comes before it is (or isn't)."""
        if '"' not in unit and not inside:
            return False, 0
        at = 0
        while True:
            if not inside:  # at the beginning of a field
                if not unit.startswith('"', at):
                    at = unit.find(",", at) + 1
                    if not at:
                        return False, 0
                    continue
                at += 1
            closed = self._closing.match(unit, at)
            if closed is None:
                return True, 0
            at = closed.end()
            inside = unit.startswith('"', at)  # a doubled quote goes on
            if inside:
                at += 1
                continue
            at = unit.find(",", at) + 1
            if not at:
                return False, 0


class JsonRecords:
    """Units end at closing braces. A record is an object of the array that the file is, or an object
    of its own where it is none."""

    separator, glue, nested = "}", "", True
    _string = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
    _closing = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)

    def step(self, unit: str, inside: bool) -> tuple[bool, int]:
        """Whether what follows is inside a string, and how much deeper it is."""
        if inside:
            closed = self._closing.match(unit)
            if closed is None:
                return True, 0
            unit = unit[closed.end() :]
        if '"' in unit:
            unit = self._string.sub("", unit)
            head, quote, _ = unit.partition('"')
            if quote:
                return True, self._depth(head)
        return False, self._depth(unit)

    @staticmethod
    def _depth(text: str) -> int:
        return text.count("{") + text.count("[") - text.count("}") - text.count("]")


KINDS = {"csv": CsvRecords(), "json": JsonRecords()}


@dataclass(frozen=True)
class Start:
    """What lies before a range: whether it begins inside quotes and how deep, at which depth records
    end, whether it is the first of its file, and whether its last unit has no separator."""

    inside: bool
    depth: int
    level: int
    first: bool
    open_end: bool


def _units(batches, glue: str) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(file, start, size) of each range of a task, and its units."""
    rows = chain.from_iterable(zip(*[b.column(i).to_pylist() for i in range(4)], strict=True) for b in batches)
    held = next(rows, None)
    while held is not None:
        key = held[:3]

        def run(key=key):
            nonlocal held
            while held is not None and held[:3] == key:
                yield held[3]
                held = next(rows, None)

        units = run()
        yield key, units
        for _ in units:  # what was left
            pass


SCAN = "file long, start long, size long, bytes long, bracket boolean, inside0 boolean, depth0 int, inside1 boolean, depth1 int"


def _scanned(kind):
    def run(batches):
        found = []
        for (file, start, size), units in _units(batches, kind.glue):
            ends, depths, count, lead = [False, True], [0, 0], 0, ""
            for unit in units:
                count += len(unit.encode()) + 1
                if len(lead) < 1:
                    lead = unit.lstrip("﻿ \t\r\n")[:1]
                unit += kind.separator if kind.nested else ""
                for k in (0, 1):
                    ends[k], deeper = kind.step(unit, ends[k])
                    depths[k] += deeper
            found.append((file, start, size, count, lead == "[", ends[0], depths[0], ends[1], depths[1]))
        types = [pa.int64()] * 4 + [pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32()]
        columns = list(zip(*found, strict=True)) if found else [()] * len(types)
        names = [f.split()[0] for f in SCAN.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def composed(ranges: list, nested: bool) -> dict[tuple[int, int], Start]:
    """The state that each range begins in, of the scan's rows: those of each file in order, each
    one's function applied to what the one before it left."""
    starts: dict[tuple[int, int], Start] = {}
    by_file: dict[int, list] = {}
    for r in ranges:
        by_file.setdefault(r.file, []).append(r)
    for file, mine in by_file.items():
        mine.sort(key=lambda r: r.start)
        inside, depth, level = False, 0, int(nested and mine[0].bracket)
        over = sum(r.bytes for r in mine) == mine[0].size + 1  # a compressed file has another size
        for k, r in enumerate(mine):
            starts[file, r.start] = Start(inside, depth, level, k == 0, over and k == len(mine) - 1)
            inside, depth = (r.inside1, depth + r.depth1) if inside else (r.inside0, depth + r.depth0)
    return starts


CUT = "file long, start long, place int, leads boolean, value string"


def _cut(kind, starts, fragments: bool):
    """Records of the ranges that lie in them whole; or else the fragments at their beginnings (place 0)
    and ends (place 1). leads marks the first of a file."""

    def walk(key, units):
        s = Start(*starts.value[key])
        inside, depth = s.inside, s.depth
        begun = not s.first and (inside or depth != s.level)
        leads, held = s.first, []
        unit = next(units, None)
        while unit is not None:
            after = next(units, None)
            if kind.nested and not (s.open_end and after is None):
                unit += kind.separator
            inside, deeper = kind.step(unit, inside)
            depth += deeper
            held.append(unit)
            ended = not inside and depth == s.level
            if ended and kind.nested:
                ended = unit.endswith(kind.separator)
            if ended:
                yield (0 if begun else None), leads, kind.glue.join(held)
                leads = leads and begun
                begun, held = False, []
            unit = after
        if held:
            yield (0 if begun else 1), leads, kind.glue.join(held)

    def run(batches):
        for (file, start, _), units in _units(batches, kind.glue):
            rows, size = [], 0
            for place, leads, value in walk((file, start), units):
                if fragments == (place is not None):
                    rows.append((file, start, place, leads, value))
                    size += len(value)
                if len(rows) >= 2000 or size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    names = [f.split()[0] for f in CUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def with_range_bytes(spark: SparkSession, split_bytes: int | None) -> SparkSession:
    """A session with the same settings, but ranges of so many bytes at most, for smaller files."""
    if split_bytes is None:
        return spark
    made = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            made.conf.set(key, value)
    made.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    made.conf.set("spark.sql.files.openCostInBytes", "0")
    return made


def record_texts(spark: SparkSession, path: str, kind: str, split_bytes: int | None = None) -> DataFrame:
    """value: the text of each record of the files at path, in no order; and leads, whether it is the first of its
    file. A CSV record that is empty is none; of JSON, what lies between objects is none, and an
    object without an end is a record, though a broken one."""
    machine = KINDS[kind]
    own = with_range_bytes(spark, split_bytes)
    text = own.read.option("lineSep", machine.separator).text(path)
    units = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")
    ranges = units.mapInArrow(_scanned(machine), SCAN).limit(MOST_RANGES + 1).collect()
    if len(ranges) > MOST_RANGES:
        raise ValueError(f"{path} has over {MOST_RANGES} ranges; raise spark.sql.files.maxPartitionBytes")
    starts = own.sparkContext.broadcast({key: astuple(s) for key, s in composed(ranges, machine.nested).items()})
    whole = units.mapInArrow(_cut(machine, starts, False), CUT).select("value", "leads")
    parts = units.mapInArrow(_cut(machine, starts, True), CUT)
    before = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.last(F.when(F.col("place") == 1, F.col("start")), ignorenulls=True).over(before)
    joined = parts.withColumn("begin", begin).groupBy("file", "begin").agg(F.sort_array(F.collect_list(F.struct("start", "place", "value"))).alias("held"), F.max("leads").alias("leads"))
    joined = joined.select(F.array_join("held.value", machine.glue).alias("value"), "leads")
    return _trimmed(whole.unionByName(joined), machine)


def _trimmed(records: DataFrame, machine) -> DataFrame:
    if not machine.nested:
        bare = records.withColumn("value", F.regexp_replace("value", "\r$", ""))
        return bare.where("value <> ''")
    brace: Column = F.instr("value", "{")
    return records.where(brace > 0).withColumn("value", F.col("value").substr(brace, F.char_length("value")))
