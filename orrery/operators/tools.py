"""Aids around the engine: comparing tables, scaling raw files, reading plans, event logs, cards."""

from __future__ import annotations

import contextlib
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate
from statistics import median

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TOLERANCE = 1e-9


def differences(old: Mapping[str, tuple], new: Mapping[str, tuple], tolerance: float = TOLERANCE) -> list[str]:
    """What differs between two sets of snapshots (rows as JSON, schema), by table; numbers with a
    fraction may differ by a relative tolerance."""
    found = [f"{name}: only in the {'old' if name in old else 'new'}" for name in sorted(old.keys() ^ new.keys())]
    for name in sorted(old.keys() & new.keys()):
        (rows, schema), (other_rows, other_schema) = old[name], new[name]
        if list(map(list, schema)) != list(map(list, other_schema)):
            found.append(f"{name}: schema")
        elif len(rows) != len(other_rows):
            found.append(f"{name}: {len(rows)} rows, {len(other_rows)} rows")
        else:
            for k, (a, b) in enumerate(zip(rows, other_rows, strict=True)):
                a, b = json.loads(a), json.loads(b)
                bad = [c for c in a if not _alike(a[c], b.get(c), tolerance)]
                if bad:
                    found.append(f"{name}: row {k}, {', '.join(bad)}")
                    break
    return found


def _alike(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return math.isclose(a, b, rel_tol=tolerance)
    return a == b


def _differs(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    """Whether two values do: nulls equal nulls, NaN equals NaN, fractions within a relative tolerance."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        size = F.greatest(F.abs(a), F.abs(b))
        near = (a == b) | (F.abs(a - b) <= tolerance * size) & (size < math.inf)  # Spark's NaN is above infinity, and equals itself
        return ~F.coalesce(near, a.isNull() & b.isNull())
    return ~a.eqNullSafe(b)


def early_difference(old: DataFrame, new: DataFrame, name: str, rows: int | None = None) -> str | None:
    """What first_difference says of two tables whose schema or number of rows differs, told without
    numbering their rows; else None. The old table's number of rows may be given."""
    if old.schema.simpleString() != new.schema.simpleString():
        return f"{name}: schema"
    counts = old.count() if rows is None else rows, new.count()
    return None if counts[0] == counts[1] else f"{name}: {counts[0]} rows, {counts[1]} rows"


def first_difference(old: DataFrame, new: DataFrame, name: str, tolerance: float = TOLERANCE) -> DataFrame:
    """One row, differs: what differs first between two tables whose rows are numbered (`place`): their
    schema, their number of rows, or the columns of the first row that differs; empty if nothing does.

    Rows meet by their number, which spreads them evenly; the first difference is a minimum over
    the tasks. Nothing but that row passes the driver."""
    spark = old.sparkSession
    a, b = old.drop("place").schema, new.drop("place").schema
    if a.simpleString() != b.simpleString():
        return spark.range(1).select(F.lit(f"{name}: schema").alias("differs"))
    left = old.select("place", *[F.col(f"`{f.name}`").alias(f"a{i}") for i, f in enumerate(a.fields)])
    right = new.select("place", *[F.col(f"`{f.name}`").alias(f"b{i}") for i, f in enumerate(b.fields)])
    both = left.withColumn("in_old", F.lit(1)).join(right.withColumn("in_new", F.lit(1)), "place", "full")
    bad = F.concat_ws(", ", *[F.when(_differs(F.col(f"a{i}"), F.col(f"b{i}"), f.dataType, tolerance), f.name) for i, f in enumerate(a.fields)])
    # the number of rows is looked at first
    found = both.select("in_old", "in_new", F.when(bad != "", F.struct("place", bad.alias("bad"))).alias("row"))
    found = found.agg(F.count("in_old").alias("old"), F.count("in_new").alias("new"), F.min("row").alias("row"))
    rows = F.concat(F.lit(f"{name}: "), F.col("old").cast("string"), F.lit(" rows, "), F.col("new").cast("string"), F.lit(" rows"))
    row = F.concat(F.lit(f"{name}: row "), F.col("row.place").cast("string"), F.lit(", "), F.col("row.bad"))
    return found.select(F.when(F.col("old") != F.col("new"), rows).otherwise(F.coalesce(row, F.lit(""))).alias("differs"))


#: Types (and decimals) of leading columns that rows may meet by: their values are alike only if equal.
MEETING = (T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DateType(), T.BinaryType(), T.StringType())
#: Rows of the old table that show how its keys lie, about, and characters of a key that they show.
SHOWN, SHOWN_CHARACTERS = 4_000, 100
#: Rows that may share a key; beyond that rows are numbered in the whole table.
SHARED_KEY = 1_000_000
#: Tables are compared in so many ranges of keys at most, one after the other, of so many rows at least; rows of
#: all tables that a task compares, about.
ROUNDS, ROUND_ROWS, TASK_ROWS = 8, 5_000_000, 500_000


def first_differences(old: DataFrame, news: Mapping[str, DataFrame], name: str, numbered: Callable[[DataFrame], DataFrame], tolerance: float = TOLERANCE) -> dict[str, str]:
    """What first_difference says of a table and each of several others, with nothing numbered or written
    where that can be told without.

    Rows of the same leading columns (the key; no fractions) stand together in the canonical order. Up to the
    first key that is there more often on one side, rows of the same key meet in their order, and there the
    tables differ for certain. So each table is shuffled once, by key, for all comparisons. It goes range of
    keys by range of keys, whose shuffle files are removed at their end; a table that differs is left out of
    the ranges to come. Where a key has too many rows, or the first column no such type, rows get numbers. Keys
    are judged by the old table; if only another has one with very many rows, one task sorts those."""
    with _shuffles_removed(old.sparkSession):
        rows = old.count()
        found = {copy: early_difference(old, new, name, rows) for copy, new in news.items()}
        left = {copy: news[copy] for copy, early in found.items() if early is None} if rows else {}
        keys, bounds = _key_ranges(old, rows) if left else ([], [])
        if left and not keys:
            places = numbered(old)
            return found | {copy: first_difference(places, numbered(new), name, tolerance).first()[0] for copy, new in left.items()}
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            if not left:
                break
            first = _first_in_range(old, left, keys, low, high, rows / (len(bounds) + 1), tolerance)
            for copy in [c for c in left if first[c]]:
                found[copy] = _told(old, left.pop(copy), keys, first[copy], name, tolerance)
        return {copy: said or "" for copy, said in found.items()}


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when it has ended, not when the driver's JVM collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _handed(column: Column, kind: T.DataType) -> Column:
    """A key's value as the driver gets it: strings by their bytes."""
    return column.cast("binary") if kind == T.StringType() else column


def _before(keys: Sequence[T.StructField], values: Sequence) -> Column:
    """Whether a row's key comes before these values, nulls first."""
    own = F.struct(*[F.col(f"`{k.name}`").alias(f"k{i}") for i, k in enumerate(keys)])
    given = [F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(k.dataType) for k, v in zip(keys, values, strict=True)]
    return own < F.struct(*[v.alias(f"k{i}") for i, v in enumerate(given)])


def _key_ranges(df: DataFrame, rows: int) -> tuple[list[T.StructField], list[tuple]]:
    """The fewest leading columns whose values few rows share, none if there are no such, and bounds of
    ranges of them with about as many rows each. Both by some rows, and nothing but time hangs on them."""
    exact: list[T.StructField] = []
    for f in df.schema.fields:
        if f.dataType not in MEETING and not isinstance(f.dataType, T.DecimalType):
            break
        exact.append(f)
    if not exact:
        return [], []
    shown = [F.col(f"`{f.name}`") for f in exact]
    shown = [F.substring(c, 1, SHOWN_CHARACTERS) if f.dataType in (T.BinaryType(), T.StringType()) else c for c, f in zip(shown, exact, strict=True)]
    some = df.select(*[c.alias(f"k{i}") for i, c in enumerate(shown)]).sample(min(1.0, SHOWN / rows), seed=1)
    some = some.orderBy(*[F.col(c).asc_nulls_first() for c in some.columns])
    some = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in some.select(*[_handed(F.col(c), f.dataType) for c, f in zip(some.columns, exact, strict=True)]).collect()]
    for n in range(1, len(exact) + 1):
        values = [r[:n] for r in some]
        if rows <= SHARED_KEY or values and max(Counter(values).values()) <= max(3, SHARED_KEY * len(values) / rows):
            rounds = min(ROUNDS, math.ceil(rows / ROUND_ROWS))
            return exact[:n], list(dict.fromkeys(values[len(values) * k // rounds] for k in range(1, rounds))) if values else []
    return [], []


def _first_in_range(old: DataFrame, news: Mapping[str, DataFrame], keys: Sequence[T.StructField], low: tuple | None, high: tuple | None, rows: float, tolerance: float) -> Row:
    """For each of news the first row in a range of keys that differs, or is on one side only: its key (k0...),
    number among the rows of that key (nth, from 1), columns that differ (bad); null if there is none."""
    spark, fields = old.sparkSession, old.schema.fields
    key, rest = [f"c{i}" for i in range(len(keys))], [(f"c{i}", f) for i, f in enumerate(fields)][len(keys) :]
    tasks = max(math.ceil(rows * (len(news) + 1) / TASK_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(rows / 10_000)))

    def dealt(df: DataFrame, side: int) -> DataFrame:
        if low is not None:
            df = df.where(~_before(keys, low))
        if high is not None:
            df = df.where(_before(keys, high))
        df = df.repartition(tasks, *[F.col(f"`{k.name}`") for k in keys])
        return df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)], F.lit(side).alias("side"))

    rows_of_all = reduce(DataFrame.union, [dealt(df, side) for side, df in enumerate([old, *news.values()])])
    order = Window.partitionBy(*key, "side").orderBy(*[F.col(c).asc_nulls_first() for c, _ in rest] or ["side"])
    met = rows_of_all.withColumn("nth", F.row_number().over(order)).groupBy(*key, "nth")
    row = F.struct(F.lit(True).alias("there"), *[c for c, _ in rest])
    met = met.agg(*[F.first(F.when(F.col("side") == side, row), ignorenulls=True).alias(f"s{side}") for side in range(len(news) + 1)])
    firsts = []
    for side, copy in enumerate(news, 1):
        bad = F.concat_ws(", ", *[F.when(_differs(F.col(f"s0.{c}"), F.col(f"s{side}.{c}"), f.dataType, tolerance), f.name) for c, f in rest])
        one = F.col("s0").isNull() != F.col(f"s{side}").isNull()
        both = F.col("s0").isNotNull() & F.col(f"s{side}").isNotNull()
        own = [_handed(F.col(c), k.dataType).alias(f"k{i}") for i, (c, k) in enumerate(zip(key, keys, strict=True))]
        where = F.struct(*own, "nth", F.when(both, bad).alias("bad"), F.col("s0").isNotNull().alias("in_old"))
        firsts.append(F.min(F.when(one | both & (bad != ""), where)).alias(copy))
    return met.agg(*firsts).first()


def _told(old: DataFrame, new: DataFrame, keys: Sequence[T.StructField], first: Row, name: str, tolerance: float) -> str:
    """What is said of a first row that differs: its place, and the columns. Of a row that one side hasn't
    got, they are those in which it differs from what stands in its place there, the next key's first row."""
    values, bad = first[: len(keys)], first.bad
    before = _before(keys, values)
    if bad is None:
        has, hasnt = (old, new) if first.in_old else (new, old)
        row = F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(old.schema.fields)])
        same = reduce(Column.__and__, [F.col(f"`{k.name}`").eqNullSafe(F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(k.dataType)) for k, v in zip(keys, values, strict=True)])
        order = Window.orderBy("row")
        nth = has.where(same).select(row.alias("row")).select("row", F.row_number().over(order).alias("nth")).where(F.col("nth") == first.nth).select(F.col("row").alias("a"))
        after = hasnt.where(~before & ~same).agg(F.min(row).alias("b"))
        sides = [_differs(F.col(f"a.c{i}"), F.col(f"b.c{i}"), f.dataType, tolerance) for i, f in enumerate(old.schema.fields)]
        bad = nth.crossJoin(after).select(F.concat_ws(", ", *[F.when(d, f.name) for d, f in zip(sides, old.schema.fields, strict=True)])).first()[0]
    return f"{name}: row {old.where(before).count() + first.nth - 1}, {bad}"


def copies(df: DataFrame, times: int, suffixed: Sequence[str] = (), shifted: Mapping[str, int] | None = None) -> DataFrame:
    """df several times over, with keys of their own: copy k appends -x<k> to suffixed columns and adds
    k times a step to shifted ones. Null and empty keys stay; a number that leaves its column's type
    is an error of the job. Each task multiplies its own rows; nothing is shuffled."""
    number = "orrery_copy"
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(number))
    k, made = F.col(number), {}
    for name in suffixed:
        key = F.col(f"`{name}`")
        made[name] = F.when((k > 0) & (key != ""), F.concat(key, F.lit("-x"), k.cast("string"))).otherwise(key)
    for name, step in (shifted or {}).items():
        key, kind = F.col(f"`{name}`"), df.schema[name].dataType
        moved = key.cast("decimal(38,0)") + k * F.lit(step).cast("decimal(20,0)")
        said = F.concat(F.lit(f"{name} "), key.cast("string"), F.lit(" in copy "), k.cast("string"), F.lit(" leaves its type"))
        made[name] = F.when(key.isNull(), None).otherwise(F.coalesce(moved.try_cast(kind), F.raise_error(said).cast(kind)))
    return out.withColumns(made).drop(number)


@dataclass(frozen=True)
class PlanFeatures:
    joins: dict[str, int]
    exchanges: dict[str, int]
    sorts: int
    windows: int
    python: int
    scans: tuple[str, ...]
    #: What adaptive execution made of the shuffles that it read: coalesced, skewed, local.
    adaptive: dict[str, int] = field(default_factory=dict)


def plan_features(df: DataFrame) -> PlanFeatures:
    """Join strategies, exchanges by kind, and what scans read, of a frame's physical plan; of the
    final plan if it has been run."""
    return features_of_text(df._jdf.queryExecution().executedPlan().toString())


def features_of_text(plan: str) -> PlanFeatures:
    plan = plan.split("== Initial Plan ==")[0]

    def counts(pattern: str) -> dict[str, int]:
        return dict(Counter(re.findall(pattern, plan)))

    def count(pattern: str) -> int:
        return len(re.findall(pattern, plan))

    joins = counts(r"\b(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)\b")
    reads = Counter(word for text in re.findall(r"AQEShuffleRead (.*)", plan) for word in re.findall(r"coalesced|skewed|local", text))
    return PlanFeatures(
        joins, counts(r"\b(?:Broadcast)?Exchange (\w+)"), count(r"(?<!Take)\bSort \["), count(r"\bWindow \["), count(r"Python|Pandas|Arrow"),
        tuple(re.findall(r"ReadSchema: struct<([^>]*)>", plan)), dict(reads),
    )


@dataclass
class ActionReport:
    """One SQL execution: what it was, from its start to its end, its jobs, and the features of the
    plan that it ended with."""

    execution: int
    description: str
    wall_s: float
    jobs: int
    plan: PlanFeatures


def actions_of_event_log(lines: Iterable[str]) -> list[ActionReport]:
    """The SQL executions of a Spark event log, slowest first. Adaptive execution reports its plan
    anew as it changes; the last one counts."""
    started, ended, plans, jobs = {}, {}, {}, Counter()
    for event in map(json.loads, lines):
        kind = event["Event"].rpartition(".")[2]
        if kind == "SparkListenerSQLExecutionStart":
            started[event["executionId"]] = event["time"], event.get("description") or ""
            plans[event["executionId"]] = event.get("physicalPlanDescription") or ""
        elif kind == "SparkListenerSQLAdaptiveExecutionUpdate":
            plans[event["executionId"]] = event.get("physicalPlanDescription") or ""
        elif kind == "SparkListenerSQLExecutionEnd":
            ended[event["executionId"]] = event["time"]
        elif kind == "SparkListenerJobStart":
            execution = (event.get("Properties") or {}).get("spark.sql.execution.id")
            if execution is not None:
                jobs[int(execution)] += 1
    made = [
        ActionReport(i, description, (ended[i] - time) / 1000, jobs[i], features_of_text(plans[i])) for i, (time, description) in started.items() if i in ended
    ]
    return sorted(made, key=lambda r: -r.wall_s)


@dataclass
class StageReport:
    stage: int
    name: str
    tasks: int
    wall_s: float
    longest_s: float
    median_s: float
    spill_mb: float
    shuffle_mb: float
    gc_s: float


def stages_of_event_log(lines: Iterable[str]) -> list[StageReport]:
    """The stages of a Spark event log, slowest first, with skew (longest and median task), spill
    and garbage collection."""
    tasks, spans = defaultdict(list), {}
    for line in lines:
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd":
            tasks[event["Stage ID"]].append(event.get("Task Metrics") or {})
        elif event["Event"] == "SparkListenerStageCompleted":
            info = event["Stage Info"]
            spans[info["Stage ID"]] = (info["Stage Name"], (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000)
    out = []
    for stage, (name, wall) in spans.items():
        times = [m.get("Executor Run Time", 0) / 1000 for m in tasks[stage]] or [0.0]
        out.append(
            StageReport(
                stage, name, len(tasks[stage]), wall, max(times), median(times), sum(m.get("Disk Bytes Spilled", 0) for m in tasks[stage]) / 1e6,
                sum((m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0) for m in tasks[stage]) / 1e6, sum(m.get("JVM GC Time", 0) for m in tasks[stage]) / 1000,
            )
        )
    return sorted(out, key=lambda r: -r.wall_s)


@dataclass(frozen=True)
class CardText:
    title: str
    display: str
    width: int
    height: int
    settings: dict
    about: str
    sql: str


def read_card(title: str, text: str) -> CardText:
    """A report file: comment lines display, size (columns x rows) and settings (JSON), then the
    description, then the query."""
    head = {"display": "table", "size": "24x8", "settings": "{}"}
    about, lines = [], text.strip().splitlines()
    while lines and lines[0].startswith("--"):
        line = lines.pop(0)[2:].strip()
        key, colon, value = line.partition(":")
        if colon and key.strip() in head and not about:
            head[key.strip()] = value.strip()
        elif line:
            about.append(line)
    width, height = map(int, head["size"].lower().split("x"))
    if not lines:
        raise ValueError(f"{title}: no query")
    return CardText(title, head["display"], width, height, json.loads(head["settings"]), " ".join(about), "\n".join(lines).strip().rstrip(";"))


def shelves(cards: Sequence[CardText], columns: int = 24) -> list[list[CardText]]:
    """The cards in order, as many on each shelf as its width holds."""
    filled: list[list[CardText]] = []
    for card in cards:
        if not filled or sum(c.width for c in filled[-1]) + card.width > columns:
            filled.append([])
        filled[-1].append(card)
    return filled


def place_cards(cards: Sequence[CardText], columns: int = 24) -> list[tuple[int, int]]:
    """(column, row) of each card: a shelf stands below the highest card of the one before it."""
    filled = shelves(cards, columns)
    tops = accumulate((max(c.height for c in shelf) for shelf in filled), initial=0)
    return [(left, top) for shelf, top in zip(filled, tops, strict=False) for left in accumulate((c.width for c in shelf[:-1]), initial=0)]
