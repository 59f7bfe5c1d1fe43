"""What the operators of this package share: column picking, Arrow passes, lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import io
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: a batch of very long texts must fit a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Rows of one key from which on it is joined apart, and how many such keys are broadcast.
HOT_ROWS, BROADCAST_KEYS = 1000, 100_000


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch size for this session; a value that was set stays."""
    given = spark.conf.getAll
    for key, own in (("maxRecordsPerBatch", str(BATCH_ROWS)), ("maxBytesPerBatch", str(BATCH_BYTES))):
        if f"spark.sql.execution.arrow.{key}" not in given:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns names.values() as names.keys(); by position, so that names which differ
    in case only, or that the caller's extra columns share, are no obstacle."""
    columns = df.columns
    positional = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return positional.select(*[F.col(f"_{columns.index(old)}").alias(new) for new, old in names.items()])


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names in spark.checkpoint.dir. Where none is set, a
    folder of our own serves a local session (tests), whose driver and executor are one process;
    on a cluster it would be out of the executors' reach, so that is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; later jobs start there,
    also after executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give memory that is no longer used back to the system: a Python worker lives on after its
    task, and what it holds counts against the executor in the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
    keep_store: bool = False,
) -> DataFrame:
    """df.mapInArrow() in bounded batches. What earlier passes keep in the worker goes, unless this
    one makes use of it."""
    bounded_batches(df.sparkSession)

    def run(batches):
        if not keep_store:
            worker_store().clear()
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    function: Callable[..., Sequence[pa.Array]],
    fields: Sequence[T.StructField],
    drop: Sequence[str] = (),
    keep_store: bool = False,
) -> DataFrame:
    """df with the columns that function(*input arrays) returns for every batch; the columns named
    in drop don't come back from the worker, and one that has a new one's name gives way to it."""
    where = [df.columns.index(name) for name in inputs]
    gone = {*drop, *(field.name for field in fields)}
    keep = [i for i, name in enumerate(df.columns) if name not in gone]
    schema = T.StructType([*(df.schema.fields[i] for i in keep), *fields])
    names = [field.name for field in schema.fields]

    def run(batches):
        for batch in batches:
            made = function(*[batch.column(i) for i in where])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=names)

    return arrow_map(df, run, schema, keep_store)


def replace_column(df: DataFrame, name: str, function: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with function(its array) in the place of a string column, whatever the others' names."""
    names, at = df.columns, df.columns.index(name)
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    made = append_columns(flat, [f"c{at}"], lambda a: [function(a)], [T.StructField("made", T.StringType())], [f"c{at}"])
    return made.select(*["made" if i == at else f"c{i}" for i in range(len(names))]).toDF(*names)


def join_counted(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows joined to few (kept; one row a key, and in n how many rows have it). The keys of over
    HOT_ROWS rows, of which there is one in HOT_ROWS rows at most, are broadcast unless they are
    over BROADCAST_KEYS, so that their rows are joined where they lie and not in one task."""
    hot = few.where(F.col("n") > HOT_ROWS).drop("n")
    if not 0 < hot.count() <= BROADCAST_KEYS:
        return rows.join(few.drop("n"), key)
    hot = F.broadcast(hot)
    others = rows.join(hot.select(key), key, "left_anti").join(few.where(F.col("n") <= HOT_ROWS).drop("n"), key)
    return rows.join(hot, key).unionByName(others)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) drawn from the hash of parts; the same on every run."""
    top = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (top + 0.5) / F.lit(float(1 << 53))


def least_by_hash(df: DataFrame, rows: int, of: int, *parts: str) -> DataFrame:
    """The rows of df, of which there are about so many, with the least hash of parts: a sample
    of at most the given number that is the same on every run. Rows beyond a share of the hashes
    that surely holds enough are dropped where they are read, so what is sorted doesn't grow with
    the table."""
    share = min(1.0, 4 * (rows + 16) / max(1, of))
    draw = uniform(*[F.col(p) for p in parts])
    return df.where(draw <= share).orderBy(draw, *parts).limit(rows)


def fit_in_task(sample: DataFrame, function: Callable[[list[dict]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What function makes of a bounded sample's rows, as arrays. It runs in one task, so neither
    the rows nor the training pass through the driver, and a lost executor means a new attempt."""

    def run(batches):
        held = io.BytesIO()
        np.savez(held, **function([row for batch in batches for row in batch.to_pylist()]))
        release()
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["model"])

    made = arrow_map(sample.repartition(1), run, "model binary").collect()
    if not made:  # a sample that is known to be empty has no task
        return function([])
    with np.load(io.BytesIO(bytes(made[0].model))) as found:
        return {name: found[name] for name in found.files}


def worker_store() -> dict:
    """A dictionary that lives as long as this Python worker, over all its tasks. (The package's
    own modules don't: functions come to each task by value.)"""
    return sys.__dict__.setdefault("_orrery_worker_store", {})


def sound_vectors(column: pa.Array) -> list[bytes | None]:
    """Each vector's components as doubles (no negative zeros), one after the other; None for those
    that are null or hold null or non-finite ones."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    length = np.where(valid, pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = np.array(column.flatten().cast(pa.float64()).fill_null(np.nan)) + 0.0
    ends = np.cumsum(length)
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sound = valid & (broken[ends] == broken[ends - length])
    raw = values.tobytes()
    return [raw[8 * (b - n) : 8 * b] if ok else None for b, n, ok in zip(ends.tolist(), length.tolist(), sound.tolist(), strict=True)]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]
