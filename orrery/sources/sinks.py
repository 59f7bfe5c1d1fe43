"""Where tables go: the catalog, a JDBC warehouse, a canonical snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def save(df: DataFrame, name: str, table_format: str = "parquet", path: str | None = None) -> None:
    """A managed table, replaced with its schema; one that lies elsewhere if a path is given."""
    writer = df.write.mode("overwrite").option("overwriteSchema", True).format(table_format)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for what was read by one task (a compressed file, multi-line records)."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def load_jdbc(df: DataFrame, name: str, options: Mapping[str, str]) -> int:
    """Replace a warehouse table's rows, keeping the table; executors write, nothing passes the
    driver. The number of rows, counted as they are written."""
    written = Observation()
    watched = df.observe(written, F.count(F.lit(1)).alias("rows"))
    watched.write.format("jdbc").mode("overwrite").options(**{**options, "dbtable": name, "truncate": "true"}).save()
    return written.get["rows"]


class LoadError(RuntimeError):
    """A load that didn't bring over every row; what was there before still is."""


def _run_sql(spark: SparkSession, statement: str, options: Mapping[str, str], source: str) -> None:
    """One statement on the database, by one task, in a session that then reads a table of one row."""
    reader = spark.read.format("jdbc").options(**{**options, "dbtable": f"(SELECT COUNT(*) AS n FROM {source}) orrery_one"})
    reader.option("sessionInitStatement", statement).load().collect()


def _read(spark: SparkSession, source: str, options: Mapping[str, str]):
    return spark.read.format("jdbc").options(**{**options, "dbtable": source}).load().first()


def _is_there(spark: SparkSession, source: str, options: Mapping[str, str]) -> bool:
    try:
        _read(spark, f"(SELECT COUNT(*) AS n FROM {source}) orrery_any", options)
    except Exception as error:  # what a database says of a missing table is its own affair, but that it answers is not
        _read(spark, options.get("probe", "(VALUES 1) orrery_probe(n)"), options)
        if "does not exist" not in str(error) and "doesn't exist" not in str(error) and "not found" not in str(error).lower():
            raise
        return False
    return True


def load_whole(df: DataFrame, name: str, options: Mapping[str, str]) -> int:
    """Replace a warehouse table's rows, all or none. The number of rows.

    What readers see is a view over two tables, of which one counts; a third, of one row, says which. The
    rows go into the other one; they are counted there; and one statement, an update of that row, makes
    them count. A load that fails before leaves the old rows in sight, and can be tried again from the
    start: it replaces what it left. One load of a table at a time. Executors write, nothing passes
    the driver."""
    spark = df.sparkSession
    slot, view_there = f"{name}_slot", True
    if not _is_there(spark, slot, options):
        spark.range(1).selectExpr("CAST(0 AS INT) AS SLOT").coalesce(1).write.format("jdbc").options(**{**options, "dbtable": slot}).save()
        view_there = False
    now = int(_read(spark, f"(SELECT * FROM {slot}) orrery_slot", options)[0])
    other = 1 - now
    view_there = view_there and _is_there(spark, name, options)
    wrote = load_jdbc(df, f"{name}_{other}", options)
    there = int(_read(spark, f"(SELECT COUNT(*) AS N FROM {name}_{other}) orrery_count", options)[0])
    if there != wrote:
        raise LoadError(f"{name}: {wrote} rows went out, {there} are there; the old rows still count")
    if not view_there:
        if not _is_there(spark, f"{name}_{now}", options):
            load_jdbc(df.limit(0), f"{name}_{now}", options)
        sides = [f"SELECT * FROM {name}_{k} WHERE EXISTS (SELECT 1 FROM {slot} WHERE \"SLOT\" = {k})" for k in (0, 1)]
        _run_sql(spark, f"CREATE VIEW {name} AS {' UNION ALL '.join(sides)}", options, slot)
    _run_sql(spark, f'UPDATE {slot} SET "SLOT" = {other}', options, slot)
    return wrote


def load_all(spark: SparkSession, names: list[str], options: Mapping[str, str], load=load_whole) -> dict[str, int]:
    return {name: load(spark.table(name), name, options) for name in names}


#: Rows that snapshot() hands to the driver at most; placed() has no bound.
SNAPSHOT_ROWS = 100_000


def canonical_order(df: DataFrame) -> list:
    return [F.col(f"`{name}`").asc_nulls_first() for name in df.columns]


def snapshot(df: DataFrame) -> tuple[list[str], list[tuple[str, str, bool]]]:
    """A small table's rows as JSON, ordered by all columns with nulls first, and its schema; of a table
    with over SNAPSHOT_ROWS rows none, but a ValueError."""
    rows = df.orderBy(*canonical_order(df)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(SNAPSHOT_ROWS + 1).collect()
    if len(rows) > SNAPSHOT_ROWS:
        raise ValueError(f"over {SNAPSHOT_ROWS} rows are no snapshot; number them with placed()")
    return [r[0] for r in rows], [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


#: Equal rows that are numbered at a time.
ALIKE_AT_ONCE = 10_000


def placed(df: DataFrame, path: str) -> DataFrame:
    """df with `place`: the number of each row, from 0, in the canonical order (all columns, nulls
    first). Written to the folder path, and read from there.

    Equal rows are counted together first, so that a row that is there many times is no burden for one
    task; the different rows are sorted by ranges, each range is written by a task that numbers its own
    rows, and the ranges' sizes, one number each, are summed up before it. Where no row is there twice, a
    row's number in its range is known as it is written, and reading them shuffles nothing."""
    spark, names = df.sparkSession, [f"c{i}" for i in range(len(df.columns))]
    alike = df.toDF(*names).groupBy(*names).agg(F.count("*").alias("n"))
    alike = alike.orderBy(*[F.col(c).asc_nulls_first() for c in names])
    alike.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that sorted
    sizes = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    if stored.agg(F.max("n")).first()[0] in (None, 1):
        within_range = F.col("at").bitwiseAND((1 << 33) - 1)  # monotonically_increasing_id: the row's number in its task
        runs = stored.join(F.broadcast(sizes), "part").withColumn("place", F.col("offset") + within_range)
        return runs.select("place", *[F.col(c).alias(name) for c, name in zip(names, df.columns, strict=True)])
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
    runs = stored.join(sizes, "part").withColumn("first", first).withColumn("last", F.col("first") + F.col("n") - 1)
    runs = runs.withColumn("some", F.explode(F.sequence("first", "last", F.lit(ALIKE_AT_ONCE).cast("long"))))
    runs = runs.withColumn("place", F.explode(F.sequence("some", F.least(F.col("some") + (ALIKE_AT_ONCE - 1), "last"))))
    return runs.select("place", *[F.col(c).alias(name) for c, name in zip(names, df.columns, strict=True)])


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and digest of a table of any size; equal for equal rows in whatever order."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns])
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.expr("bit_xor(h)").alias("digest"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"))
