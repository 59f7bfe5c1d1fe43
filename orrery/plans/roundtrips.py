"""Queries that write test tables into every kind of sink and read them back by the engine's scans."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, quality, tools
from ..sources import bulk, readers, shared, sinks
from ..sources.config import Settings
from . import roles

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
#: Bytes of a range in the scans of single files here, at least; some of the files are small.
PIECE = 8_192
#: Ranges of such a file for each core; they get longer with the file, up to Spark's own length.
RANGES = 3
#: Tasks that read a database table side by side.
READERS = 8
SUPPLIER = "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; a local session
    that names none gets one in a folder of its own, which goes when Python does."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named}/roundtrip-{uuid.uuid4().hex}"


def _one_process(spark: SparkSession) -> bool:
    """Whether the session's tasks run in the driver's own JVM."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def _embedded() -> dict[str, str]:
    """Options of a new JDBC database, which lives in this process."""
    return {"url": f"jdbc:derby:memory:orrery{uuid.uuid4().hex};create=true", "driver": DERBY}


def _warehouse(spark: SparkSession) -> shared.Warehouse:
    """A new database that all executors reach: a file in the shared folder. Spark's jars hold no JDBC
    driver for one that more than one process can open."""
    return shared.Warehouse(f"{shared.local_path(scratch(spark))}.db")


def src1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    roles.read(spark, sf_dir, "supplier").write.option("header", True).csv(path)
    return readers.read_file(spark, path, "csv", schema=SUPPLIER)


def _one_text_file(lines: DataFrame, path: str, head: str = "", between: str = "", last: str | None = None) -> str:
    """Lines in one file, the first after a head, the others each after what is between; then a last one.
    One task writes them as they come."""

    def run(batches):
        lead = head
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([lead + texts[0], *(between + t for t in texts[1:])])], names=["value"])
                lead = between
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last if lead != head else head + last])], names=["value"])

    lines.coalesce(1).mapInArrow(run, "value STRING").write.text(path)
    return path


def _range_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a range of the files at path: as many ranges as keep the cores busy, whatever the size."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return min(max(PIECE, size // (RANGES * spark.sparkContext.defaultParallelism) + 1), 128 << 20)


def src2_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file that is an array of objects, its ranges read side by side."""
    customer = roles.read(spark, sf_dir, "customer")
    objects = customer.select(F.to_json(F.struct("c_custkey", F.struct("c_name", "c_nationkey", "c_acctbal").alias("of"), F.concat(F.lit("}{\"["), "c_mktsegment").alias("c_mktsegment"))))
    path = _one_text_file(objects, scratch(spark), "[", ",", "]")
    found = readers.read_file(spark, path, "json", multiline=True, schema="c_custkey BIGINT, of STRUCT<c_name: STRING, c_nationkey: INT, c_acctbal: DOUBLE>, c_mktsegment STRING", split_bytes=_range_bytes(spark, path))
    return found.select("c_custkey", "of.*", "c_mktsegment")


def src4_multiline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with line breaks, quotes and commas in its fields, its ranges read side by side."""
    note = F.concat("p_name", F.lit("\n\""), "p_brand", F.lit('",\n'), "p_type")
    part = roles.read(spark, sf_dir, "part").select("p_partkey", note.alias("note"), "p_size")
    path = scratch(spark)
    part.coalesce(1).write.option("header", True).csv(path)
    return readers.read_file(spark, path, "csv", multiline=True, schema="p_partkey BIGINT, note STRING, p_size INT", split_bytes=_range_bytes(spark, path))


def src5_gzip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed files, whose rows are spread over all cores as bronze does."""
    path = scratch(spark)
    orders = roles.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.write.option("header", True).option("compression", "gzip").csv(path)
    return sinks.spread(readers.read_file(spark, path, "csv", schema="o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"))


def src6_jdbc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warehouse load and a read by key ranges: by JDBC over a database in this process, or, where
    executors are processes of their own, over one in the shared folder."""
    supplier = roles.read(spark, sf_dir, "supplier")
    if not _one_process(spark):
        warehouse = _warehouse(spark)
        again = [warehouse.load(supplier, "supplier") for _ in range(2)][1]  # replaces the rows
        keys = warehouse.read(spark, "supplier", warehouse.row_ranges("supplier", READERS), '"s_suppkey"')
        return warehouse.read(spark, "supplier", readers.balanced_predicates(keys, '"s_suppkey"', 3)).withColumn("loaded", F.lit(again).cast("long"))
    options = _embedded()
    loaded = sinks.load_jdbc(supplier, "supplier", options)
    again = sinks.load_jdbc(supplier, "supplier", options)  # replaces the rows
    read = Settings(mode="databases", jdbc_url=options["url"], jdbc_driver=options["driver"], jdbc_table="supplier", jdbc_split=("s_suppkey", 0, max(1, loaded), 3))
    found = readers.read_jdbc(spark, read)
    return found.toDF(*[name.lower() for name in found.columns]).withColumn("loaded", F.lit(again).cast("long"))


def src6_balanced_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by a key that is dense at one end, read in eight ranges of as many rows each; from a
    database in this process by JDBC, or from one in the folder that executors share."""
    lines = roles.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * F.col("l_orderkey")).alias("k"), "l_linenumber", "l_quantity", "l_returnflag")
    if not _one_process(spark):
        warehouse = _warehouse(spark)
        warehouse.load(lines, "line")
        keys = warehouse.read(spark, "line", warehouse.row_ranges("line", READERS), '"k"')
        return warehouse.read(spark, "line", readers.balanced_predicates(keys, '"k"', READERS))
    options = _embedded()
    sinks.load_jdbc(lines, "line", options)
    read = Settings(mode="databases", jdbc_url=options["url"], jdbc_driver=DERBY, jdbc_table="line", jdbc_balance=('"k"', READERS))
    found = readers.read_jdbc(spark, read)
    return found.toDF(*[name.lower() for name in found.columns])


ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, note STRING"


def damaged_orders(spark: SparkSession, sf_dir: str) -> str:
    """Orders in one CSV file, some of whose records are damaged: too short, too long, a price or a key that
    is no number, no key; others have empty fields, line breaks, carriage returns at the end."""
    n = F.col("o_orderkey") % 97
    note = F.when(n == 5, "").when(n == 6, F.lit('"two\nlines, \\"x\\""')).otherwise(F.concat(F.col("o_orderpriority"), F.when(n == 7, F.lit("\r")).otherwise("")))
    fields = [
        F.when(n == 1, F.lit("key")).when(n == 2, F.lit("")).otherwise(F.col("o_orderkey").cast("string")), F.col("o_custkey").cast("string"),
        F.when(n == 8, F.lit("")).otherwise(F.col("o_orderstatus")), F.when(n == 3, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")),
    ]
    line = F.when(n == 4, F.concat_ws(",", *fields[:3])).when(n == 9, F.concat_ws(",", *fields, note, F.lit("more"))).otherwise(F.concat_ws(",", *fields, note))
    names = ",".join(c.split()[0] for c in ORDERS.split(", "))
    return _one_text_file(roles.read(spark, sf_dir, "orders").select(line.alias("value")), scratch(spark), f"{names}\n")


def _bulk_loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = damaged_orders(spark, sf_dir)
    return bulk.bulk_load(spark, path, ORDERS, scratch(spark), ("o_orderkey",), max(64 * PIECE, _range_bytes(spark, path)))


def src13_bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bulk_loaded(spark, sf_dir)[0]


def src13_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why records were refused, how many, and of how many bytes together."""
    refused = _bulk_loaded(spark, sf_dir)[1]
    return refused.groupBy("reason").agg(F.count("*").alias("records"), F.sum(F.octet_length("record")).alias("bytes"))


def _dropped(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, and the catalog without the table of that name; its files, which df reads, stay."""
    spark.sql(f"DROP TABLE {name}")
    return df


def snk1_table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is replaced with another schema, and read from the catalog."""
    path, name = scratch(spark), f"orrery_{uuid.uuid4().hex}"
    sinks.save(spark.range(3), name, path=path)
    sinks.save(roles.read(spark, sf_dir, "nation"), name, path=path)
    return _dropped(spark, spark.table(name), name)


def src12_stored_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, name = scratch(spark), f"orrery_{uuid.uuid4().hex}"
    sinks.save(roles.read(spark, sf_dir, "customer"), name, path=path)
    return _dropped(spark, readers.read_stored(spark, path), name)


def snk5_placed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with its place in the canonical order, whatever the number of tasks that sort."""
    lines = roles.read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    return sinks.placed(lines, scratch(spark))


def snk3_whole_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are loaded, loaded again by a run that fails half way, and by one that doesn't: what
    readers see after each. The database is in this process, or in the folder that executors share."""
    part = roles.read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    dearer = part.withColumn("p_retailprice", F.col("p_retailprice") * 2)
    broken = dearer.repartition(4).withColumn("p_brand", F.when(F.col("p_partkey") % 50 == 7, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("p_brand")))
    options, warehouse = (_embedded(), None) if _one_process(spark) else ({}, _warehouse(spark))
    seen = []
    for step, rows in enumerate((part, broken, dearer)):
        try:
            warehouse.load_whole(rows, "part") if warehouse else sinks.load_whole(rows, "part", options)
        except Exception as error:
            if "broken" not in str(error):
                raise
        found = warehouse.read(spark, "part") if warehouse else spark.read.format("jdbc").options(**options, dbtable="part").load()
        seen.append(found.groupBy("p_brand").agg(F.count("*").alias("rows"), F.round(F.sum("p_retailprice"), 2).alias("price")).withColumn("step", F.lit(step)).collect())
    return spark.createDataFrame([r for rows in seen for r in rows], "p_brand STRING, rows BIGINT, price DOUBLE, step INT")


def snk4_load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several tables of the catalog into a warehouse, in this process or in the folder that executors
    share; the rows that each load wrote."""
    mark = f"orrery{uuid.uuid4().hex}"
    names = {f"{mark}_{name}": name for name in ("nation", "region", "supplier")}
    for table, name in names.items():
        sinks.save(roles.read(spark, sf_dir, name), table, path=scratch(spark))
    if _one_process(spark):
        loaded = sinks.load_all(spark, list(names), _embedded())
    else:
        warehouse = _warehouse(spark)
        loaded = sinks.load_all(spark, list(names), {}, lambda df, name, _: warehouse.load_whole(df, name))
    for table in names:
        spark.sql(f"DROP TABLE {table}")
    return spark.createDataFrame([(names[table], rows) for table, rows in loaded.items()], "table_name STRING, loaded BIGINT")


def prj1_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical columns go, the time of arrival comes."""
    marked = roles.read(spark, sf_dir, "region").withColumn("_id", F.lit("x")).withColumn("_rev", F.lit(1))
    arrived = readers.with_arrival(marked)
    stamped = F.col("ingestion_timestamp") <= F.current_timestamp()
    return arrived.select(*arrived.columns[:-1], stamped.alias("stamped"), F.lit(len(arrived.columns)).alias("columns"))


def prj6_specs_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"name": "S_SUPPKEY", "alias": "supplier", "type": "BIGINT"}, {"name": "s_name", "type": "STRING"}, {"name": "S_AcctBal", "alias": "balance"}]
    with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as file:  # for the driver alone
        json.dump(specs, file)
        file.flush()
        read = cleaning.read_specs(file.name)
    return cleaning.rename_by_specs(roles.read(spark, sf_dir, "supplier"), read)


def tls1_scaled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ten times over, their numbers shifted and their kinds suffixed."""
    events = roles.read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 > 0, F.col("event_type")).otherwise("").alias("event_type"), "value")
    return tools.copies(events, 10, ["event_type"], {"event_id": 10_000_000, "user_id": 1_000_000})


def tls2_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the comparer says of the line items and of copies that differ."""
    lines = roles.read(spark, sf_dir, "lineitem").drop("l_shipdate").withColumn("share", F.col("l_extendedprice") / 3)
    one = (F.col("l_orderkey") == 6) & (F.col("l_linenumber") == 1)
    altered = {
        "same": lines.repartition(7),
        "near": lines.withColumn("share", F.col("share") * (1 + 1e-12)),
        "value": lines.withColumn("share", F.col("share") + F.when(one, 1).otherwise(0)).withColumn("l_tax", F.when(one, None).otherwise(F.col("l_tax"))),
        "rows": lines.where("l_orderkey % 50 <> 3"),
        "type": lines.withColumn("share", F.col("share").cast("float")),
    }
    found = tools.first_differences(lines, altered, "t", lambda df: sinks.placed(df, scratch(spark)))
    return reduce(DataFrame.unionByName, [spark.range(1).select(F.lit(differs).alias("differs"), F.lit(name).alias("copy")) for name, differs in found.items()])


def _typed_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw policies under their names, with invalid and repeated ones."""
    return cleaning.rename_by_specs(roles.raw_policies(spark, sf_dir), roles.POLICY_SPECS)


def _typed_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = cleaning.rename_by_specs(roles.raw_accidents(spark, sf_dir), roles.ACCIDENT_SPECS, aliases=False)
    return named.withColumn("accident_date", F.try_to_timestamp("accident_date"))


def dq_policies_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(_typed_policies(spark, sf_dir), quality.SUITES["silver_policies"])


def dq_accidents_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(_typed_accidents(spark, sf_dir), quality.SUITES["silver_accidents"])


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    claims = roles.claims(spark, sf_dir).dropDuplicates(["claim_number"])
    return {"silver_claims": claims, "silver_policies": _typed_policies(spark, sf_dir), "silver_accidents": _typed_accidents(spark, sf_dir)}


def dq4_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [quality.validate(df, name, quality.SUITES[name]) for name, df in _tables(spark, sf_dir).items()]
    rows = [(r.table_name, r.success, ", ".join(r.failed_expectations)) for r in found]
    return spark.createDataFrame(rows, "table_name STRING, success BOOLEAN, failed STRING")


def dq6_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate says of tables that pass, and of some that don't."""
    said = []
    tables = _tables(spark, sf_dir)
    for names in (["silver_claims"], list(tables)):
        try:
            said.append((len(names), str(len(quality.gate({n: tables[n] for n in names})))))
        except quality.DataQualityError as error:
            said.append((len(names), str(error)))
    return spark.createDataFrame(said, "tables INT, said STRING")


QUERIES = {
    f.__name__: f
    for f in (
        src1_csv_scan, src2_json_scan, src4_multiline_csv, src5_gzip_csv, src6_jdbc_roundtrip, src6_balanced_reads,
        src13_bulk_load, src13_quarantine,
        snk1_table_overwrite, src12_stored_by_path, snk4_load_all, snk3_whole_load, snk5_placed_rows, prj1_arrival, prj6_specs_from_json,
        tls1_scaled_events, tls2_differences, dq_policies_violations, dq_accidents_violations, dq4_reports, dq6_gate,
    )
}

_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_POLICIES = """(SELECT 0 AS "check", 'expect_column_values_to_not_be_null' AS expectation, 'customer_id' AS column_name, count(*) FILTER (l_suppkey IS NULL) AS broken FROM lineitem
    UNION ALL SELECT 1, 'expect_column_values_to_not_be_null', 'policy_number', 0
    UNION ALL SELECT 2, 'expect_column_values_to_be_unique', 'policy_number', (SELECT count(*) FROM (SELECT l_orderkey % 5000 FROM lineitem GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 3, 'expect_column_values_to_not_be_null', 'issue_date', 0
    UNION ALL SELECT 4, 'expect_column_values_to_be_between', 'premium', (SELECT count(*) FROM lineitem WHERE l_extendedprice < 2000)
    UNION ALL SELECT 5, 'expect_column_values_to_be_between', 'sum_insured', (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F' AND l_extendedprice < 1000))"""
_ACCIDENTS = """(SELECT 0 AS "check", 'expect_column_values_to_not_be_null' AS expectation, 'collision_id' AS column_name, 0 AS broken
    UNION ALL SELECT 1, 'expect_column_values_to_not_be_null', 'accident_date', count(*) FILTER (event_id % 50 = 0) FROM events
    UNION ALL SELECT 2, 'expect_column_values_to_be_between', 'latitude', count(*) FILTER (event_id % 100 > 90) FROM events
    UNION ALL SELECT 3, 'expect_column_values_to_be_between', 'longitude', count(*) FILTER (abs(event_id % 400 - 200) > 180) FROM events)"""
_FAILED = """(SELECT 2 AS place, 'silver_policies' AS t, string_agg(expectation, ', ' ORDER BY "check") AS failed FROM {p} WHERE broken > 0
    UNION ALL SELECT 3, 'silver_accidents', string_agg(expectation, ', ' ORDER BY "check") FROM {a} WHERE broken > 0)""".format(p=_POLICIES, a=_ACCIDENTS)  # fmt: skip

ORACLE_SQL = {
    "src1_csv_scan": _SUPPLIER,
    "src2_json_scan": """SELECT c_custkey, c_name, c_nationkey, c_acctbal, '}{"[' || c_mktsegment AS c_mktsegment FROM customer""",
    "src4_multiline_csv": """SELECT p_partkey, p_name || chr(10) || '"' || p_brand || '",' || chr(10) || p_type AS note, p_size FROM part""",
    "src5_gzip_csv": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "src6_jdbc_roundtrip": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, (SELECT count(*) FROM supplier) AS loaded FROM supplier",
    "src6_balanced_reads": "SELECT l_orderkey * l_orderkey AS k, l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "src13_bulk_load": """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 <> 8 THEN o_orderstatus END AS o_orderstatus, o_totalprice,
       CASE o_orderkey % 97 WHEN 5 THEN NULL WHEN 6 THEN 'two' || chr(10) || 'lines, "x"' ELSE o_orderpriority END AS note
FROM orders WHERE o_orderkey % 97 NOT IN (1, 2, 3, 4, 9)""",
    "src13_quarantine": """
WITH d AS (
    SELECT o_orderkey % 97 AS n, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS note FROM orders
), t AS (
    SELECT *, length(c) + length(s) + length(note) + 4 AS rest, length(CAST(p AS VARCHAR)) AS digits FROM d
)
SELECT CASE n WHEN 1 THEN 'type: o_orderkey' WHEN 2 THEN 'missing: o_orderkey' WHEN 3 THEN 'type: o_totalprice' ELSE 'fields' END AS reason, count(*) AS records,
       CAST(sum(CASE n WHEN 1 THEN 3 + digits + rest WHEN 2 THEN digits + rest WHEN 3 THEN length(k) + 3 + rest
                       WHEN 4 THEN length(k) + length(c) + length(s) + 2 ELSE length(k) + digits + rest + 5 END) AS BIGINT) AS bytes
FROM t WHERE n IN (1, 2, 3, 4, 9) GROUP BY 1""",
    "snk1_table_overwrite": "SELECT * FROM nation",
    "src12_stored_by_path": "SELECT * FROM customer",
    "snk5_placed_rows": """
SELECT row_number() OVER (ORDER BY l_returnflag NULLS FIRST, l_quantity NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST) - 1 AS place,
       l_returnflag, l_quantity, l_discount, l_tax FROM lineitem""",
    "snk3_whole_load": """
SELECT p_brand, count(*) AS rows, round(sum(p_retailprice * CASE step WHEN 2 THEN 2 ELSE 1 END), 2) AS price, CAST(step AS INTEGER) AS step
FROM part, range(3) s(step) GROUP BY p_brand, step""",
    "snk4_load_all": "SELECT 'nation' AS table_name, count(*) AS loaded FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier",
    "prj1_arrival": "SELECT r_regionkey, r_name, true AS stamped, 3 AS columns FROM region",
    "prj6_specs_from_json": "SELECT s_suppkey AS supplier, s_name, s_nationkey, s_acctbal AS balance FROM supplier",
    "tls1_scaled_events": """
SELECT event_id + 10000000 * k AS event_id, user_id + 1000000 * k AS user_id,
       CASE WHEN event_id % 7 = 0 THEN '' WHEN k = 0 THEN event_type ELSE event_type || '-x' || k END AS event_type, value
FROM events, range(10) t(k)""",
    "tls2_differences": """
WITH o AS (
    SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS place
    FROM lineitem
), n AS (
    SELECT count(*) AS a, count(*) FILTER (WHERE l_orderkey % 50 <> 3) AS b FROM lineitem
)
SELECT 'same' AS copy, '' AS differs UNION ALL SELECT 'near', ''
UNION ALL SELECT 'value', coalesce((SELECT 't: row ' || min(place) || ', l_tax, share' FROM o WHERE l_orderkey = 6 AND l_linenumber = 1), '')
UNION ALL SELECT 'rows', 't: ' || a || ' rows, ' || b || ' rows' FROM n
UNION ALL SELECT 'type', 't: schema'""",
    "dq_policies_violations": f"SELECT * FROM {_POLICIES}",
    "dq_accidents_violations": f"SELECT * FROM {_ACCIDENTS}",
    "dq4_reports": f"SELECT 'silver_claims' AS table_name, true AS success, '' AS failed UNION ALL SELECT t, failed IS NULL, coalesce(failed, '') FROM {_FAILED}",
    "dq6_gate": f"SELECT 1 AS tables, '1' AS said UNION ALL SELECT 3, string_agg(t || ': ' || failed, '; ' ORDER BY place) FROM {_FAILED}",
}
