"""Queries over a database, where executors are processes of their own."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.plans import roundtrips
from orrery.sources import shared, sinks

DATA = "/root/testdata/sf0.001"
NAMES = ("snk3_whole_load", "snk4_load_all", "src6_balanced_reads", "src6_jdbc_roundtrip")
RUN = """
import json, sys
from pyspark.sql import SparkSession
folder, data, *names = sys.argv[1:]
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.sql.shuffle.partitions", "2").getOrCreate())
from orrery.plans import roundtrips
json.dump({n: [list(r) for r in roundtrips.QUERIES[n](spark, data).collect()] for n in names}, open(f"{folder}/found.json", "w"))
spark.stop()
"""


def test_databases_on_a_cluster_equal_sql(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = [sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r})\n{RUN}", str(tmp_path), DATA, *NAMES]
    subprocess.run(run, check=True, cwd=tmp_path, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True)
    found = json.loads((tmp_path / "found.json").read_text())
    with duckdb.connect() as sql:
        for table in ("part", "nation", "region", "supplier", "lineitem"):
            sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        for name in NAMES:
            assert sorted(map(tuple, found[name])) == sorted(sql.execute(roundtrips.ORACLE_SQL[name]).fetchall()), name


def test_a_shared_warehouse(spark, tmp_path):
    warehouse = shared.Warehouse(shared.local_path(f"file://{tmp_path}/w.db"))
    rows = spark.range(5000).selectExpr("id AS k", "CAST(id % 9 AS INT) AS n", "if(id % 5 = 0, NULL, id / 4) AS v", "if(id % 7 = 0, NULL, concat('0', id)) AS s").repartition(6)
    assert warehouse.load(rows, "t") == warehouse.load(rows, "t") == 5000
    read = warehouse.read(spark, "t", warehouse.row_ranges("t", 4))
    assert read.schema.simpleString() == rows.schema.simpleString()
    assert sinks.fingerprint(read).first() == sinks.fingerprint(rows).first()
    assert warehouse.read(spark, "t", ["k < 10", "k > 4990"], '"k"').agg(F.count("*")).first()[0] == 19
    old = rows.where("k < 3").drop("v")
    assert warehouse.load_whole(old, "w") == 3
    broken = rows.drop("v").withColumn("s", F.expr("if(k = 4321, raise_error('broken'), s)"))
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            warehouse.load_whole(broken, "w")
        assert sinks.fingerprint(warehouse.read(spark, "w")).first() == sinks.fingerprint(old).first()
    assert warehouse.load_whole(old.limit(0), "w") == 0 == warehouse.read(spark, "w").count()
    with pytest.raises(Exception, match="NaN"):
        warehouse.load(rows.withColumn("v", F.lit(float("nan"))), "nan")
    with pytest.raises(ValueError, match="mount"):
        shared.local_path("hdfs://host/folder")
