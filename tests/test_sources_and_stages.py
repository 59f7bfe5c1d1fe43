import gzip
import json

import pytest

from orrery.operators import tools
from orrery.plans import cards, gold, roundtrips, stages
from orrery.sources import bulk, readers, sinks
from orrery.sources.config import Settings
from orrery.streaming.windows import counts_by_window

DOCUMENT = {
    "claim_amount": {"injury": 1, "property": 2, "total": 6, "vehicle": 3}, "claim_datetime": "2020-02-01 10:00:00", "claim_no": "c1",
    "collision": {"number_of_vehicles_involved": 2, "type": "rear"}, "driver": {"age": 30.0, "insured_relationship": "son", "license_issue_date": "01-02-2003"},
    "incident": {"date": "31-01-2020", "hour": 7, "severity": "minor", "type": "single"}, "months_as_customer": 5, "number_of_witnesses": 1, "policy_no": "101/1", "suspicious_activity": False,
}


@pytest.fixture
def files(tmp_path):
    names = [c.split()[0] for c in readers.POLICIES.split(", ")]
    row = ["1", "101/1", "COMP", "04-01-2020", "04-01-2020", "03-01-2021", "SUV", "TOYOTA", '"two\nlines"', "2004", "C", "PRIVATE", "01-01-1980", "BRONX", "N", "10453", "X", "14080", "1090", "2000"]
    (tmp_path / "policies.csv").write_text(",".join(names) + "\n" + ",".join(row) + "\n" + ",".join(["2", "102", *row[2:17], "", "5", ""]) + "\n")
    (tmp_path / "claims.json").write_text(json.dumps([DOCUMENT, {**DOCUMENT, "claim_no": "c2", "policy_no": "x"}]))
    names = [c.split()[0] for c in readers.ACCIDENTS.split(", ")]
    row = dict.fromkeys(names, "") | {"ACCIDENT_DATE": "2020-01-05", "ACCIDENT_TIME": "7:05", "BOROUGH": "BRONX", "LATITUDE": "40.7", "LONGITUDE": "-73.9", "COLLISION_ID": "7", "ON_STREET_NAME": '"A, B"', "NUMBER_OF_PERSONS_INJURED": "2"}
    with gzip.open(tmp_path / "accidents.csv.gz", "wt") as out:
        out.write(",".join(names) + "\n" + ",".join(row.values()) + "\n")
    return tmp_path


def test_files(spark, files):
    settings = Settings(data_dir=str(files))
    tables = readers.raw_tables(spark, settings)
    policies = tables["bronze_policies"].orderBy("CUST_ID").collect()
    assert policies[0].MODEL == "two\nlines" and policies[1].SUM_INSURED is None and len(policies) == 2
    assert tables["bronze_claims"].first().driver.age == 30.0
    accident = tables["bronze_accidents"].first()
    assert accident.ON_STREET_NAME == "A, B" and accident.ingestion_timestamp is not None
    assert len(readers.ACCIDENTS.split(", ")) == 28
    inferred = readers.read_file(spark, settings.path("policies.csv"), multiline=True)
    assert dict(inferred.dtypes)["CUST_ID"] == "int" and inferred.count() == 2
    with pytest.raises(ValueError, match="parquet"):
        readers.read_file(spark, "x", "parquet")
    technical = readers.with_arrival(spark.createDataFrame([(1, 2)], "_id int, a int"))
    assert technical.columns == ["a", "ingestion_timestamp"]


class Collection:
    closed = False

    def __init__(self, fails=False):
        self.fails = fails

    def find(self, query, projection):
        assert projection == {"_id": 0}
        if self.fails:
            raise OSError
        every = [DOCUMENT, {**DOCUMENT, "claim_no": "c2", "policy_no": "x"}]
        return every if not query else [d for d in every if d["claim_no"] in query["claim_no"]]

    def close(self):
        self.closed = True


def test_documents_equal_files(spark, files):
    source = Collection()
    texts = list(readers.fetch_documents(lambda: source))
    assert source.closed
    own = readers.from_json_texts(spark, texts)
    file = readers.read_file(spark, str(files / "claims.json"), "json", True, readers.CLAIMS)
    assert own.schema.simpleString() == file.schema.simpleString()
    assert sorted(map(str, own.collect())) == sorted(map(str, file.collect()))
    source = Collection(fails=True)
    with pytest.raises(OSError):
        list(readers.fetch_documents(lambda: source))
    assert source.closed
    assert readers.from_json_texts(spark, ["{broken"]).first().claim_no is None
    for queries in (({},), ({"claim_no": ["c1"]}, {"claim_no": ["c2", "c3"]}, {"claim_no": []})):
        read = readers.read_documents(spark, Collection, queries)
        assert read.schema.simpleString() == file.schema.simpleString()
        assert sorted(map(str, read.collect())) == sorted(map(str, file.collect()))
    with pytest.raises(Exception, match="OSError"):
        readers.read_documents(spark, lambda: Collection(fails=True)).collect()
    databases = Settings(mode="databases", data_dir=str(files), jdbc_url="jdbc:derby:memory:orrery_raw;create=true", jdbc_driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    sinks.load_jdbc(readers.read_file(spark, str(files / "policies.csv"), "csv", True, readers.POLICIES), "policies", databases.jdbc_options())
    raw = readers.raw_tables(spark, databases, Collection)
    assert raw["bronze_claims"].count() == raw["bronze_policies"].count() == 2 and "ingestion_timestamp" in raw["bronze_claims"].columns


def test_key_ranges_share_out_all_documents():
    assert readers.key_ranges("k", 0, 10, 1) == [{}]
    assert readers.key_ranges("k", 0, 10, 3) == [{"k": {"$lt": 3}}, {"k": {"$gte": 3, "$lt": 6}}, {"k": {"$gte": 6}}, {"k": None}]


def test_stages_are_tried_again_in_their_order(spark, monkeypatch):
    called = []

    def flaky(name, failures, error=OSError):
        def stage(spark, settings):
            called.append(name)
            if called.count(name) <= failures:
                raise error("broken")

        return stage

    monkeypatch.setattr(stages, "STAGES", {"bronze": flaky("bronze", 1), "silver": flaky("silver", 0), "quality": flaky("quality", 1, stages.quality.DataQualityError), "gold": flaky("gold", 0)})
    assert list(stages.run(spark, Settings(), ("silver", "bronze"), retries=1)) == ["bronze", "silver"]
    assert called == ["bronze", "bronze", "silver"]
    called.clear()
    with pytest.raises(stages.quality.DataQualityError):
        stages.run(spark, Settings(), ("quality", "gold"), retries=3)
    assert called == ["quality"]
    called.clear()
    with pytest.raises(OSError):
        stages.run(spark, Settings(), ("bronze",), retries=0)


def test_settings():
    assert Settings.from_environment({}) == Settings()
    got = Settings.from_environment({"SOURCE_MODE": "databases", "JDBC_URL": "jdbc:x", "JDBC_PASSWORD": "secret", "SHUFFLE_PARTITIONS": "7"})
    assert got.mode == "databases" and got.shuffle_partitions == 7 and "secret" not in repr(got)
    assert got.jdbc_options() == {"url": "jdbc:x", "dbtable": "policies", "user": "", "password": "secret", "driver": "com.mysql.cj.jdbc.Driver"}
    assert Settings(jdbc_split=("id", 0, 9, 3)).jdbc_options()["numPartitions"] == "3"
    with pytest.raises(ValueError, match="mode"):
        Settings(mode="ftp")
    got = Settings.from_environment({"JDBC_SPLIT": "id, 0, 90, 3", "DOCUMENT_SPLIT": "n,-5,5,2"})
    assert got.jdbc_options()["upperBound"] == "90" and got.document_split == ("n", -5, 5, 2)
    for bad in ("id", "id,1,2", "id,5,5,1", ",0,1,1", "id,0,x,2"):
        with pytest.raises(ValueError, match="split"):
            Settings.from_environment({"JDBC_SPLIT": bad})


def test_stages_from_files_to_reports(spark, files, tmp_path, monkeypatch):
    settings = Settings(data_dir=str(files))
    names = [f"{layer}_{t}" for layer in ("bronze", "silver") for t in ("policies", "claims", "accidents")] + list(gold.builders())
    try:
        for stage in stages.STAGES.values():
            stage(spark, settings)
        assert spark.table("gold_loss_ratio_monthly").where("year_month = '2020-01'").first().loss_ratio_pct == 0.55
        assert spark.table("gold_accidents_weekday_hour").count() == 168
        tables = {name: spark.table(name) for name in gold.builders()}
        for name, card in cards.CARDS.items():
            text = card.sql()
            assert spark.sql(text).columns == [c.strip("`") for c in card.columns], name
        first = {n: sinks.snapshot(df) for n, df in tables.items()}
        stages.gold(spark, settings)
        assert tools.differences(first, {n: sinks.snapshot(spark.table(n)) for n in tables}) == []
        assert sinks.load_all(spark, ["gold_policies_monthly"], {}, lambda df, name, options: df.count()) == {"gold_policies_monthly": 2}
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_tables_are_replaced_with_their_schema(spark):
    try:
        sinks.save(spark.range(3), "orrery_t")
        sinks.save(spark.range(2).withColumnRenamed("id", "x"), "orrery_t")
        assert spark.table("orrery_t").columns == ["x"] and spark.table("orrery_t").count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS orrery_t")
    df = spark.range(100).repartition(7)
    assert sinks.fingerprint(df).first() == sinks.fingerprint(df.orderBy("id")).first() != sinks.fingerprint(spark.range(99)).first()
    assert sinks.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_differences(spark):
    a = sinks.snapshot(spark.createDataFrame([(1, 0.1), (2, None)], "k int, v double"))
    b = sinks.snapshot(spark.createDataFrame([(2, None), (1, 0.1 + 1e-12)], "k int, v double"))
    assert tools.differences({"t": a}, {"t": b}) == []
    c = sinks.snapshot(spark.createDataFrame([(1, 0.2), (2, None)], "k int, v double"))
    assert tools.differences({"t": a, "only": a}, {"t": c}) == ["only: only in the old", "t: row 0, v"]
    assert tools.differences({"t": a}, {"t": sinks.snapshot(spark.range(2))}) == ["t: schema"]


def test_copies(spark):
    df = spark.createDataFrame([("101/1", 5, "a"), ("", 6, None), (None, None, "b")], "policy string, id int, note string")
    got = tools.copies(df, 3, ["policy"], {"id": 10}).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        str((p if not p or not k else f"{p}-x{k}", None if i is None else i + 10 * k, n)) for p, i, n in map(tuple, df.collect()) for k in range(3)
    )
    far = spark.createDataFrame([(2147483000,)], "id int")
    assert tools.copies(far, 2, [], {"id": 600}).count() == 2
    with pytest.raises(Exception, match="leaves its type"):
        tools.copies(far, 2, [], {"id": 10_000_000}).collect()


def test_places_and_first_differences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ALIKE_AT_ONCE", 7)
    rows = [(i % 5, None if i % 3 else float(i % 7), "x") for i in range(300)] + [(2, 1.5, "hot")] * 200
    df = spark.createDataFrame(rows, "K int, v double, k2 string").repartition(6)
    got = sinks.placed(df, f"{tmp_path}/a").orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    assert [tuple(r[1:]) for r in got] == want and [r.place for r in got] == list(range(500))
    assert sinks.placed(df.limit(0), f"{tmp_path}/e").count() == 0

    def compared(a, b):
        left = sinks.placed(spark.createDataFrame(a, "k int, v double"), f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
        right = sinks.placed(spark.createDataFrame(b, "k int, v double"), f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
        return tools.first_difference(left, right, "t").first().differs

    nan = float("nan")
    assert compared([(1, 0.1), (2, None), (3, nan)], [(3, nan), (2, None), (1, 0.1 + 1e-12)]) == ""
    assert compared([(1, 0.1), (2, 0.0)], [(1, 0.2), (2, 1e-300)]) == "t: row 0, v"
    assert compared([(1, 0.1), (2, None)], [(1, 0.1), (2, 3.0)]) == "t: row 1, v"
    assert compared([(1, 0.1), (2, None)], [(1, 0.1)]) == "t: 2 rows, 1 rows" and compared([], []) == ""
    with pytest.raises(ValueError, match="placed"):
        monkeypatch.setattr(sinks, "SNAPSHOT_ROWS", 10)
        sinks.snapshot(df)


def test_rows_that_differ_are_numbered_without_a_shuffle(spark, tmp_path):
    df = spark.range(500).selectExpr("(id * 37) % 500 AS k", "CAST(id AS STRING) AS s").repartition(5)
    got = sinks.placed(df, f"{tmp_path}/a")
    assert [(r.place, r.k) for r in got.orderBy("place").collect()] == [(k, k) for k in range(500)]
    assert "ENSURE_REQUIREMENTS" not in got.select("place", "s")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert tools.early_difference(df, df.limit(7), "t") == "t: 500 rows, 7 rows" and tools.early_difference(df, df.repartition(2), "t") is None
    assert tools.early_difference(df, df.select("s"), "t") == "t: schema"


def test_first_differences_by_key_are_those_of_numbered_rows(spark, tmp_path, monkeypatch):
    rows = [(None if i % 50 == 7 else f"k{i % 90:02}é", i % 4, None if i % 11 == 3 else i / 7, i % 3 or None) for i in range(400)] + [("k05é", 1, 0.25, 2)] * 9

    def changed(k, **cells):
        return [tuple(cells.get(c, v) for c, v in zip("abcd", r, strict=True)) if i == k else r for i, r in enumerate(rows)]

    news = {
        "same": rows[::-1], "near": [(a, b, c and c * (1 + 1e-13), d) for a, b, c, d in rows], "far": [(a, b, c and c * (1 + 1e-7), d) for a, b, c, d in rows],
        "null": changed(260, d=None), "more": changed(300, a="k05é"), "less": changed(8, a="k91"), "none": changed(200, a=None), "two": changed(350, b=9, c=float("nan")), "rows": rows[1:],
    }

    def said(columns, some):
        def ordered(table):
            picked = [tuple(r["abcd".index(c)] for c in columns) for r in table]
            return sorted(picked, key=lambda r: [(v is not None, v != v, 0 if v is None or v != v else v) for v in r])

        if len(some) != len(rows):
            return f"t: {len(rows)} rows, {len(some)} rows"
        for k, (x, y) in enumerate(zip(ordered(rows), ordered(some), strict=True)):
            bad = [c for c, v, w in zip(columns, x, y, strict=True) if v != w and not (c == "c" and v and w and abs(v - w) <= 1e-9 * max(abs(v), abs(w)))]
            if bad:
                return f"t: row {k}, {', '.join(bad)}"
        return ""

    def numbered(df):
        if not may_number:
            raise AssertionError("rows are numbered")
        return sinks.placed(df, f"{tmp_path}/{len(list(tmp_path.iterdir()))}")

    def compared(columns, *names):
        old, *others = (spark.createDataFrame(some, "a string, b int, c double, d long").select(*columns).repartition(3) for some in (rows, *[news[n] for n in names]))
        assert tools.first_differences(old, dict(zip(names, others, strict=True)), "t", numbered) == {n: said(columns, news[n]) for n in names}

    may_number = False
    monkeypatch.setattr(tools, "TASK_ROWS", 1_000)
    compared("abcd", *news)
    monkeypatch.setattr(tools, "ROUND_ROWS", 150)  # ranges of keys
    compared("abcd", *news)
    monkeypatch.setattr(tools, "SHARED_KEY", 40)  # a key of three columns
    compared("bdac", "same", "near", "more", "none", "two")
    with pytest.raises(AssertionError, match="numbered"):
        compared("ca", "same")
    may_number = True
    compared("ca", "same", "null", "more")  # fractions come first
    compared("bc", "near", "two")  # too many rows of a key
    assert tools.first_differences(spark.range(0), {"x": spark.range(0)}, "t", numbered) == {"x": ""}


def test_compared_line_items_are_not_numbered_and_leave_no_shuffle(spark, monkeypatch):
    def placed(df, path):
        raise AssertionError("rows are numbered")

    def shuffles():
        return set(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))

    monkeypatch.setattr(sinks, "placed", placed)
    monkeypatch.setattr(tools, "ROUND_ROWS", 2_000)
    before = shuffles()
    got = dict((r.copy, r.differs) for r in roundtrips.tls2_differences(spark, "/root/testdata/sf0.001").collect())
    assert got["same"] == got["near"] == "" and got["type"] == "t: schema" and " rows, " in got["rows"]
    assert not {f for f in shuffles() - before if "shuffle_" in f}


def test_balanced_reads(spark):
    keys = spark.range(4000).selectExpr("id * id AS k").unionByName(spark.sql("SELECT CAST(9 AS BIGINT) AS k FROM range(700)")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k FROM range(50)"))
    found = readers.balanced_predicates(keys, "k", 8)
    counts = [keys.where(p).count() for p in found]
    assert sum(counts) == keys.count() and max(counts) <= 2 * keys.count() / 8
    assert keys.where("NOT (" + ") AND NOT (".join(f"coalesce({p}, false)" for p in found) + ")").count() == 0
    assert readers.balanced_predicates(keys.where("k IS NULL"), "k", 8) == readers.balanced_predicates(keys, "k", 1) == ["1 = 1"]
    assert Settings.from_environment({"JDBC_BALANCE": "id, 8"}).jdbc_balance == ("id", 8)
    for bad in ("id", "id,0", ",3", "id,x"):
        with pytest.raises(ValueError, match="balanced"):
            Settings.from_environment({"JDBC_BALANCE": bad})


def test_bulk_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b'id,name,v\r\n1,"two\nlines",1.5\r\n2,,\r\nx,y,1\r\n,n,2\r\n3,a\r\n4,a,1,2\r\n5,b,1e400x\r\n')
    good, bad = bulk.bulk_load(spark, f"{tmp_path}/in", "id INT, name STRING, v DOUBLE", f"{tmp_path}/out", ("id",))
    assert sorted(map(tuple, good.collect())) == [(1, "two\nlines", 1.5), (2, None, None)]
    assert sorted((r.reason, r.record) for r in bad.collect()) == [("fields", "3,a"), ("fields", "4,a,1,2"), ("missing: id", ",n,2"), ("type: id", "x,y,1"), ("type: v", "5,b,1e400x")]


def test_a_load_that_fails_leaves_the_old_rows(spark):
    options = {"url": "jdbc:derby:memory:orrery_whole;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}

    def seen():
        return sorted(tuple(r) for r in spark.read.format("jdbc").options(**options, dbtable="t").load().collect())

    old, new = spark.createDataFrame([(1, "a")], "k int, s string"), spark.createDataFrame([(2, "b"), (3, None)], "k int, s string")
    assert sinks.load_whole(old, "t", options) == 1 and seen() == [(1, "a")]
    broken = new.selectExpr("k", "if(k = 3, raise_error('broken'), s) AS s")
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            sinks.load_whole(broken, "t", options)
        assert seen() == [(1, "a")]
    assert sinks.load_whole(new, "t", options) == 2 and len(seen()) == 2
    assert sinks.load_whole(old.limit(0), "t", options) == 0 and seen() == []
    with pytest.raises(Exception):  # no database, no guess
        sinks.load_whole(old, "t", {**options, "url": "jdbc:derby:memory:orrery_not_there"})


def test_plans_logs_and_cards(spark):
    big, small = spark.range(1000).selectExpr("id % 7 AS k"), spark.range(5).withColumnRenamed("id", "k")
    found = tools.plan_features(big.join(small.hint("broadcast"), "k").groupBy("k").count())
    assert found.joins == {"BroadcastHashJoin": 1} and found.exchanges["hashpartitioning"] == 1 and found.python == 0
    log = [json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Task Metrics": {"Executor Run Time": t, "Disk Bytes Spilled": 10**6, "JVM GC Time": 5}}) for t in (1000, 9000, 1000)]
    log.append(json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Name": "save", "Submission Time": 0, "Completion Time": 9500}}))
    (report,) = tools.stages_of_event_log(log)
    assert (report.tasks, report.longest_s, report.median_s, report.wall_s, report.spill_mb) == (3, 9.0, 1.0, 9.5, 3.0)
    log = [
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 4, "description": "save", "time": 1000, "physicalPlanDescription": "Exchange hashpartitioning(a)"},
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Properties": {"spark.sql.execution.id": "4"}},
        {"Event": "SparkListenerJobStart", "Job ID": 2, "Properties": {}},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLAdaptiveExecutionUpdate", "executionId": 4, "physicalPlanDescription": "AQEShuffleRead coalesced\n+- AQEShuffleRead coalesced and skewed\nBroadcastHashJoin\n== Initial Plan ==\nSortMergeJoin"},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd", "executionId": 4, "time": 3500},
        {"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 5, "description": "open", "time": 1},
    ]
    (action,) = tools.actions_of_event_log(map(json.dumps, log))
    assert (action.description, action.wall_s, action.jobs, action.plan.joins, action.plan.adaptive) == ("save", 2.5, 1, {"BroadcastHashJoin": 1}, {"coalesced": 2, "skewed": 1})
    card = tools.read_card("t", "-- display: line\n-- size: 12x6\n-- settings: {\"a\": 1}\n-- What it\n-- shows.\nSELECT 1;\n")
    assert (card.display, card.width, card.height, card.settings, card.about, card.sql) == ("line", 12, 6, {"a": 1}, "What it shows.", "SELECT 1")
    assert tools.place_cards([card, card, card]) == [(0, 0), (12, 0), (0, 6)]
    tall = tools.read_card("t", "-- size: 5x9\nSELECT 1")
    assert tools.place_cards([card, tall, card, tall, tall, tall]) == [(0, 0), (12, 0), (0, 9), (12, 9), (17, 9), (0, 18)] and tools.place_cards([]) == []
    with pytest.raises(ValueError):
        tools.read_card("t", "-- nothing")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 AS int)) AS ts, if(id % 3 = 0, 'a', 'b') AS event_type FROM range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = counts_by_window(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("orrery_counts").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert sorted(map(str, spark.table("orrery_counts").collect())) == sorted(map(str, counts_by_window(rows).collect()))
    finally:
        query.stop()
