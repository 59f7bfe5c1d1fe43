"""Records that span lines, against Spark's own reader, which reads such a file in one task."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.plans import roundtrips
from orrery.sources import readers, records

CSV = "k INT, a STRING, b STRING, v DOUBLE"
JSON = "k INT, a STRING, deep STRUCT<x: ARRAY<INT>, s: STRING>"


def same(left, right):
    assert left.schema.simpleString() == right.schema.simpleString()
    return sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def field(rng):
    text = "".join(rng.choice(["x", "é", ",", "\n", '\\"', "\\\\", "\r\n", " ", "yy", "'"]) for _ in range(rng.randrange(6)))
    return f'"{text}"' if rng.random() < 0.7 else rng.choice(["", "plain", 'in"side', "5' 3\""])


@pytest.mark.parametrize("seed", [1, 2])
def test_csv_with_line_breaks_equals_the_reader(spark, tmp_path, seed):
    rng = random.Random(seed)
    ends = rng.choice(["\n", "\r\n"]) if seed == 2 else "\n"
    for name in ("one.csv", "two.csv"):
        lines = ['k,a,"b\nc",v'] + [f"{i},{field(rng)},{field(rng)},{rng.choice(['', '1.5', 'bad'])}" for i in range(400)]
        (tmp_path / name).write_bytes((ends.join(lines) + (ends if name < "p" else "")).encode())
    read = readers.read_file(spark, str(tmp_path), "csv", True, CSV, split_bytes=300)
    assert read.rdd.getNumPartitions() > 20
    want = spark.read.option("header", True).option("multiLine", True).schema(CSV).csv(str(tmp_path))
    assert same(read, want) and read.count() == 800


def test_a_field_over_many_ranges(spark, tmp_path):
    long = "line\n" * 500
    (tmp_path / "a.csv").write_text(f'k,a,b,v\n1,"{long}",y,2\n2,z,"{long}",3\n\n3,,,\n4,"open{long}')
    read = readers.read_file(spark, str(tmp_path), "csv", True, CSV, split_bytes=100)
    rows = sorted(read.collect(), key=lambda r: r.k)
    assert [r.k for r in rows] == [1, 2, 3, 4] and rows[0].a == rows[1].b == long and rows[2].v is None
    assert rows[3].a.startswith("openline")


@pytest.mark.parametrize("form", ["compact", "pretty", "lines", "broken"])
def test_json_arrays_equal_the_reader(spark, tmp_path, form):
    rng = random.Random(3)
    words = ["}", "{", '"', "\\", "]", "[", "é", "\n", "x,", "}{"]
    data = [{"k": i, "a": "".join(rng.choice(words) for _ in range(rng.randrange(9))), "deep": {"x": [i, {}] and [i], "s": rng.choice(words)}} for i in range(300)]
    data[7] = {}
    text = {"compact": json.dumps(data), "pretty": json.dumps(data, indent=2, ensure_ascii=False) + "\n", "broken": json.dumps(data)[:-40]}.get(form)
    (tmp_path / "a.json").write_text(text if text else "\n".join(map(json.dumps, data)))
    read = readers.read_file(spark, str(tmp_path), "json", True, JSON, split_bytes=400)
    assert read.rdd.getNumPartitions() > 20
    if form == "broken":  # every object that is whole is read; Spark's reader gives up the file
        got = {r.k: r for r in read.collect() if r.k is not None}
        assert len(got) >= 298 and got[5].a == data[5]["a"] and read.count() == 300
        return
    want = spark.read.option("multiLine", form != "lines").schema(JSON).json(str(tmp_path))
    assert same(read, want) and read.count() == 300


def test_ranges_grow_with_the_file(spark, tmp_path):
    counts = []
    for size in (1 << 20, 8 << 20):
        (tmp_path / f"{size}").mkdir()
        line = "x" * 99 + "\n"
        (tmp_path / f"{size}" / "a.csv").write_text(line * (size // len(line)))
        path = str(tmp_path / f"{size}")
        made = records.with_range_bytes(spark, roundtrips._range_bytes(spark, path))
        counts.append(made.read.text(path).rdd.getNumPartitions())
    most = roundtrips.RANGES * spark.sparkContext.defaultParallelism
    assert 1 < counts[0] <= most and 1 < counts[1] <= most


def test_steps_from_either_state():
    csv, js = records.KINDS["csv"], records.KINDS["json"]
    assert csv.step('a,"b', False) == (True, 0) and csv.step('b",c', True) == (False, 0) and csv.step('a"b', False) == (False, 0)
    assert csv.step('b"",', True) == (True, 0) and csv.step('b\\"', True) == (True, 0) and csv.step('b",",",""', True) == (False, 0)
    assert js.step('{"a": "}', False) == (True, 1) and js.step('"}', True) == (False, -1) and js.step('[{"a": [1', False) == (False, 3)


def test_files_without_records(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text("k,a,b,v\n")
    (tmp_path / "e.json").write_text("[]\n")
    assert readers.read_file(spark, f"{tmp_path}/*.csv", "csv", True, CSV).count() == 0
    assert readers.read_file(spark, f"{tmp_path}/*.json", "json", True, JSON).count() == 0
    made = records.with_range_bytes(spark, 1000)
    assert made is not spark and spark.range(1).select(F.lit(1)).count() == 1
    assert made.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
