import datetime as dt

from pyspark.sql import functions as F

from orrery.functions import columns as c

D = dt.date


def days(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "day date")


def test_labels(spark):
    got = days(spark, D(2016, 1, 1), D(2018, 12, 31), D(2018, 1, 3), D(2016, 1, 4), D(2024, 3, 9), None)
    rows = got.select(c.week_label("day"), c.month_label("day"), c.iso_weekday("day")).collect()
    assert [tuple(r) for r in rows] == [("2015-53", "2016-01", 5), ("2019-01", "2018-12", 1), ("2018-01", "2018-01", 3), ("2016-01", "2016-01", 1), ("2024-10", "2024-03", 6), ("", "", None)]


def test_ratios_are_null_without_a_whole(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 3.0), (0.0, 2.0)], "a double, b double")
    got = rows.select(c.percent(F.col("a"), F.col("b")), c.ratio_if_positive(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (33.33, 33.33), (0.0, 0.0)]


def test_outside_is_certain_or_not_at_all(spark):
    day, a, z = D(2020, 1, 5), D(2020, 1, 1), D(2020, 2, 1)
    rows = [(day, a, z), (D(2019, 1, 1), a, z), (D(2021, 1, 1), a, z), (D(2019, 1, 1), a, None), (D(2021, 1, 1), a, None), (day, None, None), (a, a, a)]
    frame = spark.createDataFrame(rows, "d date, s date, e date")
    assert [r[0] for r in frame.select(c.outside(F.col("d"), F.col("s"), F.col("e"))).collect()] == [0, 1, 1, 1, 0, 0, 0]
