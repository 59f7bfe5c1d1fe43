import datetime
import datetime as dt
import random
from decimal import Decimal

import pytest

from orrery.operators import cleaning, quality
from orrery.sources.readers import CLAIMS

D = dt.date


def claim(no="c", policy="p", age=40.0, licence="06-03-2007", day="04-01-2015", hour=5, injury=1, at="2015-01-04 10:00:00"):
    return ((injury, 2, 3, 4), at, no, (1, "x"), (age, "son", licence), (day, hour, "s", "t"), 1, 2, policy, True, D(2024, 1, 1))


def cleaned(spark, *rows):
    return cleaning.clean_claims(spark.createDataFrame(list(rows), CLAIMS + ", ingestion_timestamp DATE"))


def test_claims(spark):
    rows = [claim("a", age=0.0, licence="01-01-1900"), claim("b", age=15.0, licence="1-1-2001"), claim("c", age=16.0), claim("d", licence="31-02-2001", at="later", injury=None)]
    got = {r.claim_number: r for r in cleaned(spark, *rows).collect()}
    assert [got[k].driver_age for k in "abc"] == [None, None, 16.0]
    assert [got[k].license_issue_date for k in "abcd"] == [None, None, D(2007, 3, 6), None]
    assert got["c"].incident_date == D(2015, 1, 4) and got["d"].claim_datetime is None and got["d"].injury_to_person == 0
    left = cleaned(spark, claim("a", hour=23), claim("b", hour=24), claim("c", hour=None), claim(None), claim("e", policy=None), claim("f", day="2015-01-04"))
    assert [r.claim_number for r in left.collect()] == ["a"] and len(left.columns) == 21


POLICY = "CUST_ID double, policy_NO string, issue string, eff string, expiry string, dob string, premium double, sum_insured double, body string"
SPECS = [{"name": "cust_id", "alias": "customer_id"}, {"name": "POLICY_NO", "alias": "policy_number"}, {"name": "issue", "alias": "issue_date"}, {"name": "eff", "alias": "effective_date"}, {"name": "expiry", "alias": "expiry_date"}, {"name": "dob", "alias": "driver_dob"}]


def policy(number, issue="01-01-2015", expiry="01-01-2016", premium=10.0, insured=None, body="SUV", customer=1.0):
    return (customer, number, issue, "never", expiry, "01-01-1980", premium, insured, body)


@pytest.mark.parametrize("turned", [False, True])
def test_policies_keep_one_valid_row(spark, turned):
    rows = [
        policy("p1", "01-05-2016"), policy("p1", "01-05-2017"), policy("p1", "01-05-2018", premium=-1.0),
        policy("p2", expiry="10-02-2019"), policy("p2", expiry=None), policy("p3", premium=1900.0), policy("p3", premium=20.0),
        policy("p4", body="SALOON"), policy("p4", body="4 WD"), policy("p5", insured=-1.0), policy("p6", insured=0.0),
        policy("p7", issue="soon"), policy("p8", customer=None), policy(None), policy("p9", premium=None),
    ]
    raw = spark.createDataFrame(rows[::-1] if turned else rows, POLICY).repartition(3 if turned else 1)
    got = {r.policy_number: r for r in cleaning.clean_policies(raw, SPECS).collect()}
    assert got.keys() == {"p1", "p2", "p3", "p4", "p6"}
    assert (got["p1"].issue_date, got["p2"].expiry_date, got["p3"].premium, got["p4"].body) == (D(2017, 5, 1), D(2019, 2, 10), 1900.0, "4 WD")
    assert got["p1"].effective_date is None


def test_accidents(spark):
    names = "ACCIDENT_DATE string, ACCIDENT_TIME string, ZIP_CODE string, LATITUDE double, LONGITUDE double, NUMBER_OF_PERSONS_INJURED string, NUMBER_OF_PERSONS_KILLED string, NUMBER_OF_MOTORIST_INJURED string, NUMBER_OF_MOTORIST_KILLED string, COLLISION_ID int"
    good = ("2019-11-03", "7:45", "10001.0", 40.0, -73.0, "2", "x", None, "1e99", 1)
    rows = [good, ("2019-11-03", "24:00", "1e12", 90.0, 180.0, "2", "x", None, "1", 2), ("odd", *good[1:]), (*good[:3], 91.0, *good[4:]), (*good[:4], -181.0, *good[5:]), (*good[:9], None), (*good[:3], None, *good[4:])]
    got = cleaning.clean_accidents(spark.createDataFrame(rows, names), [{"name": n.split()[0].lower(), "alias": "no"} for n in names.split(", ")]).collect()
    assert [(r.collision_id, r.accident_hour, r.zip_code, r.number_of_persons_injured, r.number_of_persons_killed, r.number_of_motorist_killed) for r in got] == [("1", 7, 10001, 2, None, None), ("2", None, None, 2, None, 1)]


def test_renames(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"name": "a", "alias": "x"}, {"name": "B"}]')
    specs = cleaning.read_specs(str(tmp_path / "s.json"))
    df = spark.createDataFrame([(1, 2, 3)], "A int, b int, c int")
    assert cleaning.rename_by_specs(df, specs).columns == ["x", "B", "c"]
    assert cleaning.rename_by_specs(df, specs, aliases=False).columns == ["a", "B", "c"]
    with pytest.raises(ValueError, match="no column 'z'; there are A, b, c"):
        cleaning.rename_by_specs(df, [{"name": "z"}])
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert cleaning.with_all(nan, "x").count() == 1


CHECKED = "claim_number string, policy_number string, incident_date date, incident_hour int, total_claim_amount long"
GOOD = [("a", "p", D(2020, 1, 1), 0, 0), ("b", "p", D(2020, 1, 1), 23, 5)]


def test_quality(spark):
    suite = quality.SUITES["silver_claims"]

    def report(*rows):
        return quality.validate(spark.createDataFrame(GOOD + list(rows), CHECKED), "silver_claims", suite)

    assert report() == quality.Report("silver_claims", True, [])
    assert report(("c", "p", D(2020, 1, 1), 24, 1)).failed_expectations == ["expect_column_values_to_be_between"]
    assert report(GOOD[0]).failed_expectations == ["expect_column_values_to_be_unique"]
    bad = report((None, None, None, None, -1))
    assert bad.failed_expectations == ["expect_column_values_to_not_be_null"] * 3 + ["expect_column_values_to_be_between"]
    assert [len(s) for s in quality.SUITES.values()] == [6, 6, 4]
    assert quality.violations(spark.createDataFrame([], CHECKED), suite).where("broken > 0").count() == 0
    assert quality.violations(spark.createDataFrame([], CHECKED), ()).count() == 0


def test_the_gate_names_every_failure(spark):
    bad = spark.createDataFrame([("a", None, None, 30, 1)], CHECKED)
    policies = spark.createDataFrame([(1.0, "p", D(2020, 1, 1), 1.0, None), (1.0, "p", D(2020, 1, 1), 1.0, None)], "customer_id double, policy_number string, issue_date date, premium double, sum_insured double")
    with pytest.raises(quality.DataQualityError, match="silver_claims: .*null.*between; silver_policies: expect_column_values_to_be_unique"):
        quality.gate({"silver_claims": bad, "silver_policies": policies})
    assert quality.gate({"silver_policies": policies.limit(1)})[0].success


def test_the_first_of_a_key_equals_the_ranking(spark):
    kinds = "k int, i bigint, d double, b boolean, day date, t timestamp, n timestamp_ntz, m decimal(9,2), s string, z double"
    rng = random.Random(8)
    pick = lambda *values: rng.choice([None, *values])
    day = datetime.date
    rows = [
        (
            pick(1, 2, 3), pick(-(2**63), 5, 2**63 - 1), pick(0.5, float("nan"), -1.0), pick(True, False), pick(day(1, 1, 1), day(2024, 5, 1)),
            pick(datetime.datetime(1960, 1, 1), datetime.datetime(2024, 1, 1, 1, 1, 1, 5)), pick(datetime.datetime(1900, 1, 1), datetime.datetime(2024, 1, 1)),
            pick(Decimal("1.25"), Decimal("-3")), pick("a", "b"), pick(1.0, 2.0),
        )
        for _ in range(200)
    ]
    df = spark.createDataFrame(rows, kinds).repartition(5)
    for best in (("i", "d"), ("d", "b", "m"), ("day", "n"), ("t",), ()):
        rest = sorted({*df.columns} - {"k", *best})
        got, want = cleaning.keep_first(df, "k", best), cleaning._first_by_rank(df, "k", best, rest)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan and plan.count("ObjectHashAggregate") == 2
        assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), best
    assert cleaning.keep_first(df, "k", ("s",)).count() == 4  # texts can't be turned round


def test_uniqueness_by_hashes(spark):
    df = spark.sql("SELECT id, id % 100 AS k, if(id % 3 = 0, NULL, cast(id AS string)) AS s, cast(id AS double) AS v FROM range(1000)")
    suite = (quality.Unique("k"), quality.NotNull("s"), quality.Unique("s"), quality.Between("v", 10, 899), quality.Unique("id"))
    got = {r.check: r.broken for r in quality.violations(df, suite).collect()}
    assert got == {0: 100, 1: 334, 2: 0, 3: 110, 4: 0}
    empty = {r.check: r.broken for r in quality.violations(df.limit(0), suite).collect()}
    assert empty == dict.fromkeys(range(5), 0) and quality.violations(df, ()).count() == 0
