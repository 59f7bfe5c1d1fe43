import datetime as dt

from pyspark.sql import functions as F

from orrery.operators import density, many_series, portfolio, series

D = dt.date
CLAIM = "claim_datetime date, total_claim_amount long, injury_claim_amount long, property_claim_amount long, vehicle_claim_amount long, incident_hour int, driver_age double"


def claims_on(spark, *pairs):
    return spark.createDataFrame([(d, a, 0, 0, a, 10, 30.0) for d, a in pairs], CLAIM)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_weeks_belong_to_their_iso_year(spark):
    got = by(series.claim_series(claims_on(spark, *[(D(*x), 1) for x in [(2015, 12, 31), (2016, 1, 1), (2016, 1, 4), (2018, 1, 1), (2018, 12, 31), (2019, 1, 1)]]), series.WEEK), "claim_year_week")
    assert {k: r.number_of_claims for k, r in got.items()} == {"2015-53": 2, "2016-01": 1, "2018-01": 1, "2019-01": 2}


def test_daily_mean_is_over_calendar_days(spark):
    got = by(series.claim_series(claims_on(spark, (D(2024, 1, 1), 300), (D(2024, 1, 2), 30), (D(2024, 1, 31), 600)), series.DAY), "claim_date")
    name = "30d_rolling_avg_total_claim_amount"
    assert [got[D(2024, 1, d)][name] for d in (1, 2, 31)] == [300, 165, 21]
    assert got[D(2024, 1, 1)].pct_change_number_of_claims is None and got[D(2024, 1, 2)].pct_change_number_of_claims == 0


def test_monthly_mean_is_over_rows(spark):
    got = by(series.claim_series(claims_on(spark, *[(D(2024, m, 5), a) for m, a in ((1, 100), (2, 200), (3, 300), (4, 400), (9, 500))]), series.MONTH), "claim_year_month")
    assert got["2024-04"]["3m_rolling_avg_total_claim_amount"] == 300 and got["2024-09"]["3m_rolling_avg_total_claim_amount"] == 400


def test_modes_leave_nulls_out_and_ties_to_the_smallest(spark):
    day = D(2024, 1, 1)
    rows = [(day, 1, None, None)] * 5 + [(day, 3, "Queens", 2)] * 2 + [(day, None, "Bronx", 1)] * 2 + [(D(2024, 1, 2), 1, None, None)]
    got = by(series.accident_series(spark.createDataFrame(rows, "accident_date date, accident_hour int, borough string, zip_code int").repartition(4), series.DAY), "accident_date")
    assert (got[day].most_common_borough, got[day].most_common_zip_code, got[day].number_of_accidents) == ("Bronx", 1, 9)
    assert got[D(2024, 1, 2)].most_common_borough is None


def test_grid(spark):
    rows = [(40.7121, -73.9511, 1), (40.7119, -73.9509, None), (40.8, -73.9, 2), (0.0, 0.0, 9), (40.7, -80.0, 9)]
    got = density.grid_density(spark.createDataFrame(rows, "latitude double, longitude double, number_of_persons_injured int")).collect()
    assert {tuple(r) for r in got} == {(40.712, -73.951, 2, 1), (40.8, -73.9, 1, 2)}


def test_week_has_all_its_hours(spark):
    rows = [(D(2024, 1, 1), 8), (D(2024, 1, 8), 8), (D(2024, 1, 7), 23), (D(2024, 1, 7), None)]
    got = density.weekday_hours(spark.createDataFrame(rows, "accident_date date, accident_hour int")).collect()
    assert len(got) == 168 and sum(r.number_of_accidents for r in got) == 3
    cells = {(r.weekday, r.accident_hour): r.number_of_accidents for r in got}
    assert cells["Mon", 8] == 2 and cells["Sun", 23] == 1 and cells["Tue", 0] == 0


def test_unknown_borough_is_a_group(spark):
    rows = [(D(2024, 1, 1), "BROOKLYN"), (D(2024, 1, 2), "BROOKLYN"), (D(2024, 1, 3), None)]
    got = density.monthly_by_category(spark.createDataFrame(rows, "accident_date date, borough string")).collect()
    assert {r.borough: r.number_of_accidents for r in got} == {"BROOKLYN": 2, None: 1}


def test_months_with_one_side_stay(spark):
    rows = [(D(2020, 1, 5), D(2021, 1, 5), "2016", None, 100.4), (D(2020, 1, 9), None, "2017", 10.0, 50.3)]
    got = by(portfolio.monthly_business(spark.createDataFrame(rows, "issue_date date, expiry_date date, model_year string, sum_insured double, premium double")), "year_month")
    assert tuple(got["2020-01"])[1:] == (2, 10.0, 151.0, 3.5, 0)
    assert tuple(got["2021-01"])[1:] == (0, None, 0.0, None, 1) and got[""].policies_expired == 1


def test_loss_ratio_by_incident_and_issue(spark):
    policies = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 1, 1), D(2020, 12, 31), 1000.0), ("b", D(2020, 3, 1), D(2020, 3, 1), None, 500.0)], "policy_number string, issue_date date, effective_date date, expiry_date date, premium double")
    claims = spark.createDataFrame([("a", D(2020, 1, 10), 100), ("a", D(2020, 2, 10), 75), ("b", D(2019, 12, 1), 40), ("gone", D(2020, 1, 3), 900)], "policy_number string, incident_date date, total_claim_amount long")
    got = by(portfolio.monthly_loss_ratio(claims, policies), "year_month")
    assert [got[m].loss_ratio_pct for m in ("2019-12", "2020-01", "2020-02", "2020-03")] == [None, 10.0, None, 0.0]
    assert got["2020-03"]["3m_rolling_avg_loss_ratio_pct"] == 11.67 and got["2020-02"]["3m_rolling_avg_loss_ratio_pct"] is None
    assert tuple(portfolio.totals(portfolio.monthly_loss_ratio(claims, policies)).first()) == (3, 1)


def test_segments(spark):
    policies = spark.createDataFrame([("a", "SUV", 100.0, 5.0), ("b", "SUV", 100.0, None), ("c", "", 1.0, 1.0), ("d", None, 1.0, 1.0), ("e", "VAN", 0.0, None)], "policy_number string, body string, premium double, sum_insured double")
    claims = spark.createDataFrame([("a", 50), ("c", 9)], "policy_number string, total_claim_amount long")
    got = by(portfolio.segment_risk(claims, policies, "body", "vehicle_body"), "vehicle_body")
    assert tuple(got["SUV"])[1:] == (2, 200.0, 5.0, 1, 50, 50.0, 50.0, 25.0)
    assert tuple(got["VAN"])[1:] == (1, 0.0, None, 0, 0, None, 0.0, None) and len(got) == 2


def test_contributions_sum_to_the_ratio_less_100(spark):
    rows = [(f"s{i}", "SUV", 10.0) for i in range(20)] + [("v", "VAN", 100.0), ("t", "TAXI", 0.0), ("u", " ", 100.0)]
    policies = spark.createDataFrame(rows, "policy_number string, body string, premium double")
    claims = spark.createDataFrame([("s1", 300), ("v", 50), ("none", 7)], "policy_number string, total_claim_amount long")
    got = by(portfolio.loss_contribution(claims, policies), "vehicle_body")
    assert {k: r.contribution_pct_points for k, r in got.items()} == {"SUV": 25.0, portfolio.POOLED: -12.5, portfolio.UNKNOWN: -25.0}
    assert sum(r.contribution_pct_points for r in got.values()) == 350 / 400 * 100 - 100
    assert got[portfolio.POOLED].number_of_policies == 2


def test_modes_of_columns_with_as_many_values_as_rows(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id + 10 AS every", "CAST(id % 2 AS string) AS two", "CAST(NULL AS int) AS never")
    df = df.unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS g, CAST(7 AS bigint) AS every, 'x' AS two, 1 AS never"))
    got = {r.g: (r.e, r.t, r.n) for r in series.modes(df, "g", {"every": "e", "two": "t", "never": "n"}).collect()}
    assert got == {0: (10, "0", None), 1: (11, "1", None), 2: (12, "0", None), None: (7, "x", 1)}


def test_windows_over_many_series_need_no_single_partition(spark):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=3 * i + (k or 0)), i * 7 % 11 + 1) for k in (1, 2, None) for i in range(120)] + [(1, None, 5)]
    df = spark.createDataFrame(rows, "k int, day date, v long").repartition(5)
    for size in (7, 30, 400):
        got = many_series.rolling_calendar_means(df, ("k",), "day", "v", "m", days=30, segment_days=size)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        found = {(r.k, r.day): r.m for r in got.collect()}
        assert len(found) == len(rows)
        for k, day, _ in rows:
            if day is None:
                assert found[k, day] is None
                continue
            first = min(d for x, d, _ in rows if x == k and d)
            recent = sum(v for x, d, v in rows if x == k and d and dt.timedelta(0) <= day - d < dt.timedelta(days=30))
            assert abs(found[k, day] - recent / min(30, (day - first).days + 1)) < 1e-9
    dated = df.where("day IS NOT NULL")
    got = many_series.running_totals(dated, ("k",), ("day",), F.trunc("day", "month"), "v", "t")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert all(r.t == sum(v for x, d, v in rows if x == r.k and d and d <= r.day) for r in got.collect())
