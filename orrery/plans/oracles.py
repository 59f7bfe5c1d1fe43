"""DuckDB SQL of the registered queries, written over the same raw tables, in its own way."""

from __future__ import annotations

import re

POLICIES = """
policies AS (
    SELECT o_orderkey AS policy_number, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS issue_date,
           CAST(o_orderdate AS DATE) AS effective_date, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS expiry_date,
           CAST(floor(o_totalprice) AS DOUBLE) AS premium,
           CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice) * 10 AS DOUBLE) END AS sum_insured,
           nullif(n_name, 'KENYA') AS body, c_mktsegment AS vehicle_usage, year(o_orderdate) - o_orderkey % 20 AS model_year
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= 20000
)"""

CLAIMS = """
claims AS (
    SELECT policy_number, claim_number, claim_datetime, amount AS total, amount // 4 AS injury, amount // 2 AS property,
           amount - amount // 4 - amount // 2 AS vehicle, incident_date, incident_hour, driver_age
    FROM (SELECT l_orderkey AS policy_number, l_orderkey * 10 + l_linenumber AS claim_number,
                 CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) + l_linenumber END AS claim_datetime,
                 CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS amount, CAST(l_shipdate AS DATE) AS incident_date,
                 CAST(l_quantity AS INTEGER) % 24 AS incident_hour, CASE WHEN l_quantity >= 16 THEN l_quantity END AS driver_age
          FROM lineitem)
)"""

ACCIDENTS = """
accidents AS (
    SELECT CAST(ts AS DATE) - CAST(8400 + event_id % 1500 AS INTEGER) AS day, hour(ts) AS hour, nullif(event_type, 'error') AS borough, CAST(user_id AS INTEGER) AS zip_code,
           ts FROM events
)"""


def label(day: str, grain: str) -> str:
    return {
        "date": day,
        "year_week": f"coalesce(strftime({day}, '%G-%V'), '')",
        "year_month": f"coalesce(strftime({day}, '%Y-%m'), '')",
    }[grain]


def trend(source: str, period: str, grain: str, count: str, value: str) -> str:
    """Growth and rolling mean on top of a table of periods."""
    prefix, frame = {"date": ("30d", 0), "year_week": ("4w", 3), "year_month": ("3m", 2)}[grain]
    if grain == "date":
        mean = f"""round(sum({value}) OVER (ORDER BY {period} NULLS FIRST RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
                   / least(30, date_diff('day', min({period}) OVER (), {period}) + 1))"""
    else:
        mean = f"round(avg({value}) OVER (ORDER BY {period} ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW))"
    before = f"lag({count}) OVER (ORDER BY {period} NULLS FIRST)"
    return f"""SELECT *, round(({count} - {before}) / {before} * 100, 2) AS pct_change_{count},
       {mean} AS "{prefix}_rolling_avg_{value}" FROM {source}"""


def claim_series(grain: str) -> str:
    period = f"claim_{grain}"
    return f"""(WITH t AS (
    SELECT {label("claim_datetime", grain)} AS {period}, count(*) AS number_of_claims, CAST(sum(total) AS BIGINT) AS total_claim_amount,
           CAST(sum(injury) AS BIGINT) AS injury_claim_amount, CAST(sum(property) AS BIGINT) AS property_claim_amount,
           CAST(sum(vehicle) AS BIGINT) AS vehicle_claim_amount, round(avg(incident_hour)) AS average_incident_hour,
           round(avg(driver_age)) AS average_driver_age
    FROM claims GROUP BY 1)
    {trend("t", period, grain, "number_of_claims", "total_claim_amount")})"""


def accident_series(grain: str) -> str:
    period = f"accident_{grain}"

    def mode(name: str) -> str:
        return f"""(SELECT {period}, {name} FROM (SELECT {label("day", grain)} AS {period}, {name}, row_number() OVER
            (PARTITION BY {label("day", grain)} ORDER BY count(*) DESC, {name}) AS r FROM accidents WHERE {name} IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""

    return f"""(WITH g AS (
    SELECT {label("day", grain)} AS {period}, count(*) AS number_of_accidents, round(avg(hour)) AS average_accident_hour FROM accidents GROUP BY 1
    ), t AS (
    SELECT g.*, b.borough AS most_common_borough, z.zip_code AS most_common_zip_code
    FROM g LEFT JOIN {mode("borough")} b USING ({period}) LEFT JOIN {mode("zip_code")} z USING ({period}))
    {trend("t", period, grain, "number_of_accidents", "number_of_accidents")})"""


def segment(column: str, name: str) -> str:
    return f"""(WITH p AS (
    SELECT {column} AS {name}, count(*) AS number_of_policies, round(sum(premium)) AS total_premium, round(sum(sum_insured)) AS exposure
    FROM policies WHERE {column} <> '' GROUP BY 1
    ), l AS (
    SELECT p.{column} AS {name}, count(*) AS n, CAST(sum(c.total) AS BIGINT) AS amount, round(avg(c.total)) AS severity
    FROM claims c JOIN policies p USING (policy_number) WHERE p.{column} <> '' GROUP BY 1)
    SELECT p.*, coalesce(n, 0) AS number_of_claims, coalesce(amount, 0) AS total_claim_amount, severity AS avg_claim_severity,
           round(coalesce(n, 0) / number_of_policies * 100, 2) AS claims_per_100_policies,
           CASE WHEN total_premium > 0 THEN round(coalesce(amount, 0) / total_premium * 100, 2) END AS loss_ratio_pct
    FROM p LEFT JOIN l USING ({name}))"""


TABLES = {
    "gold_claims_daily": claim_series("date"),
    "gold_claims_weekly": claim_series("year_week"),
    "gold_claims_monthly": claim_series("year_month"),
    "gold_accidents_daily": accident_series("date"),
    "gold_accidents_weekly": accident_series("year_week"),
    "gold_accidents_monthly": accident_series("year_month"),
    "gold_accident_grid": """(
    SELECT round(CAST(embedding[1] AS DOUBLE), 1) + 0.0 AS latitude, round(CAST(embedding[2] AS DOUBLE), 1) + 0.0 AS longitude,
           count(*) AS number_of_accidents, CAST(sum(CASE WHEN label > 3 THEN label ELSE 0 END) AS BIGINT) AS number_of_persons_injured
    FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) BETWEEN -0.3 AND 0.3 AND CAST(embedding[2] AS DOUBLE) BETWEEN -0.3 AND 0.3 GROUP BY 1, 2)""",
    "gold_accidents_weekday_hour": """(
    SELECT CAST(d AS INTEGER) AS weekday_number, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][d] AS weekday, CAST(h AS INTEGER) AS accident_hour,
           count(ts) AS number_of_accidents
    FROM range(1, 8) x(d) CROSS JOIN range(24) y(h) LEFT JOIN accidents ON isodow(day) = d AND hour = h GROUP BY d, h)""",
    "gold_accidents_borough_monthly": f"""(
    SELECT {label("day", "year_month")} AS accident_year_month, borough, count(*) AS number_of_accidents FROM accidents GROUP BY 1, 2)""",
    "gold_policies_monthly": f"""(
    SELECT year_month, coalesce(i.n, 0) AS policies_issued, exposure, coalesce(total_premium, 0) AS total_premium, avg_issue_age_of_vehicle,
           coalesce(e.n, 0) AS policies_expired
    FROM (SELECT {label("issue_date", "year_month")} AS year_month, count(*) AS n, round(sum(sum_insured)) AS exposure, round(sum(premium)) AS total_premium,
                 round(avg(year(issue_date) - model_year), 1) AS avg_issue_age_of_vehicle FROM policies GROUP BY 1) i
    FULL JOIN (SELECT {label("expiry_date", "year_month")} AS year_month, count(*) AS n FROM policies GROUP BY 1) e USING (year_month))""",
    "gold_loss_ratio_monthly": f"""(WITH m AS (
    SELECT year_month, coalesce(n, 0) AS number_of_claims, coalesce(amount, 0) AS total_claim_amount, coalesce(beyond, 0) AS claims_outside_policy_period,
           coalesce(premium, 0) AS total_premium
    FROM (SELECT {label("incident_date", "year_month")} AS year_month, count(*) AS n, CAST(sum(total) AS BIGINT) AS amount,
                 CAST(sum(CASE WHEN incident_date NOT BETWEEN effective_date AND expiry_date THEN 1 ELSE 0 END) AS BIGINT) AS beyond
          FROM claims JOIN policies USING (policy_number) GROUP BY 1) c
    FULL JOIN (SELECT {label("issue_date", "year_month")} AS year_month, round(sum(premium)) AS premium FROM policies GROUP BY 1) p USING (year_month))
    SELECT *, CASE WHEN total_premium > 0 THEN round(total_claim_amount / total_premium * 100, 2) END AS loss_ratio_pct,
           CASE WHEN total_premium > 0 THEN round(sum(total_claim_amount) OVER w / sum(total_premium) OVER w * 100, 2) END AS "3m_rolling_avg_loss_ratio_pct"
    FROM m WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    "gold_vehicle_body_risk": segment("body", "vehicle_body"),
    "gold_vehicle_usage_risk": segment("vehicle_usage", "vehicle_usage"),
    "gold_loss_ratio_contribution": """(WITH p AS (
    SELECT *, CASE WHEN trim(coalesce(body, '')) = '' THEN 'Unknown body' WHEN count(*) OVER (PARTITION BY body) < 550 THEN 'Other (< 20 policies)' ELSE body END AS vehicle_body FROM policies
    ), b AS (
    SELECT vehicle_body, CAST(count(*) AS BIGINT) AS number_of_policies, sum(premium) AS total_premium FROM p GROUP BY 1
    ), l AS (
    SELECT vehicle_body, CAST(sum(total) AS BIGINT) AS amount FROM claims JOIN p USING (policy_number) GROUP BY 1)
    SELECT b.*, coalesce(amount, 0) AS total_claim_amount, round((coalesce(amount, 0) - total_premium) / sum(total_premium) OVER () * 100, 4) AS contribution_pct_points,
           CASE WHEN total_premium > 0 THEN round(coalesce(amount, 0) / total_premium * 100, 2) END AS loss_ratio_pct
    FROM b LEFT JOIN l USING (vehicle_body))""",
}

_ROLES = f"{POLICIES}, {CLAIMS}, {ACCIDENTS}"


def gold_table(name: str) -> str:
    return f"WITH {_ROLES} SELECT * FROM {TABLES[name]} t"


#: SQL of the report queries over the tables above, each written by itself.
REPORTS = {
    "q01_total_claims": "SELECT CAST(sum(number_of_claims) AS BIGINT) AS total_claims FROM gold_claims_weekly",
    "q02_total_claim_amount": "SELECT CAST(sum(total) AS BIGINT) AS total_claim_amount FROM claims",
    "q03_average_claim_severity": "SELECT round(avg(total), 2) AS avg_claim_amount FROM claims",
    "q04_total_accidents": "SELECT count(*) AS total_accidents FROM accidents",
    "q05_total_policies_issued": "SELECT count(*) AS total_policies_issued FROM policies",
    "q06_business_trends_indexed": """
SELECT m AS month, round(c.v / c0.v * 100, 1) AS claims, round(a.v / a0.v * 100, 1) AS accidents, round(p.v / p0.v * 100, 1) AS policies_issued
FROM (SELECT m FROM c UNION SELECT m FROM a UNION SELECT m FROM p) LEFT JOIN c USING (m) LEFT JOIN a USING (m) LEFT JOIN p USING (m), first
LEFT JOIN c c0 ON c0.m = first.lo LEFT JOIN a a0 ON a0.m = first.lo LEFT JOIN p p0 ON p0.m = first.lo
WHERE m >= first.lo AND m <= first.hi""",
    "q07_monthly_claim_trends": """
SELECT claim_year_month, n AS number_of_claims, round((n / lag(n) OVER (ORDER BY claim_year_month) - 1) * 100, 2) AS pct_change_number_of_claims
FROM (SELECT coalesce(strftime(claim_datetime, '%Y-%m'), '') AS claim_year_month, count(*) AS n FROM claims GROUP BY ALL)""",
    "q08_claim_amount_by_type": """
SELECT coalesce(strftime(claim_datetime, '%Y-%m'), '') AS claim_year_month, CAST(sum(injury) AS BIGINT) AS injury_claim_amount,
       CAST(sum(property) AS BIGINT) AS property_claim_amount, CAST(sum(vehicle) AS BIGINT) AS vehicle_claim_amount
FROM claims GROUP BY ALL""",
    "q09_daily_claims_rolling": """
SELECT d.claim_datetime AS claim_date, d.v AS total_claim_amount,
       CASE WHEN d.claim_datetime IS NOT NULL THEN round((SELECT sum(e.v) FROM days e WHERE e.claim_datetime > d.claim_datetime - INTERVAL 30 DAY AND e.claim_datetime <= d.claim_datetime)
             / least(30, date_diff('day', (SELECT min(claim_datetime) FROM days), d.claim_datetime) + 1)) ELSE round(d.v / 30) END AS rolling_30d_avg_claim_amount
FROM days d""",
    "q10_weekly_claim_volume": """
SELECT coalesce(strftime(claim_datetime, '%G-%V'), '') AS claim_year_week, count(*) AS number_of_claims FROM claims GROUP BY ALL""",
    "q11_driver_age_and_hour": """
SELECT coalesce(strftime(claim_datetime, '%Y-%m'), '') AS claim_year_month, round(sum(driver_age) / count(driver_age)) AS average_driver_age,
       round(sum(incident_hour) / count(incident_hour)) AS average_incident_hour
FROM claims GROUP BY ALL""",
    "q12_total_accidents_by_borough": "SELECT count(ts) AS total_accidents FROM accidents",
    "q13_accidents_without_borough": "SELECT count(*) FILTER (borough IS NULL) AS accidents_with_no_borough FROM accidents",
    "q14_share_without_borough": "SELECT round(100 * (1 - count(borough) / count(*)), 1) AS pct_with_no_borough FROM accidents",
    "q15_accident_map": """
SELECT latitude, longitude, number_of_accidents, number_of_persons_injured FROM gold_accident_grid
QUALIFY row_number() OVER (ORDER BY number_of_accidents DESC, latitude, longitude) <= 2000""",
    "q16_when_accidents_happen": """
SELECT printf('%02d', h) AS hour, count(ts) FILTER (isodow(day) = 1) AS Mon, count(ts) FILTER (isodow(day) = 2) AS Tue, count(ts) FILTER (isodow(day) = 3) AS Wed,
       count(ts) FILTER (isodow(day) = 4) AS Thu, count(ts) FILTER (isodow(day) = 5) AS Fri, count(ts) FILTER (isodow(day) = 6) AS Sat, count(ts) FILTER (isodow(day) = 7) AS Sun
FROM range(24) t(h) LEFT JOIN accidents ON hour = h GROUP BY h""",
    "q17_monthly_accidents_by_borough": """
SELECT strftime(day, '%Y-%m') AS accident_year_month, borough, count(*) AS number_of_accidents FROM accidents WHERE borough IS NOT NULL GROUP BY ALL""",
    "q18_weekly_accidents_rolling": """
SELECT w AS accident_year_week, n AS number_of_accidents,
       round((n + coalesce(lag(n, 1) OVER o, 0) + coalesce(lag(n, 2) OVER o, 0) + coalesce(lag(n, 3) OVER o, 0)) / least(4, row_number() OVER o)) AS rolling_4w_avg
FROM (SELECT strftime(day, '%G-%V') AS w, count(*) AS n FROM accidents GROUP BY ALL) WINDOW o AS (ORDER BY w)""",
    "q19_monthly_accident_trends": """
SELECT accident_year_month, n AS number_of_accidents, round((n - lag(n) OVER o) * 100 / lag(n) OVER o, 2) AS pct_change_number_of_accidents
FROM (SELECT strftime(day, '%Y-%m') AS accident_year_month, count(*) AS n FROM accidents GROUP BY ALL) WINDOW o AS (ORDER BY accident_year_month)""",
    "q20_policy_growth": "SELECT strftime(issue_date, '%Y-%m') AS year_month, count(*) AS policies_issued FROM policies GROUP BY ALL",
    "q21_issued_vs_expired": """
SELECT year_month, count(*) FILTER (kind = 1) AS policies_issued, count(*) FILTER (kind = 2) AS policies_expired
FROM (SELECT strftime(issue_date, '%Y-%m') AS year_month, 1 AS kind FROM policies UNION ALL SELECT strftime(expiry_date, '%Y-%m'), 2 FROM policies) GROUP BY ALL""",
    "q22_estimated_active_policies": """
SELECT year_month, (SELECT count(*) FROM policies WHERE strftime(issue_date, '%Y-%m') <= year_month) - (SELECT count(*) FROM policies WHERE strftime(expiry_date, '%Y-%m') <= year_month) AS estimated_active_policies
FROM (SELECT strftime(issue_date, '%Y-%m') AS year_month FROM policies UNION SELECT strftime(expiry_date, '%Y-%m') FROM policies)""",
    "q23_exposure_trend": "SELECT strftime(issue_date, '%Y-%m') AS year_month, sum(sum_insured) AS exposure FROM policies GROUP BY ALL",
    "q24_vehicle_age_trend": """
SELECT strftime(issue_date, '%Y-%m') AS year_month, round(sum(year(issue_date) - model_year) / count(model_year), 1) AS avg_issue_age_of_vehicle FROM policies GROUP BY ALL""",
    "q25_overall_loss_ratio": """
SELECT round((SELECT sum(total) FROM claims SEMI JOIN policies USING (policy_number)) / (SELECT sum(premium) FROM policies) * 100, 2) AS overall_loss_ratio_pct""",
    "q26_riskiest_vehicle_body": """
SELECT vehicle_body FROM gold_vehicle_body_risk a
WHERE number_of_policies > 19 AND loss_ratio_pct IS NOT NULL
  AND NOT EXISTS (FROM gold_vehicle_body_risk b WHERE b.number_of_policies > 19 AND (b.loss_ratio_pct > a.loss_ratio_pct OR b.loss_ratio_pct = a.loss_ratio_pct AND b.vehicle_body < a.vehicle_body))""",
    "q27_loss_ratio_trend": """
SELECT year_month, round(100 * x.lost / x.premium, 2) AS loss_ratio_pct,
       CASE WHEN x.premium > 0 THEN round(100 * (x.lost + coalesce(lag(x.lost) OVER o, 0) + coalesce(lag(x.lost, 2) OVER o, 0)) / (x.premium + coalesce(lag(x.premium) OVER o, 0) + coalesce(lag(x.premium, 2) OVER o, 0)), 2) END AS "3m_rolling_avg_loss_ratio_pct"
FROM (SELECT year_month, sum(lost) AS lost, nullif(sum(premium), 0) AS premium FROM (
        SELECT strftime(incident_date, '%Y-%m') AS year_month, total AS lost, 0 AS premium FROM claims SEMI JOIN policies USING (policy_number)
        UNION ALL SELECT strftime(issue_date, '%Y-%m'), 0, premium FROM policies) GROUP BY ALL) x
WINDOW o AS (ORDER BY year_month)""",
    "q28_contribution_waterfall": """
SELECT vehicle_body, round(pts, 2) AS pct_points_vs_break_even FROM (
    SELECT vehicle_body, contribution_pct_points AS pts FROM shares WHERE better < 10
    UNION ALL SELECT 'All other bodies', sum(contribution_pct_points) FROM shares WHERE better >= 10 HAVING count(*) > 0)""",
    "q29_underwriting_risk_map": """
SELECT round(n_claims * 100 / n, 2) AS claims_per_100_policies, vehicle_body, round(lost / n_claims) AS avg_claim_severity, premium AS total_premium
FROM (SELECT body AS vehicle_body, count(*) AS n, sum(premium) AS premium FROM policies WHERE body <> '' GROUP BY ALL)
JOIN (SELECT body AS vehicle_body, count(*) AS n_claims, sum(total) AS lost FROM claims JOIN policies USING (policy_number) GROUP BY ALL) USING (vehicle_body)
WHERE n > 19""",
    "q30_loss_ratio_by_body": """
SELECT vehicle_body, loss_ratio_pct FROM gold_vehicle_body_risk WHERE number_of_policies > 19
QUALIFY row_number() OVER (ORDER BY loss_ratio_pct IS NULL, loss_ratio_pct DESC, vehicle_body) <= 15""",
    "q31_private_vs_commercial": """
SELECT vehicle_usage, n AS number_of_policies, premium AS total_premium, n_claims AS number_of_claims, round(100 * n_claims / n, 2) AS claims_per_100_policies,
       round(100 * lost / premium, 2) AS loss_ratio_pct
FROM (SELECT vehicle_usage, count(*) AS n, sum(premium) AS premium FROM policies GROUP BY ALL ORDER BY premium DESC, vehicle_usage LIMIT 2)
JOIN (SELECT vehicle_usage, count(*) AS n_claims, CAST(sum(total) AS BIGINT) AS lost FROM claims JOIN policies USING (policy_number) GROUP BY ALL) USING (vehicle_usage)""",
}

#: Named subqueries of some of these.
_HELPERS = {
    "q06_business_trends_indexed": """
c AS (SELECT strftime(claim_datetime, '%Y-%m') AS m, count(*) AS v FROM claims WHERE claim_datetime IS NOT NULL GROUP BY ALL),
a AS (SELECT strftime(day, '%Y-%m') AS m, count(*) AS v FROM accidents GROUP BY ALL),
p AS (SELECT strftime(issue_date, '%Y-%m') AS m, count(*) AS v FROM policies GROUP BY ALL),
first AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(m) AS lo, max(m) AS hi FROM c UNION ALL SELECT min(m), max(m) FROM a UNION ALL SELECT min(m), max(m) FROM p))""",
    "q09_daily_claims_rolling": "days AS (SELECT claim_datetime, CAST(sum(total) AS BIGINT) AS v FROM claims GROUP BY ALL)",
    "q28_contribution_waterfall": """
shares AS (SELECT *, (SELECT count(*) FROM gold_loss_ratio_contribution b
    WHERE abs(b.contribution_pct_points) > abs(g.contribution_pct_points) OR abs(b.contribution_pct_points) = abs(g.contribution_pct_points) AND b.vehicle_body < g.vehicle_body) AS better
    FROM gold_loss_ratio_contribution g)""",
}


def report(name: str) -> str:
    """A report query's SQL below the roles, the business tables that it reads, and its helpers."""
    text = REPORTS[name] + _HELPERS.get(name, "")
    used = [f"{t} AS {TABLES[t]}" for t in TABLES if re.search(rf"\b{t}\b", text)]
    return "WITH " + ", ".join([_ROLES, *used, *filter(None, [_HELPERS.get(name)])]) + " " + REPORTS[name]


SILVER = {
    "slv1_claims": """
SELECT l_orderkey || '/' || l_linenumber AS claim_number, CAST(l_orderkey AS VARCHAR) AS policy_number,
       CASE WHEN l_linenumber <> 5 THEN CAST(l_shipdate AS TIMESTAMP) END AS claim_datetime,
       CAST(l_quantity AS BIGINT) - 25 AS injury_claim_amount, l_partkey AS property_claim_amount, CAST(l_linenumber AS BIGINT) AS vehicle_claim_amount,
       l_suppkey AS total_claim_amount, CAST(l_linenumber AS BIGINT) AS number_of_vehicles_involved, l_linestatus AS collision_type,
       CASE WHEN l_quantity >= 26 THEN l_quantity - 10 END AS driver_age, l_returnflag AS insured_relationship,
       CASE WHEN l_linenumber NOT IN (1, 2, 3) THEN CAST(l_shipdate AS DATE) END AS license_issue_date, CAST(l_shipdate AS DATE) AS incident_date,
       CAST(l_quantity AS BIGINT) - 5 AS incident_hour, l_returnflag AS severity, l_linestatus AS incident_type,
       CAST(l_quantity AS BIGINT) AS months_as_customer, CAST(l_linenumber AS BIGINT) AS number_of_witnesses, l_discount > 0.05 AS suspicious_activity,
       CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS injury_to_person
FROM lineitem WHERE l_orderkey <> 1 AND l_quantity <> 7 AND l_quantity BETWEEN 5 AND 28""",
    "slv2_policies": """
WITH p AS (
    SELECT CAST(l_suppkey AS DOUBLE) AS customer_id, CAST(l_orderkey % 5000 AS VARCHAR) AS policy_number, CAST(l_shipdate AS DATE) AS issue_date,
           CASE WHEN l_linenumber <> 1 THEN CAST(l_shipdate AS DATE) END AS effective_date, CAST(l_shipdate AS DATE) + 365 AS expiry_date,
           CAST(l_shipdate AS DATE) - 9999 AS driver_dob, l_returnflag AS body, CASE WHEN l_linestatus = 'F' THEN l_extendedprice END - 1000 AS sum_insured,
           l_extendedprice - 2000 AS premium, l_linenumber AS deductible FROM lineitem
)
SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY policy_number ORDER BY issue_date DESC NULLS LAST, expiry_date DESC NULLS LAST, premium DESC NULLS LAST,
        sum_insured DESC NULLS LAST, body NULLS LAST, customer_id NULLS LAST, deductible NULLS LAST, driver_dob NULLS LAST, effective_date NULLS LAST) AS r
    FROM p WHERE premium >= 0 AND (sum_insured IS NULL OR sum_insured >= 0)) WHERE r = 1""",
    "slv3_accidents": """
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS accident_date, CASE WHEN event_id % 7 = 0 THEN '24:00' ELSE strftime(ts, '%-H:%M') END AS accident_time,
       event_type AS borough, CASE WHEN event_id % 3 = 2 THEN CAST(user_id AS INTEGER) END AS zip_code,
       CAST(event_id % 100 AS DOUBLE) AS latitude, CAST(event_id % 400 AS DOUBLE) - 200 AS longitude,
       TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS number_of_persons_injured, CAST(NULL AS INTEGER) AS number_of_persons_killed,
       CAST(event_id % 3 AS INTEGER) AS number_of_motorist_injured, CAST(NULL AS INTEGER) AS number_of_motorist_killed,
       CAST(event_id AS VARCHAR) AS collision_id, CASE WHEN event_id % 7 <> 0 THEN hour(ts) END AS accident_hour
FROM events WHERE event_id % 50 <> 0 AND event_id % 100 BETWEEN 0 AND 90 AND event_id % 400 - 200 BETWEEN -180 AND 180""",
}

QUALITY = {
    "dq_claims_violations": f"""WITH {CLAIMS}
SELECT * FROM (VALUES (0, 'expect_column_values_to_not_be_null', 'claim_number', 0),
    (1, 'expect_column_values_to_be_unique', 'claim_number', (SELECT count(*) FROM (SELECT claim_number FROM claims GROUP BY 1 HAVING count(*) > 1))),
    (2, 'expect_column_values_to_not_be_null', 'policy_number', 0), (3, 'expect_column_values_to_not_be_null', 'incident_date', 0),
    (4, 'expect_column_values_to_be_between', 'incident_hour', 0), (5, 'expect_column_values_to_be_between', 'total_claim_amount', 0)
) v("check", expectation, column_name, broken)""",
    "dq_bounds_on_customers": """
SELECT * FROM (VALUES (0, 'expect_column_values_to_be_between', 'c_acctbal', (SELECT count(*) FROM customer WHERE c_acctbal < 0)),
    (1, 'expect_column_values_to_be_unique', 'c_nationkey', (SELECT count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey HAVING count(*) > 1))),
    (2, 'expect_column_values_to_be_between', 'c_nationkey', (SELECT count(*) FROM customer WHERE c_nationkey > 20))
) v("check", expectation, column_name, broken)""",
}

OTHER = {
    "str1_event_windows": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "win2_means_of_many_series": """
WITH d AS (
    SELECT user_id, event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS events FROM events GROUP BY 1, 2, 3
), w AS (
    SELECT *, sum(cents) OVER (PARTITION BY user_id, event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS recent,
           least(30, day - min(day) OVER (PARTITION BY user_id, event_type) + 1) AS divisor
    FROM d
)
SELECT user_id, event_type, day, cents, events, round(CAST(recent AS DOUBLE) / divisor, 6) AS mean_cents FROM w""",
    "win10_totals_of_many_series": """
SELECT event_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cents
FROM events""",
    "agg7_modes_of_all_values": """
WITH k AS (
    SELECT o_orderpriority, o_orderkey AS v, count(*) AS n FROM orders GROUP BY ALL
), c AS (
    SELECT o_orderpriority, o_custkey % 500 AS v, count(*) AS n FROM orders GROUP BY ALL
), s AS (
    SELECT o_orderpriority, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL
), p AS (
    SELECT DISTINCT o_orderpriority FROM orders
)
SELECT o_orderpriority,
       (SELECT k.v FROM k WHERE k.o_orderpriority = p.o_orderpriority ORDER BY k.n DESC, k.v LIMIT 1) AS common_key,
       (SELECT c.v FROM c WHERE c.o_orderpriority = p.o_orderpriority ORDER BY c.n DESC, c.v LIMIT 1) AS common_customer,
       (SELECT s.v FROM s WHERE s.o_orderpriority = p.o_orderpriority ORDER BY s.n DESC, s.v LIMIT 1) AS common_status
FROM p""",
    "win7_keep_first": """
SELECT * EXCLUDE (r) FROM (SELECT l_orderkey || '-' || l_linenumber AS line, * EXCLUDE (l_orderkey, l_linenumber), row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_extendedprice DESC, l_discount, l_linestatus, l_partkey, l_quantity, l_returnflag, l_suppkey, l_tax) AS r FROM lineitem) WHERE r = 1""",
    "agg18_totals": f"""WITH {POLICIES}, {CLAIMS}
SELECT count(*) AS claims, CAST(sum(CASE WHEN incident_date NOT BETWEEN effective_date AND expiry_date THEN 1 ELSE 0 END) AS BIGINT) AS claims_outside_policy_period
FROM claims JOIN policies USING (policy_number)""",
    "prj4_renamed_columns": """
SELECT CAST(s_suppkey AS BIGINT) AS supplier, s_name AS S_NAME, s_nationkey AS nation, s_acctbal AS balance FROM supplier""",
}
