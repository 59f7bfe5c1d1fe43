"""The report queries over the business tables.

Each is a small spec from which Spark SQL is made: its columns, source, filter, order and limit.
The SQL stays within what other engines read as well, so that it can be held against them; quoted
names are in backticks. Every order with a limit or a rank ends in a unique name, so that results
don't hang on ties. Rounding is Spark's: half up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import gold


@dataclass(frozen=True)
class Card:
    title: str
    source: str
    columns: dict[str, str]
    where: str = ""
    group: str = ""
    order: str = ""
    limit: int = 0
    before: dict[str, str] = field(default_factory=dict)  # named subqueries

    def sql(self) -> str:
        parts = []
        if self.before:
            parts.append("WITH " + ", ".join(f"{name} AS ({query})" for name, query in self.before.items()))
        shown = [expression if expression == name else f"{expression} AS {name}" for name, expression in self.columns.items()]
        parts += [f"SELECT {', '.join(shown)}", f"FROM {self.source}"]
        parts += [f"{word} {value}" for word, value in (("WHERE", self.where), ("GROUP BY", self.group), ("ORDER BY", self.order), ("LIMIT", self.limit)) if value]
        return "\n".join(parts)

    def tables(self) -> list[str]:
        return sorted(set(re.findall(r"\bgold_\w+", self.sql())))


def same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


CLAIMS, CRASHES, BOOK = "gold_claims_monthly", "gold_accidents_monthly", "gold_policies_monthly"
BOROUGHS, BODIES, RATIO = "gold_accidents_borough_monthly", "gold_vehicle_body_risk", "gold_loss_ratio_monthly"


def indexed_trends() -> Card:
    """The three monthly counts, each 100 in the first month that all have, up to the last one.
    Each table is read once: its counts are a column of their own in a union, and the common span
    and the first values are windows over the months, of which there are some hundreds."""
    before = {
        "counts": f"""
    SELECT claim_year_month AS m, number_of_claims AS c, NULL AS a, NULL AS p FROM {CLAIMS}
    UNION ALL SELECT accident_year_month, NULL, number_of_accidents, NULL FROM {CRASHES}
    UNION ALL SELECT year_month, NULL, NULL, policies_issued FROM {BOOK} WHERE policies_issued > 0""",
        "months": "SELECT m, max(c) AS c, max(a) AS a, max(p) AS p FROM counts GROUP BY m",
        "ends": """
    SELECT *,
           greatest(min(CASE WHEN c IS NOT NULL THEN m END) OVER (), min(CASE WHEN a IS NOT NULL THEN m END) OVER (), min(CASE WHEN p IS NOT NULL THEN m END) OVER ()) AS lo,
           least(max(CASE WHEN c IS NOT NULL THEN m END) OVER (), max(CASE WHEN a IS NOT NULL THEN m END) OVER (), max(CASE WHEN p IS NOT NULL THEN m END) OVER ()) AS hi
    FROM months""",
        "based": """
    SELECT *, max(CASE WHEN m = lo THEN c END) OVER () AS c0, max(CASE WHEN m = lo THEN a END) OVER () AS a0, max(CASE WHEN m = lo THEN p END) OVER () AS p0
    FROM ends""",
    }
    columns = {
        "month": "m",
        "claims": "round(c / nullif(c0, 0) * 100, 1)",
        "accidents": "round(a / nullif(a0, 0) * 100, 1)",
        "policies_issued": "round(p / nullif(p0, 0) * 100, 1)",
    }
    return Card("business trends, indexed", "based", columns, where="m BETWEEN lo AND hi", order="m", before=before)


def waterfall(shown: int = 10) -> Card:
    ranked = "SELECT vehicle_body AS body, contribution_pct_points AS pts, row_number() OVER (ORDER BY abs(contribution_pct_points) DESC, vehicle_body) AS place FROM gold_loss_ratio_contribution"
    label = f"CASE WHEN place <= {shown} THEN body ELSE 'All other bodies' END"
    columns = {"vehicle_body": label, "pct_points_vs_break_even": "round(sum(pts), 2)"}
    return Card("what each body adds to the loss ratio", "ranked", columns, group=label, order="min(place)", before={"ranked": ranked})


def by_month(title: str, source: str, month: str, *names: str, where: str = "") -> Card:
    return Card(title, source, same(month, *names), where=where, order=month)


def single(title: str, source: str, name: str, expression: str, where: str = "") -> Card:
    return Card(title, source, {name: expression}, where=where)


_hours = {"hour": "lpad(CAST(accident_hour AS STRING), 2, '0')"} | {
    day: f"CAST(sum(CASE WHEN weekday_number = {k} THEN number_of_accidents ELSE 0 END) AS BIGINT)" for k, day in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), 1)
}
_no_borough = "sum(CASE WHEN borough IS NULL THEN number_of_accidents ELSE 0 END)"

CARDS: dict[str, Card] = {
    "q01_total_claims": single("all claims", CLAIMS, "total_claims", "CAST(sum(number_of_claims) AS BIGINT)"),
    "q02_total_claim_amount": single("all claim amounts", CLAIMS, "total_claim_amount", "CAST(round(sum(total_claim_amount)) AS BIGINT)"),
    "q03_average_claim_severity": single("amount per claim", CLAIMS, "avg_claim_amount", "round(sum(total_claim_amount) / nullif(sum(number_of_claims), 0), 2)"),
    "q04_total_accidents": single("all accidents", CRASHES, "total_accidents", "CAST(sum(number_of_accidents) AS BIGINT)"),
    "q05_total_policies_issued": single("all policies", BOOK, "total_policies_issued", "CAST(sum(policies_issued) AS BIGINT)"),
    "q06_business_trends_indexed": indexed_trends(),
    "q07_monthly_claim_trends": by_month("claims and their growth", CLAIMS, "claim_year_month", "number_of_claims", "pct_change_number_of_claims"),
    "q08_claim_amount_by_type": by_month("amounts by kind", CLAIMS, "claim_year_month", "injury_claim_amount", "property_claim_amount", "vehicle_claim_amount"),
    "q09_daily_claims_rolling": Card("daily amounts and their 30-day mean", "gold_claims_daily", same("claim_date", "total_claim_amount") | {"rolling_30d_avg_claim_amount": "`30d_rolling_avg_total_claim_amount`"}, order="claim_date"),
    "q10_weekly_claim_volume": by_month("claims by week", "gold_claims_weekly", "claim_year_week", "number_of_claims"),
    "q11_driver_age_and_hour": by_month("driver age and hour", CLAIMS, "claim_year_month", "average_driver_age", "average_incident_hour"),
    "q12_total_accidents_by_borough": single("all accidents, from the borough table", BOROUGHS, "total_accidents", "CAST(sum(number_of_accidents) AS BIGINT)"),
    "q13_accidents_without_borough": single("accidents without a borough", BOROUGHS, "accidents_with_no_borough", "CAST(sum(number_of_accidents) AS BIGINT)", "borough IS NULL"),
    "q14_share_without_borough": single("their share", BOROUGHS, "pct_with_no_borough", f"round({_no_borough} / nullif(sum(number_of_accidents), 0) * 100, 1)"),
    "q15_accident_map": Card("the busiest cells", "gold_accident_grid", same("latitude", "longitude", "number_of_accidents", "number_of_persons_injured"), order="number_of_accidents DESC, latitude, longitude", limit=2000),
    "q16_when_accidents_happen": Card("accidents by hour and weekday", "gold_accidents_weekday_hour", _hours, group="accident_hour", order="accident_hour"),
    "q17_monthly_accidents_by_borough": Card("accidents by borough", BOROUGHS, same("accident_year_month", "borough", "number_of_accidents"), where="borough IS NOT NULL", order="accident_year_month, borough"),
    "q18_weekly_accidents_rolling": Card("weekly accidents and their 4-week mean", "gold_accidents_weekly", same("accident_year_week", "number_of_accidents") | {"rolling_4w_avg": "`4w_rolling_avg_number_of_accidents`"}, order="accident_year_week"),
    "q19_monthly_accident_trends": by_month("accidents and their growth", CRASHES, "accident_year_month", "number_of_accidents", "pct_change_number_of_accidents"),
    "q20_policy_growth": by_month("policies issued", BOOK, "year_month", "policies_issued", where="policies_issued > 0"),
    "q21_issued_vs_expired": by_month("issued and expired", BOOK, "year_month", "policies_issued", "policies_expired"),
    "q22_estimated_active_policies": Card("policies in force", BOOK, same("year_month") | {"estimated_active_policies": "CAST(sum(policies_issued - policies_expired) OVER (ORDER BY year_month) AS BIGINT)"}, order="year_month"),
    "q23_exposure_trend": by_month("sums insured", BOOK, "year_month", "exposure", where="policies_issued > 0"),
    "q24_vehicle_age_trend": by_month("vehicle age", BOOK, "year_month", "avg_issue_age_of_vehicle", where="policies_issued > 0"),
    "q25_overall_loss_ratio": single("the loss ratio", RATIO, "overall_loss_ratio_pct", "round(sum(total_claim_amount) / nullif(sum(total_premium), 0) * 100, 2)"),
    "q26_riskiest_vehicle_body": Card("the worst body", BODIES, same("vehicle_body"), where="number_of_policies >= 20 AND loss_ratio_pct IS NOT NULL", order="loss_ratio_pct DESC, vehicle_body", limit=1),
    "q27_loss_ratio_trend": Card("loss ratios", RATIO, {name: f"CASE WHEN total_premium > 0 THEN {name} END" if "ratio" in name else name for name in ("year_month", "loss_ratio_pct", "`3m_rolling_avg_loss_ratio_pct`")}, order="year_month"),
    "q28_contribution_waterfall": waterfall(),
    "q29_underwriting_risk_map": Card("frequency and severity", BODIES, same("claims_per_100_policies", "vehicle_body", "avg_claim_severity", "total_premium"), where="number_of_policies >= 20 AND number_of_claims > 0", order="total_premium DESC, vehicle_body"),
    "q30_loss_ratio_by_body": Card("the 15 worst bodies", BODIES, same("vehicle_body", "loss_ratio_pct"), where="number_of_policies >= 20", order="loss_ratio_pct DESC NULLS LAST, vehicle_body", limit=15),
    "q31_private_vs_commercial": Card("the two largest uses", "gold_vehicle_usage_risk", same("vehicle_usage", "number_of_policies", "total_premium", "number_of_claims", "claims_per_100_policies", "loss_ratio_pct"), order="total_premium DESC, vehicle_usage", limit=2),
}


def run_card(card: Card, spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The card over the given business tables. They are bound to this query alone, so tables of
    the catalog keep their names."""
    text = re.sub(r"\bgold_\w+", lambda m: "{" + m.group() + "}", card.sql())
    return spark.sql(text, **{name: tables[name] for name in card.tables()})


def on_test_tables(card: Card, spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = gold.role_silver(spark, sf_dir)
    return run_card(card, spark, {name: gold.ON_TEST_TABLES[name](silver) for name in card.tables()})
