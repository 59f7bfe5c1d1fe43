"""The business tables by name, each a plan over the silver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import density, portfolio, series
from . import roles


@dataclass(frozen=True)
class Silver:
    """The tables that business tables are built from; points are the accidents with a place."""

    claims: DataFrame
    policies: DataFrame
    accidents: DataFrame
    points: DataFrame


Builder = Callable[[Silver], DataFrame]


def builders(min_policies: int = 20, decimals: int = 3, area: tuple = density.AREA) -> dict[str, Builder]:
    made: dict[str, Builder] = {}
    for unit, grain in (("daily", series.DAY), ("weekly", series.WEEK), ("monthly", series.MONTH)):
        made[f"gold_claims_{unit}"] = lambda s, grain=grain: series.claim_series(s.claims, grain)
        made[f"gold_accidents_{unit}"] = lambda s, grain=grain: series.accident_series(s.accidents, grain)
    return made | {
        "gold_accident_grid": lambda s: density.grid_density(s.points, decimals, area),
        "gold_accidents_weekday_hour": lambda s: density.weekday_hours(s.accidents),
        "gold_accidents_borough_monthly": lambda s: density.monthly_by_category(s.accidents),
        "gold_policies_monthly": lambda s: portfolio.monthly_business(s.policies),
        "gold_loss_ratio_monthly": lambda s: portfolio.monthly_loss_ratio(s.claims, s.policies),
        "gold_vehicle_body_risk": lambda s: portfolio.segment_risk(s.claims, s.policies, "body", "vehicle_body"),
        "gold_vehicle_usage_risk": lambda s: portfolio.segment_risk(s.claims, s.policies, "vehicle_usage"),
        "gold_loss_ratio_contribution": lambda s: portfolio.loss_contribution(s.claims, s.policies, "body", min_policies),
    }


#: The parameters that suit the test tables: some nations are pooled, some cells are outside.
ON_TEST_TABLES = builders(min_policies=550, decimals=1, area=((-0.3, 0.3), (-0.3, 0.3)))


def role_silver(spark: SparkSession, sf_dir: str) -> Silver:
    return Silver(*(role(spark, sf_dir) for role in (roles.claims, roles.policies, roles.accidents, roles.points)))


def on_test_tables(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ON_TEST_TABLES[name](role_silver(spark, sf_dir))
