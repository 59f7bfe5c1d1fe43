"""Named queries over a table folder, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, many_series, portfolio, quality, series
from ..streaming import windows
from . import cards, gold, oracles, roles, roundtrips

Query = Callable[[SparkSession, str], DataFrame]

GOLD_IDS = {
    "gld1_claims_daily": "gold_claims_daily", "gld2_claims_weekly": "gold_claims_weekly", "gld3_claims_monthly": "gold_claims_monthly",
    "gld4_accidents_daily": "gold_accidents_daily", "gld5_accidents_weekly": "gold_accidents_weekly",
    "gld6_accidents_monthly": "gold_accidents_monthly", "gld7_accident_grid": "gold_accident_grid",
    "gld8_weekday_hour": "gold_accidents_weekday_hour", "gld9_borough_monthly": "gold_accidents_borough_monthly",
    "gld10_policies_monthly": "gold_policies_monthly", "gld11_monthly_loss_ratio": "gold_loss_ratio_monthly",
    "gld12_vehicle_body_risk": "gold_vehicle_body_risk", "gld13_vehicle_usage_risk": "gold_vehicle_usage_risk",
    "gld14_loss_ratio_contribution": "gold_loss_ratio_contribution",
}


def slv1_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_claims(roles.raw_claims(spark, sf_dir)).drop("ingestion_timestamp")


def slv2_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_policies(roles.raw_policies(spark, sf_dir), roles.POLICY_SPECS).drop("ingestion_timestamp")


def slv3_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_accidents(roles.raw_accidents(spark, sf_dir), roles.ACCIDENT_SPECS)


def dq_claims_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(roles.claims(spark, sf_dir), quality.SUITES["silver_claims"])


def dq_bounds_on_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = (quality.Between("c_acctbal", 0), quality.Unique("c_nationkey"), quality.Between("c_nationkey", most=20))
    return quality.violations(roles.read(spark, sf_dir, "customer"), suite)


def win7_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = roles.read(spark, sf_dir, "lineitem")
    keyed = lines.withColumn("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return cleaning.keep_first(keyed.drop("l_orderkey", "l_linenumber"), "line", ("l_shipdate", "l_extendedprice"))


def win2_means_of_many_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-day means of the events of each user and kind."""
    events = roles.read(spark, sf_dir, "events")
    daily = events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("events"))
    means = many_series.rolling_calendar_means(daily, ("user_id", "event_type"), "day", "cents", "mean_cents", segment_days=45)
    return means.withColumn("mean_cents", F.round("mean_cents", 6))


def win10_totals_of_many_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running total of each kind of events."""
    events = roles.read(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return many_series.running_totals(events, ("event_type",), ("ts", "event_id"), F.trunc("ts", "week"), "cents", "running_cents")


def agg7_modes_of_all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes by order priority, of a column with as many values as rows and of others."""
    orders = roles.read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_custkey") % 500).alias("customer"), "o_orderstatus")
    return series.modes(orders, "o_orderpriority", {"o_orderkey": "common_key", "customer": "common_customer", "o_orderstatus": "common_status"})


def agg18_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.totals(gold.on_test_tables("gold_loss_ratio_monthly", spark, sf_dir))


def prj4_renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = ({"name": "S_SUPPKEY", "alias": "supplier"}, {"name": "S_NAME"}, {"name": "s_nationkey", "alias": "nation"}, {"name": "S_AcctBal", "alias": "balance"})
    return cleaning.rename_by_specs(roles.read(spark, sf_dir, "supplier"), specs)


def _gold(name: str) -> Query:
    return lambda spark, sf_dir: gold.on_test_tables(name, spark, sf_dir)


def _card(card: cards.Card) -> Query:
    return lambda spark, sf_dir: cards.on_test_tables(card, spark, sf_dir)


def str1_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the stream, over the table at rest."""
    return windows.counts_by_window(roles.read(spark, sf_dir, "events"))


_OTHERS = (str1_event_windows, slv1_claims, slv2_policies, slv3_accidents, dq_claims_violations, dq_bounds_on_customers, win7_keep_first, win2_means_of_many_series, win10_totals_of_many_series, agg7_modes_of_all_values, agg18_totals, prj4_renamed_columns)

QUERIES: dict[str, Query] = (
    {key: _gold(name) for key, name in GOLD_IDS.items()}
    | {key: _card(card) for key, card in cards.CARDS.items()}
    | {f.__name__: f for f in _OTHERS}
    | roundtrips.QUERIES
)

ORACLE_SQL: dict[str, str] = (
    {key: oracles.gold_table(name) for key, name in GOLD_IDS.items()}
    | {key: oracles.report(key) for key in cards.CARDS}
    | oracles.SILVER
    | oracles.QUALITY
    | oracles.OTHER
    | roundtrips.ORACLE_SQL
)
