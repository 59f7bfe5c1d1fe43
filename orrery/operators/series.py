"""Time series over days, ISO weeks and months: one operator for every grain."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as c


@dataclass(frozen=True)
class Grain:
    """How rows are put into periods, and the frame and name of the rolling mean."""

    suffix: str
    prefix: str
    frame: int
    by_calendar: bool = False

    def label(self, at: str) -> Column:
        return {"date": lambda: F.col(at).cast("date"), "year_week": lambda: c.week_label(at), "year_month": lambda: c.month_label(at)}[self.suffix]()


DAY = Grain("date", "30d", 30, by_calendar=True)
WEEK = Grain("year_week", "4w", 4)
MONTH = Grain("year_month", "3m", 3)


def modes(rows: DataFrame, group: str, columns: Mapping[str, str]) -> DataFrame:
    """For each value of group the most frequent one of each column, nulls left out; of equally frequent
    ones the smallest. columns gives the result's name for each.

    Values are counted as groups of their own, combined map-side and spilled like any other, so a
    column with as many values as rows needs no more memory than one with two."""
    names = list(columns)
    counted = rows.groupingSets([[group, n] for n in names], group, *names).agg(F.count("*").alias("times"), F.grouping_id().alias("which"))
    full = (1 << len(names)) - 1  # of the bits of grouping_id the one of the set's own column is clear
    best = [
        F.min(F.when((F.col("which") == full - (1 << (len(names) - 1 - i))) & F.col(n).isNotNull(), F.struct((-F.col("times")).alias("t"), F.col(n).alias("v"))))["v"].alias(columns[n])
        for i, n in enumerate(names)
    ]
    return counted.groupBy(group).agg(*best)


def period_series(
    rows: DataFrame, at: str, name: str, grain: Grain, measures: Mapping[str, Column], growth: str, rolled: str, common: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per period of the column at, named <name>_<grain>: the measures, the modes of the columns
    in common, the change of the measure growth against the period before, and the rolling mean of
    the measure rolled.

    The aggregation is partial before its one shuffle; the windows run over its result, which has
    a row per period, so their single partition holds some thousand rows whatever the input. Rows
    without a day have a null day, or the empty label among weeks and months.
    """
    period = f"{name}_{grain.suffix}"
    rows = rows.withColumn(period, grain.label(at))
    out = rows.groupBy(period).agg(*[measure.alias(key) for key, measure in measures.items()])
    if common:
        found = modes(rows, period, common).withColumnRenamed(period, "_period")
        out = out.join(found, F.col(period).eqNullSafe(F.col("_period")), "left").select(*out.columns, *common.values())
    along = Window.orderBy(period)
    mean = c.calendar_mean(rolled, period, grain.frame) if grain.by_calendar else c.row_mean(rolled, along, grain.frame)
    return out.select("*", c.change_from_previous(growth, along).alias(f"pct_change_{growth}"), mean.alias(f"{grain.prefix}_rolling_avg_{rolled}"))


CLAIM_SUMS = ("total_claim_amount", "injury_claim_amount", "property_claim_amount", "vehicle_claim_amount")


def claim_series(claims: DataFrame, grain: Grain) -> DataFrame:
    measures = {"number_of_claims": F.count("*")}
    measures |= {name: F.sum(name) for name in CLAIM_SUMS}
    measures |= {"average_incident_hour": F.round(F.avg("incident_hour")), "average_driver_age": F.round(F.avg("driver_age"))}
    return period_series(claims, "claim_datetime", "claim", grain, measures, "number_of_claims", "total_claim_amount")


def accident_series(accidents: DataFrame, grain: Grain) -> DataFrame:
    """The modes leave nulls out; among equally frequent values the smallest is taken, so the
    result doesn't hang on how the rows are partitioned."""
    measures = {"number_of_accidents": F.count("*"), "average_accident_hour": F.round(F.avg("accident_hour"))}
    common = {name: f"most_common_{name}" for name in ("borough", "zip_code")}
    return period_series(accidents, "accident_date", "accident", grain, measures, "number_of_accidents", "number_of_accidents", common)
