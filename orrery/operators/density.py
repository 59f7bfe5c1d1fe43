"""Counts over space, over the week, and over months and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

#: The area of the map: (least, most) latitude and longitude. Fixed values.
AREA = ((40.49, 40.92), (-74.27, -73.68))
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def grid_density(points: DataFrame, decimals: int = 3, area: tuple = AREA) -> DataFrame:
    """Accidents and persons injured per cell of rounded coordinates inside the area, ends
    included; an unknown number injured counts as none."""
    (south, north), (west, east) = area
    inside = points.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    cell = [F.round(F.col(axis), decimals).alias(axis) for axis in ("latitude", "longitude")]
    injured = F.coalesce(F.sum("number_of_persons_injured"), F.lit(0))
    return inside.groupBy(*cell).agg(F.count("*").alias("number_of_accidents"), injured.alias("number_of_persons_injured"))


def weekday_hours(accidents: DataFrame) -> DataFrame:
    """All 7 x 24 cells of ISO weekday and hour with their accidents, zero where there are none;
    rows without an hour are in no cell."""
    spark = accidents.sparkSession
    cells = spark.range(7 * 24).select(
        (F.expr("id div 24") + 1).cast("int").alias("weekday_number"),
        F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.expr("id div 24").cast("int") + 1).alias("weekday"),
        (F.col("id") % 24).cast("int").alias("accident_hour"),
    )
    counted = accidents.where("accident_hour IS NOT NULL").groupBy(
        c.iso_weekday("accident_date").alias("weekday_number"), "accident_hour"
    ).count()
    out = cells.join(counted, ["weekday_number", "accident_hour"], "left")
    return out.select("weekday_number", "weekday", "accident_hour", F.coalesce("count", F.lit(0)).alias("number_of_accidents"))


def monthly_by_category(accidents: DataFrame, category: str = "borough") -> DataFrame:
    """Accidents per month and category; the unknown category stays a group of its own."""
    month = c.month_label("accident_date").alias("accident_year_month")
    return accidents.groupBy(month, category).agg(F.count("*").alias("number_of_accidents"))
