"""Rolling and running measures of many series, none of which need fit one partition.

A series is cut into segments of time. A window then runs within a series' segment; what it needs
of the time before comes as a halo (copies of the rows just before the segment) or as an offset (the
total of all segments before, a row each). A series with most of all rows is so dealt out by its
segments, and no exchange brings everything into one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENT_DAYS = 360


def rolling_calendar_means(rows: DataFrame, series: Sequence[str], day: str, value: str, name: str, days: int = 30, segment_days: int = SEGMENT_DAYS) -> DataFrame:
    """rows (one for each series and day) with the mean of value per calendar day, over the days up to each
    row's: days without a row count as zero, and where the series is younger, the days since its
    first are the divisor. Rows without a day have no mean."""
    number = F.unix_date(F.col(day))
    first = rows.groupBy(*series).agg(F.min(number).alias("_first"))
    own = F.floor(number / segment_days)
    # into its own segment, and into those that begin within the days after it
    reach = F.coalesce(F.sequence(own, F.floor((number + (days - 1)) / segment_days)), F.array(F.lit(None).cast("long")))
    dealt = rows.withColumns({"_number": number, "_own": own}).withColumn("_segment", F.explode(reach))
    recent = Window.partitionBy(*series, "_segment").orderBy("_number").rangeBetween(1 - days, Window.currentRow)
    dealt = dealt.withColumn("_sum", F.sum(value).over(recent)).where("_segment <=> _own")
    same = F.lit(True)
    for key in series:
        same = same & F.col(f"l.`{key}`").eqNullSafe(F.col(f"r.`{key}`"))
    met = dealt.alias("l").join(first.alias("r"), same)
    age = F.col("_number") - F.col("_first") + 1
    mean = F.when(F.col("_number").isNotNull(), F.try_divide(F.col("_sum"), F.least(age, F.lit(days))))
    return met.select(*[F.col(f"l.`{c}`") for c in rows.columns], mean.alias(name))


def running_totals(rows: DataFrame, series: Sequence[str], order: Sequence[str], segment, value: str, name: str) -> DataFrame:
    """rows with the total of value in their series up to each, in the given order, which must tell rows
    apart. segment is a column that never falls along that order (say the month of the first of its
    columns); rows of one series and segment meet in a task, the others as one total each."""
    held = rows.withColumn("_segment", segment)
    totals = held.groupBy(*series, "_segment").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*series).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    same = F.col("l._segment").eqNullSafe(F.col("r._segment"))
    for key in series:
        same = same & F.col(f"l.`{key}`").eqNullSafe(F.col(f"r.`{key}`"))
    within = Window.partitionBy(*series, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    met = held.alias("l").join(offsets.alias("r"), same)
    return met.select(*[F.col(f"l.`{c}`") for c in rows.columns], (F.col("_within") + F.col("_offset")).alias(name))
