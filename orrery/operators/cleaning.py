"""Typed, valid, unique rows from raw ones. Malformed values become null, never an error."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fixed values of the sources: the youngest driver, and the licence date that means unknown.
YOUNGEST_DRIVER = 16
NO_LICENCE_DATE = "01-01-1900"
DAY_PATTERN = "dd-MM-yyyy"
DAY_SHAPE = "^[0-9]{2}-[0-9]{2}-[0-9]{4}$"


def read_specs(path: str) -> list[dict]:
    """Column specs, objects with name and perhaps alias, of a JSON file."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def find_column(df: DataFrame, name: str) -> str:
    """The column of that name in whatever case."""
    for column in df.columns:
        if column.lower() == name.lower():
            return column
    raise ValueError(f"no column {name!r}; there are {', '.join(df.columns)}")


def rename_by_specs(df: DataFrame, specs: Iterable[Mapping], aliases: bool = True) -> DataFrame:
    """Columns named as the specs say (their alias, or their name where aliases is false)."""
    new = {find_column(df, spec["name"]): spec.get("alias", spec["name"]) if aliases else spec["name"] for spec in specs}
    return df.withColumnsRenamed({old: name for old, name in new.items() if old != name})


def day(column: str, pattern: str = DAY_PATTERN) -> Column:
    return F.try_to_date(F.col(column), pattern)


def day_unless(column: str, sentinel: str) -> Column:
    """The day, if the text is shaped like one and isn't the sentinel."""
    text = F.col(column)
    return F.when(text.rlike(DAY_SHAPE) & (text != sentinel), day(column))


def with_all(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which none of the columns is null (NaN is a value)."""
    return df.where(" AND ".join(f"`{name}` IS NOT NULL" for name in names))


def _reversed(value: Column, kind: T.DataType) -> list[Column] | None:
    """Columns that ascend as the value descends; None if there are none for its type."""
    if isinstance(kind, T.IntegralType):
        return [F.bitwise_not(value)]
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return [~F.isnan(value), F.when(F.isnan(value), F.lit(0.0)).otherwise(-value)]
    if isinstance(kind, T.DecimalType):
        return [-value]
    if isinstance(kind, T.BooleanType):
        return [~value]
    if isinstance(kind, T.DateType):
        return [-F.unix_date(value)]
    if isinstance(kind, T.TimestampType):
        return [-F.unix_micros(value)]
    if isinstance(kind, T.TimestampNTZType):
        return [-F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)]
    return None


def keep_first(df: DataFrame, key: str, best: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """One row per key: highest in the columns best, in this order, then lowest in every other
    column by name, so the choice never hangs on partitioning; nulls come last.

    The row is the least of a struct that orders as said, an aggregate that is combined before the
    shuffle: of a key with however many rows, each task passes one on, and no window holds them. Where a
    column to be highest can't be turned round (a text), or another has no order, rows are ranked."""
    rest = sorted(set(df.columns) - {key, *best, *ignored})
    order: list[Column] = []
    orderable = all(not isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields)
    for name in best:
        turned = _reversed(F.col(name), df.schema[name].dataType)
        orderable = orderable and turned is not None
        order += [F.col(name).isNull(), *(turned or ())]
    if not orderable:
        return _first_by_rank(df, key, best, rest)
    for name in rest:
        order += [F.col(name).isNull(), F.col(name)]
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(n) for n in df.columns if n != key]).alias("row"))
    # a list beside it, always empty, makes this an aggregate over objects, which are hashed; a struct alone would be sorted
    found = df.groupBy(key).agg(F.min(row).alias("_least"), F.collect_list(F.lit(None).cast("int")).alias("_none"))
    found = found.where(F.size("_none") == 0)
    return found.select(*[F.col(key) if n == key else F.col(f"_least.row.`{n}`").alias(n) for n in df.columns])


def _first_by_rank(df: DataFrame, key: str, best: Sequence[str], rest: Sequence[str]) -> DataFrame:
    order = [F.col(name).desc_nulls_last() for name in best] + [F.col(name).asc_nulls_last() for name in rest]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


#: Nested fields of raw claims and the columns that they become.
CLAIM_COLUMNS = {
    "claim_number": "claim_no", "policy_number": "policy_no", "claim_datetime": "claim_datetime",
    "injury_claim_amount": "claim_amount.injury", "property_claim_amount": "claim_amount.property",
    "vehicle_claim_amount": "claim_amount.vehicle", "total_claim_amount": "claim_amount.total",
    "number_of_vehicles_involved": "collision.number_of_vehicles_involved", "collision_type": "collision.type",
    "driver_age": "driver.age", "insured_relationship": "driver.insured_relationship",
    "license_issue_date": "driver.license_issue_date", "incident_date": "incident.date", "incident_hour": "incident.hour",
    "severity": "incident.severity", "incident_type": "incident.type", "months_as_customer": "months_as_customer",
    "number_of_witnesses": "number_of_witnesses", "suspicious_activity": "suspicious_activity",
    "ingestion_timestamp": "ingestion_timestamp",
}


def clean_claims(raw: DataFrame) -> DataFrame:
    flat = raw.select(*[F.col(path).alias(name) for name, path in CLAIM_COLUMNS.items()])
    typed = flat.withColumns(
        {
            "claim_datetime": F.try_to_timestamp("claim_datetime", F.lit("yyyy-MM-dd HH:mm:ss")),
            "incident_date": day("incident_date"),
            "license_issue_date": day_unless("license_issue_date", NO_LICENCE_DATE),
            "driver_age": F.when(F.col("driver_age") >= YOUNGEST_DRIVER, F.col("driver_age")),
            "injury_to_person": F.coalesce((F.col("injury_claim_amount") > 0).cast("int"), F.lit(0)),
        }
    )
    return with_all(typed, "claim_number", "policy_number", "incident_date").where("incident_hour BETWEEN 0 AND 23")


def valid_policies(typed: DataFrame) -> DataFrame:
    """Rows with a customer, a number, a day of issue and a premium that isn't negative; nor may a
    sum insured be, if there is one."""
    valid = with_all(typed, "customer_id", "policy_number", "issue_date", "premium")
    return valid.where("premium >= 0 AND coalesce(sum_insured >= 0, true)")


def clean_policies(raw: DataFrame, specs: Iterable[Mapping] = ()) -> DataFrame:
    """Invalid rows go before duplicates do, so an invalid copy can't displace a valid one."""
    named = rename_by_specs(raw, specs)
    typed = named.withColumns({name: day(name) for name in ("issue_date", "effective_date", "expiry_date", "driver_dob")})
    return keep_first(valid_policies(typed), "policy_number", ("issue_date", "expiry_date", "premium", "sum_insured"), ("ingestion_timestamp",))


def clean_accidents(raw: DataFrame, specs: Iterable[Mapping] = ()) -> DataFrame:
    named = rename_by_specs(raw, specs, aliases=False)
    counts = [f"number_of_{who}_{what}" for who in ("persons", "motorist") for what in ("injured", "killed")]
    typed = named.withColumns(
        {name: F.col(name).try_cast("int") for name in counts}
        | {
            "accident_date": F.try_to_timestamp("accident_date"),
            "zip_code": F.col("zip_code").try_cast("double").try_cast("int"),
            "collision_id": F.col("collision_id").cast("string"),
            "accident_hour": F.hour(F.try_to_timestamp("accident_time", F.lit("H:mm"))),
        }
    )
    valid = with_all(typed, "accident_date", "collision_id", "latitude", "longitude")
    return valid.where("latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
