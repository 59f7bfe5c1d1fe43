"""The quality gate: declared expectations, checked in one pass, reported all together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataQualityError(RuntimeError):
    """Some table fails its expectations."""


@dataclass(frozen=True)
class NotNull:
    column: str
    kind = "expect_column_values_to_not_be_null"

    def broken(self) -> Column:
        return F.count_if(F.col(self.column).isNull())


@dataclass(frozen=True)
class Between:
    """Nulls pass; either end may be open."""

    column: str
    least: float | None = None
    most: float | None = None
    kind = "expect_column_values_to_be_between"

    def broken(self) -> Column:
        value, below = F.col(self.column), F.lit(False)
        if self.least is not None:
            below = below | (value < self.least)
        if self.most is not None:
            below = below | (value > self.most)
        return F.count_if(below)


@dataclass(frozen=True)
class Unique:
    """No value, null aside, is there twice."""

    column: str
    kind = "expect_column_values_to_be_unique"


Expectation = NotNull | Between | Unique


@dataclass(frozen=True)
class Report:
    table_name: str
    success: bool
    failed_expectations: list[str]


SUITES: dict[str, tuple[Expectation, ...]] = {
    "silver_claims": (
        NotNull("claim_number"), Unique("claim_number"), NotNull("policy_number"), NotNull("incident_date"),
        Between("incident_hour", 0, 23), Between("total_claim_amount", 0),
    ),
    "silver_policies": (
        NotNull("customer_id"), NotNull("policy_number"), Unique("policy_number"), NotNull("issue_date"), Between("premium", 0),
        Between("sum_insured", 0),
    ),
    "silver_accidents": (
        NotNull("collision_id"), NotNull("accident_date"), Between("latitude", -90, 90), Between("longitude", -180, 180),
    ),
}


def _counted(df: DataFrame, suite: Sequence[Expectation]) -> tuple[dict[int, int], list[int]]:
    """What breaks each null or range check, and the uniqueness checks in which some hash is met twice; all
    from one scan and one exchange, in which a value to be unique is the 8 bytes of its hash."""
    direct = {i: x for i, x in enumerate(suite) if not isinstance(x, Unique)}
    unique = {i: x for i, x in enumerate(suite) if isinstance(x, Unique)}
    broken = [x.broken().alias(f"b{i}") for i, x in direct.items()]
    if not unique:
        row = df.agg(F.lit(0).alias("b"), *broken).first()
        return {i: row[f"b{i}"] for i in direct}, []
    hashed = df.withColumns({f"h{i}": F.when(F.col(x.column).isNotNull(), F.xxhash64(x.column)) for i, x in unique.items()})
    names = [f"h{i}" for i in unique]
    groups = hashed.groupingSets([*([n] for n in names), []], *names).agg(F.count("*").alias("n"), F.grouping_id().alias("which"), *broken)
    full = (1 << len(names)) - 1  # the bit of a set's own column is clear
    twice = [F.count_if((F.col("which") == full - (1 << (len(names) - 1 - k))) & F.col(n).isNotNull() & (F.col("n") > 1)).alias(n) for k, n in enumerate(names)]
    row = groups.agg(F.lit(0).alias("b"), *twice, *[F.max(F.when(F.col("which") == full, F.col(f"b{i}"))).alias(f"b{i}") for i in direct]).first()
    return {i: row[f"b{i}"] or 0 for i in direct}, [i for i in unique if row[f"h{i}"]]


def _met_twice(df: DataFrame, column: str) -> DataFrame:
    """broken: how many values of the column are there twice or more. Only rows whose hash is met twice
    are grouped by the value itself."""
    hashed = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), F.xxhash64(column).alias("h"))
    twice = hashed.groupBy("h").count().where(F.col("count") > 1).select("h")
    return hashed.join(twice, "h", "left_semi").groupBy("value").count().agg(F.count_if(F.col("count") > 1).alias("broken"))


def violations(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """check (number in the suite), expectation, column_name, broken: the rows or values that
    break each. One scan of the named columns makes all checks: counts for nulls and ranges, and, for values
    to be unique, whether a hash is met twice, which no equal values escape. Only where one is are
    the values themselves counted. The driver gets a number for each check. Nothing is cached."""
    spark = df.sparkSession
    counts, doubtful = _counted(df, suite) if suite else ({}, [])
    counts |= {i: 0 for i, x in enumerate(suite) if isinstance(x, Unique) and i not in doubtful}
    rows = [(i, suite[i].kind, suite[i].column, broken) for i, broken in sorted(counts.items())]
    out = spark.createDataFrame(rows, "check int, expectation string, column_name string, broken long")
    for i in doubtful:
        x = suite[i]
        out = out.unionByName(_met_twice(df, x.column).select(F.lit(i).alias("check"), F.lit(x.kind).alias("expectation"), F.lit(x.column).alias("column_name"), "broken"))
    return out


def validate(df: DataFrame, table_name: str, suite: Sequence[Expectation]) -> Report:
    """The kinds of the expectations that fail, in the suite's order; collects a row for each."""
    rows = sorted(violations(df, suite).where("broken > 0").collect(), key=lambda r: r["check"])
    return Report(table_name, not rows, [r["expectation"] for r in rows])


def gate(tables: Mapping[str, DataFrame], suites: Mapping[str, Sequence[Expectation]] = SUITES) -> list[Report]:
    """Every table's report; DataQualityError, naming all failures, if there are any."""
    reports = [validate(df, name, suites[name]) for name, df in tables.items()]
    bad = [f"{r.table_name}: {', '.join(r.failed_expectations)}" for r in reports if not r.success]
    if bad:
        raise DataQualityError("; ".join(bad))
    return reports
