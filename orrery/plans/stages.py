"""The run: bronze, silver, quality, gold; tables pass between stages by the catalog alone."""

from __future__ import annotations

import argparse
import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from ..operators import cleaning, portfolio, quality
from ..sources import readers, sinks
from ..sources.config import Settings
from .gold import Silver, builders

log = logging.getLogger(__name__)

#: Renames of raw policy columns; accidents keep their names in lower case. Fixed values.
POLICY_NAMES = (
    ("CUST_ID", "customer_id"), ("POLICY_NO", "policy_number"), ("POLICYTYPE", "policy_type"), ("POL_ISSUE_DATE", "issue_date"),
    ("POL_EFF_DATE", "effective_date"), ("POL_EXPIRY_DATE", "expiry_date"), ("BODY", "body"), ("MAKE", "make"), ("MODEL", "model"),
    ("MODEL_YEAR", "model_year"), ("CHASSIS_NO", "chassis_number"), ("USE_OF_VEHICLE", "vehicle_usage"), ("DRV_DOB", "driver_dob"),
    ("BOROUGH", "borough"), ("NEIGHBORHOOD", "neighborhood"), ("ZIP_CODE", "zip_code"), ("PRODUCT", "product"),
    ("SUM_INSURED", "sum_insured"), ("PREMIUM", "premium"), ("DEDUCTABLE", "deductable"),
)
POLICY_SPECS = [{"name": name, "alias": alias} for name, alias in POLICY_NAMES]


def session(settings: Settings, name: str = "orrery") -> SparkSession:
    made = SparkSession.builder.appName(name).config("spark.sql.warehouse.dir", settings.warehouse)
    made = made.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    # keys whose rows a task of a deduplication holds before it sorts instead: some 50 MB
    made = made.config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "50000")
    if settings.master:
        made = made.master(settings.master)
    if settings.shuffle_partitions:
        made = made.config("spark.sql.shuffle.partitions", settings.shuffle_partitions)
    return made.getOrCreate()


def bronze(spark: SparkSession, settings: Settings, connect=None) -> None:
    """Policies and accidents come from one task each (multi-line, compressed), so both are spread;
    no result hangs on the order of their rows."""
    for name, df in readers.raw_tables(spark, settings, connect).items():
        sinks.save(df if name == "bronze_claims" else sinks.spread(df), name, settings.table_format)


def silver(spark: SparkSession, settings: Settings) -> None:
    accidents = spark.table("bronze_accidents")
    specs = [{"name": c, "alias": c} for c in accidents.columns]
    made = {
        "silver_claims": cleaning.clean_claims(spark.table("bronze_claims")),
        "silver_policies": cleaning.clean_policies(spark.table("bronze_policies"), POLICY_SPECS),
        "silver_accidents": cleaning.clean_accidents(accidents.toDF(*[c.lower() for c in accidents.columns]), [{"name": s["name"].lower()} for s in specs]),
    }
    for name, df in made.items():
        sinks.save(df, name, settings.table_format)


def check(spark: SparkSession, settings: Settings) -> list[quality.Report]:
    return quality.gate({name: spark.table(name) for name in quality.SUITES})


def gold(spark: SparkSession, settings: Settings) -> None:
    accidents = spark.table("silver_accidents")
    tables = Silver(spark.table("silver_claims"), spark.table("silver_policies"), accidents, accidents)
    for name, build in builders().items():
        sinks.save(build(tables), name, settings.table_format)
    total = portfolio.totals(spark.table("gold_loss_ratio_monthly")).first()
    log.warning("%s of %s claims lie outside their policy's period", total["claims_outside_policy_period"], total["claims"])


STAGES: dict[str, Callable] = {"bronze": bronze, "silver": silver, "quality": check, "gold": gold}


def run(spark: SparkSession, settings: Settings, chosen: Sequence[str] = tuple(STAGES), retries: int = 0, wait_s: float = 0.0) -> dict[str, float]:
    """The chosen stages in their order, each attempted again so many times after a failure; seconds
    by stage. A quality failure is a finding about the data and isn't tried again. Stages replace
    their tables, so an attempt that broke off leaves nothing to clear away."""
    took = {}
    for name in (n for n in STAGES if n in chosen):
        for attempt in range(retries + 1):
            began = time.monotonic()
            try:
                spark.sparkContext.setJobDescription(name)
                STAGES[name](spark, settings)
                break
            except quality.DataQualityError:
                raise
            except Exception:
                if attempt == retries:
                    raise
                log.warning("%s failed, attempt %s of %s", name, attempt + 1, retries + 1, exc_info=True)
                time.sleep(wait_s)
            finally:
                spark.sparkContext.setJobDescription(None)
        took[name] = time.monotonic() - began
        log.info("%s took %.1f s", name, took[name])
    return took


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m orrery", description=__doc__)
    parser.add_argument("stage", choices=[*STAGES, "all"])
    parser.add_argument("--retries", type=int, default=0, help="further attempts of a stage that fails")
    parser.add_argument("--wait", type=float, default=60.0, help="seconds before a further attempt")
    given = parser.parse_args(arguments)
    settings = Settings.from_environment()
    run(session(settings), settings, tuple(STAGES) if given.stage == "all" else (given.stage,), given.retries, given.wait)
