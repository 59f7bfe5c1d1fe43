"""The test tables in the roles of policies, claims and accidents, typed and raw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a policy; the customer's nation and market segment are its segments. Small orders
    have a negative premium, so the rules for valid policies drop them, and their claims have none."""
    orders, customer, nation = (read(spark, sf_dir, name) for name in ("orders", "customer", "nation"))
    named = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    joined = orders.join(named, orders["o_custkey"] == customer["c_custkey"])
    typed = joined.selectExpr(
        "o_orderkey AS policy_number", "o_custkey AS customer_id",
        "cast(o_orderdate AS date) AS issue_date", "cast(o_orderdate AS date) AS effective_date",
        "add_months(cast(o_orderdate AS date), 12) AS expiry_date",
        "cast(CASE WHEN o_totalprice < 20000 THEN -1 ELSE floor(o_totalprice) END AS double) AS premium",
        "CASE WHEN o_orderstatus <> 'O' THEN cast(floor(o_totalprice) * 10 AS double) END AS sum_insured",
        "nullif(n_name, 'KENYA') AS body", "c_mktsegment AS vehicle_usage",
        "cast(year(o_orderdate) - o_orderkey % 20 AS double) AS model_year",
    )
    return cleaning.valid_policies(typed)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a claim, dated a few days after its incident; one in seven has no date."""
    lines = read(spark, sf_dir, "lineitem").withColumn("amount", F.expr("cast(floor(l_extendedprice * l_discount) AS bigint)"))
    return lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS claim_number", "l_orderkey AS policy_number",
        "CASE WHEN l_linenumber <> 7 THEN date_add(cast(l_shipdate AS date), l_linenumber) END AS claim_datetime",
        "amount AS total_claim_amount", "amount div 4 AS injury_claim_amount", "amount div 2 AS property_claim_amount",
        "amount - amount div 4 - amount div 2 AS vehicle_claim_amount",
        "cast(l_shipdate AS date) AS incident_date", "cast(l_quantity AS int) % 24 AS incident_hour",
        "CASE WHEN l_quantity >= 16 THEN l_quantity END AS driver_age",
    )


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is an accident; its days are spread over the years that policies are from."""
    return read(spark, sf_dir, "events").selectExpr(
        "date_sub(cast(ts AS date), cast(8400 + event_id % 1500 AS int)) AS accident_date", "hour(ts) AS accident_hour", "nullif(event_type, 'error') AS borough",
        "cast(user_id AS int) AS zip_code", "cast(get_json_object(props, '$.k') AS int) AS number_of_persons_injured",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of a vector are its place; its label, where above 3, the number injured."""
    return read(spark, sf_dir, "embeddings").selectExpr(
        "cast(embedding[0] AS double) AS latitude", "cast(embedding[1] AS double) AS longitude",
        "CASE WHEN label > 3 THEN label END AS number_of_persons_injured",
    )


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested and textual, with malformed dates, sentinels, missing keys and impossible hours."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "named_struct('injury', cast(l_quantity AS bigint) - 25, 'property', cast(l_partkey AS bigint), 'total', cast(l_suppkey AS bigint), 'vehicle', cast(l_linenumber AS bigint)) AS claim_amount",
        "CASE WHEN l_linenumber = 5 THEN 'yesterday' ELSE date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss') END AS claim_datetime",
        "concat(l_orderkey, '/', l_linenumber) AS claim_no",
        "named_struct('number_of_vehicles_involved', cast(l_linenumber AS bigint), 'type', l_linestatus) AS collision",
        "named_struct('age', l_quantity - 10, 'insured_relationship', l_returnflag, 'license_issue_date', CASE WHEN l_linenumber = 1 THEN '01-01-1900' WHEN l_linenumber = 2 THEN '1-1-2001' WHEN l_linenumber = 3 THEN '31-02-2001' ELSE date_format(l_shipdate, 'dd-MM-yyyy') END) AS driver",
        "named_struct('date', CASE WHEN l_quantity = 7 THEN '2001-01-01' ELSE date_format(l_shipdate, 'dd-MM-yyyy') END, 'hour', cast(l_quantity AS bigint) - 5, 'severity', l_returnflag, 'type', l_linestatus) AS incident",
        "cast(l_quantity AS bigint) AS months_as_customer", "nullif(cast(l_orderkey AS string), '1') AS policy_no",
        "cast(l_linenumber AS bigint) AS number_of_witnesses", "l_discount > 0.05 AS suspicious_activity",
        "timestamp'2024-01-01' AS ingestion_timestamp",
    )


def raw_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, so most policy numbers repeat; upper-case names; negative premiums."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey AS double) AS CUST_ID", "cast(l_orderkey % 5000 AS string) AS POLICY_NO",
        "date_format(l_shipdate, 'dd-MM-yyyy') AS POL_ISSUE_DATE",
        "CASE WHEN l_linenumber = 1 THEN 'soon' ELSE date_format(l_shipdate, 'dd-MM-yyyy') END AS POL_EFF_DATE",
        "date_format(date_add(cast(l_shipdate AS date), 365), 'dd-MM-yyyy') AS POL_EXPIRY_DATE",
        "date_format(date_sub(cast(l_shipdate AS date), 9999), 'dd-MM-yyyy') AS DRV_DOB",
        "l_returnflag AS BODY", "CASE WHEN l_linestatus = 'F' THEN l_extendedprice END - 1000 AS SUM_INSURED",
        "l_extendedprice - 2000 AS PREMIUM", "l_linenumber AS DEDUCTABLE", "timestamp'2024-01-01' AS ingestion_timestamp",
    )


POLICY_SPECS = (
    {"name": "cust_id", "alias": "customer_id"}, {"name": "policy_no", "alias": "policy_number"},
    {"name": "pol_issue_date", "alias": "issue_date"}, {"name": "pol_eff_date", "alias": "effective_date"},
    {"name": "pol_expiry_date", "alias": "expiry_date"}, {"name": "drv_dob", "alias": "driver_dob"}, {"name": "body"},
    {"name": "sum_insured"}, {"name": "premium"}, {"name": "deductable", "alias": "deductible"},
)


def raw_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE date_format(ts, 'yyyy-MM-dd') END AS ACCIDENT_DATE",
        "CASE WHEN event_id % 7 = 0 THEN '24:00' ELSE date_format(ts, 'H:mm') END AS ACCIDENT_TIME", "event_type AS BOROUGH",
        "CASE WHEN event_id % 3 = 0 THEN '1e12' WHEN event_id % 3 = 1 THEN 'n/a' ELSE concat(user_id, '.0') END AS ZIP_CODE",
        "cast(event_id % 100 AS double) AS LATITUDE", "cast(event_id % 400 AS double) - 200 AS LONGITUDE",
        "get_json_object(props, '$.k') AS NUMBER_OF_PERSONS_INJURED", "'x' AS NUMBER_OF_PERSONS_KILLED",
        "cast(event_id % 3 AS string) AS NUMBER_OF_MOTORIST_INJURED", "cast(NULL AS string) AS NUMBER_OF_MOTORIST_KILLED",
        "cast(event_id AS int) AS COLLISION_ID",
    )


ACCIDENT_SPECS = tuple(
    {"name": name, "alias": "unused"}
    for name in (
        "accident_date", "accident_time", "borough", "zip_code", "latitude", "longitude", "number_of_persons_injured",
        "number_of_persons_killed", "number_of_motorist_injured", "number_of_motorist_killed", "collision_id",
    )
)
