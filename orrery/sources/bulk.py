"""Bulk load of delimited files: typed rows, and a quarantine of those that don't fit, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import record_texts

#: Why a record is refused as a whole: it hasn't as many fields as the schema.
FIELDS = "fields"


def judged(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), split_bytes: int | None = None) -> DataFrame:
    """The records of the CSV files at path (headers aside): the schema's columns, the record's text in
    `record`, and in `reason` why it is refused, else null.

    Empty fields are null, and carriage returns at the end of the last field are off. Refused are
    records with too few or too many fields (`fields`), with a value that isn't of its column's type
    (`type: column`), or without one that is required (`missing: column`); the first of these, in the
    order of the columns, is named. One pass over the file, by ranges, also where records span lines."""
    fields = T.StructType.fromDDL(schema).fields
    texts = record_texts(spark, path, "csv", split_bytes).where(~F.col("leads"))
    # the corrupt-record column is set where the number of fields is another
    raw = ", ".join(f"f{i} STRING" for i in range(len(fields))) + ", broken STRING"
    read = texts.select("value", F.from_csv("value", raw, {"multiLine": "true", "columnNameOfCorruptRecord": "broken"}).alias("r")).select("value", "r.*")
    last = f"f{len(fields) - 1}"
    read = read.withColumn(last, F.regexp_replace(last, "\r+$", ""))
    text = [F.when(F.col(f"f{i}") != "", F.col(f"f{i}")) for i in range(len(fields))]
    typed = [t if isinstance(f.dataType, T.StringType) else t.try_cast(f.dataType) for t, f in zip(text, fields, strict=True)]
    reasons: list[Column] = [F.when(F.col("broken").isNotNull(), FIELDS)]
    for f, t, value in zip(fields, text, typed, strict=True):
        reasons.append(F.when(t.isNotNull() & value.isNull(), f"type: {f.name}"))
        if f.name in required:
            reasons.append(F.when(t.isNull(), f"missing: {f.name}"))
    return read.select(*[v.alias(f.name) for v, f in zip(typed, fields, strict=True)], F.col("value").alias("record"), F.coalesce(*reasons).alias("reason"))


def bulk_load(spark: SparkSession, path: str, schema: str, target: str, required: tuple[str, ...] = (), split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the records at path to the folder target, in one pass, good ones and refused ones apart.
    Returns the good rows with the schema's columns, and the refused ones' record and reason."""
    rows = judged(spark, path, schema, required, split_bytes)
    refused = F.col("reason").isNotNull()
    # of a good row the text isn't kept: its columns say it all
    rows = rows.withColumn("record", F.when(refused, F.col("record"))).withColumn("refused", refused)
    rows.write.mode("overwrite").partitionBy("refused").parquet(target)
    columns = T.StructType.fromDDL(schema).fieldNames()
    stored = spark.read.schema(f"{schema}, record STRING, reason STRING, refused BOOLEAN").parquet(target)
    return stored.where("NOT refused").select(*columns), stored.where("refused").select("record", "reason")
