"""Settings of a pipeline run, from the environment or given."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

FILES, DATABASES = "files", "databases"


def split_of(text: str) -> tuple[str, int, int, int]:
    """column,low,high,readers."""
    column, *numbers = (part.strip() for part in text.split(","))
    try:
        low, high, readers = map(int, numbers)
    except ValueError:
        raise ValueError(f"a split is column,low,high,readers, not {text!r}") from None
    if not column or low >= high or readers < 1:
        raise ValueError(f"a split is column,low,high,readers with low below high, not {text!r}")
    return column, low, high, readers


def balance_of(text: str) -> tuple[str, int]:
    """column,readers."""
    column, _, readers = (part.strip() for part in text.partition(","))
    if not column or not readers.isdecimal() or int(readers) < 1:
        raise ValueError(f"a balanced read is column,readers, not {text!r}")
    return column, int(readers)


@dataclass(frozen=True)
class Settings:
    """Where the sources are, how tables are stored, and how sessions are made."""

    mode: str = FILES
    data_dir: str = "data"
    warehouse: str = "spark-warehouse"
    table_format: str = "parquet"
    master: str | None = None
    shuffle_partitions: int | None = None
    jdbc_url: str = ""
    jdbc_table: str = "policies"
    jdbc_user: str = ""
    jdbc_password: str = field(default="", repr=False)
    jdbc_driver: str = "com.mysql.cj.jdbc.Driver"
    #: A numeric column, its range and a number of readers make the JDBC read parallel.
    jdbc_split: tuple[str, int, int, int] | None = None
    #: A numeric column and a number of readers, each of which gets about as many rows.
    jdbc_balance: tuple[str, int] | None = None
    #: As jdbc_split for the document store; a document's key, its range and a number of readers.
    document_split: tuple[str, int, int, int] | None = None

    def __post_init__(self) -> None:
        if self.mode not in (FILES, DATABASES):
            raise ValueError(f"mode is {self.mode!r}; it can be {FILES!r} or {DATABASES!r}")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Settings:
        given = {
            "mode": env.get("SOURCE_MODE"), "data_dir": env.get("DATA_DIR"), "warehouse": env.get("WAREHOUSE_DIR"),
            "table_format": env.get("TABLE_FORMAT"), "master": env.get("SPARK_MASTER"), "jdbc_url": env.get("JDBC_URL"),
            "jdbc_table": env.get("JDBC_TABLE"), "jdbc_user": env.get("JDBC_USER"), "jdbc_password": env.get("JDBC_PASSWORD"),
            "jdbc_driver": env.get("JDBC_DRIVER"),
        }
        for name, variable in (("jdbc_split", "JDBC_SPLIT"), ("document_split", "DOCUMENT_SPLIT")):
            if env.get(variable):
                given[name] = split_of(env[variable])
        if env.get("JDBC_BALANCE"):
            given["jdbc_balance"] = balance_of(env["JDBC_BALANCE"])
        if "SHUFFLE_PARTITIONS" in env:
            given["shuffle_partitions"] = int(env["SHUFFLE_PARTITIONS"])
        return cls(**{k: v for k, v in given.items() if v})

    def path(self, name: str) -> str:
        return f"{self.data_dir.rstrip('/')}/{name}"

    def jdbc_options(self) -> dict[str, str]:
        options = {"url": self.jdbc_url, "dbtable": self.jdbc_table, "user": self.jdbc_user, "password": self.jdbc_password, "driver": self.jdbc_driver}
        if self.jdbc_split:
            column, low, high, readers = self.jdbc_split
            options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(readers)}
        return options
