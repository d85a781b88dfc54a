"""A project's sandbox: one database with copies of its source tables."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SYNCED = "synced_at"


def load(spark: SparkSession, database: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Copies every table into the database anew; table_name and row_count of what it then holds."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
    spark.sql(f"ALTER DATABASE `{database}` SET DBPROPERTIES ('{SYNCED}' = '{datetime.now(UTC).isoformat()}')")
    return contents(spark, database)


def last_sync(spark: SparkSession, database: str) -> datetime | None:
    """When load() last filled the database; None if it has not, or if there is no such database."""
    if not exists(spark, database):
        return None
    told = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE DATABASE EXTENDED `{database}`").collect()}
    found = re.search(rf"\({SYNCED},([^)]*)\)", told.get("Properties") or "")
    return datetime.fromisoformat(found[1]) if found else None


def total_rows(spark: SparkSession, database: str) -> int:
    """The rows of all tables, counted in one job; 0 where there is none."""
    return contents(spark, database).agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]


def contents(spark: SparkSession, database: str) -> DataFrame:
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    if not names:
        return spark.createDataFrame([], "table_name string, row_count long")
    return reduce(DataFrame.unionByName, [spark.table(f"`{database}`.`{n}`").agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names])


def exists(spark: SparkSession, database: str) -> bool:
    return spark.catalog.databaseExists(database)
