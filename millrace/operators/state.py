"""Stored state: versions of small frames in append-only Parquet, of which the newest is read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import drift


def store(df: DataFrame, directory: str, kind: str) -> str:
    """Adds df as the newest version of its kind; a version is committed whole or not at all."""
    version = uuid4().hex
    df.withColumns({"version": F.lit(version), "stored_at": F.current_timestamp()}).write.mode("append").parquet(f"{directory}/{kind}")
    return version


def versions(spark: SparkSession, directory: str, kind: str) -> DataFrame | None:
    """version, stored_at and rows of each version; None if there is none."""
    try:
        df = spark.read.parquet(f"{directory}/{kind}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # damaged or unreadable: not the same as nothing stored
        return None
    return df.groupBy("version", "stored_at").agg(F.count("*").alias("rows"))


def newest(spark: SparkSession, directory: str, kind: str) -> DataFrame | None:
    """The rows of the newest version; None if there is none. An empty frame stored is no version."""
    found = versions(spark, directory, kind)
    last = found.agg(F.max_by("version", "stored_at").alias("v")).first()["v"] if found is not None else None
    if last is None:
        return None
    return spark.read.parquet(f"{directory}/{kind}").where(F.col("version") == last).drop("version", "stored_at")


def refresh_catalogue(catalogue: DataFrame, directory: str) -> tuple[DataFrame | None, str, bool]:
    """(changes against the newest snapshot, advice, whether this one was stored): stored if it is the first or differs."""
    spark = catalogue.sparkSession
    before = newest(spark, directory, "snapshots")
    if before is None:
        store(catalogue, directory, "snapshots")
        return None, drift.advice([]), True
    changes = drift.compare(before, catalogue)
    found = [r["severity"] for r in changes.select("severity").collect()]
    if found:
        store(catalogue, directory, "snapshots")
    return changes, drift.advice(found), bool(found)


def snapshot_rows(snapshot: list[dict], spark: SparkSession) -> DataFrame:
    """A snapshot of nested dictionaries as rows; a column's name and type may be called column_name and data_type."""
    rows = [
        (t["table_name"], c.get("name", c.get("column_name")), c.get("type", c.get("data_type")), c.get("nullable", c.get("is_nullable", True)))
        for t in snapshot
        for c in t["columns"]
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean")
