"""Ad-hoc SQL: run, explain, shape for a grid; and named queries."""

from __future__ import annotations

import time
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...]
    rows: tuple[dict, ...]
    milliseconds: int
    plan: str | None
    error: str | None = None


def plain(value):
    """A value as JSON can have it: numbers and text stay, what else there is becomes text."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return float(value) if isinstance(value, Decimal) else value.isoformat() if hasattr(value, "isoformat") else str(value)


def run(spark: SparkSession, sql: str, limit: int = 1000, database: str | None = None) -> Result:
    """The first rows of a query, its time and its plan; an error is a result too.

    database is the environment that the query's tables are looked up in: the sandbox or the warehouse.
    """
    began = time.monotonic()
    before = spark.catalog.currentDatabase()
    try:
        if database:
            spark.catalog.setCurrentDatabase(database)
        df = spark.sql(sql)
        rows = tuple({k: plain(v) for k, v in r.asDict().items()} for r in df.limit(limit).collect())
        return Result(tuple(df.columns), rows, round((time.monotonic() - began) * 1000), explain(spark, sql))
    except Exception as e:  # the user's query may be wrong in any way
        return Result((), (), round((time.monotonic() - began) * 1000), None, str(e).splitlines()[0])
    finally:
        spark.catalog.setCurrentDatabase(before)


def column_kind(result: Result, column: str) -> str:
    """What a result's column looks like by its first value: integer, numeric, boolean, text or unknown."""
    value = next((r[column] for r in result.rows if r[column] is not None), None)
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "integer" if float(value).is_integer() else "numeric"
    return "unknown" if value is None else "text"


class Demo:
    """A read-only workspace: its named queries run, SQL text is refused."""

    def __init__(self, spark: SparkSession, queries: dict[str, tuple[str, str]], limit: int = 200):
        self.spark, self.queries, self.limit = spark, queries, limit

    def titles(self) -> dict[str, str]:
        return {k: title for k, (title, _) in self.queries.items()}

    def frame(self, name: str) -> DataFrame:
        if name not in self.queries:
            raise PermissionError("only the demo's own queries may be run")
        return self.spark.sql(self.queries[name][1]).limit(self.limit)


def explain(spark: SparkSession, sql: str) -> str | None:
    try:
        return spark.sql(f"EXPLAIN FORMATTED {sql}").first()[0]
    except Exception:  # statements without a plan
        return None


def grid(df: DataFrame, filters: dict[str, str] | None = None, sort: str | None = None, descending: bool = False, page: int = 0, size: int = 25) -> DataFrame:
    """A page of a grid: rows whose columns contain the texts, whatever their case, sorted with nulls last."""
    for column, text in (filters or {}).items():
        df = df.where(F.contains(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(text.lower())))
    if sort:
        keys = [F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)]
        df = df.orderBy(*keys, *[F.asc_nulls_last(c) for c in df.columns if c != sort])
    return df.offset(page * size).limit(size)


class Saved:
    """Named queries in a table of their own: save, list, delete, run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, name: str, sql: str, environment: str = "source") -> None:
        self.spark.createDataFrame([(name, sql, environment, False)], "name string, sql string, environment string, gone boolean").withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def delete(self, name: str) -> None:
        self.spark.createDataFrame([(name, None, None, True)], "name string, sql string, environment string, gone boolean").withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def list(self) -> DataFrame:
        newest = self.spark.read.parquet(self.path).groupBy("name").agg(F.max_by(F.struct("sql", "environment", "gone"), "at").alias("q"))
        return newest.where(~F.col("q.gone")).select("name", "q.sql", "q.environment")

    def history(self) -> DataFrame:
        """All that was saved or deleted, the newest first."""
        return self.spark.read.parquet(self.path).select("at", "name", "sql", "environment", F.when(F.col("gone"), "deleted").otherwise("saved").alias("action")).orderBy(F.desc("at"), "name")

    def run(self, name: str) -> DataFrame:
        row = self.list().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        return self.spark.sql(row["sql"])
