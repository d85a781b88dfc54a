"""Materialising a warehouse design and validating it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.design import Design, Part


def build(df: DataFrame, part: Part) -> DataFrame:
    """The rows of a warehouse table: the source's columns and the audit columns."""
    now = F.current_timestamp()
    audit = {"dw_created_at": now} | ({"dw_updated_at": now} if part.kind == "dimension" else {})
    return df.withColumns(audit)


#: Name of the column by which facts are partitioned: the first day of the month of their date.
MONTH = "dw_month"


def layout(design: Design, frames: dict[str, DataFrame]) -> dict[str, tuple[tuple[str, ...], str | None]]:
    """How each warehouse table lies: the columns by which it is bucketed, and for facts the date whose month partitions it.

    A dimension is bucketed by its key. A fact is bucketed by its foreign key to the dimension with the most rows,
    so that this join, the largest, needs no shuffle; others are small or follow.
    """
    by, out = {p.name: p for p in design.parts}, {}
    for p in design.parts:
        if p.kind == "dimension":
            out[p.name] = (p.key, None)
            continue
        largest = max((k for k in p.links if by[k[1]].kind == "dimension" and ((k[2],) if isinstance(k[2], str) else k[2]) == by[k[1]].key), key=lambda k: by[k[1]].rows, default=None)
        keys = () if largest is None else (largest[0],) if isinstance(largest[0], str) else largest[0]
        out[p.name] = (keys, next((f.name for f in frames[p.source].schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))), None))
    return out


def materialise(spark: SparkSession, frames: dict[str, DataFrame], design: Design, database: str, buckets: int | None = None) -> dict[str, str]:
    """Writes all tables of the design anew, audit columns too; tells of each whether it was written or why not.

    With buckets, tables lie as layout() says: bucketed and sorted by key, facts partitioned by month as
    well, in place of the indexes that a database has. A filter on MONTH then reads those months only.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    status = {}
    for part in design.parts:
        try:
            df = build(frames[part.source], part)
            if buckets is None:
                writer = df.write
            else:
                keys, date = layout(design, frames)[part.name]
                df = df.withColumn(MONTH, F.trunc(F.col(f"`{date}`").cast("date"), "month")) if date else df
                # One task a bucket writes one file a month and bucket, however many rows a month has.
                writer = (df.repartition(buckets, *[F.col(f"`{k}`") for k in keys]) if keys else df).write
                writer = writer.bucketBy(buckets, *keys).sortBy(*keys) if keys else writer
                writer = writer.partitionBy(MONTH) if date else writer
            writer.mode("overwrite").saveAsTable(f"`{database}`.`{part.name}`")
            status[part.name] = "created"
        except Exception as e:  # one table's failure is reported, the others go on
            status[part.name] = f"error: {str(e).splitlines()[0]}"
    return status


def refresh(spark: SparkSession, frames: dict[str, DataFrame], design: Design, copies: str, database: str) -> dict[str, str]:
    """Copies the sources anew into the sandbox database and builds the warehouse from the copies, audit columns too.

    Tells of each copy and warehouse table whether it was written or why not.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{copies}`")
    status, made = {}, {}
    for name, df in frames.items():
        try:
            df.write.mode("overwrite").saveAsTable(f"`{copies}`.`{name}`")
            made[name], status[name] = spark.table(f"`{copies}`.`{name}`"), "copied"
        except Exception as e:  # one table's failure is reported, the others go on
            status[name] = f"error: {str(e).splitlines()[0]}"
    return status | materialise(spark, made, design, database)


def orphans(fact: DataFrame, column: str | tuple[str, ...], dimension: DataFrame, key: str | tuple[str, ...]) -> DataFrame:
    """One row: orphan_count, the rows whose foreign key is not null and not in the dimension.

    A key of several columns must be there as a whole; one with a null among them refers to nothing and is no orphan.
    """
    own, theirs = ((x,) if isinstance(x, str) else x for x in (column, key))
    held = fact.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)]).where(reduce(lambda a, b: a & b, (F.col(f"own_{i}").isNotNull() for i in range(len(own)))))
    keys = dimension.select(*[F.col(f"`{c}`").alias(f"key_{i}") for i, c in enumerate(theirs)])
    lost = held.join(keys, reduce(lambda a, b: a & b, (F.col(f"own_{i}") == F.col(f"key_{i}") for i in range(len(own)))), "left_anti")
    return lost.agg(F.count("*").alias("orphan_count"))


def sums(df: DataFrame, part: Part) -> DataFrame:
    """table_name, row_count, measure and total of each measure, from one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.round(F.sum(m), 2).cast("double").alias(f"m{i}") for i, m in enumerate(part.measures)])
    lines = [F.struct(F.lit(m).alias("measure"), F.col(f"m{i}").alias("total")) for i, m in enumerate(part.measures)]
    none = F.struct(F.lit(None).cast("string").alias("measure"), F.lit(None).cast("double").alias("total"))
    return row.select(F.lit(part.name).alias("table_name"), F.col("n").alias("row_count"), F.explode(F.array(*(lines or [none]))).alias("x")).select("table_name", "row_count", "x.*")


def unique_keys(df: DataFrame, part: Part) -> DataFrame:
    """One row: duplicate_keys, how many key values occur more than once (in place of a unique index)."""
    return df.groupBy(*part.key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))


def validate(frames: dict[str, DataFrame], design: Design) -> DataFrame:
    """check, table_name, detail, value and status of row counts, orphans and key uniqueness of all tables."""
    by = {p.name: p for p in design.parts}
    checks = []

    def line(kind: str, table: str, detail: str, value: DataFrame, bad: str) -> DataFrame:
        v = value.columns[0]
        wrong = (F.col(v) == 0) if kind == "rows" else (F.col(v) > 0)
        return value.select(F.lit(kind).alias("check"), F.lit(table).alias("table_name"), F.lit(detail).alias("detail"), F.col(v).cast("long").alias("value"), F.when(wrong, bad).otherwise("passed").alias("status"))

    for p in design.parts:
        checks.append(line("rows", p.name, "", frames[p.source].agg(F.count("*").alias("n")), "warning"))
        if p.key:
            checks.append(line("unique_key", p.name, ",".join(p.key), unique_keys(frames[p.source], p), "error"))
    for p in design.facts:
        for column, target, key in p.links:
            shown = [x if isinstance(x, str) else f"({', '.join(x)})" for x in (column, key)]
            checks.append(line("orphans", p.name, f"{shown[0]} -> {target}.{shown[1]}", orphans(frames[p.source], column, frames[by[target].source], key), "error"))
    return reduce(DataFrame.unionByName, checks)
