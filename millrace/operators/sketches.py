"""Profiles that can be merged: new rows are added to a stored profile without reading the old ones.

Counts, extremes, mean and deviation are exact; distinct counts come from HyperLogLog sketches and
quantiles from KLL sketches, each of a fixed size, so a state has one small row a column whatever the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import state as stored
from .profile import as_text, known

#: Sizes of the sketches: a distinct count is off by about 0.8 per cent, a quantile's rank by about 0.2 per cent of the rows.
HLL_BITS, KLL_SIZE = 14, 2000
STATE = "column_name string, row_count long, null_count long, low string, high string, least double, most double, mean double, squares double, distinct_sketch binary, quantile_sketch binary"


def state(df: DataFrame) -> DataFrame:
    """The state of df: STATE, one row a column, from one pass. Null and NaN are no values; a table without rows has counts of zero."""
    lines = []
    for f in df.schema.fields:
        text, value = as_text(df, f.name), known(df, f.name)
        numeric = isinstance(f.dataType, T.NumericType)
        x = value.cast("double") if numeric else F.lit(None).cast("double")
        n = F.count(x)
        lines.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.count("*").alias("row_count"),
                F.count_if(text.isNull()).alias("null_count"),
                F.min(F.when(F.lit(not numeric), text)).alias("low"),
                F.max(F.when(F.lit(not numeric), text)).alias("high"),
                F.min(x).alias("least"),
                F.max(x).alias("most"),
                F.avg(x).alias("mean"),
                F.when(n > 0, F.var_pop(x) * n).alias("squares"),
                F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias("distinct_sketch"),
                (F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)) if numeric else F.lit(None).cast("binary")).alias("quantile_sketch"),
            )
        )
    row = df.agg(*[line.alias(f"c{i}") for i, line in enumerate(lines)])
    return row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(lines))])))


def merged(*states: DataFrame) -> DataFrame:
    """One state of the rows of all: as if state() had seen them together, but for the sketches' error."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    n, total = F.col("row_count") - F.col("null_count"), F.sum(F.col("row_count") - F.col("null_count"))
    mean = F.sum(F.col("mean") * n) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), n)), F.lit(0))
    out = rows.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        mean.alias("mean"),
        (F.sum("squares") + F.sum(F.col("mean") * F.col("mean") * n) - total * mean * mean).alias("squares"),
        F.hll_union_agg("distinct_sketch", F.lit(False)).alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.count("quantile_sketch").alias("numeric"),
    )
    return out.withColumn("quantile_sketch", F.when(F.col("numeric") > 0, F.col("quantile_sketch"))).drop("numeric")


def shown(states: DataFrame) -> DataFrame:
    """The profile that a state stands for; distinct_count, uniqueness_ratio and median are estimates."""
    n = F.col("row_count") - F.col("null_count")
    distinct = F.least(F.hll_sketch_estimate("distinct_sketch"), n)
    median = F.when(F.kll_sketch_get_n_double("quantile_sketch") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5)))
    return states.select(
        "column_name",
        F.col("row_count").alias("total_count"),
        "null_count",
        F.round(F.col("null_count") * 100 / F.nullif(F.col("row_count"), F.lit(0)), 2).alias("null_percentage"),
        distinct.alias("distinct_count"),
        F.round(distinct / F.nullif(F.col("row_count"), F.lit(0)), 4).alias("uniqueness_ratio"),
        F.coalesce(F.col("low"), F.col("least").cast("string")).alias("min"),
        F.coalesce(F.col("high"), F.col("most").cast("string")).alias("max"),
        F.round("mean", 4).alias("mean"),
        median.alias("median"),
        F.round(F.when(F.col("squares").isNotNull(), F.when(n == 1, 0.0).otherwise(F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / (n - 1)))), 4).alias("std_dev"),
    )


def add(new_rows: DataFrame, directory: str, kind: str) -> DataFrame:
    """Adds rows to the state stored under a name, or begins it, and gives the profile of all so far. Only new_rows is read."""
    before = stored.newest(new_rows.sparkSession, directory, kind)
    now = state(new_rows)
    stored.store(now if before is None else merged(before, now), directory, kind)
    return shown(stored.newest(new_rows.sparkSession, directory, kind))
