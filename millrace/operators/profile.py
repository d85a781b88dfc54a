"""Column profiles of a table: nulls, distinct values, numbers, frequent values, duplicates, mistyped text.

All columns are unpivoted into (column, value) and counted by one shuffle of distinct values, so a wide
table does not become one Expand per column; statistics of numbers come from one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import type_name

TOP = 5
# What a type's name has in it to count as numeric, and to be exempt from the text check.
NUMERIC_WORDS = ("int", "float", "numeric", "decimal", "real", "double", "bigint", "smallint")
EXEMPT_WORDS = ("int", "float", "numeric", "decimal", "timestamp", "date", "time", "bool", "boolean", "json")
#: Text that reads as a number, an empty one too (it reads as not a number).
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^$|^\s*[+-]?(inf|infinity)\s*$"


def is_numeric(kind: str) -> bool:
    return any(w in kind.lower() for w in NUMERIC_WORDS)


def is_exempt(kind: str) -> bool:
    return any(w in kind.lower() for w in EXEMPT_WORDS)


def known(df: DataFrame, name: str) -> Column:
    """A column with NaN as null."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    return F.nanvl(col, F.lit(None).cast(kind)) if isinstance(kind, (T.DoubleType, T.FloatType)) else col


def as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = known(df, name)
    return F.to_json(col) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else col.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """column_name, value (as text) and n of every distinct value of every column; null is a value."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in df.columns])
    return df.select(F.explode(cells).alias("cell")).groupBy("cell.column_name", "cell.value").agg(F.count("*").alias("n"))


def facts(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """column_name, total_count, null_count, null_percentage, distinct_count, uniqueness_ratio and suspected_type_mismatch.

    A text column of which every value reads as a number is suspected to be mistyped.
    """
    values = value_counts(df) if values is None else values
    judged = [f.name for f in df.schema.fields if not is_exempt(type_name(f.dataType)) and not isinstance(f.dataType, T.NumericType)]
    known_value = F.col("value").isNotNull()
    nulls = F.coalesce(F.sum(F.when(~known_value, F.col("n"))), F.lit(0))
    distinct = F.count_if(known_value)
    text = F.col("column_name").isin(judged)
    return values.groupBy("column_name").agg(
        F.sum("n").alias("total_count"),
        nulls.alias("null_count"),
        F.round(nulls * 100 / F.sum("n"), 2).alias("null_percentage"),
        distinct.alias("distinct_count"),
        F.round(distinct / F.sum("n"), 4).alias("uniqueness_ratio"),
        (text & (distinct > 0) & (F.count_if(text & known_value & ~F.col("value").rlike(NUMBER_TEXT)) == 0)).alias("suspected_type_mismatch"),
    )


def counts(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """The counts and ratios of facts()."""
    return facts(df, values).drop("suspected_type_mismatch")


def top_values(df: DataFrame, values: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """column_name, place, value and n of the most frequent values that are not null; ties by value."""
    values = value_counts(df) if values is None else values
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return values.where(F.col("value").isNotNull()).withColumn("place", place).where(F.col("place") <= top).select("column_name", "place", "value", "n")


#: How far on either side of the middle the bracket reaches in which the median is looked for, and the
#: accuracy of the percentiles that give it: their error is at most a third of that.
AROUND, ACCURACY = 0.0003, 10_000
SLOTS = 1000


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and the exact median of some numeric columns.

    Approximate percentiles give a bracket around the middle. A second pass counts what lies below it
    and each value inside, a thousandth of the table; of these only the slots that hold the middle, a thousandth again, are sorted,
    each by one task.
    """
    names = F.array(*map(F.lit, columns))
    made = []
    for c in columns:
        x = known(df, c).cast("double")
        ends = F.percentile_approx(x, [0.5 - AROUND, 0.5 + AROUND], ACCURACY)
        made.append(F.struct(F.get(ends, F.lit(0)).alias("low"), F.get(ends, F.lit(1)).alias("high"), F.count(x).alias("total")))
    brackets = df.agg(F.array(*made).alias("b")).select(F.posexplode("b").alias("i", "e")).select("i", "e.*").where("total > 0")
    cells = df.select(F.posexplode(F.array(*[known(df, c).cast("double") for c in columns])).alias("i", "v")).where("v IS NOT NULL")
    met = cells.join(F.broadcast(brackets), "i").where("v <= high")
    counted = met.groupBy("i", "total", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    # The values inside lie in SLOTS slots of about as many values each; sums over slots tell which ones hold the middle.
    shares = [k / SLOTS for k in range(1, SLOTS)]
    edges = counted.where("v IS NOT NULL").groupBy(F.col("i").alias("of_i")).agg(F.percentile_approx("v", shares, ACCURACY).alias("edges"))
    dealt = counted.join(F.broadcast(edges), F.col("i") == F.col("of_i")).select("i", "total", "v", "n", F.when(F.col("v").isNull(), -1).otherwise(_slot(F.col("v"), F.col("edges"))).alias("slot"))
    ordered = Window.partitionBy("i").orderBy("slot")
    slots = dealt.groupBy("i", "total", "slot").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(ordered))
    ranks = F.explode(F.array(F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1)).alias("rank")
    wanted = slots.select("i", "slot", (F.col("upto") - F.col("n")).alias("before"), "upto", ranks).where("rank > before AND rank <= upto").select(F.col("i").alias("of_i"), F.col("slot").alias("of_slot"), "before", "rank").distinct()
    inside = dealt.join(F.broadcast(wanted), (F.col("i") == F.col("of_i")) & (F.col("slot") == F.col("of_slot")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("i", "rank").orderBy("v"))
    found = inside.withColumn("upto", upto).where(F.col("upto") >= F.col("rank")).groupBy("i", "rank").agg(F.min("v").alias("v"))
    middle = found.groupBy("i").agg(F.avg("v").alias("median"))
    return middle.select(F.get(names, F.col("i")).alias("column_name"), "median")


def _slot(value: Column, edges: Column) -> Column:
    """How many of some rising edges are below value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(SLOTS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, width: F.when(F.try_element_at(edges, at + width) < value, at + width).otherwise(at))


def numbers(df: DataFrame) -> DataFrame | None:
    """column_name, min, max, mean, median and std_dev (0 of a single value) of numeric columns; None without one."""
    own = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not own:
        return None
    made = []
    for i, c in enumerate(own):
        x = known(df, c).cast("double")
        spread = F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))
        made.append(F.struct(*[F.round(v, 4).alias(k) for k, v in (("min", F.min(x)), ("max", F.max(x)), ("mean", F.avg(x)), ("std_dev", spread))]).alias(f"c{i}"))
    row = df.agg(*made)
    line = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("s")) for i, c in enumerate(own)])
    told = row.select(F.explode(line).alias("x")).select("x.column_name", "x.s.*").join(F.broadcast(medians(df, own)), "column_name", "left")
    return told.select("column_name", "min", "max", "mean", F.round("median", 4).alias("median"), "std_dev")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """total_count, duplicate_count (rows less distinct rows, nulls equal) and duplicate_percentage."""
    keys = [as_text(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    more = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(total.alias("total_count"), more.alias("duplicate_count"), F.coalesce(F.round(more * 100 / F.nullif(total, F.lit(0)), 2), F.lit(0.0)).alias("duplicate_percentage"))


def mistyped(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """column_name and suspected_type_mismatch of facts()."""
    return facts(df, values).select("column_name", "suspected_type_mismatch")


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row a column: counts, types, statistics and an array of top values. An empty table gives none."""
    values = value_counts(df)
    tops = top_values(df, values).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("t"))
    tops = tops.select("column_name", F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("top_values"))
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, type_name(f.dataType))])
    out = facts(df, values).join(tops, "column_name", "left")
    stats = numbers(df)
    if stats is not None:
        out = out.join(F.broadcast(stats), "column_name", "left")
    return out.select(F.lit(name).alias("table_name"), "*", F.try_element_at(types, F.col("column_name")).alias("declared_type"))


COLUMN_FACTS = "table_name string, column_name string, total_count long, null_count long, null_percentage double, distinct_count long, uniqueness_ratio double, suspected_type_mismatch boolean"
TABLE_FACTS = "table_name string, total_count long, duplicate_count long, duplicate_percentage double, error string"


def profile_each(spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], threads: int = 4) -> tuple[DataFrame, DataFrame]:
    """profile_all() with each table's jobs run at once, a few tables side by side; a table that fails stops no other.

    It is a row of zeros with its error, and has no columns. A table may be given as a function that
    reads it. What comes back is a row a column and a row a table.
    """

    def run(name: str) -> tuple[list, tuple]:
        try:
            df = tables[name]() if callable(tables[name]) else tables[name]
            whole = duplicate_rows(df).first()
            return [(name, *r) for r in facts(df).select(*[c.split()[0] for c in COLUMN_FACTS.split(", ")[1:]]).collect()], (name, *whole, None)
        except Exception as e:  # whatever a source fails with is told of its table
            return [], (name, 0, 0, 0.0, str(e).splitlines()[0])

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(run, tables))
    return spark.createDataFrame([r for rows, _ in found for r in rows], COLUMN_FACTS), spark.createDataFrame([whole for _, whole in found], TABLE_FACTS)


def profile_all(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(column profiles without statistics, table profiles) of several tables: the input of quality."""
    columns, rows = [], []
    for name, df in tables.items():
        columns.append(facts(df).select(F.lit(name).alias("table_name"), "*"))
        rows.append(duplicate_rows(df).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, columns), reduce(DataFrame.unionByName, rows)
