"""Breakdowns of a KPI: by month, by a column, by a dimension reached over foreign keys, by activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Path
from .kpis import Measure

#: Activity buckets (fixed values): from, to, label; what is above is the last one.
BUCKETS = ((1, 5, "1-5"), (6, 10, "6-10"), (11, 20, "11-20"))


def by_month(df: DataFrame, measure: Measure, date: str) -> DataFrame:
    """period (the month's first day) and value, in order of period, a null period last."""
    month = F.trunc(F.col(date).cast("date"), "month")
    return measure.rows(df).groupBy(month.alias("period")).agg(measure.value().alias("value")).orderBy(F.asc_nulls_last("period"))


def _top(grouped: DataFrame, limit: int) -> DataFrame:
    return grouped.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("label")).limit(limit)


def by_column(df: DataFrame, measure: Measure, column: str, limit: int = 10, shown: str | None = None) -> DataFrame:
    """label and value of the groups with the largest values; ties go to the smaller label.

    For an identifier, shown names it: the label is then shown and the identifier.
    """
    label = F.col(column).cast("string")
    if shown and column.lower().endswith("_id"):
        label = F.concat(F.lit(f"{shown} "), label)
    return _top(measure.rows(df).groupBy(label.alias("label")).agg(measure.value().alias("value")), limit)


def by_path(tables: dict[str, DataFrame], base: str, measure: Measure, path: Path, limit: int = 10) -> DataFrame:
    """label and value over an inner-join chain along path from base.

    A step from parent to child repeats the base's rows, once for each child, and measures count
    them as often. Measures are the base's columns, whatever names the other tables have. What can be
    added up is summed by the first step's foreign key before anything is joined: all rows of a key meet the same rows.
    """
    rows, parts = measure.rows(tables[base]), measure.in_parts()
    if parts:
        rows = rows.groupBy(*dict.fromkeys(x for x, _ in path.edges[0].pairs)).agg(*[v.alias(n) for n, v in parts[0].items()])
    joined = rows.alias(base)
    for e in path.edges:
        on = reduce(lambda a, b: a & b, (F.col(f"{e.table}.{x}") == F.col(f"{e.target}.{y}") for x, y in e.pairs))
        joined = joined.join(tables[e.target].alias(e.target), on, "inner")
    value = parts[1] if parts else measure.value(f"{base}.")
    return _top(joined.groupBy(path_label(path).alias("label")).agg(value.alias("value")), limit)


def path_label(path: Path, alias: str | None = None) -> Column:
    parts = [F.col(f"`{alias or path.table}`.`{c}`").cast("string") for c in path.label]
    if len(parts) > 1:
        return F.concat(parts[0], F.lit(" "), parts[1])
    return parts[0] if path.named else F.concat(F.lit(path.table.replace("_", " ").title() + " "), parts[0])


def by_activity(df: DataFrame, identifier: str) -> DataFrame:
    """How many entities have how many rows: label, value and sort_key, in order."""
    counts = df.groupBy(identifier).agg(F.count("*").alias("n"))
    label = F.lit(f"{BUCKETS[-1][1] + 1}+")
    for low, high, name in reversed(BUCKETS):
        label = F.when(F.col("n").between(low, high), name).otherwise(label)
    return counts.groupBy(label.alias("label")).agg(F.count("*").alias("value"), F.min("n").alias("sort_key")).orderBy("sort_key")


def with_share(df: DataFrame) -> DataFrame:
    """label, value and share of the total, for results that are already short."""
    total = F.sum("value").over(Window.partitionBy())
    return df.select("label", "value", F.round(F.col("value") / F.nullif(total, F.lit(0.0)), 4).alias("share"))


def over_periods(series: DataFrame) -> DataFrame:
    """A series (period, value) with value_before, change_percentage (null after zero or nothing) and so_far, the total.

    A series has a row a month and is short, so one task orders it.
    """
    order = Window.partitionBy().orderBy(F.asc_nulls_last("period"))
    before = F.lag("value").over(order)
    change = F.round((F.col("value") / F.nullif(before, F.lit(0.0)) - 1) * 100, 4)
    return series.select("period", "value", before.alias("value_before"), change.alias("change_percentage"), F.round(F.sum("value").over(order), 2).alias("so_far"))


def by_all(tables: dict[str, DataFrame], base: str, measures: dict[str, Measure], dates: tuple[str, ...] = (), columns: tuple[str, ...] = (), paths: tuple[Path, ...] = (), limit: int = 10, titles: dict[str, str] | None = None) -> DataFrame:
    """measure, dimension, place, period, label and value of several KPIs over several dimensions, from one pass over base.

    Each is what by_month(), by_column() and by_path() give: dimensions are called by their column, or by
    the table that a path ends in; of columns and paths the first limit groups of each measure are
    there. The pass groups by GROUPING SETS, one a dimension. Paths may go to parents only, whose rows are met once; a
    step to children would repeat base's rows for all other dimensions too.
    """
    joined, keys, there, met = tables[base].alias(base), {}, {}, {(): base}
    for p in paths:
        for k, e in enumerate(p.edges):
            if p.edges[: k + 1] in met:
                continue
            at, name = met[p.edges[:k]], f"step {len(met)} {e.target}"
            met[p.edges[: k + 1]] = name
            on = reduce(lambda a, b: a & b, (F.col(f"`{at}`.`{x}`") == F.col(f"`{name}`.`{y}`") for x, y in e.pairs))
            joined = joined.join(tables[e.target].withColumn("is_there", F.lit(True)).alias(name), on, "left")
        keys[p.table] = path_label(p, met[p.edges])
        there[p.table] = F.col(f"`{met[p.edges]}`.is_there").isNotNull()
    for c in columns:
        label = F.col(f"`{base}`.`{c}`").cast("string")
        shown = (titles or {}).get(c)
        keys[c] = F.concat(F.lit(f"{shown} "), label) if shown and c.lower().endswith("_id") else label
    # A label and whether it was reached are one key, so that groups of rows without a match can be left out.
    held = [F.struct(k.alias("label"), there.get(n, F.lit(True)).alias("there"), F.lit(None).cast("date").alias("period")).alias(f"dimension_{i}") for i, (n, k) in enumerate(keys.items())]
    held += [F.struct(F.lit(None).cast("string").alias("label"), F.lit(True).alias("there"), F.trunc(F.col(f"`{base}`.`{c}`").cast("date"), "month").alias("period")).alias(f"dimension_{len(keys) + i}") for i, c in enumerate(dates)]
    names = [*keys, *dates]
    rows = joined.select(*held, *[F.col(f"`{base}`.`{c}`") for c in tables[base].columns])
    ids = [f"dimension_{i}" for i in range(len(names))]
    wanted = [F.expr(m.filter) if m.filter else None for m in measures.values()]
    values = [F.struct(m.value(where=w).alias("value"), (F.count("*") if w is None else F.count_if(w)).alias("n")).alias(f"measure_{k}") for k, (m, w) in enumerate(zip(measures.values(), wanted))]
    grouped = rows.groupingSets([[i] for i in ids], *ids).agg(F.grouping_id(*ids).alias("g"), *values)
    # In grouping_id a dimension's bit is zero where it is grouped by; of n bits the first dimension has the highest.
    number = {(1 << len(ids)) - 1 - (1 << (len(ids) - 1 - i)): i for i in range(len(ids))}
    which = F.create_map(*[F.lit(x) for g, i in number.items() for x in (g, names[i])])
    key = F.coalesce(*[F.when(F.col("g") == g, F.col(f"dimension_{i}")) for g, i in number.items()])
    lines = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"measure_{k}.value").alias("value"), F.col(f"measure_{k}.n").alias("n")) for k, n in enumerate(measures)])
    long = grouped.select(F.element_at(which, F.col("g").cast("int")).alias("dimension"), key.alias("key"), F.explode(lines).alias("x")).where("key.there AND x.n > 0")
    long = long.select("x.measure", "dimension", F.col("key.period").alias("period"), F.col("key.label").alias("label"), F.col("x.value").alias("value"))
    over = Window.partitionBy("measure", "dimension")
    if not keys:
        return long.withColumn("place", F.row_number().over(over.orderBy(F.asc_nulls_last("period")))).select("measure", "dimension", "place", "period", "label", "value")
    ranked = long.where(~F.col("dimension").isin(*dates)) if dates else long
    ranked = ranked.withColumn("place", F.row_number().over(over.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("label")))).where(F.col("place") <= limit)
    if dates:
        series = long.where(F.col("dimension").isin(*dates)).withColumn("place", F.row_number().over(over.orderBy(F.asc_nulls_last("period"))))
        ranked = ranked.unionByName(series)
    return ranked.select("measure", "dimension", "place", "period", "label", "value")
