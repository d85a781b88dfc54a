"""KPI aggregates: a spec instead of SQL text, so that all KPIs of a table are one aggregation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"
AGGREGATIONS = ("COUNT", "SUM", "AVG", "MAX", "MIN", "COUNT_DISTINCT", "SUM_PER_DISTINCT", "COUNT_PER_DISTINCT", "NULL_RATE")


@dataclass(frozen=True)
class Measure:
    """An aggregation over one table. filter is a condition in SQL, carried over to every breakdown."""

    aggregation: str
    column: str | None = None
    identifier: str | None = None
    filter: str | None = None

    def value(self, qualify: str = "", where: Column | None = None) -> Column:
        """The aggregate as a double, over the rows where a condition holds; ratios are null where nothing is counted."""

        def of(x: Column) -> Column:
            return x if where is None else F.when(where, x)

        def col(name: str) -> Column:
            return of(F.col(f"{qualify}`{name}`"))

        rows = F.count("*") if where is None else F.count_if(where)

        def rounded(x: Column) -> Column:
            return F.round(x.cast(MONEY), 2).cast("double")

        def per(x: Column) -> Column:
            return F.round(x.cast("decimal(28,6)") / F.nullif(F.count_distinct(col(self.identifier)), F.lit(0)), 2).cast("double")

        match self.aggregation:
            case "COUNT":
                return rows.cast("double")
            case "SUM":
                return rounded(F.sum(col(self.column)))
            case "AVG":
                return rounded(F.avg(col(self.column)))
            case "MAX":
                return rounded(F.max(col(self.column)))
            case "MIN":
                return rounded(F.min(col(self.column)))
            case "COUNT_DISTINCT":
                return F.count_distinct(col(self.identifier)).cast("double")
            case "SUM_PER_DISTINCT":
                return per(F.sum(col(self.column)))
            case "COUNT_PER_DISTINCT":
                return per(rows)
            case "NULL_RATE":
                missing = (rows - F.count(col(self.column))).cast("decimal(28,6)")
                return F.round(missing / F.nullif(rows, F.lit(0)) * 100, 2).cast("double")
        raise ValueError(f"unknown aggregation {self.aggregation}")

    def in_parts(self) -> tuple[dict[str, Column], Column] | None:
        """Aggregates of parts of the rows by name, and value() from the parts' aggregates; None where distinct values are counted."""
        c = F.col(f"`{self.column}`")
        whole = lambda name: F.sum(f"part_{name}")
        rounded = lambda x: F.round(x.cast(MONEY), 2).cast("double")
        match self.aggregation:
            case "COUNT":
                return {"part_n": F.count("*")}, whole("n").cast("double")
            case "SUM":
                return {"part_s": F.sum(c)}, rounded(whole("s"))
            case "AVG":
                return {"part_s": F.sum(c), "part_k": F.count(c)}, rounded(whole("s") / F.nullif(whole("k"), F.lit(0)))
            case "MAX":
                return {"part_x": F.max(c)}, rounded(F.max("part_x"))
            case "MIN":
                return {"part_x": F.min(c)}, rounded(F.min("part_x"))
            case "NULL_RATE":
                missing = (whole("n") - whole("k")).cast("decimal(28,6)")
                return {"part_n": F.count("*"), "part_k": F.count(c)}, F.round(missing / F.nullif(whole("n"), F.lit(0)) * 100, 2).cast("double")
        return None

    def rows(self, df: DataFrame) -> DataFrame:
        return df.where(self.filter) if self.filter else df


def single(df: DataFrame, measure: Measure) -> DataFrame:
    """One row with the column value."""
    return measure.rows(df).agg(measure.value().alias("value"))


def batch(df: DataFrame, measures: dict[str, Measure]) -> DataFrame:
    """name and value of all KPIs of one table, from one pass over it; filters are conditions of each aggregate."""
    row = df.agg(*[m.value(where=F.expr(m.filter) if m.filter else None).alias(f"v{i}") for i, m in enumerate(measures.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"v{i}").alias("value")) for i, k in enumerate(measures)])))


def values(results: Iterable[DataFrame]) -> dict[str, float | None]:
    return {r["name"]: r["value"] for df in results for r in df.collect()}
