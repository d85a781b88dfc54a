"""Cleaning steps as DataFrame transformations: previewed lazily, applied by writing a new version."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .profile import as_text, is_numeric, medians


@dataclass(frozen=True)
class Step:
    """operation: drop_duplicates, impute_median, flag_nulls or cast_type. value is the frozen median."""

    operation: str
    table: str
    column: str | None = None
    value: float | None = None
    confidence: str = "low"
    status: str = "pending"
    id: str = field(default_factory=lambda: uuid4().hex, compare=False)

    def apply(self, df: DataFrame) -> DataFrame:
        match self.operation:
            case "drop_duplicates":
                return df.dropDuplicates()
            case "impute_median":
                kind = df.schema[self.column].dataType
                return df.withColumn(self.column, F.coalesce(F.col(self.column), F.lit(self.value).cast(kind)))
            case "flag_nulls":
                return df
            case "cast_type":
                return df.withColumn(self.column, F.col(self.column).try_cast("double"))
        raise ValueError(f"unknown operation {self.operation}")

    def metric(self, df: DataFrame) -> DataFrame:
        """One row with the count that the step is to lower: surplus rows, nulls or text that is no number."""
        match self.operation:
            case "drop_duplicates":
                keys = [as_text(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
                groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
                return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("metric"))
            case "cast_type":
                c = F.col(self.column)
                return df.agg(F.count_if(c.isNotNull() & c.cast("string").try_cast("double").isNull()).alias("metric"))
            case _:
                return df.agg(F.count_if(F.col(self.column).isNull()).alias("metric"))

    def hint(self) -> str:
        """The step as SQL, to be read."""
        match self.operation:
            case "drop_duplicates":
                return f"SELECT DISTINCT * FROM {self.table}"
            case "impute_median":
                return f"SELECT *, coalesce({self.column}, {self.value}) AS {self.column} FROM {self.table}"
            case "cast_type":
                return f"SELECT *, try_cast({self.column} AS DOUBLE) AS {self.column} FROM {self.table}"
        return f"SELECT count(*) FROM {self.table} WHERE {self.column} IS NULL"


def recommend(issues: list[dict], types: dict[tuple[str, str], str], medians: dict[tuple[str, str], float]) -> list[Step]:
    """A step for each issue but low_cardinality_identifier; nulls of a numeric column with a median are imputed, others flagged."""
    steps = []
    for i in issues:
        at = (i["table"], i["column"])
        match i["issue_type"]:
            case "duplicate_rows":
                steps.append(Step("drop_duplicates", i["table"], confidence="high"))
            case "high_null_rate":
                if is_numeric(types.get(at, "")) and medians.get(at) is not None:
                    steps.append(Step("impute_median", *at, value=round(medians[at], 4), confidence="medium"))
                else:
                    steps.append(Step("flag_nulls", *at, confidence="low"))
            case "type_mismatch":
                steps.append(Step("cast_type", *at, confidence="medium"))
    return steps


def medians_for(issues: list[dict], types: dict[tuple[str, str], str], tables: dict[str, DataFrame]) -> dict[tuple[str, str], float]:
    """The medians of the numeric columns with many nulls, which recommend() proposes to fill in; one job a table."""
    wanted: dict[str, list[str]] = {}
    for i in issues:
        if i["issue_type"] == "high_null_rate" and is_numeric(types.get((i["table"], i["column"]), "")):
            wanted.setdefault(i["table"], []).append(i["column"])
    return {(t, r["column_name"]): r["median"] for t, columns in wanted.items() for r in medians(tables[t], columns).collect()}


def decide(steps: list[Step]) -> list[Step]:
    """High confidence approved, low rejected, what lies between left to a person."""
    verdict = {"high": "approved", "low": "rejected"}
    return [replace(s, status=verdict.get(s.confidence, "pending")) for s in steps]


def decided(steps: list[Step], verdicts: dict[str, str]) -> list[Step]:
    """Steps with a person's verdict by their id: approved, rejected, or pending to take one back."""
    if wrong := set(verdicts.values()) - {"approved", "rejected", "pending"}:
        raise ValueError(f"unknown status {', '.join(sorted(wrong))}")
    return [replace(s, status=verdicts.get(s.id, s.status)) for s in steps]


def preview(tables: dict[str, DataFrame], steps: list[Step]) -> list[tuple[Step, int, int]]:
    """Each step's metric before and after, all steps one after another on the same lazy tables; nothing is written.

    All metrics are one job. If it fails, steps are tried one by one, and one that fails changes
    nothing: its metric after is the one before (0 if that can't be had either).
    """

    def chained(some: list[Step]) -> list[tuple[int, int, DataFrame]]:
        now, out = dict(tables), []
        for k, s in enumerate(some):
            out.append((k, 0, s.metric(now[s.table])))
            now[s.table] = s.apply(now[s.table])
            if s.operation != "flag_nulls":
                out.append((k, 1, s.metric(now[s.table])))
        return out

    try:
        parts = [m.select(F.lit(k).alias("k"), F.lit(at).alias("at"), "metric") for k, at, m in chained(steps)]
        got = {(r["k"], r["at"]): r["metric"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}
    except (PySparkException, KeyError):
        got, good = {}, []
        for k, s in enumerate(steps):
            got[k, 0] = 0
            try:
                own = chained([*good, s])
                for _, at, m in own[-1 if s.operation == "flag_nulls" else -2 :]:
                    got[k, at] = m.first()["metric"]
                good.append(s)
            except (PySparkException, KeyError):
                got.pop((k, 1), None)
    return [(s, got[k, 0], got.get((k, 1), got[k, 0])) for k, s in enumerate(steps)]


def apply(spark: SparkSession, tables: dict[str, DataFrame], steps: list[Step], directory: str) -> tuple[dict[str, DataFrame], list[tuple[Step, str]]]:
    """The cleaned tables as new versions under directory, and each step with applied or its error.

    A step that fails is left out, the others of its table are applied. What the tables were read
    from is left as it is, and a new version is committed whole or not at all.
    """
    out, told = dict(tables), []
    for name in dict.fromkeys(s.table for s in steps):
        df, own = tables.get(name), []
        for s in (s for s in steps if s.table == name):
            try:
                if df is None:
                    raise KeyError(f"no table {name}")
                after = s.apply(df)
                after.schema  # an unknown column shows here
                df, own = after, [*own, s]
            except (PySparkException, KeyError) as e:
                told.append((s, str(e).splitlines()[0]))
        if not own:
            continue
        path = f"{directory}/{name}/version={uuid4().hex}"
        try:
            df.write.parquet(path)
            out[name] = spark.read.parquet(path)
            told += [(replace(s, status="applied"), "applied") for s in own]
        except PySparkException as e:
            told += [(s, str(e).splitlines()[0]) for s in own]
    return out, told
