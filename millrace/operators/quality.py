"""Quality scores and issues from profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the overall score, and thresholds in per cent (cardinality: a ratio).
WEIGHTS = {"completeness": 0.45, "uniqueness": 0.30, "consistency": 0.25}
DUPLICATES_CRITICAL, NULLS_CRITICAL, NULLS_WARNING, LOW_CARDINALITY = 5.0, 50.0, 20.0, 0.01
IDENTIFIER_NAMES = ("id", "uuid", "key", "code")
ISSUE = "severity string, table string, column string, issue_type string, description string, metric double"


def overall(completeness: float, uniqueness: float, consistency: float) -> int:
    """The weighted score, half to even."""
    return round(WEIGHTS["completeness"] * completeness + WEIGHTS["uniqueness"] * uniqueness + WEIGHTS["consistency"] * consistency)


def _overall(c: Column, u: Column, s: Column) -> Column:
    return F.bround(F.round(c * WEIGHTS["completeness"] + u * WEIGHTS["uniqueness"] + s * WEIGHTS["consistency"], 6), 0).cast("int")


def _completeness() -> Column:
    return F.coalesce(F.round(F.avg(1 - F.col("null_percentage") / 100) * 100, 2), F.lit(100.0))


def _consistency() -> Column:
    return F.coalesce(F.round(F.avg(F.when(F.col("suspected_type_mismatch"), 0.0).otherwise(1.0)) * 100, 2), F.lit(100.0))


def _uniqueness() -> Column:
    return F.coalesce(F.round(F.avg(F.when(F.col("duplicate_percentage") < DUPLICATES_CRITICAL, 1.0).otherwise(0.0)) * 100, 2), F.lit(100.0))


def scores(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: completeness, uniqueness, consistency, overall and potential (all issues solved)."""
    parts = columns.agg(_completeness().alias("completeness"), _consistency().alias("consistency"))
    whole = tables.agg(_uniqueness().alias("uniqueness"))
    one = parts.withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k")
    return one.select("completeness", "uniqueness", "consistency", _overall(F.col("completeness"), F.col("uniqueness"), F.col("consistency")).alias("overall"), F.lit(100).alias("potential"))


def issues(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """severity, table, column, issue_type, description and metric of every issue."""
    t, c = F.col("table_name"), F.col("column_name")
    share = F.col("duplicate_percentage")
    critical = share >= DUPLICATES_CRITICAL
    text = F.concat(F.lit("Table '"), t, F.lit("' has "), F.col("duplicate_count").cast("string"), F.lit(" duplicate rows"))
    rows = tables.where(critical | (F.col("duplicate_count") > 0)).select(
        F.when(critical, "critical").otherwise("warning").alias("severity"),
        t.alias("table"),
        F.lit(None).cast("string").alias("column"),
        F.lit("duplicate_rows").alias("issue_type"),
        F.when(critical, F.concat(text, F.lit(" ("), share.cast("string"), F.lit("% of total rows)"))).otherwise(text).alias("description"),
        share.cast("double").alias("metric"),
    )
    nulls, ratio = F.col("null_percentage"), F.col("uniqueness_ratio")
    where = F.concat(F.lit("Column '"), c, F.lit("' in '"), t, F.lit("' "))
    candidates = F.array(
        F.when(nulls >= NULLS_WARNING, F.struct(F.when(nulls >= NULLS_CRITICAL, "critical").otherwise("warning").alias("severity"), F.lit("high_null_rate").alias("issue_type"), F.concat(where, F.lit("has "), nulls.cast("string"), F.lit("% null values")).alias("description"), nulls.cast("double").alias("metric"))),
        F.when(F.col("suspected_type_mismatch"), F.struct(F.lit("warning").alias("severity"), F.lit("type_mismatch").alias("issue_type"), F.concat(where, F.lit("holds text that reads as numbers")).alias("description"), F.lit(None).cast("double").alias("metric"))),
        F.when((ratio < LOW_CARDINALITY) & (F.col("total_count") > 10) & F.lower(c).isin(*IDENTIFIER_NAMES), F.struct(F.lit("critical").alias("severity"), F.lit("low_cardinality_identifier").alias("issue_type"), F.concat(where, F.lit("appears to be an identifier but has very low cardinality (uniqueness ratio: "), ratio.cast("string"), F.lit(")")).alias("description"), ratio.cast("double").alias("metric"))),
    )
    own = columns.select(t.alias("table"), c.alias("column"), F.explode(F.filter(candidates, lambda x: x.isNotNull())).alias("i"))
    return rows.unionByName(own.select("i.severity", "table", "column", "i.issue_type", "i.description", "i.metric"))


def table_scores(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """table_name, score, status and issue_count, the lowest scores first."""
    own = columns.groupBy("table_name").agg(_completeness().alias("c"), _consistency().alias("s"))
    whole = tables.groupBy("table_name").agg(_uniqueness().alias("u"))
    found = issues(columns, tables).groupBy(F.col("table").alias("table_name")).agg(F.count("*").alias("issue_count"))
    score = _overall(F.coalesce("c", F.lit(100.0)), F.col("u"), F.coalesce("s", F.lit(100.0)))
    out = whole.join(own, "table_name", "left").join(found, "table_name", "left").select("table_name", score.alias("score"), F.coalesce("issue_count", F.lit(0)).alias("issue_count"))
    status = F.when(F.col("score") >= 90, "Healthy").when(F.col("score") >= 80, "Warning").when(F.col("score") >= 60, "Needs Review").otherwise("Critical")
    return out.select("table_name", "score", status.alias("status"), "issue_count").orderBy("score", "table_name")


def impact(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """One row of six counters: what the issues touch."""
    doubled = tables.where((F.col("duplicate_percentage") >= DUPLICATES_CRITICAL) | (F.col("duplicate_count") > 0))
    a = doubled.agg(F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("duplicate_records"), F.count("*").alias("duplicate_tables"))
    missing, wrong = F.col("null_percentage") >= NULLS_WARNING, F.col("suspected_type_mismatch")
    b = columns.agg(
        F.coalesce(F.sum(F.when(missing, F.col("null_count"))), F.lit(0)).alias("missing_values"),
        F.count_distinct(F.when(missing, F.col("table_name"))).alias("missing_value_tables"),
        F.count_if(wrong).alias("invalid_formats"),
        F.count_distinct(F.when(wrong, F.col("table_name"))).alias("invalid_format_tables"),
    )
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def report(columns: DataFrame, tables: DataFrame, path: str) -> None:
    """The report as CSV: scores, ranked tables and issues, each in a folder under path."""
    for name, df in (("scores", scores(columns, tables)), ("tables", table_scores(columns, tables)), ("issues", issues(columns, tables))):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
