"""The queries of the analytics operators over the benchmark tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .operators import asof, breakdowns, cleaning, drift, kpis, ordered, profile, quality, ranges, relationships, sketches, state, warehouse, workspace
from .operators.views import MaterialisedView
from .operators.kpis import Measure
from .plans import catalog, charts, graph, kpi_match, project
from .plans.design import design
from .session import TABLES, fresh_dir, table
from .sources import dump, files
from .sources.versioned import VersionedTable
from .streaming import refresh, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def frames(spark: SparkSession, sf: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in names}


# Derived inputs: the tables are clean, so these make the dirt that the operators are for.


def orders_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))


def orders_twice(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.unionByName(orders.where("o_orderkey % 10 = 0"))


def text_orders(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("o_orderkey"),
        key.cast("string").alias("all_numbers"),
        F.when(key % 50 == 0, "n/a").otherwise(key.cast("string")).alias("some_numbers"),
        F.lit("x").alias("code"),
        F.when(key % 3 == 0, F.col("o_orderstatus")).alias("mostly_null"),
    )


NULLS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders"
TWICE_SQL = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0"
TEXT_SQL = "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS all_numbers, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS some_numbers, 'x' AS code, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS mostly_null FROM orders"

# KPIs


def _kpi(name: str, tab: str, measure: Measure, sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = orders_with_nulls(spark, sf) if tab == "orders_nulls" else table(spark, sf, tab)
        return kpis.single(df, measure)

    QUERIES[name] = run
    SQL[name] = sql


_kpi("kpi_count", "orders", Measure("COUNT"), "SELECT CAST(count(*) AS DOUBLE) AS value FROM orders")
_kpi("kpi_sum", "lineitem", Measure("SUM", "l_extendedprice"), "SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem")
_kpi("kpi_avg", "orders", Measure("AVG", "o_totalprice"), "SELECT round(avg(o_totalprice), 2) AS value FROM orders")
_kpi("kpi_max", "orders", Measure("MAX", "o_totalprice"), "SELECT round(max(o_totalprice), 2) AS value FROM orders")
_kpi("kpi_min", "orders", Measure("MIN", "o_totalprice"), "SELECT round(min(o_totalprice), 2) AS value FROM orders")
_kpi("kpi_count_distinct", "orders", Measure("COUNT_DISTINCT", identifier="o_custkey"), "SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value FROM orders")
_kpi("kpi_sum_per_distinct", "orders", Measure("SUM_PER_DISTINCT", "o_totalprice", "o_custkey"), "SELECT round(sum(o_totalprice) / nullif(count(DISTINCT o_custkey), 0), 2) AS value FROM orders")
_kpi("kpi_count_per_distinct", "orders", Measure("COUNT_PER_DISTINCT", identifier="o_custkey"), "SELECT round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT o_custkey), 0), 2) AS value FROM orders")
_kpi("kpi_null_rate", "orders_nulls", Measure("NULL_RATE", "o_totalprice"), f"SELECT round(100.0 * count(CASE WHEN o_totalprice IS NULL THEN 1 END) / nullif(count(*), 0), 2) AS value FROM ({NULLS_SQL})")
_kpi("kpi_filtered", "orders", Measure("SUM", "o_totalprice", filter="o_orderstatus = 'F'"), "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")


@query(
    "SELECT 'orders' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'revenue', round(sum(o_totalprice), 2) FROM orders UNION ALL "
    "SELECT 'customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders UNION ALL SELECT 'open', round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'O'"
)
def kpi_batch(spark, sf):
    """Several KPIs of one table from one pass."""
    spec = {"orders": Measure("COUNT"), "revenue": Measure("SUM", "o_totalprice"), "customers": Measure("COUNT_DISTINCT", identifier="o_custkey"), "open": Measure("SUM", "o_totalprice", filter="o_orderstatus = 'O'")}
    return kpis.batch(table(spark, sf, "orders"), spec)


# Breakdowns


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 1")
def ts_monthly_revenue(spark, sf):
    return breakdowns.by_month(table(spark, sf, "orders"), Measure("SUM", "o_totalprice"), "o_orderdate")


@query("SELECT CAST(date_trunc('month', ts) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
def ts_monthly_events(spark, sf):
    return breakdowns.by_month(table(spark, sf, "events"), Measure("COUNT"), "ts")


@query("SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def cat_top_priority(spark, sf):
    return breakdowns.by_column(table(spark, sf, "orders"), Measure("SUM", "o_totalprice"), "o_orderpriority")


@query("SELECT 'User ' || CAST(user_id AS VARCHAR) AS label, round(sum(value), 2) AS value FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 10")
def cat_top_user_label(spark, sf):
    return breakdowns.by_column(table(spark, sf, "events"), Measure("SUM", "value"), "user_id", shown="User")


def _path(spark, sf, base: str, target: str) -> tuple[dict[str, DataFrame], graph.Path]:
    tabs = frames(spark, sf)
    metas = [catalog.describe(n, d, catalog.BENCH_KEYS[n]) for n, d in tabs.items()]
    return tabs, next(p for p in graph.dimension_paths(metas, base) if p.table == target)


@query("SELECT n.n_name AS label, round(sum(o.o_totalprice), 2) AS value FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 21")
def joined_revenue_by_nation(spark, sf):
    tabs, path = _path(spark, sf, "orders", "nation")
    return breakdowns.by_path(tabs, "orders", Measure("SUM", "o_totalprice"), path, 21)


@query("SELECT r.r_name AS label, round(sum(o.o_totalprice), 2) AS value FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 21")
def joined_revenue_by_region(spark, sf):
    tabs, path = _path(spark, sf, "orders", "region")
    return breakdowns.by_path(tabs, "orders", Measure("SUM", "o_totalprice"), path, 21)


@query("SELECT l.l_returnflag AS label, round(sum(o.o_totalprice), 2) AS value FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 21")
def joined_fanout_by_returnflag(spark, sf):
    """A step to children: each order counts once for each of its lines."""
    tabs, path = _path(spark, sf, "orders", "lineitem")
    return breakdowns.by_path(tabs, "orders", Measure("SUM", "o_totalprice"), path, 21)


@query(
    "SELECT CASE WHEN n BETWEEN 1 AND 5 THEN '1-5' WHEN n BETWEEN 6 AND 10 THEN '6-10' WHEN n BETWEEN 11 AND 20 THEN '11-20' ELSE '21+' END AS label, count(*) AS value, min(n) AS sort_key "
    "FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1"
)
def seg_customer_activity(spark, sf):
    return breakdowns.by_activity(table(spark, sf, "orders"), "o_custkey")


@query("SELECT label, value, round(value / sum(value) OVER (), 4) AS share FROM (SELECT o_orderpriority AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1)")
def share_of_total(spark, sf):
    return breakdowns.with_share(breakdowns.by_column(table(spark, sf, "orders"), Measure("COUNT"), "o_orderpriority"))


@query("SELECT n, count(*) AS customers FROM (SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1) GROUP BY 1")
def left_join_zero_counts(spark, sf):
    tabs = frames(spark, sf, ("customer", "orders"))
    per = tabs["customer"].join(tabs["orders"], F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("customers"))


@query(
    "SELECT n.n_name, count(*) AS line_count, round(sum(o.o_totalprice), 2) AS revenue FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1"
)
def mixed_join_store_like(spark, sf):
    tabs = frames(spark, sf, ("nation", "customer", "orders"))
    joined = tabs["nation"].join(tabs["customer"], F.col("c_nationkey") == F.col("n_nationkey")).join(tabs["orders"], F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name").agg(F.count("*").alias("line_count"), F.round(F.sum("o_totalprice").cast("decimal(38,6)"), 2).cast("double").alias("revenue"))


@query(
    "SELECT n.n_name AS nation, r.r_name AS region, string_agg(DISTINCT p.p_brand, ', ' ORDER BY p.p_brand) AS brands FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey "
    "JOIN region r ON n.n_regionkey = r.r_regionkey JOIN lineitem l ON l.l_suppkey = s.s_suppkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size = 1 GROUP BY 1, 2"
)
def string_agg_parts(spark, sf):
    """A wide star join with a distinct, ordered list."""
    t = frames(spark, sf)
    joined = (
        t["lineitem"].join(t["part"].where("p_size = 1"), F.col("p_partkey") == F.col("l_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("brands"))


@query(
    "SELECT c_custkey, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS amount FROM customer JOIN orders ON o_custkey = c_custkey "
    "WHERE o_orderdate >= (SELECT max(date_trunc('month', o_orderdate)) - INTERVAL 3 MONTH FROM orders) GROUP BY 1 HAVING sum(o_totalprice) > 100000 AND count(o_orderkey) > 1"
)
def rewards_having(spark, sf):
    """Customers by what they ordered in the last three months: a condition on two aggregates."""
    t = frames(spark, sf, ("customer", "orders"))
    since = t["orders"].agg(F.add_months(F.max(F.trunc(F.col("o_orderdate").cast("date"), "month")), -3).alias("since"))
    recent = t["orders"].join(F.broadcast(since), F.col("o_orderdate").cast("date") >= F.col("since"))
    joined = t["customer"].join(recent, F.col("o_custkey") == F.col("c_custkey"))
    out = joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("s"))
    return out.where("s > 100000 AND n_orders > 1").select("c_custkey", "n_orders", F.round(F.col("s").cast("decimal(38,6)"), 2).cast("double").alias("amount"))


@query(
    "WITH owed AS (SELECT o_custkey, sum(o_totalprice) AS fees FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1), "
    "late AS (SELECT o_custkey, sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 90) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 90 GROUP BY 1) "
    "SELECT c_custkey, round(coalesce(fees, 0) + coalesce(days, 0) - c_acctbal, 2) AS balance FROM customer LEFT JOIN owed ON owed.o_custkey = c_custkey LEFT JOIN late ON late.o_custkey = c_custkey"
)
def customer_balances(spark, sf):
    """What all customers owe at a date: fees, a unit for each overdue day, less what they paid; three aggregates, joined."""
    t = frames(spark, sf, ("customer", "orders", "lineitem"))
    orders = t["orders"].where(F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz"))
    owed = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("fees"))
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 90
    late = orders.join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).where(days > 0).groupBy(F.col("o_custkey").alias("late_custkey")).agg(F.sum(days).alias("days"))
    joined = t["customer"].join(owed, F.col("o_custkey") == F.col("c_custkey"), "left").join(late, F.col("late_custkey") == F.col("c_custkey"), "left")
    balance = F.coalesce("fees", F.lit(0.0)) + F.coalesce("days", F.lit(0)) - F.col("c_acctbal")
    return joined.select("c_custkey", F.round(balance.cast("decimal(38,6)"), 2).cast("double").alias("balance"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-06-01')")
def parts_in_stock(spark, sf):
    """Parts that nothing open holds: an anti-join on the open lines."""
    t = frames(spark, sf, ("part", "lineitem"))
    held = t["lineitem"].where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    return t["part"].where("p_size > 40").join(held, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey", "p_name")


@query(
    "SELECT n_name, string_agg(c_mktsegment || ': ' || names, '; ' ORDER BY c_mktsegment) AS info FROM (SELECT n_name, c_mktsegment, string_agg(c_name, ', ' ORDER BY c_name) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1, 2) GROUP BY 1"
)
def nested_lists(spark, sf):
    """A list per nation of lists per segment: the inner one is aggregated first, then joined into the outer."""
    t = frames(spark, sf, ("customer", "nation"))
    rich = t["customer"].where("c_acctbal > 9000").join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    inner = rich.groupBy("n_name", "c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("names"))
    lines = F.array_sort(F.collect_list(F.struct("c_mktsegment", "names")))
    return inner.groupBy("n_name").agg(F.array_join(F.transform(lines, lambda x: F.concat(x["c_mktsegment"], F.lit(": "), x["names"])), "; ").alias("info"))


# Profiles


def _cells(table_sql: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ({table_sql})" for c in columns)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TEXT_COLUMNS = ["o_orderkey", "all_numbers", "some_numbers", "code", "mostly_null"]


def _counts_sql(cells: str) -> str:
    return (
        "SELECT column_name, count(*) AS total_count, count(*) - count(value) AS null_count, round((count(*) - count(value)) * 100.0 / count(*), 2) AS null_percentage, "
        f"count(DISTINCT value) AS distinct_count, round(count(DISTINCT value) * 1.0 / count(*), 4) AS uniqueness_ratio FROM ({cells}) GROUP BY 1"
    )


@query(_counts_sql(_cells(NULLS_SQL, ORDER_COLUMNS)))
def profile_counts(spark, sf):
    return profile.counts(orders_with_nulls(spark, sf))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std_dev FROM ({NULLS_SQL})"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
)
def profile_numeric(spark, sf):
    return profile.numbers(orders_with_nulls(spark, sf))


_PLAIN = ["event_id", "user_id", "event_type", "props"]


@query(
    f"SELECT column_name, CAST(place AS INTEGER) AS place, value, n FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place FROM (SELECT column_name, value, count(*) AS n FROM ({_cells('SELECT * FROM events', _PLAIN)}) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE place <= 5"
)
def profile_top5(spark, sf):
    return profile.top_values(table(spark, sf, "events").select(*_PLAIN))


@query(f"SELECT count(*) AS total_count, count(*) - count(DISTINCT x) AS duplicate_count, round((count(*) - count(DISTINCT x)) * 100.0 / count(*), 2) AS duplicate_percentage FROM (SELECT t AS x FROM ({TWICE_SQL}) t)")
def profile_duplicates(spark, sf):
    return profile.duplicate_rows(orders_twice(spark, sf))


def _mistyped_sql(column: str) -> str:
    if column == "o_orderkey":
        return f"SELECT '{column}' AS column_name, false AS suspected_type_mismatch"
    return f"SELECT '{column}' AS column_name, count({column}) > 0 AND count(CASE WHEN NOT regexp_full_match({column}, '[+-]?[0-9]+') THEN 1 END) = 0 AS suspected_type_mismatch FROM ({TEXT_SQL})"


MISTYPED_SQL = " UNION ALL ".join(map(_mistyped_sql, TEXT_COLUMNS))


@query(MISTYPED_SQL)
def profile_type_mismatch(spark, sf):
    return profile.mistyped(text_orders(spark, sf))


_NUMERIC = ("o_orderkey", "o_custkey", "o_totalprice")
_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std_dev FROM ({NULLS_SQL})" for c in _NUMERIC
)
_TOP_SQL = (
    "SELECT column_name, string_agg(value || '=' || n, '|' ORDER BY n DESC, value) AS top_values FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place "
    f"FROM (SELECT column_name, value, count(*) AS n FROM ({_cells(NULLS_SQL, ORDER_COLUMNS)}) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE place <= 5 GROUP BY 1"
)
_TYPES_SQL = "SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'varchar'), ('o_totalprice', 'double precision'), ('o_orderdate', 'timestamp'), ('o_orderpriority', 'varchar')) v(column_name, declared_type)"


@query(
    f"SELECT 'orders' AS table_name, c.*, false AS suspected_type_mismatch, top_values, min, max, mean, median, std_dev, declared_type FROM ({_counts_sql(_cells(NULLS_SQL, ORDER_COLUMNS))}) c "
    f"LEFT JOIN ({_TOP_SQL}) t USING (column_name) LEFT JOIN ({_STATS_SQL}) s USING (column_name) JOIN ({_TYPES_SQL}) k USING (column_name)"
)
def profile_full(spark, sf):
    """Whole profiles, the frequent values as one text."""
    shown = F.array_join(F.transform("top_values", lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), "|")
    return profile.profile(orders_with_nulls(spark, sf), "orders").withColumn("top_values", shown)


@query("SELECT column_name, CAST(place AS INTEGER) AS place, value, n FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place FROM (SELECT column_name, value, count(*) AS n FROM "
       "(SELECT 'l_quantity' AS column_name, CAST(l_quantity AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'l_shipdate', CAST(l_shipdate AS VARCHAR) FROM lineitem UNION ALL SELECT 'l_discount', CAST(l_discount AS VARCHAR) FROM lineitem) GROUP BY 1, 2)) WHERE place <= 5")
def profile_top5_typed(spark, sf):
    """The most frequent numbers and times, as text."""
    return profile.top_values(table(spark, sf, "lineitem").select("l_quantity", "l_shipdate", "l_discount"))


# Quality, over three derived tables


def dirty(spark, sf) -> tuple[DataFrame, DataFrame]:
    return profile.profile_all({"orders_nulls": orders_with_nulls(spark, sf), "orders_twice": orders_twice(spark, sf), "text_orders": text_orders(spark, sf)})


_DIRTY = {"orders_nulls": (NULLS_SQL, ORDER_COLUMNS), "orders_twice": (TWICE_SQL, ORDER_COLUMNS), "text_orders": (TEXT_SQL, TEXT_COLUMNS)}
_COLUMNS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, * FROM ({_counts_sql(_cells(s, c))})" for t, (s, c) in _DIRTY.items())
_TABLES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) - count(DISTINCT x) AS duplicate_count, round((count(*) - count(DISTINCT x)) * 100.0 / count(*), 2) AS duplicate_percentage FROM (SELECT t AS x FROM ({s}) t)" for t, (s, _) in _DIRTY.items()
)
_WITH = f"WITH wrong AS (SELECT 'text_orders' AS table_name, * FROM ({MISTYPED_SQL})), c AS (SELECT k.*, coalesce(w.suspected_type_mismatch, false) AS suspected_type_mismatch FROM ({_COLUMNS_SQL}) k LEFT JOIN wrong w ON k.table_name = w.table_name AND k.column_name = w.column_name), t AS ({_TABLES_SQL}) "
_SCORES = "round(avg(1 - null_percentage / 100) * 100, 2) AS completeness, round(avg(CASE WHEN suspected_type_mismatch THEN 0.0 ELSE 1.0 END) * 100, 2) AS consistency"


@query(
    _WITH + f"SELECT completeness, uniqueness, consistency, CAST(round_even(0.45 * completeness + 0.30 * uniqueness + 0.25 * consistency, 0) AS INTEGER) AS overall, 100 AS potential "
    f"FROM (SELECT {_SCORES} FROM c), (SELECT round(avg(CASE WHEN duplicate_percentage < 5 THEN 1.0 ELSE 0.0 END) * 100, 2) AS uniqueness FROM t)"
)
def quality_scores(spark, sf):
    return quality.scores(*dirty(spark, sf))


@query(
    _WITH + 'SELECT CASE WHEN duplicate_percentage >= 5 THEN \'critical\' ELSE \'warning\' END AS severity, table_name AS "table", NULL AS "column", \'duplicate_rows\' AS issue_type, duplicate_percentage AS metric FROM t WHERE duplicate_count > 0 '
    "UNION ALL SELECT CASE WHEN null_percentage >= 50 THEN 'critical' ELSE 'warning' END, table_name, column_name, 'high_null_rate', null_percentage FROM c WHERE null_percentage >= 20 "
    "UNION ALL SELECT 'warning', table_name, column_name, 'type_mismatch', NULL FROM c WHERE suspected_type_mismatch "
    "UNION ALL SELECT 'critical', table_name, column_name, 'low_cardinality_identifier', uniqueness_ratio FROM c WHERE uniqueness_ratio < 0.01 AND total_count > 10 AND lower(column_name) IN ('id', 'uuid', 'key', 'code')"
)
def quality_issues(spark, sf):
    return quality.issues(*dirty(spark, sf)).drop("description")


@query(
    _WITH + ", i AS (SELECT table_name FROM t WHERE duplicate_count > 0 UNION ALL SELECT table_name FROM c WHERE null_percentage >= 20 UNION ALL SELECT table_name FROM c WHERE suspected_type_mismatch UNION ALL SELECT table_name FROM c WHERE uniqueness_ratio < 0.01 AND total_count > 10 AND column_name = 'code') "
    "SELECT table_name, score, CASE WHEN score >= 90 THEN 'Healthy' WHEN score >= 80 THEN 'Warning' WHEN score >= 60 THEN 'Needs Review' ELSE 'Critical' END AS status, (SELECT count(*) FROM i WHERE i.table_name = s.table_name) AS issue_count FROM "
    f"(SELECT t.table_name, CAST(round_even(0.45 * completeness + 0.30 * (CASE WHEN duplicate_percentage < 5 THEN 100.0 ELSE 0.0 END) + 0.25 * consistency, 0) AS INTEGER) AS score FROM t JOIN (SELECT table_name, {_SCORES} FROM c GROUP BY 1) k ON k.table_name = t.table_name) s"
)
def quality_table_scores(spark, sf):
    return quality.table_scores(*dirty(spark, sf))


@query(
    _WITH + "SELECT (SELECT CAST(sum(duplicate_count) AS BIGINT) FROM t WHERE duplicate_count > 0) AS duplicate_records, (SELECT count(*) FROM t WHERE duplicate_count > 0) AS duplicate_tables, CAST(sum(CASE WHEN null_percentage >= 20 THEN null_count END) AS BIGINT) AS missing_values, "
    "count(DISTINCT CASE WHEN null_percentage >= 20 THEN table_name END) AS missing_value_tables, count(CASE WHEN suspected_type_mismatch THEN 1 END) AS invalid_formats, count(DISTINCT CASE WHEN suspected_type_mismatch THEN table_name END) AS invalid_format_tables FROM c"
)
def quality_issue_impact(spark, sf):
    return quality.impact(*dirty(spark, sf))


# Cleaning


@query(f"SELECT DISTINCT * FROM ({TWICE_SQL})")
def clean_dedup(spark, sf):
    return cleaning.Step("drop_duplicates", "orders").apply(orders_twice(spark, sf))


@query(f"SELECT o_orderkey, coalesce(o_totalprice, (SELECT round(median(o_totalprice), 4) FROM ({NULLS_SQL}))) AS o_totalprice FROM ({NULLS_SQL})")
def clean_impute_median(spark, sf):
    df = orders_with_nulls(spark, sf)
    median = profile.numbers(df.select("o_totalprice")).first()["median"]
    return cleaning.Step("impute_median", "orders", "o_totalprice", median).apply(df).select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, TRY_CAST(some_numbers AS DOUBLE) AS some_numbers FROM ({TEXT_SQL})")
def clean_cast_type(spark, sf):
    return cleaning.Step("cast_type", "t", "some_numbers").apply(text_orders(spark, sf)).select("o_orderkey", "some_numbers")


@query(
    f"SELECT 'drop_duplicates' AS operation, count(*) - count(DISTINCT x) AS metric FROM (SELECT t AS x FROM ({TWICE_SQL}) t) UNION ALL SELECT 'impute_median', count(*) FROM ({NULLS_SQL}) WHERE o_totalprice IS NULL "
    f"UNION ALL SELECT 'cast_type', count(*) FROM ({TEXT_SQL}) WHERE some_numbers IS NOT NULL AND TRY_CAST(some_numbers AS DOUBLE) IS NULL"
)
def clean_metrics(spark, sf):
    steps = (
        (cleaning.Step("drop_duplicates", "a"), orders_twice(spark, sf)),
        (cleaning.Step("impute_median", "b", "o_totalprice", 0.0), orders_with_nulls(spark, sf)),
        (cleaning.Step("cast_type", "c", "some_numbers"), text_orders(spark, sf)),
    )
    a, b, c = (s.metric(df).select(F.lit(s.operation).alias("operation"), "metric") for s, df in steps)
    return a.unionByName(b).unionByName(c)


@query(
    f"SELECT 'orders_twice' AS \"table\", NULL AS \"column\", 'drop_duplicates' AS operation, 'high' AS confidence, count(*) - count(DISTINCT x) AS before, 0 AS after FROM (SELECT t AS x FROM ({TWICE_SQL}) t) "
    f"UNION ALL SELECT 'text_orders', 'all_numbers', 'cast_type', 'medium', count(CASE WHEN TRY_CAST(all_numbers AS DOUBLE) IS NULL THEN 1 END), 0 FROM ({TEXT_SQL}) "
    f"UNION ALL SELECT 'text_orders', 'mostly_null', 'flag_nulls', 'low', count(*) - count(mostly_null), count(*) - count(mostly_null) FROM ({TEXT_SQL})"
)
def clean_preview(spark, sf):
    """Recommended steps with their metric before and after, effects adding up."""
    tabs = {"orders_twice": orders_twice(spark, sf), "text_orders": text_orders(spark, sf)}
    found = [r.asDict() for r in quality.issues(*profile.profile_all(tabs)).collect()]
    steps = cleaning.recommend(found, {}, {})
    rows = [(s.table, s.column, s.operation, s.confidence, before, after) for s, before, after in cleaning.preview(tabs, steps)]
    return spark.createDataFrame(rows, "table string, column string, operation string, confidence string, before long, after long")


# Relationships: the tables' keys have no usual suffix, so renamed views


def renamed(spark, sf) -> dict[str, DataFrame]:
    t = frames(spark, sf, ("customer", "orders", "nation"))
    return {
        "customers": t["customer"].select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_key"), F.col("c_name").alias("name")),
        "orders": t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"), F.col("o_totalprice").alias("amount")),
        "nation": t["nation"].select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")),
    }


_RENAMED_KEYS = {"customers": catalog.Keys(("customer_id",)), "orders": catalog.Keys(("order_id",)), "nation": catalog.Keys(("key",))}
_PAIRS = [("orders", "cust_id", "customers", "customer_id"), ("customers", "nation_key", "nation", "key"), ("orders", "cust_id", "nation", "key")]


def _overlap_sql(a: str, x: str, b: str, y: str, names: tuple) -> str:
    t, c, u, d = names
    return (
        f"SELECT '{t}' AS from_table, '{c}' AS from_column, '{u}' AS to_table, '{d}' AS to_column, "
        f"round(count(DISTINCT CASE WHEN {x} IN (SELECT {y} FROM {b}) THEN {x} END) * 1.0 / count(DISTINCT {x}), 6) AS overlap, round(count(DISTINCT {x}) * 1.0 / count({x}), 6) AS cardinality FROM {a}"
    )


@query(
    " UNION ALL ".join(
        [
            _overlap_sql("orders", "o_custkey", "customer", "c_custkey", _PAIRS[0]),
            _overlap_sql("customer", "c_nationkey", "nation", "n_nationkey", _PAIRS[1]),
            _overlap_sql("orders", "o_custkey", "nation", "n_nationkey", _PAIRS[2]),
        ]
    )
)
def rel_overlap(spark, sf):
    return relationships.evidence(renamed(spark, sf), _PAIRS)


def _inferred_sql(names: tuple, name: float, source: tuple, targeted: str = "true") -> str:
    """One relationship: how alike the names are is given, the overlap of values and all that follows from it is computed."""
    a, x, b, y = source
    return (
        f"SELECT {', '.join(f'{v!r} AS {k}' for k, v in zip(('from_table', 'from_column', 'to_table', 'to_column'), names))}, CAST(round({name} * 100) AS INTEGER) AS name_score, CAST(round(o * 100) AS INTEGER) AS overlap_score, p AS confidence, "
        f"CASE WHEN p >= 75 THEN 'high' ELSE 'medium' END AS tier, CASE WHEN p >= 75 THEN 'auto_accepted' ELSE 'pending' END AS status, {targeted} AS targeted FROM (SELECT o, CAST(round_even((0.55 * {name} + 0.45 * o) * 100, 0) AS INTEGER) AS p "
        f"FROM (SELECT count(DISTINCT CASE WHEN {x} IN (SELECT {y} FROM {b}) THEN {x} END) * 1.0 / count(DISTINCT {x}) AS o FROM {a})) WHERE p >= 50"
    )


@query(
    _inferred_sql(("customers", "nation_key", "nation", "key"), 1.0, ("customer", "c_nationkey", "nation", "n_nationkey"))
    + " UNION ALL "
    + _inferred_sql(("orders", "cust_id", "customers", "customer_id"), 22 / 31, ("orders", "o_custkey", "customer", "c_custkey"))
)
def rel_inferred(spark, sf):
    tabs = renamed(spark, sf)
    return relationships.infer(spark, [catalog.describe(n, d, _RENAMED_KEYS[n]) for n, d in tabs.items()], tabs)


_TYPED = [("orders", "as_double", "customers", "as_decimal"), ("orders", "as_decimal", "customers", "key"), ("orders", "key", "customers", "as_double"), ("orders", "half", "customers", "half_decimal"), ("orders", "half", "customers", "key")]


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS from_table, '{c}' AS from_column, '{u}' AS to_table, '{d}' AS to_column, round(count(DISTINCT CASE WHEN {x} IN (SELECT {y} FROM customer) THEN {x} END) * 1.0 / count(DISTINCT {x}), 6) AS overlap, "
        f"round(count(DISTINCT {x}) * 1.0 / count({x}), 6) AS cardinality FROM orders"
        for (t, c, u, d), (x, y) in zip(_TYPED, [("o_custkey", "c_custkey")] * 3 + [("o_custkey * 0.5", "c_custkey * 0.5"), ("o_custkey * 0.5", "c_custkey")])
    )
)
def rel_overlap_typed(spark, sf):
    """Numbers of different types meet where they are equal."""
    t = frames(spark, sf, ("customer", "orders"))

    def forms(df, key):
        k = F.col(key)
        half = k.cast("double") / 2
        return df.select(k.alias("key"), k.cast("double").alias("as_double"), k.cast("decimal(20,4)").alias("as_decimal"), half.alias("half"), half.cast("decimal(20,3)").alias("half_decimal"))

    return relationships.evidence({"orders": forms(t["orders"], "o_custkey"), "customers": forms(t["customer"], "c_custkey")}, _TYPED)


# Warehouse


def _design(spark, sf):
    tabs = frames(spark, sf)
    metas = catalog.discover(tabs)
    return tabs, metas, design(metas)


@query()
def wh_fact_scores(spark, sf):
    _, _, d = _design(spark, sf)
    rows = [(p.source, p.name, p.kind, p.score, list(p.measures), list(p.reasons)) for p in d.parts]
    return spark.createDataFrame(rows, "source_table string, warehouse_table string, kind string, score double, measures array<string>, reasons array<string>")


@query(
    "WITH n AS (" + " UNION ALL ".join(f"SELECT '{t}' AS source_table, count(*) AS n FROM {t}" for t in TABLES) + "), m AS (SELECT * FROM (VALUES ('region', 0, 0, 1), ('nation', 1, 0, 1), ('customer', 1, 0, 1), ('supplier', 1, 0, 1), ('part', 0, 1, 0), ('orders', 1, 1, 1), "
    "('lineitem', 3, 5, 1), ('events', 0, 1, 1)) v(source_table, links, measures, dates)), s AS (SELECT source_table, least(100, CASE WHEN n >= (SELECT list_sort(list(n))[7] FROM n) THEN 30 ELSE 0 END + CASE WHEN links >= 3 THEN 30 WHEN links = 2 THEN 20 WHEN links = 1 THEN 5 ELSE 0 END "
    "+ CASE WHEN measures >= 2 THEN 25 ELSE 15 * measures END + 15 * dates) AS p FROM n JOIN m USING (source_table)) SELECT source_table, CASE WHEN p >= 50 THEN 'fact_' ELSE 'dim_' END || source_table AS warehouse_table, CASE WHEN p >= 50 THEN 'fact' ELSE 'dimension' END AS kind, CAST(p AS DOUBLE) AS score FROM s"
)
def wh_classes(spark, sf):
    """Which tables are facts, by their points for rows (upper quartile), links, measures and dates."""
    return wh_fact_scores(spark, sf).select("source_table", "warehouse_table", "kind", "score")


@query("SELECT c_custkey, true AS created, true AS updated FROM customer")
def wh_dim_audit(spark, sf):
    tabs, _, d = _design(spark, sf)
    made = warehouse.build(tabs["customer"], next(p for p in d.parts if p.source == "customer"))
    recent = F.expr("interval 1 hour")
    return made.select("c_custkey", (F.col("dw_created_at") > F.current_timestamp() - recent).alias("created"), (F.col("dw_updated_at") == F.col("dw_created_at")).alias("updated"))


@query("SELECT * FROM customer")
def wh_dim_ctas(spark, sf):
    tabs, _, d = _design(spark, sf)
    part = next(p for p in d.parts if p.source == "customer")
    return warehouse.build(tabs["customer"], part).drop("dw_created_at", "dw_updated_at")


@query("SELECT 'fact_lineitem' AS table_name, count(*) AS row_count, u.measure, u.total FROM lineitem, (SELECT 'l_quantity' AS measure, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'l_extendedprice', round(sum(l_extendedprice), 2) FROM lineitem UNION ALL SELECT 'l_discount', round(sum(l_discount), 2) FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_tax), 2) FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(sum(l_linenumber) AS DOUBLE) FROM lineitem) u GROUP BY u.measure, u.total")
def wh_validate_sums(spark, sf):
    tabs, _, d = _design(spark, sf)
    return warehouse.sums(tabs["lineitem"], next(p for p in d.facts if p.source == "lineitem"))


@query("SELECT count(*) AS orphan_count FROM (SELECT CASE WHEN o_orderkey % 100 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS k FROM orders) LEFT JOIN customer ON k = c_custkey WHERE k IS NOT NULL AND c_custkey IS NULL")
def wh_validate_orphans(spark, sf):
    key = F.when(F.col("o_orderkey") % 100 == 0, F.col("o_custkey") + 10000000).otherwise(F.col("o_custkey"))
    return warehouse.orphans(table(spark, sf, "orders").withColumn("o_custkey", key), "o_custkey", table(spark, sf, "customer"), "c_custkey")


def _orphans_sql(fact: str, column: str, target: str, dimension: str, key: str) -> str:
    return (
        f"SELECT 'orphans', 'fact_{fact}', '{column} -> {target}.{key}', v, CASE WHEN v > 0 THEN 'error' ELSE 'passed' END "
        f"FROM (SELECT count(*) AS v FROM {fact} f LEFT JOIN {dimension} d ON f.{column} = d.{key} WHERE f.{column} IS NOT NULL AND d.{key} IS NULL)"
    )


@query(
    " UNION ALL ".join(
        [f"SELECT 'rows' AS \"check\", '{'fact' if t in ('orders', 'lineitem') else 'dim'}_{t}' AS table_name, '' AS detail, count(*) AS value, CASE WHEN count(*) = 0 THEN 'warning' ELSE 'passed' END AS status FROM {t}" for t in TABLES]
        + [
            f"SELECT 'unique_key', '{'fact' if t == 'orders' else 'dim'}_{t}', '{k}', v, CASE WHEN v > 0 THEN 'error' ELSE 'passed' END FROM (SELECT count(*) AS v FROM (SELECT {k} FROM {t} GROUP BY 1 HAVING count(*) > 1))"
            for t, keys in catalog.BENCH_KEYS.items()
            for k in keys.primary
        ]
        + [
            _orphans_sql("lineitem", "l_orderkey", "fact_orders", "orders", "o_orderkey"),
            _orphans_sql("lineitem", "l_partkey", "dim_part", "part", "p_partkey"),
            _orphans_sql("lineitem", "l_suppkey", "dim_supplier", "supplier", "s_suppkey"),
            _orphans_sql("orders", "o_custkey", "dim_customer", "customer", "c_custkey"),
        ]
    )
)
def wh_validate(spark, sf):
    tabs, _, d = _design(spark, sf)
    return warehouse.validate(tabs, d)


# KPIs from a catalogue


_SHOWN_SQL = (
    "CASE WHEN unit = 'count' THEN format('{:,}', CAST(value AS BIGINT)) WHEN abs(value) >= 1e6 THEN '$' || format('{:.1f}', value / 1e6) || 'M' WHEN abs(value) >= 1e3 THEN '$' || format('{:.1f}', value / 1e3) || 'K' "
    "ELSE '$' || format('{:,.2f}', value) END"
)
_PRICE = "CAST(round({}(l_extendedprice), 2) AS DOUBLE)"


@query(
    f"SELECT name, table_name, aggregation, confidence, value, {_SHOWN_SQL} AS shown FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{t}' AS table_name, '{a}' AS aggregation, {c} AS confidence, CAST({'count(*)' if a == 'COUNT' else _PRICE.format(a.lower())} AS DOUBLE) AS value, '{'count' if a == 'COUNT' else 'currency'}' AS unit FROM {t}"
        for n, t, a, c in (
            ("Total Transactions", "lineitem", "COUNT", 100),
            ("Total Products", "lineitem", "COUNT", 100),
            ("Total Customers", "customer", "COUNT", 100),
            ("Total Revenue", "lineitem", "SUM", 70),
            ("Average Transaction Value", "lineitem", "AVG", 70),
            ("Maximum Transaction Value", "lineitem", "MAX", 70),
            ("Total Shipments", "lineitem", "COUNT", 100),
            ("Total Shipment Value", "lineitem", "SUM", 70),
        )
    )
    + ")"
)
def kpi_recommended(spark, sf):
    tabs, metas, d = _design(spark, sf)
    found = kpi_match.compute([m for domain in ("retail", "logistics") for m in kpi_match.match(domain, metas, d)], tabs)
    rows = [(m.kpi.name, m.table, m.kpi.aggregation, m.confidence, m.value, m.text) for m in found]
    return spark.createDataFrame(rows, "name string, table_name string, aggregation string, confidence int, value double, shown string")


@query(
    "SELECT 0 AS place, 'Total Revenue' AS name, CAST(round(sum(l_tax), 2) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 1, 'Total Revenue', CAST(round(sum(l_extendedprice), 2) AS DOUBLE) FROM lineitem "
    "UNION ALL SELECT 2, 'Total Revenue', CAST(round(sum(o_totalprice), 2) AS DOUBLE) FROM orders UNION ALL SELECT 3, 'Total Revenue', CAST(round(sum(o_totalprice), 2) AS DOUBLE) FROM orders WHERE o_orderstatus = 'O'"
)
def kpi_same_name(spark, sf):
    """KPIs of one name over several columns, tables and filters keep their own values."""
    kpi = kpi_match.DOMAINS["retail"][0]
    asked = (("lineitem", Measure("SUM", "l_tax")), ("lineitem", Measure("SUM", "l_extendedprice")), ("orders", Measure("SUM", "o_totalprice")), ("orders", Measure("SUM", "o_totalprice", filter="o_orderstatus = 'O'")))
    found = kpi_match.compute([kpi_match.Match(kpi, t, m, 100) for t, m in asked], frames(spark, sf, ("lineitem", "orders")))
    return spark.createDataFrame([(k, m.kpi.name, m.value) for k, m in enumerate(found)], "place int, name string, value double")


_UNITS = ("currency", "inr", "percentage", "days", "count", "ratio", "points")


@query(
    "SELECT o_orderkey, unit, CASE unit WHEN 'currency' THEN CASE WHEN v >= 1e6 THEN '$' || format('{:.1f}', v / 1e6) || 'M' WHEN v >= 1e3 THEN '$' || format('{:.1f}', v / 1e3) || 'K' ELSE '$' || format('{:,.2f}', v) END "
    "WHEN 'inr' THEN CASE WHEN v >= 1e7 THEN '₹' || format('{:.2f}', v / 1e7) || 'Cr' WHEN v >= 1e5 THEN '₹' || format('{:.1f}', v / 1e5) || 'L' ELSE '₹' || format('{:,.2f}', v) END "
    "WHEN 'percentage' THEN format('{:.2f}', v) || '%' WHEN 'days' THEN format('{:.2f}', v) || ' days' WHEN 'count' THEN format('{:,.0f}', v) WHEN 'ratio' THEN format('{:.2f}', v) ELSE format('{:,.0f}', v) END AS shown "
    "FROM (SELECT o_orderkey, unit, CAST((o_orderkey * 7919) % 4099 * 10 ** (o_orderkey % 5) + 1 AS DOUBLE) AS v FROM orders, (SELECT unnest(['currency', 'inr', 'percentage', 'days', 'count', 'ratio', 'points']) AS unit))"
)
def kpi_formatted(spark, sf):
    """Values of every size by every unit, formatted by Spark."""
    value = ((F.col("o_orderkey") * 7919) % 4099 * F.pow(F.lit(10), F.col("o_orderkey") % 5) + 1).cast("double")
    rows = table(spark, sf, "orders").select("o_orderkey", value.alias("v"), F.explode(F.array(*map(F.lit, _UNITS))).alias("unit"))
    return rows.select("o_orderkey", "unit", formats.kpi_column(F.col("v"), F.col("unit")).alias("shown"))


@query()
def chart_plan(spark, sf):
    tabs, metas, d = _design(spark, sf)
    picked = charts.dashboard(kpi_match.match("retail", metas, d), metas, tabs)
    return spark.createDataFrame([(c.key, c.title, c.kind, c.form, len(c.rows)) for c in picked], "key string, title string, kind string, form string, points int")


@query(
    "WITH RECURSIVE e AS (SELECT * FROM (VALUES ('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer'), ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier')) v(a, b)), "
    "l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w AS (SELECT a AS base, b AS dimension, 1 AS hops FROM l UNION SELECT w.base, l.b, w.hops + 1 FROM w JOIN l ON w.dimension = l.a WHERE w.hops < 4) "
    "SELECT base, dimension, min(hops) AS hops, label, true AS named FROM w JOIN (VALUES ('region', 'r_name'), ('nation', 'n_name'), ('customer', 'c_name'), ('supplier', 's_name'), ('part', 'p_name'), ('orders', 'o_orderstatus'), ('lineitem', 'l_returnflag')) n(t, label) ON t = dimension "
    "WHERE base <> dimension GROUP BY base, dimension, label"
)
def graph_paths(spark, sf):
    metas = [catalog.describe(n, x, catalog.BENCH_KEYS[n]) for n, x in frames(spark, sf).items()]
    rows = [(base, p.table, len(p.edges), " ".join(p.label), p.named) for base in TABLES for p in graph.dimension_paths(metas, base)]
    return spark.createDataFrame(rows, "base string, dimension string, hops int, label string, named boolean")


# Catalogue and drift


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def catalog_tables(spark, sf):
    return catalog.row_counts(frames(spark, sf))


@query("SELECT CAST(8 AS BIGINT) AS table_count, CAST(43 AS BIGINT) AS column_count, CAST((" + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES) + ") AS BIGINT) AS row_count, CAST(7 AS BIGINT) AS foreign_key_count")
def catalog_overview(spark, sf):
    return catalog.overview(catalog.as_frame(spark, catalog.discover(frames(spark, sf))))


@query("SELECT * FROM (VALUES ('customer', 'c_nationkey'), ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey'), ('supplier', 's_nationkey')) v(table_name, column_name)")
def catalog_search(spark, sf):
    return catalog.search(catalog.as_frame(spark, catalog.discover(frames(spark, sf))), "NATION").select("table_name", "column_name")


def _snapshots(spark, sf) -> DataFrame:
    """The changes between two stored snapshots of the tables: as they are, and with orders altered, region gone and returns new."""
    tabs = frames(spark, sf)
    orders = tabs["orders"].drop("o_orderpriority").withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("o_note", F.lit("x"))
    later = {n: d for n, d in tabs.items() if n != "region"} | {"orders": orders, "returns": tabs["lineitem"].select("l_orderkey", "l_quantity")}
    directory = fresh_dir(spark, "snapshots")
    for some in (tabs, later):
        seen = catalog.as_frame(spark, [catalog.describe(n, d) for n, d in some.items()]).select("table_name", "column_name", "type", F.lit(True).alias("nullable"))
        changes, _, _ = state.refresh_catalogue(seen, directory)
    return changes


_KINDS_SQL = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double precision' WHEN 'VARCHAR' THEN 'varchar' ELSE 'timestamp' END"
_CHANGES_SQL = (
    f"WITH RECURSIVE was AS (SELECT DISTINCT table_name, column_name, {_KINDS_SQL} AS type FROM information_schema.columns WHERE table_name IN ({', '.join(map(repr, TABLES))})), "
    "now AS (SELECT table_name, column_name, CASE WHEN column_name = 'o_totalprice' THEN 'varchar' ELSE type END AS type FROM was WHERE table_name <> 'region' AND column_name <> 'o_orderpriority' "
    "UNION ALL SELECT 'orders', 'o_note', 'varchar' UNION ALL SELECT 'returns', column_name, type FROM was WHERE column_name IN ('l_orderkey', 'l_quantity')), "
    "changes AS (SELECT DISTINCT 'table_added' AS change, table_name, CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS old_type, CAST(NULL AS VARCHAR) AS new_type, 'info' AS severity FROM now WHERE table_name NOT IN (SELECT table_name FROM was) "
    "UNION ALL SELECT DISTINCT 'table_deleted', table_name, NULL, NULL, NULL, 'critical' FROM was WHERE table_name NOT IN (SELECT table_name FROM now) "
    "UNION ALL SELECT CASE WHEN w.type IS NULL THEN 'column_added' WHEN n.type IS NULL THEN 'column_deleted' ELSE 'column_modified' END, coalesce(w.table_name, n.table_name), coalesce(w.column_name, n.column_name), w.type, n.type, "
    "CASE WHEN w.type IS NULL THEN 'info' WHEN n.type IS NULL THEN 'critical' ELSE 'warning' END FROM was w FULL JOIN now n ON w.table_name = n.table_name AND w.column_name = n.column_name WHERE w.type IS DISTINCT FROM n.type "
    "AND coalesce(w.table_name, n.table_name) IN (SELECT table_name FROM was) AND coalesce(w.table_name, n.table_name) IN (SELECT table_name FROM now)) "
)


@query(_CHANGES_SQL + "SELECT * FROM changes")
def drift_columns(spark, sf):
    """What changed between two stored snapshots of the tables."""
    return _snapshots(spark, sf)


def _designed(spark, sf, **overrides: str):
    tabs = frames(spark, sf, ("region", "nation", "customer", "orders"))
    metas = catalog.discover(tabs, catalog.BENCH_KEYS)
    d = design(metas, {"orders": "fact", "region": "dimension", "nation": "dimension", "customer": "dimension"} | overrides)
    return tabs, metas, d, kpi_match.match("retail", metas, d)


@query(
    _CHANGES_SQL + ", kpis(kpi_name, table_name, columns) AS (VALUES ('Total Transactions', 'orders', []), ('Total Customers', 'customer', []), ('Total Revenue', 'orders', ['o_totalprice']), "
    "('Average Transaction Value', 'orders', ['o_totalprice']), ('Maximum Transaction Value', 'orders', ['o_totalprice'])) "
    "SELECT kpi_name, change, c.table_name, column_name, severity FROM kpis k JOIN changes c ON c.table_name = k.table_name AND change IN ('table_deleted', 'column_deleted', 'column_modified') AND (column_name IS NULL OR list_contains(columns, column_name))"
)
def drift_impact(spark, sf):
    """KPIs, as matched to the tables, that the changes touch."""
    _, _, _, matches = _designed(spark, sf)
    used = [(m.kpi.name, m.table, [c for c in (m.measure.column, m.measure.identifier) if c]) for m in matches]
    return drift.affected_kpis(_snapshots(spark, sf), spark.createDataFrame(used, "kpi_name string, table_name string, columns array<string>"))


@query(
    _CHANGES_SQL + ", made(source_table, warehouse_table) AS (SELECT DISTINCT table_name, CASE WHEN table_name = 'orders' THEN 'fact_' ELSE 'dim_' END || table_name FROM was WHERE table_name IN ('region', 'nation', 'customer', 'orders')) "
    "SELECT warehouse_table, source_table, CASE WHEN change = 'table_deleted' THEN 'Source table ''' || source_table || ''' was deleted' ELSE 'Column ''' || column_name || ''' used in source table ''' || source_table || ''' was deleted' END AS reason, "
    "'critical' AS severity FROM made JOIN changes ON table_name = source_table WHERE change IN ('table_deleted', 'column_deleted')"
)
def drift_warehouse(spark, sf):
    """Warehouse tables that the changes break."""
    _, _, d, _ = _designed(spark, sf)
    made = spark.createDataFrame([(p.source, p.name) for p in d.parts], "source_table string, warehouse_table string")
    return drift.affected_warehouse(_snapshots(spark, sf), made)


@query(
    _CHANGES_SQL + ", held AS (SELECT * FROM was WHERE table_name IN ('region', 'nation', 'customer', 'orders')), named AS (SELECT *, CASE WHEN table_name = 'orders' THEN 'fact_' ELSE 'dim_' END || table_name AS made FROM held), "
    "edges AS (SELECT table_name || '.' || column_name AS object, table_name AS needs FROM named UNION SELECT made || '.' || column_name, table_name || '.' || column_name FROM named UNION SELECT made, made || '.' || column_name FROM named "
    "UNION SELECT 'KPI ' || k, 'fact_orders.o_totalprice' FROM (VALUES ('Total Revenue'), ('Average Transaction Value'), ('Maximum Transaction Value')) v(k) UNION SELECT 'KPI Total Transactions', 'fact_orders.o_orderkey' UNION SELECT 'KPI Total Customers', 'dim_customer.c_custkey'), "
    "lost AS (SELECT CASE WHEN column_name IS NULL THEN table_name ELSE table_name || '.' || column_name END AS object FROM changes WHERE severity <> 'info'), "
    "reach AS (SELECT object, object AS cause, 0 AS steps FROM lost UNION ALL SELECT e.object, r.cause, r.steps + 1 FROM reach r JOIN edges e ON e.needs = r.object) "
    "SELECT object, cause, min(steps) AS steps FROM reach WHERE steps > 0 GROUP BY 1, 2"
)
def drift_closure(spark, sf):
    """All that depends on what was changed, over any number of steps: columns, warehouse tables, KPIs."""
    _, metas, d, matches = _designed(spark, sf)
    lost = _snapshots(spark, sf).where("severity <> 'info'").select(F.concat_ws(".", "table_name", "column_name").alias("object"))
    return drift.dependants(drift.lineage(spark, metas, d, matches), lost)


# Workspace


@query("SELECT * FROM (SELECT * FROM customer WHERE lower(c_name) LIKE '%1%' AND lower(c_mktsegment) LIKE '%build%' ORDER BY c_acctbal DESC NULLS LAST, c_custkey, c_name, c_nationkey, c_mktsegment LIMIT 25 OFFSET 25)")
def grid_filter_sort_page(spark, sf):
    return workspace.grid(table(spark, sf, "customer"), {"c_name": "1", "c_mktsegment": "BUILD"}, "c_acctbal", descending=True, page=1)


@query("SELECT n_name, count(*) AS n, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")
def curated_balances(spark, sf):
    """A named query run as text, as a workspace does."""
    for n in ("customer", "nation"):
        table(spark, sf, n).createOrReplaceTempView(f"ws_{n}")
    return spark.sql("SELECT n_name, count(*) AS n, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance FROM ws_customer JOIN ws_nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10")


CURATED = {
    "curated_monthly_orders": ("Monthly orders", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS order_count FROM {orders} GROUP BY 1 ORDER BY 1 LIMIT 200"),
    "curated_top_parts": ("Top 10 parts by sold lines", "SELECT p_partkey, p_name, count(*) AS line_count FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10"),
    "curated_revenue_by_segment": ("Revenue by segment", "SELECT c_mktsegment AS segment, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS revenue FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC LIMIT 200"),
    "curated_customer_activity": ("Customers by orders", "SELECT order_count, count(*) AS customer_count FROM (SELECT c_custkey, count(o_orderkey) AS order_count FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1 ORDER BY 1 LIMIT 200"),
}


def _curated(name: str):
    def run(spark, sf):
        for n in ("customer", "orders", "lineitem", "part"):
            table(spark, sf, n).createOrReplaceTempView(f"ws_{n}")
        own = {k: (title, sql.format(**{t: f"ws_{t}" for t in TABLES})) for k, (title, sql) in CURATED.items()}
        return workspace.Demo(spark, own).frame(name)

    run.__name__ = name
    return query(CURATED[name][1].format(**{t: t for t in TABLES}))(run)


for _name in CURATED:
    _curated(_name)


@query(
    "SELECT o_orderkey, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS due, "
    "upper(substr(o_orderpriority, 3, 1)) || lower(substr(o_orderpriority, 4)) AS priority FROM orders"
)
def calendar_and_names(spark, sf):
    """Month ends, parts of dates, intervals and capitalised names."""
    day, name = F.col("o_orderdate"), F.col("o_orderpriority")
    told = F.concat(F.upper(F.substr(name, F.lit(3), F.lit(1))), F.lower(F.substr(name, F.lit(4))))
    return table(spark, sf, "orders").select("o_orderkey", F.last_day(day).alias("month_end"), F.year(day).alias("year"), F.month(day).alias("month"), (day + F.expr("interval 1 month")).cast("date").alias("due"), told.alias("priority"))


@query("SELECT o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS o_orderkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).d AS o_orderdate FROM orders GROUP BY 1")
def latest_orders(spark, sf):
    """The newest row of each group, as the newest of stored versions is found."""
    newest = F.max_by(F.struct("o_orderdate", "o_orderkey"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(newest.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_orderdate")


@query("SELECT c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal LIMIT 100")
def source_sample_values(spark, sf):
    return files.sample_values(table(spark, sf, "customer"), "c_acctbal")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_hourly(spark, sf):
    """The windowed counts of the streaming addition, on the whole table."""
    out = refresh.counts(table(spark, sf, "events"), "ts", "event_type")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return joined_revenue_by_nation(spark, sf)


# Joins by time and by range, windows over groups of any size


@query(
    "WITH placed AS (SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 9000 DAY AS placed_at, o_totalprice FROM orders), best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY o_custkey, placed_at ORDER BY o_orderkey DESC) = 1) "
    "SELECT e.event_id, e.user_id, coalesce(b.o_orderkey, -1) AS o_orderkey, b.o_totalprice FROM (SELECT * FROM events) e ASOF LEFT JOIN best b ON e.user_id = b.o_custkey AND CAST(e.ts AS TIMESTAMP) >= b.placed_at"
)
def asof_events_orders(spark, sf):
    """To each event the user's last order at or before it (order dates moved into the events' month), the greater key of two at one time."""
    orders = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAYS")).alias("at"), "o_orderkey", "o_totalprice")
    found = asof.asof_join(table(spark, sf, "events").select("event_id", "user_id", "ts"), orders, "ts", "at", {"user_id": "o_custkey"})
    return found.select("event_id", "user_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), "o_totalprice")


@query(
    "WITH b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view') SELECT e.event_id, coalesce(v.event_id, -1) AS view_id, coalesce(p.event_id, -1) AS next_view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e "
    "ASOF LEFT JOIN b v ON e.user_id = v.user_id AND e.ts > v.ts ASOF LEFT JOIN b p ON e.user_id = p.user_id AND e.ts <= p.ts"
)
def asof_views_of_purchases(spark, sf):
    """To each purchase the user's last view before it and the next one at or after it."""
    events = table(spark, sf, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    back = asof.asof_join(bought, views, "ts", "ts", {"user_id": "user_id"}, strict=True).select("event_id", "user_id", "ts", "view_id")
    both = asof.asof_join(back, views.withColumnRenamed("view_id", "next_view_id"), "ts", "ts", {"user_id": "user_id"}, "forward")
    return both.select("event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("view_id", "next_view_id")])


@query(
    "SELECT p_partkey, count(*) AS orders_in_band, round(sum(o_totalprice), 2) AS amount FROM part JOIN orders ON o_totalprice >= (p_retailprice - 900) * 2500 AND o_totalprice < (p_retailprice - 900) * 2500 + p_size * 20 GROUP BY 1"
)
def range_orders_in_bands(spark, sf):
    """Orders by the price bands of parts: bands overlap, some are long."""
    low = (F.col("p_retailprice") - 900) * 2500
    bands = table(spark, sf, "part").select("p_partkey", low.alias("low"), (low + F.col("p_size") * 20).alias("high"))
    prices = table(spark, sf, "orders").select("o_totalprice")
    met = ranges.range_totals(prices, bands, "o_totalprice", "low", "high", closed="low", amount=F.col("o_totalprice").cast("decimal(20,4)"))
    return met.groupBy("p_partkey").agg(F.sum("n").alias("orders_in_band"), F.round(F.sum("amount"), 2).cast("double").alias("amount"))


_SPANS = "SELECT l_orderkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + l_linenumber AS b FROM lineitem WHERE l_returnflag ="


@query(
    f"SELECT x.l_suppkey, count(*) AS pairs, CAST(sum(x.l_orderkey + y.l_orderkey) AS BIGINT) AS key_sum FROM ({_SPANS} 'R') x JOIN ({_SPANS} 'A') y ON x.l_suppkey = y.l_suppkey AND x.a <= y.b AND y.a <= x.b GROUP BY 1"
)
def range_overlapping_shipments(spark, sf):
    """Pairs of shipments of a supplier that are under way at one time, one returned and one accepted."""
    lines = table(spark, sf, "lineitem")
    sent = F.col("l_shipdate").cast("date")
    spans = [lines.where(F.col("l_returnflag") == flag).select("l_suppkey", "l_orderkey", sent.alias("a"), F.date_add(sent, F.col("l_linenumber")).alias("b")) for flag in "RA"]
    key = F.col("l_orderkey").cast("decimal(20,0)")
    met = ranges.overlap_totals(spans[0], spans[1], "a", "b", "a", "b", {"l_suppkey": "l_suppkey"}, others=key, known=key.isNotNull().cast("long"))
    # A pair with a null key has no sum.
    both = F.when(F.col("known") > 0, key * F.col("known") + F.col("others"))
    return met.groupBy("l_suppkey").agg(F.sum("n").alias("pairs"), F.sum(both).cast("long").alias("key_sum"))


@query(
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS so_far, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders"
)
def run_global_total(spark, sf):
    """The running total of all orders by date: one group that lies over all tasks."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    told = ordered.running_totals(orders, [], [F.asc("o_orderdate"), F.asc("o_orderkey")], so_far=("sum", F.col("price")), place=("count", F.lit(1)))
    return told.select("o_orderkey", F.col("so_far").cast("double").alias("so_far"), "place")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS dense_rank FROM lineitem"
)
def run_ranks(spark, sf):
    """Lines ranked by quantity within their flag: few large groups, many ties."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return ordered.ranked(lines, ["l_returnflag"], [F.desc("l_quantity")], ["l_quantity"]).drop("place", "l_returnflag", "l_quantity")


@query(
    "SELECT event_id, round(avg(value) OVER w, 6) AS moving_average, max(value) OVER w AS moving_max, coalesce(lag(event_id) OVER o, -1) AS before, coalesce(lead(event_id, 2) OVER o, -1) AS second_after FROM events "
    "WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id), w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
)
def run_moving(spark, sf):
    """Moving averages and neighbours of events within their type: frames that reach over tasks."""
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    told = ordered.framed(
        events, ["event_type"], [F.asc("ts"), F.asc("event_id")], 6, 2,
        moving_average=lambda w: F.round(F.avg("value").over(w.rowsBetween(-6, 0)), 6),
        moving_max=lambda w: F.max("value").over(w.rowsBetween(-6, 0)),
        before=lambda w: F.coalesce(F.lag("event_id").over(w), F.lit(-1)),
        second_after=lambda w: F.coalesce(F.lead("event_id", 2).over(w), F.lit(-1)),
    )
    return told.drop("event_type", "ts", "value")


@query(
    "SELECT period, value, lag(value) OVER (ORDER BY period) AS value_before, round((value / nullif(lag(value) OVER (ORDER BY period), 0) - 1) * 100, 4) AS change_percentage, round(sum(value) OVER (ORDER BY period), 2) AS so_far "
    "FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)"
)
def run_period_over_period(spark, sf):
    """A monthly series with the month before, the change and the total so far."""
    return breakdowns.over_periods(breakdowns.by_month(table(spark, sf, "orders"), Measure("SUM", "o_totalprice"), "o_orderdate"))


# Tables with transactions


_UPDATES = (
    "SELECT * FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 15 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 "
    "UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 7 = 0)"
)


def _merged(spark, sf) -> VersionedTable:
    """orders, then a merge of changed, deleted and new rows, then an update and a delete."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    changed = orders.where(key % 3 == 0).select("o_orderkey", "o_custkey", F.when(key % 15 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"))
    new = orders.where(key % 7 == 0).select((key + 1_000_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice")
    held = VersionedTable(spark, fresh_dir(spark, "orders"))
    held.create(orders, ["o_orderkey"], 8)
    held.merge(changed.unionByName(new), delete=F.col("s.o_orderstatus") == "X")
    held.update({"o_orderstatus": F.lit("C")}, (F.col("o_orderstatus") == "N") & (F.col("o_totalprice") > 250_000))
    held.delete(F.col("o_custkey") == 7)
    return held


_MERGED = (
    f"WITH s AS ({_UPDATES}), m AS (SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice "
    "FROM orders t FULL JOIN s ON t.o_orderkey = s.o_orderkey WHERE s.o_orderstatus IS DISTINCT FROM 'X'), u AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'N' AND o_totalprice > 250000 THEN 'C' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM m) "
)


@query(_MERGED + "SELECT * FROM u WHERE o_custkey <> 7")
def wh_merge_orders(spark, sf):
    """A table after a merge, an update and a delete."""
    return _merged(spark, sf).read()


@query(
    _MERGED + "SELECT 1 AS version, 'create' AS operation, count(*) AS row_count, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL SELECT 2, 'merge', count(*), round(sum(o_totalprice), 2) FROM m "
    "UNION ALL SELECT 3, 'update', count(*), round(sum(o_totalprice), 2) FROM u UNION ALL SELECT 4, 'delete', count(*), round(sum(o_totalprice), 2) FROM u WHERE o_custkey <> 7"
)
def wh_merge_history(spark, sf):
    """Every version of that table as it is read back."""
    held = _merged(spark, sf)
    sums = [held.read(n).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")), 2).cast("double").alias("total")).select(F.lit(n).alias("version"), "total") for n in held.numbers()]
    return held.history().drop("changed_buckets").join(F.broadcast(reduce(DataFrame.unionByName, sums)), "version")


# Keys of several columns: what a supplier offers, from the lines that are not new


_OFFERS = "SELECT l_partkey AS part_no, l_suppkey AS supplier_no, max(l_discount) AS best FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2"


def with_offers(spark, sf) -> tuple[dict[str, DataFrame], list[catalog.Table]]:
    """lines, which refer to offers by part and supplier together, and what offers refer to."""
    lines = table(spark, sf, "lineitem")
    offers = lines.where("l_returnflag <> 'N'").groupBy(F.col("l_partkey").alias("part_no"), F.col("l_suppkey").alias("supplier_no")).agg(F.max("l_discount").alias("best"))
    tabs = {"lines": lines.drop("l_shipdate"), "offers": offers, "part": table(spark, sf, "part"), "supplier": table(spark, sf, "supplier")}
    keys = {
        "lines": catalog.Keys((), composite=(catalog.Link(("l_partkey", "l_suppkey"), "offers", ("part_no", "supplier_no")),)),
        "offers": catalog.Keys(("part_no", "supplier_no"), {"part_no": ("part", "p_partkey"), "supplier_no": ("supplier", "s_suppkey")}),
        "part": catalog.Keys(("p_partkey",)),
        "supplier": catalog.Keys(("s_suppkey",)),
    }
    return tabs, [catalog.describe(n, d, keys[n]) for n, d in tabs.items()]


@query(
    f"SELECT 'l_partkey, l_suppkey' AS key_columns, count(*) AS orphan_count FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM ({_OFFERS}) WHERE part_no = l_partkey AND supplier_no = l_suppkey) "
    f"UNION ALL SELECT 'l_partkey', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM ({_OFFERS}) WHERE part_no = l_partkey)"
)
def composite_orphans(spark, sf):
    """Lines without an offer, by the whole key and, for comparison, by its first column alone."""
    tabs, metas = with_offers(spark, sf)
    link = metas[0].links[0]
    made = [warehouse.orphans(tabs["lines"], link.columns[:k], tabs[link.table], link.targets[:k]).select(F.lit(", ".join(link.columns[:k])).alias("key_columns"), "orphan_count") for k in (2, 1)]
    return made[0].unionByName(made[1])


@query(
    f"SELECT s_name AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN ({_OFFERS}) ON part_no = l_partkey AND supplier_no = l_suppkey JOIN supplier ON s_suppkey = supplier_no GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"
)
def composite_joined(spark, sf):
    """Revenue by supplier on the path that the catalogue finds: over the two-column key to offers, then on."""
    tabs, metas = with_offers(spark, sf)
    path = next(p for p in graph.dimension_paths(metas, "lines") if p.table == "supplier")
    return breakdowns.by_path(tabs, "lines", Measure("SUM", "l_extendedprice"), path, 15)


@query(
    f"SELECT 'rows' AS \"check\", 'fact_lines' AS table_name, '' AS detail, (SELECT count(*) FROM lineitem) AS value, 'passed' AS status UNION ALL SELECT 'rows', 'dim_offers', '', count(*), 'passed' FROM ({_OFFERS}) "
    "UNION ALL SELECT 'rows', 'dim_part', '', count(*), 'passed' FROM part UNION ALL SELECT 'rows', 'dim_supplier', '', count(*), 'passed' FROM supplier "
    f"UNION ALL SELECT 'unique_key', 'dim_offers', 'part_no,supplier_no', count(*) - count(DISTINCT (part_no, supplier_no)), 'passed' FROM ({_OFFERS}) UNION ALL SELECT 'unique_key', 'dim_part', 'p_partkey', 0, 'passed' UNION ALL SELECT 'unique_key', 'dim_supplier', 's_suppkey', 0, 'passed' "
    f"UNION ALL SELECT 'orphans', 'fact_lines', '(l_partkey, l_suppkey) -> dim_offers.(part_no, supplier_no)', count(*), CASE WHEN count(*) > 0 THEN 'error' ELSE 'passed' END FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM ({_OFFERS}) WHERE part_no = l_partkey AND supplier_no = l_suppkey)"
)
def composite_validation(spark, sf):
    """The checks of a warehouse with a two-column key."""
    tabs, metas = with_offers(spark, sf)
    return warehouse.validate(tabs, design(metas, {"lines": "fact", "offers": "dimension", "part": "dimension", "supplier": "dimension"}))


# All breakdowns of a fact from one pass


def _dash_sql() -> str:
    joined = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
    measures = {"orders": "CAST(count(*) AS DOUBLE)", "revenue": "round(sum(o_totalprice), 2)", "customers": "CAST(count(DISTINCT o_custkey) AS DOUBLE)", "open": "round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2)"}
    labels = {"customer": "c_name", "nation": "n_name", "region": "r_name", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}
    parts = []
    for m, value in measures.items():
        where = "WHERE o_orderstatus = 'O'" if m == "open" else ""
        parts += [f"(SELECT '{m}' AS measure, '{d}' AS dimension, row_number() OVER (ORDER BY value DESC, label) AS place, NULL::VARCHAR AS period, label, value FROM (SELECT {c} AS label, {value} AS value FROM {joined} {where} GROUP BY 1) QUALIFY place <= 10)" for d, c in labels.items()]
        parts.append(f"(SELECT '{m}', 'o_orderdate', row_number() OVER (ORDER BY period), CAST(period AS VARCHAR), NULL, value FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, {value} AS value FROM orders {where} GROUP BY 1))")
    return " UNION ALL ".join(parts)


@query(_dash_sql())
def dash_one_pass(spark, sf):
    """Four KPIs of orders over three dimensions that are joined, two columns and time: one scan of orders."""
    tabs = frames(spark, sf)
    metas = [catalog.describe(n, d, catalog.BENCH_KEYS[n]) for n, d in tabs.items()]
    paths = tuple(p for p in graph.dimension_paths(metas, "orders") if p.table in ("customer", "nation", "region"))
    asked = {"orders": Measure("COUNT"), "revenue": Measure("SUM", "o_totalprice"), "customers": Measure("COUNT_DISTINCT", identifier="o_custkey"), "open": Measure("SUM", "o_totalprice", filter="o_orderstatus = 'O'")}
    return breakdowns.by_all(tabs, "orders", asked, ("o_orderdate",), ("o_orderstatus", "o_orderpriority"), paths).withColumn("period", F.col("period").cast("string"))


# A whole run, a warehouse as it lies, profiles and views that grow, sessions


_DIRTY_ORDERS = f"SELECT * FROM ({NULLS_SQL}) UNION ALL SELECT * FROM ({NULLS_SQL}) WHERE o_orderkey % 10 = 0"


@query(
    f"WITH dirty AS ({_DIRTY_ORDERS}), filled AS (SELECT DISTINCT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT round(median(o_totalprice), 4) FROM dirty)) AS price FROM dirty) "
    "SELECT 'step' AS kind, 'impute_median o_totalprice' AS name, (SELECT round(median(o_totalprice), 4) FROM dirty) AS value UNION ALL SELECT 'step', 'drop_duplicates', NULL "
    "UNION ALL SELECT 'kpi', 'Total Transactions', CAST(count(*) AS DOUBLE) FROM filled UNION ALL SELECT 'kpi', 'Total Customers', CAST(count(*) AS DOUBLE) FROM customer "
    "UNION ALL SELECT 'kpi', 'Total Revenue', round(sum(price), 2) FROM filled UNION ALL SELECT 'kpi', 'Average Transaction Value', round(avg(price), 2) FROM filled UNION ALL SELECT 'kpi', 'Maximum Transaction Value', round(max(price), 2) FROM filled "
    "UNION ALL SELECT 'rows passed', 'fact_orders', CAST(count(*) AS DOUBLE) FROM filled UNION ALL SELECT 'rows passed', 'dim_customer', CAST(count(*) AS DOUBLE) FROM customer UNION ALL SELECT 'rows passed', 'dim_nation', CAST(count(*) AS DOUBLE) FROM nation UNION ALL SELECT 'rows passed', 'dim_region', CAST(count(*) AS DOUBLE) FROM region "
    "UNION ALL SELECT 'unique_key passed', t, 0 FROM (VALUES ('fact_orders'), ('dim_customer'), ('dim_nation'), ('dim_region')) v(t) "
    "UNION ALL SELECT 'orphans passed', 'fact_orders', CAST(count(*) AS DOUBLE) FROM filled WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"
)
def run_summary(spark, sf):
    """From dirty sources to KPIs over a warehouse: the cleaning that was applied, the warehouse's checks and the KPIs."""
    tabs = frames(spark, sf, ("region", "nation", "customer")) | {"orders": orders_with_nulls(spark, sf).unionByName(orders_with_nulls(spark, sf).where("o_orderkey % 10 = 0"))}
    directory = fresh_dir(spark, "run")
    database = "run_" + directory.rpartition("-")[2]
    spark.sql(f"CREATE DATABASE `{database}` LOCATION '{directory}/warehouse'")
    try:
        done, _ = project.run_all(spark, "summary", tabs, catalog.BENCH_KEYS, directory, database=database, buckets=4, accept=("impute_median",))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    rows = [("step", " ".join(x for x in (s.operation, s.column) if x), s.value) for s in done.applied]
    rows += [(f"{check} {status}", name, float(value)) for check, name, _, value, status in done.checks] + [("kpi", m.kpi.name, m.value) for m in done.kpis]
    return spark.createDataFrame(rows, "kind string, name string, value double")


@query(
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' GROUP BY 1"
)
def wh_layout_join(spark, sf):
    """Half a year of a fact with its dimension, from tables bucketed by key and partitioned by month: no shuffle but the sums', and six months read."""
    tabs, metas, d, _ = _designed(spark, sf)
    where = fresh_dir(spark, "layout")
    database = "layout_" + where.rpartition("-")[2]
    spark.sql(f"CREATE DATABASE `{database}` LOCATION '{where}'")
    held = {p.name: f"`{database}`.`{p.name}`" for p in d.parts}
    warehouse.materialise(spark, tabs, d, database, buckets=4)
    fact = spark.table(held["fact_orders"]).where(F.col(warehouse.MONTH).between("1996-01-01", "1996-06-01"))
    joined = fact.join(spark.table(held["dim_customer"]), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")), 2).cast("double").alias("amount"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percentage, "
        + (f"round(CAST(avg({c}) AS DOUBLE), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev" if c in _NUMERIC else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std_dev")
        + f", true AS median_close, true AS distinct_close FROM ({NULLS_SQL})"
        for c in ORDER_COLUMNS
    )
)
def profile_incremental(spark, sf):
    """A profile of old and new rows, merged without reading the old ones again; estimates are told to be close or not (2 per cent, and 1 per cent of the ranks)."""
    df, directory = orders_with_nulls(spark, sf), fresh_dir(spark, "profile")
    sketches.add(df.where("o_orderkey % 5 <> 0"), directory, "orders")
    told = sketches.add(df.where("o_orderkey % 5 = 0"), directory, "orders")
    exact = profile.counts(df).select("column_name", F.col("distinct_count").alias("exact"))
    guess = {r["column_name"]: r["median"] for r in told.collect()}
    ranks = df.agg(*[(F.count_if(F.col(c) <= guess[c]) / F.count(c)).alias(c) for c in _NUMERIC])
    ranks = ranks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rank")) for c in _NUMERIC])))
    out = told.join(exact, "column_name").join(F.broadcast(ranks), "column_name", "left")
    close = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.02)
    return out.select("column_name", "total_count", "null_count", "null_percentage", "mean", "std_dev", F.coalesce(F.abs(F.col("rank") - 0.5) < 0.01, F.col("median").isNull()).alias("median_close"), close.alias("distinct_close"))


@query("SELECT p_brand, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS amount, max(l_shipdate) AS latest, min(l_quantity) AS least FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def mv_refresh(spark, sf):
    """A materialised star join after two appends: each refresh has read the new files alone."""
    lines, part, where = table(spark, sf, "lineitem"), table(spark, sf, "part"), fresh_dir(spark, "lines")
    measures = {"n": ("count", F.lit(1)), "amount": ("sum", F.col("l_extendedprice").cast("decimal(20,4)")), "latest": ("max", F.col("l_shipdate")), "least": ("min", F.col("l_quantity"))}
    lines.where("l_orderkey % 10 < 5").write.parquet(where)
    view = MaterialisedView(spark, fresh_dir(spark, "view"), where, {"p_brand": F.col("p_brand"), "l_returnflag": F.col("l_returnflag")}, measures, lambda df: df.join(part, F.col("p_partkey") == F.col("l_partkey")))
    view.create(with_data=False)
    view.refresh()
    for low in (5, 8):
        lines.where((F.col("l_orderkey") % 10).between(low, low + 2 if low == 5 else 9)).write.mode("append").parquet(where)
        view.refresh()
    return view.read().withColumn("amount", F.round("amount", 2).cast("double"))


@query(
    "WITH marked AS (SELECT user_id, ts, value, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "numbered AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked) "
    "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, k"
)
def events_sessions(spark, sf):
    """Sessions of users, at most six hours between events."""
    found = sessions.sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours", "value")
    return found.withColumns({"total": F.round("total", 2), **{c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}})


@query("SELECT c_custkey, c_name, c_acctbal, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dump_tables(spark, sf):
    """Two tables read back from one dump of four, some of their columns."""
    names, where = ("region", "nation", "customer", "part"), fresh_dir(spark, "dump")
    lines = []
    for k, n in enumerate(names):
        df = table(spark, sf, n)
        head = spark.createDataFrame([(k, 0, f"COPY public.{n} ({', '.join(df.columns)}) FROM stdin;"), (k, 2, "\\."), (k, 3, "")], "section int, part int, value string")
        lines += [head, dump.as_lines(df).select(F.lit(k).alias("section"), F.lit(1).alias("part"), "value")]
    reduce(DataFrame.unionByName, lines).coalesce(1).sortWithinPartitions("section", "part").select("value").write.text(where)
    path = next(f for f in spark.read.text(where).inputFiles())
    index = dump.sections(spark, path, 10_000)
    customer = dump.read_table(spark, path, "customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double", 10_000, index)
    nation = dump.read_table(spark, path, "nation", "n_nationkey int, n_name string", 10_000, index)
    return customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_name", "c_acctbal", "n_name")
