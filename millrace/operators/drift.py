"""Schema drift between two catalogue snapshots, and what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = {"table_added": "info", "table_deleted": "critical", "column_added": "info", "column_deleted": "critical", "column_modified": "warning"}


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """change, table_name, column_name, old_type, new_type and severity of each difference.

    Snapshots are rows (table_name, column_name, type, nullable). A column counts as modified if its
    type or nullability differs; columns of added or deleted tables are not listed one by one.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("table_name", "column_name", F.struct("type", "nullable").alias(tag))

    both = side(before, "old").join(side(after, "new"), ["table_name", "column_name"], "full_outer")
    held = both.groupBy("table_name").agg(F.count("old").alias("had"), F.count("new").alias("has"))
    tables = held.where("had = 0 OR has = 0").select(
        F.when(F.col("had") == 0, "table_added").otherwise("table_deleted").alias("change"),
        "table_name",
        *[F.lit(None).cast("string").alias(c) for c in ("column_name", "old_type", "new_type")],
    )
    change = F.when(F.col("old").isNull(), "column_added").when(F.col("new").isNull(), "column_deleted").when(F.col("old") != F.col("new"), "column_modified")
    columns = both.join(held.where("had > 0 AND has > 0"), "table_name", "left_semi").withColumn("change", change).where("change IS NOT NULL")
    found = tables.unionByName(columns.select("change", "table_name", "column_name", F.col("old.type").alias("old_type"), F.col("new.type").alias("new_type")))
    grade = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return found.withColumn("severity", F.element_at(grade, F.col("change"))).orderBy("table_name", "change", "column_name")


def affected_warehouse(changes: DataFrame, design: DataFrame) -> DataFrame:
    """warehouse_table, source_table, reason and severity: one row each, a deleted table before deleted columns.

    design has source_table and warehouse_table.
    """
    lost = changes.where(F.col("change").isin("table_deleted", "column_deleted"))
    reason = F.when(F.col("change") == "table_deleted", F.concat(F.lit("Source table '"), "source_table", F.lit("' was deleted"))).otherwise(
        F.concat(F.lit("Column '"), "column_name", F.lit("' used in source table '"), "source_table", F.lit("' was deleted"))
    )
    rank = F.struct((F.col("change") != "table_deleted").alias("later"), "column_name")
    met = design.join(lost, F.col("source_table") == F.col("table_name"))
    return met.groupBy("warehouse_table", "source_table").agg(F.min_by(reason, rank).alias("reason")).withColumn("severity", F.lit("critical"))


def affected_kpis(changes: DataFrame, kpis: DataFrame, by_text: bool = False) -> DataFrame:
    """kpi_name, change, table_name, column_name and severity.

    kpis has kpi_name, table_name and columns (an array), and with by_text sql: a KPI is then touched if
    its text has the names in it, as a search would find them; else if it uses just these.
    """
    k = kpis.alias("k")
    d = changes.where(F.col("change").isin("table_deleted", "column_deleted", "column_modified")).alias("d")
    table, column = F.col("d.table_name"), F.col("d.column_name")
    if by_text:
        text = F.lower("k.sql")
        on = F.contains(text, F.lower(table)) & (column.isNull() | F.contains(text, F.lower(column)))
        met = k.join(F.broadcast(d), on)
    else:
        met = k.join(d, (F.col("k.table_name") == table) & (column.isNull() | F.array_contains("k.columns", column)))
    return met.select("k.kpi_name", "d.change", table.alias("table_name"), column.alias("column_name"), "d.severity").orderBy("kpi_name", "change", "table_name", "column_name")


def advice(severities: list[str]) -> str:
    if "critical" in severities:
        return "Review affected KPIs and warehouse tables before the next refresh."
    if "warning" in severities:
        return "Check changed columns; results may still be valid."
    return "No action needed." if severities else "No changes."


def dependants(edges: DataFrame, changed: DataFrame, most_steps: int = 50) -> DataFrame:
    """object, steps (fewest) and cause of all that depends on changed objects, over any number of steps.

    edges has object and needs (what it is made from), changed has object; both are names, rows that repeat count once.
    An object is not a dependant of itself, also where dependences form a ring; a recursive query follows them, at most most_steps far.
    """
    spark = edges.sparkSession
    found = spark.sql(
        """
        WITH RECURSIVE reach (object, cause, steps) AS (
          SELECT DISTINCT object, object AS cause, 0 FROM {changed} WHERE object IS NOT NULL
          UNION ALL
          SELECT e.object, r.cause, r.steps + 1 FROM reach r JOIN {edges} e ON e.needs = r.object WHERE r.steps < {most} AND e.object <> r.cause
        )
        SELECT object, cause, min(steps) AS steps FROM reach WHERE steps > 0 GROUP BY object, cause
        """,
        changed=changed,
        edges=edges.select("object", "needs").distinct(),
        most=most_steps,
    )
    return found


def lineage(spark, tables, design, matches, charts=()) -> DataFrame:
    """object and needs: columns of source tables, the warehouse tables over them, KPIs and charts, as names like table.column.

    A warehouse table needs the columns that it copies, a KPI the columns of its measure (and through them
    the table), a chart its KPI.
    """
    by = {t.name: t for t in tables}
    made = {p.source: p.name for p in design.parts}
    rows = [(f"{t.name}.{c.name}", t.name) for t in tables for c in t.columns]
    rows += [(f"{p.name}.{c.name}", f"{p.source}.{c.name}") for p in design.parts for c in by[p.source].columns]
    rows += [(p.name, f"{p.name}.{c.name}") for p in design.parts for c in by[p.source].columns]
    for m in matches:
        home = made.get(m.table, m.table)
        used = [c for c in (m.measure.column, m.measure.identifier) if c]
        rows += [(f"KPI {m.kpi.name}", f"{home}.{c}") for c in used] or [(f"KPI {m.kpi.name}", f"{home}.{by[m.table].columns[0].name}")]
    rows += [(f"chart {c.title}", f"KPI {c.metric}") for c in charts]
    return spark.createDataFrame(sorted(set(rows)), "object string, needs string")
