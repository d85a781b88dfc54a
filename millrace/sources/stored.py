"""Tables and databases that the session's catalogue stores: lists, sizes, statistics."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.names import is_partition_child

SYSTEM = ("information_schema", "pg_catalog", "pg_toast", "sys")


def schemas(spark: SparkSession, hidden: tuple[str, ...] = ()) -> list[str]:
    """Databases but for those of the system and the hidden ones, such as a project's warehouse."""
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name not in (*SYSTEM, *hidden))


def tables(spark: SparkSession, database: str) -> list[str]:
    """The tables of a database, without the months of a partitioned one."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and not is_partition_child(t.name))


def statistics(spark: SparkSession, name: str, analyse: bool = True) -> dict:
    """size_bytes, row_count and created of a stored table, sizes anew with analyse."""
    if analyse:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    sizes = dict(part.split(" ")[::-1] for part in (told.get("Statistics") or "").split(", ") if part)
    return {"size_bytes": int(sizes.get("bytes", 0)), "row_count": int(sizes["rows"]) if "rows" in sizes else None, "created": told.get("Created Time"), "location": told.get("Location")}


def server(spark: SparkSession) -> dict:
    """What answers: version, time zone, the current database and where tables are stored."""
    conf = spark.conf
    return {"version": spark.version, "time_zone": conf.get("spark.sql.session.timeZone"), "database": spark.catalog.currentDatabase(), "warehouse": conf.get("spark.sql.warehouse.dir", None), "encoding": "UTF-8"}
