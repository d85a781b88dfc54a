"""Tables from a database over JDBC, with the keys that it declares."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import is_partition_child
from ..plans.catalog import Keys, Link


def parse_dsn(dsn: str) -> dict:
    """host, port, database, user and options of a connection string; the password is not among them."""
    parts = urlsplit(dsn)
    return {"host": parts.hostname, "port": parts.port, "database": parts.path.lstrip("/") or None, "user": unquote(parts.username or "") or None, "options": dict(parse_qsl(parts.query))}


def read(spark: SparkSession, url: str, table: str, schema: str | None = None, partition: tuple[str, int, int, int] | None = None, search_path: str | None = None, **options: str) -> DataFrame:
    """One table. partition (column, lower, upper, parts) splits the scan into that many reads.

    search_path, a schema's name, is set for every session of the database that reads.
    """
    if search_path is not None:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", search_path):
            raise ValueError(f"no schema name: {search_path}")
        options = {"sessionInitStatement": f'SET search_path TO "{search_path}"'} | options
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"{schema}.{table}" if schema else table).option("loginTimeout", "5").options(**options)
    if partition:
        column, low, high, parts = partition
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def declared_keys(spark: SparkSession, url: str, schema: str | None = None) -> dict[str, Keys]:
    """Tables with their primary and foreign keys, those of several columns too, by the driver's metadata."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        meta = connection.getMetaData()
        names = []
        found = meta.getTables(None, schema, "%", None)
        while found.next():
            if found.getString("TABLE_TYPE") == "TABLE" and not is_partition_child(found.getString("TABLE_NAME")):
                names.append(found.getString("TABLE_NAME"))
        out = {}
        for name in names:
            primary, foreign = [], []
            keys = meta.getPrimaryKeys(None, schema, name)
            while keys.next():
                primary.append((keys.getInt("KEY_SEQ"), keys.getString("COLUMN_NAME")))
            links = meta.getImportedKeys(None, schema, name)
            while links.next():
                # Rows come by referenced table and place in the key, so two keys to one table come mixed; the name tells them apart.
                foreign.append((links.getString("PKTABLE_NAME"), links.getString("FK_NAME") or "", links.getInt("KEY_SEQ"), links.getString("FKCOLUMN_NAME"), links.getString("PKCOLUMN_NAME")))
            held: dict[tuple, list] = {}
            for target, key, _, column, referenced in sorted(foreign):
                held.setdefault((target, key), []).append((column, referenced))
            single = {own[0][0]: (target, own[0][1]) for (target, _), own in held.items() if len(own) == 1}
            several = [Link(tuple(a for a, _ in own), target, tuple(b for _, b in own)) for (target, _), own in held.items() if len(own) > 1]
            out[name] = Keys(tuple(c for _, c in sorted(primary)), single, tuple(several))
        return out
    finally:
        connection.close()


def schemas(spark: SparkSession, url: str, hidden: tuple[str, ...] = ()) -> list[str]:
    """The database's schemas but for those of its system and the hidden ones."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found, out = connection.getMetaData().getSchemas(), []
        while found.next():
            out.append(found.getString("TABLE_SCHEM"))
        return sorted(n for n in out if n not in hidden and not n.lower().startswith(("pg_", "sys", "information_schema", "nullid", "sqlj")))
    finally:
        connection.close()


def indexes(spark: SparkSession, url: str, table: str, schema: str | None = None) -> dict[str, tuple[bool, tuple[str, ...]]]:
    """A table's indexes by name: whether each is unique, and its columns in their order."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found, out = connection.getMetaData().getIndexInfo(None, schema, table, False, True), {}
        while found.next():
            if name := found.getString("INDEX_NAME"):
                out.setdefault(name, (not found.getBoolean("NON_UNIQUE"), []))[1].append((found.getInt("ORDINAL_POSITION"), found.getString("COLUMN_NAME")))
        return {name: (unique, tuple(c for _, c in sorted(columns))) for name, (unique, columns) in out.items()}
    finally:
        connection.close()


def constraints(spark: SparkSession, url: str, table: str, schema: str | None = None) -> list[tuple[str, str, tuple[str, ...], str | None, tuple[str, ...]]]:
    """A table's constraints: (kind, name, columns, referenced table, its columns) of its primary key, its foreign keys and its unique columns, in order of name within a kind."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        meta, keys, links = connection.getMetaData(), {}, {}
        found = meta.getPrimaryKeys(None, schema, table)
        while found.next():
            keys.setdefault(found.getString("PK_NAME") or "", []).append((found.getInt("KEY_SEQ"), found.getString("COLUMN_NAME")))
        found = meta.getImportedKeys(None, schema, table)
        while found.next():
            links.setdefault((found.getString("FK_NAME") or "", found.getString("PKTABLE_NAME")), []).append((found.getInt("KEY_SEQ"), found.getString("FKCOLUMN_NAME"), found.getString("PKCOLUMN_NAME")))
    finally:
        connection.close()
    primary = [("primary key", name, tuple(c for _, c in sorted(own)), None, ()) for name, own in sorted(keys.items())]
    foreign = [("foreign key", name, tuple(c for _, c, _ in sorted(own)), target, tuple(d for *_, d in sorted(own))) for (name, target), own in sorted(links.items())]
    # A foreign key is backed by an index of its own columns, a unique one only if the columns are unique too.
    unique = [("unique", name, columns, None, ()) for name, (only, columns) in sorted(indexes(spark, url, table, schema).items()) if only and columns not in {p[2] for p in primary}]
    return primary + foreign + unique
