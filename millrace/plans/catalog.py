"""The catalogue: tables, columns and keys of a project, as small frozen objects."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import type_name


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str


@dataclass(frozen=True)
class Link:
    """A foreign key of one or more columns."""

    columns: tuple[str, ...]
    table: str
    targets: tuple[str, ...]


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False
    foreign: ForeignKey | None = None
    in_link: bool = False  # whether a foreign key of several columns has it

    @property
    def linked(self) -> bool:
        return self.foreign is not None or self.in_link


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    rows: int = 0
    composite: tuple[Link, ...] = ()  # foreign keys of several columns

    @property
    def links(self) -> tuple[Link, ...]:
        """All foreign keys: those of one column in the columns' order, then those of several."""
        return (*[Link((c.name,), c.foreign.table, (c.foreign.column,)) for c in self.columns if c.foreign], *self.composite)

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary]

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class Keys:
    """Declared keys of one table, for formats that have none of their own."""

    primary: tuple[str, ...] = ()
    foreign: Mapping[str, tuple[str, str]] = ()  # column -> (table, column)
    composite: tuple[Link, ...] = ()


#: Keys of the benchmark tables.
BENCH_KEYS = {
    "region": Keys(("r_regionkey",)),
    "nation": Keys(("n_nationkey",), {"n_regionkey": ("region", "r_regionkey")}),
    "customer": Keys(("c_custkey",), {"c_nationkey": ("nation", "n_nationkey")}),
    "supplier": Keys(("s_suppkey",), {"s_nationkey": ("nation", "n_nationkey")}),
    "part": Keys(("p_partkey",)),
    "orders": Keys(("o_orderkey",), {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": Keys((), {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    "events": Keys(("event_id",)),
}


def describe(name: str, df: DataFrame, keys: Keys = Keys(), rows: int = 0) -> Table:
    foreign, held = dict(keys.foreign), {c for link in keys.composite for c in link.columns}
    columns = tuple(
        Column(f.name, type_name(f.dataType), f.nullable, f.name in keys.primary, ForeignKey(*foreign[f.name]) if f.name in foreign else None, f.name in held) for f in df.schema.fields
    )
    return Table(name, columns, rows, tuple(keys.composite))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and row_count of all tables, counted in one job."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def discover(tables: Mapping[str, DataFrame], keys: Mapping[str, Keys] = BENCH_KEYS) -> list[Table]:
    """Catalogue entries of all tables, with exact row counts."""
    rows = {r["table_name"]: r["row_count"] for r in row_counts(tables).collect()} if tables else {}
    return [describe(name, df, keys.get(name, Keys()), rows[name]) for name, df in tables.items()]


def recounted(tables: Iterable[Table], frames: Mapping[str, DataFrame]) -> list[Table]:
    """The catalogue with the columns and row counts that the tables have now, keys as they were; the catalogue of cleaned tables."""
    rows = {r["table_name"]: r["row_count"] for r in row_counts(frames).collect()} if frames else {}
    kinds = {n: {f.name: type_name(f.dataType) for f in df.schema.fields} for n, df in frames.items()}
    return [replace(t, rows=rows.get(t.name, t.rows), columns=tuple(replace(c, type=kinds.get(t.name, {}).get(c.name, c.type)) for c in t.columns)) for t in tables]


def accepted(tables: Iterable[Table], links: Iterable[tuple[str, str, str, str]]) -> list[Table]:
    """The catalogue with accepted relationships (table, column, target, column) as foreign keys too."""
    by = {(a, b): ForeignKey(c, d) for a, b, c, d in links}
    return [replace(t, columns=tuple(replace(c, foreign=c.foreign or by.get((t.name, c.name))) for c in t.columns)) for t in tables]


COLUMN_SCHEMA = "table_name string, row_count long, position int, column_name string, type string, nullable boolean, is_primary_key boolean, references_table string, references_column string, composite array<struct<number:int,place:int,table:string,column:string>>"


def as_frame(spark: SparkSession, tables: Iterable[Table]) -> DataFrame:
    """The catalogue as rows, one a column; also the form in which snapshots are kept."""
    rows = [
        (t.name, t.rows, k, c.name, c.type, c.nullable, c.primary, c.foreign and c.foreign.table, c.foreign and c.foreign.column, _places(t, c.name))
        for t in tables
        for k, c in enumerate(t.columns)
    ]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def _places(table: Table, column: str) -> list[tuple[int, int, str, str]]:
    """Where a column stands in the table's composite foreign keys, and what it refers to there."""
    return [(n, k, link.table, link.targets[k]) for n, link in enumerate(table.composite) for k, c in enumerate(link.columns) if c == column]


def _composite(rows: list) -> tuple[Link, ...]:
    found: dict[int, list] = {}
    for r in rows:
        for x in r["composite"] or ():
            found.setdefault(x["number"], []).append((x["place"], r["column_name"], x["table"], x["column"]))
    return tuple(Link(tuple(c for _, c, _, _ in own), own[0][2], tuple(d for *_, d in own)) for _, own in sorted((n, sorted(x)) for n, x in found.items()))


def from_frame(frame: DataFrame) -> list[Table]:
    found: dict[str, list] = {}
    for r in frame.orderBy("table_name", "position").collect():
        found.setdefault(r["table_name"], []).append(r)
    return [
        Table(
            name,
            tuple(Column(r["column_name"], r["type"], r["nullable"], r["is_primary_key"], ForeignKey(r["references_table"], r["references_column"]) if r["references_table"] else None, bool(r["composite"])) for r in rows),
            rows[0]["row_count"],
            _composite(rows),
        )
        for name, rows in found.items()
    ]


def overview(columns: DataFrame) -> DataFrame:
    """Totals of a catalogue frame."""
    tables = columns.groupBy("table_name").agg(F.first("row_count").alias("rows"), F.count("*").alias("columns"), (F.count("references_table") + F.sum(F.size(F.filter(F.coalesce("composite", F.array()), lambda x: x["place"] == 0)))).alias("links"))
    return tables.agg(
        F.count("*").alias("table_count"), F.sum("columns").alias("column_count"), F.sum("rows").alias("row_count"), F.sum("links").alias("foreign_key_count")
    )


def search(columns: DataFrame, text: str) -> DataFrame:
    """Catalogue rows whose table or column name contains text, whatever its case."""
    wanted = F.lit(text.lower())
    return columns.where(F.contains(F.lower("table_name"), wanted) | F.contains(F.lower("column_name"), wanted))


def create_statement(table: Table) -> str:
    lines = [f"    {c.name} {c.type}" + ("" if c.nullable else " NOT NULL") for c in table.columns]
    if table.primary_key:
        lines.append(f"    PRIMARY KEY ({', '.join(table.primary_key)})")
    lines += [f"    FOREIGN KEY ({', '.join(k.columns)}) REFERENCES {k.table} ({', '.join(k.targets)})" for k in table.links]
    return f"CREATE TABLE {table.name} (\n" + ",\n".join(lines) + "\n);"


def prompt_context(tables: Iterable[Table], most: int = 25) -> str:
    """One line a table, the first tables by name."""
    return "\n".join(f"{t.name}({', '.join(f'{c.name} {c.type}' for c in t.columns)})" for t in sorted(tables, key=lambda t: t.name)[:most])
