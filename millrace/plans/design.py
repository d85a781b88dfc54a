"""Warehouse design: which tables are facts, which dimensions, and what they hold."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from ..functions.names import base_type
from .catalog import Table

# Words and types by which columns are told apart.
MEASURE_WORDS = (
    "amount", "price", "cost", "revenue", "sales", "quantity", "qty", "total", "sum", "value", "balance", "fee", "rate", "salary", "income",
    "expense", "profit", "loss", "discount", "tax", "weight", "volume", "count", "number", "score", "rating",
)
DATE_WORDS = (
    "date", "time", "at", "on", "created", "updated", "modified", "timestamp", "datetime", "day", "month", "year", "period",
)
DESCRIPTIVE_WORDS = (
    "name", "description", "type", "status", "category", "code", "label", "title", "address", "city", "country", "region", "email", "phone", "gender",
    "flag", "indicator",
)
NUMERIC = {"integer", "bigint", "smallint", "int", "int4", "int8", "numeric", "decimal", "real", "double precision", "float"}
DATES = {"timestamp", "date", "time", "timestamptz", "timestamp with time zone", "timestamp without time zone"}
TEXTS = {"varchar", "text", "char", "character varying", "string"}
FACT_SCORE = 50


def _has(name: str, words) -> bool:
    return any(w in name.lower() for w in words)


def is_measure(c) -> bool:
    return base_type(c.type) in NUMERIC and not c.primary and not c.linked and _has(c.name, MEASURE_WORDS)


def is_date(c) -> bool:
    """By type, or by a word in the name ("on" and "at" too, wherever they stand)."""
    return base_type(c.type) in DATES or _has(c.name, DATE_WORDS)


def is_descriptive(c) -> bool:
    return base_type(c.type) in TEXTS or _has(c.name, DESCRIPTIVE_WORDS)


def _ranked(tables: list[Table], share: float) -> int | None:
    rows = sorted(t.rows for t in tables if t.rows > 0)
    return rows[int(len(rows) * share)] if rows else None


def fact_score(table: Table, tables: list[Table]) -> float:
    """0 to 100 points for many rows, foreign keys, measures and a date."""
    many = _ranked(tables, 0.75)
    links = len(table.links)
    measures = sum(map(is_measure, table.columns))
    points = 30 * (many is not None and table.rows >= many)
    points += 30 if links >= 3 else {2: 20, 1: 5}.get(links, 0)
    points += 25 if measures >= 2 else 15 * measures
    points += 15 * any(map(is_date, table.columns))
    return float(min(points, 100))


@dataclass(frozen=True)
class Part:
    source: str
    name: str
    kind: str  # fact or dimension
    score: float
    rows: int
    key: tuple[str, ...]
    measures: tuple[str, ...]
    attributes: tuple[str, ...]
    links: tuple[tuple, ...]  # column, warehouse table, its column; of a composite key all columns as tuples
    reasons: tuple[str, ...]


@dataclass(frozen=True)
class Design:
    kind: str  # star or snowflake
    facts: tuple[Part, ...]
    dimensions: tuple[Part, ...]

    @property
    def parts(self) -> tuple[Part, ...]:
        return self.dimensions + self.facts


def aggregations(column: str) -> list[str]:
    counted = _has(column, ("quantity", "qty", "count", "number"))
    return ["AVG", "MAX", "MIN"] if not counted and _has(column, ("rate", "ratio", "percentage", "score")) else ["SUM", "AVG", "MAX", "MIN"]


def reasons(table: Table, tables: list[Table], fact: bool) -> tuple[str, ...]:
    out = []
    many, middle = _ranked(tables, 0.75), _ranked(tables, 0.5)
    links = len(table.links)
    measures = [c.name for c in table.columns if is_measure(c)]
    if fact:
        dates = [c.name for c in table.columns if is_date(c)]
        out += [f"many rows ({table.rows})"] * (many is not None and table.rows >= many)
        out += [f"{links} foreign keys"] * (links >= 2)
        out += ["measures: " + ", ".join(measures[:3])] * bool(measures)
        out += [f"date column {dates[0]}" for _ in dates[:1]]
    else:
        told = [c.name for c in table.columns if is_descriptive(c)]
        out += [f"few rows ({table.rows})"] * (middle is not None and table.rows <= middle)
        out += ["descriptive columns: " + ", ".join(told[:3])] * bool(told)
        out += ["no measures"] * (not measures)
    return tuple(out)


def design(tables: list[Table], overrides: Mapping[str, str] | None = None) -> Design:
    """Tables of FACT_SCORE points or more are facts (the best one if none is), others dimensions; overrides decide for themselves."""
    score = {t.name: fact_score(t, tables) for t in tables}
    order = sorted(tables, key=lambda t: -score[t.name])
    kind = {t.name: "fact" if score[t.name] >= FACT_SCORE else "dimension" for t in order}
    if order and "fact" not in kind.values():
        kind[order[0].name] = "fact"
    kind |= {n: k for n, k in (overrides or {}).items() if n in kind and k in ("fact", "dimension")}
    named = {n: ("fact_" if k == "fact" else "dim_") + n for n, k in kind.items()}

    def part(t: Table) -> Part:
        measures = tuple(c.name for c in t.columns if is_measure(c))
        attributes = tuple(c.name for c in t.columns if not c.primary and not c.linked and not is_measure(c))
        links = tuple((k.columns, named[k.table], k.targets) if len(k.columns) > 1 else (k.columns[0], named[k.table], k.targets[0]) for k in t.links if k.table in named)
        return Part(t.name, named[t.name], kind[t.name], score[t.name], t.rows, tuple(t.primary_key), measures, attributes, links, reasons(t, tables, kind[t.name] == "fact"))

    parts = [part(t) for t in order]
    facts = tuple(p for p in parts if p.kind == "fact")
    dims = tuple(p for p in parts if p.kind == "dimension")
    linked = {p.name for p in dims}
    snow = any(target in linked for p in dims for _, target, _ in p.links)
    return Design("snowflake" if snow else "star", facts, dims)


def reclassified(tables: list[Table], overrides: Mapping[str, str], table: str, kind: str) -> tuple[Design, dict[str, str]]:
    """The design after a person calls a table fact or dimension, and all such decisions so far. It is a new design, so it waits for approval again."""
    if kind not in ("fact", "dimension"):
        raise ValueError("a table is a fact or a dimension")
    if table not in {t.name for t in tables}:
        raise ValueError(f"no table {table}")
    told = {**overrides, table: kind}
    return design(tables, told), told


#: What a dialect calls the types of the catalogue where it does not know them by that name.
DIALECTS = {"spark": {"varchar": "string", "double precision": "double"}, "postgres": {}, "duckdb": {"double precision": "double"}}


def tables_script(d: Design, tables: list[Table], schema: str, source: str, dialect: str) -> str:
    """CREATE TABLE AS statements from the tables of source, dimensions first, with audit columns, in one of DIALECTS."""
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {', '.join(DIALECTS)}")
    by, quote = {t.name: t for t in tables}, "`" if dialect == "spark" else '"'
    q = lambda *names: ".".join(f"{quote}{n}{quote}" for n in names)
    now = "current_timestamp()" if dialect == "spark" else "CURRENT_TIMESTAMP"
    out = [f"-- {d.kind} schema", f"CREATE SCHEMA IF NOT EXISTS {q(schema)};"]
    for p in d.parts:
        columns = [q(c.name) for c in by[p.source].columns] + [f"{now} AS dw_created_at"] + [f"{now} AS dw_updated_at"] * (p.kind == "dimension")
        out += [f"DROP TABLE IF EXISTS {q(schema, p.name)};", f"CREATE TABLE {q(schema, p.name)} AS\nSELECT {', '.join(columns)}\nFROM {q(source, p.source)};"]
    return "\n".join(out)


def keys_script(d: Design, tables: list[Table], schema: str, dialect: str) -> str:
    """What keeps keys and finds rows in a database: primary keys (duckdb: unique indexes of dimensions), indexes of facts' foreign keys and, for postgres, of a fact's first date.

    Spark has neither; see warehouse.materialise() for what stands in their place.
    """
    if dialect not in ("postgres", "duckdb"):
        raise ValueError("only postgres and duckdb have keys and indexes")
    by, out = {t.name: t for t in tables}, []
    q = lambda *names: ".".join(f'"{n}"' for n in names)

    def index(p: Part, columns: tuple[str, ...], unique: str = "", suffix: str = "") -> str:
        return f"CREATE {unique}INDEX {q('_'.join(['idx', p.name, suffix or '_'.join(columns)]))} ON {q(schema, p.name)} ({', '.join(map(q, columns))});"

    for p in d.parts:
        if p.key and dialect == "postgres":
            out.append(f"ALTER TABLE {q(schema, p.name)} ADD PRIMARY KEY ({', '.join(map(q, p.key))});")
        elif p.key and p.kind == "dimension":
            out.append(index(p, p.key, "UNIQUE ", "pk"))
        if p.kind == "fact":
            out += [index(p, k.columns) for k in by[p.source].links]
            dates = [c.name for c in by[p.source].columns if is_date(c) and not c.primary]
            out += [index(p, (c,)) for c in dates[: dialect == "postgres"]]
    return "\n".join(out)


def create_script(d: Design, tables: list[Table], database: str) -> str:
    """CREATE TABLE AS statements for Spark SQL, dimensions first."""
    by = {t.name: t for t in tables}
    out = [f"-- {d.kind} schema\nCREATE DATABASE IF NOT EXISTS {database};"]
    for p in d.parts:
        cols = [f"`{c.name}`" for c in by[p.source].columns] + ["current_timestamp() AS dw_created_at"] + ["current_timestamp() AS dw_updated_at"] * (p.kind == "dimension")
        out.append(f"CREATE TABLE {database}.{p.name} USING parquet AS SELECT {', '.join(cols)} FROM {p.source};")
    return "\n\n".join(out)
