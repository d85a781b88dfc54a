"""Names of tables and columns: types, words, similarity and keyword scores.

Metadata is tens of rows, so this is plain Python on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Suffixes and abbreviations by which foreign keys are recognised.
KEY_SUFFIXES = ("_id", "_key", "_fk", "_ref", "_code", "_no", "_num", "_number")
ABBREVIATIONS = {
    "cust": "customer",
    "emp": "employee",
    "dept": "department",
    "prod": "product",
    "ord": "order",
    "addr": "address",
    "mgr": "manager",
    "acct": "account",
    "usr": "user",
    "cat": "category",
    "loc": "location",
    "org": "organization",
    "proj": "project",
    "trans": "transaction",
    "inv": "invoice",
    "vend": "vendor",
    "supp": "supplier",
    "branch": "branch",
    "item": "item",
}
# The two families of types that may be joined with each other.
NUMERIC = {"integer", "bigint", "smallint", "int", "int4", "int8", "numeric", "decimal", "real", "double precision"}
TEXTUAL = {"varchar", "text", "char", "character varying", "string"}

_TYPE_NAMES = {
    T.ByteType: "smallint",
    T.ShortType: "smallint",
    T.IntegerType: "integer",
    T.LongType: "bigint",
    T.FloatType: "real",
    T.DoubleType: "double precision",
    T.StringType: "varchar",
    T.BooleanType: "boolean",
    T.DateType: "date",
    T.TimestampType: "timestamp",
    T.TimestampNTZType: "timestamp",
    T.BinaryType: "bytea",
}


def type_name(kind: T.DataType) -> str:
    """The name under which a Spark type takes part in the metadata rules."""
    if isinstance(kind, T.DecimalType):
        return f"numeric({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"{type_name(kind.elementType)}[]"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "json"
    return next((name for cls, name in _TYPE_NAMES.items() if isinstance(kind, cls)), kind.simpleString())


def base_type(name: str | None) -> str:
    return (name or "").lower().partition("(")[0].strip()


def compatible(a: str, b: str) -> bool:
    x, y = base_type(a), base_type(b)
    return x == y or any(x in family and y in family for family in (NUMERIC, TEXTUAL))


def singular(word: str) -> str:
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith(("ses", "xes", "zes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def expanded(name: str) -> str:
    return "_".join(ABBREVIATIONS.get(part, part) for part in name.lower().replace("-", "_").split("_"))


def snake(name: str) -> str:
    """CamelCase to snake case, one underscore before each capital but the first letter."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def is_key_like(column: str) -> bool:
    return any(form.endswith(s) and form != s for form in (column.lower(), expanded(column), snake(column)) for s in KEY_SUFFIXES)


def entity(column: str) -> str | None:
    """What a key-like column refers to: customer_id and CustomerId give customer."""
    ending = "|".join(map(re.escape, KEY_SUFFIXES))
    found = (re.fullmatch(f"(.+?)(?:{ending})", form) for form in (snake(column), column.lower()))
    meant = next((m[1] for m in found if m), "")
    return meant.rstrip("_") or None


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def tables_for(token: str, tables: list[str], least: float = 0.75) -> list[str]:
    """Tables whose names say what the token says, the most alike first (equal ones in the given order)."""
    wide = expanded(token)
    wanted = {singular(token.lower()), wide, singular(wide)}
    scored = []
    for table in tables:
        grown = expanded(table)
        forms = {table.lower(), singular(table.lower()), grown, singular(grown)}
        score = 1.0 if wanted & forms else max(indel_ratio(a, b) for a in wanted for b in forms)
        if score >= least:
            scored.append((score, table))
    return [t for _, t in sorted(scored, key=lambda x: -x[0])]


def keyword_score(name: str | None, keywords: list[str] | tuple[str, ...]) -> int:
    """100 for the keyword itself, 85 at either end behind an underscore, 70 inside; the first keyword that matches decides."""
    low = (name or "").lower()
    first = next((k for k in keywords if low and k in low), None)
    if first is None:
        return 0
    return 100 if low == first else 85 if f"_{low}_".startswith(f"_{first}_") or f"_{low}_".endswith(f"_{first}_") else 70


def table_score(name: str | None, keywords: list[str] | tuple[str, ...]) -> int:
    low = (name or "").lower()
    return next((100 if low == k else 70 for k in keywords if k in low), 0) if low else 0


def is_partition_child(table: str | None) -> bool:
    """Whether a name ends like one month of a partitioned table, as in payment_p2022_03."""
    return bool(re.search(r"_p\d{4}_\d{2}$", table or ""))


def title(name: str) -> str:
    return name.replace("_", " ").title()
