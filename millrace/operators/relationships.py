"""Inferred foreign keys: names, overlap of values and cardinality, all values in one job."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import compatible, entity, expanded, indel_ratio, is_key_like, singular, tables_for
from ..plans.catalog import Table

# Weights of name and overlap, tiers, and from where a high cardinality costs points.
NAME_WEIGHT, OVERLAP_WEIGHT = 0.55, 0.45
HIGH, MEDIUM = 75, 50


@dataclass(frozen=True)
class Candidate:
    table: str
    column: str
    target: str
    target_column: str
    name_score: float
    targeted: bool


def name_score(column: str, table: str, key: str) -> float:
    one = singular(table.lower())
    patterns = [f"{form}_{key.lower()}" for form in (table.lower(), one, expanded(one), expanded(table))]
    return max(indel_ratio(form, p) for p in patterns for form in (column.lower(), expanded(column)))


def candidates(tables: list[Table], declared: set[tuple[str, str, str, str]] = frozenset()) -> list[Candidate]:
    """Key-like columns against primary keys of compatible types: of the tables their name means, else of all."""
    keys = {t.name: t.primary_key for t in tables if t.primary_key}
    by = {t.name: t for t in tables}
    out = []
    for t in tables:
        others = [n for n in keys if n != t.name]
        for c in t.columns:
            if c.primary or not is_key_like(c.name):
                continue
            token = entity(c.name)
            meant = tables_for(token, others) if token else []
            for target in meant or others:
                for key in keys[target]:
                    if (t.name, c.name, target, key) not in declared and compatible(c.type, by[target].column(key).type):
                        out.append(Candidate(t.name, c.name, target, key, name_score(c.name, target, key), bool(meant)))
    return out


def key_text(df: DataFrame, name: str) -> Column:
    """A column's values as text under which equal numbers of all numeric types are the same: 1, 1.0 and 1.00 are 1."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType):
        text = col.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        size = F.abs(col)
        plain = F.when(col == F.floor(col), col.cast("decimal(38,0)").cast("string")).otherwise(col.cast("decimal(38,18)").cast("string"))
        text = F.when((size < 1e18) & ((size > 1e-12) | (size == 0)), plain).when(~F.isnan(col), col.cast("string"))
    else:
        return col.cast("string")
    return F.when(text.contains(".") & ~text.contains("E"), F.regexp_replace(text, "[.]?0+$", "")).otherwise(text)


def evidence(frames: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """from_table, from_column, to_table, to_column, overlap and cardinality of each pair of columns.

    overlap is the share of the distinct values that the target has, cardinality distinct over non-null
    values (1 without values). All columns become rows (table, column, value) that are counted once;
    values then meet their targets by a join on the value, so no column is collected. Numbers of
    whatever type meet where they are equal (key_text()).
    """
    spark = next(iter(frames.values())).sparkSession

    def distinct_values(own: set[tuple[str, str]]) -> DataFrame:
        def one(table: str) -> DataFrame:
            cells = F.array(*[F.struct(F.lit(c).alias("c"), key_text(frames[table], c).alias("v")) for t, c in sorted(own) if t == table])
            return frames[table].select(F.explode(cells).alias("x")).where("x.v IS NOT NULL").groupBy("x.c", "x.v").agg(F.count("*").alias("n")).select(F.lit(table).alias("t"), "c", "v", "n")

        return reduce(DataFrame.unionByName, [one(t) for t in sorted({t for t, _ in own})])

    asked = spark.createDataFrame(pairs, "from_table string, from_column string, to_table string, to_column string")
    left = distinct_values({(a, b) for a, b, _, _ in pairs}).alias("l")
    right = distinct_values({(c, d) for _, _, c, d in pairs}).select(F.col("t").alias("rt"), F.col("c").alias("rc"), F.col("v").alias("rv"))
    sizes = left.groupBy(F.col("t").alias("st"), F.col("c").alias("sc")).agg(F.count("*").alias("distinct"), F.sum("n").alias("total"))
    probe = left.join(F.broadcast(asked), (F.col("t") == F.col("from_table")) & (F.col("c") == F.col("from_column")))
    met = probe.join(right, (F.col("to_table") == F.col("rt")) & (F.col("to_column") == F.col("rc")) & (F.col("v") == F.col("rv")), "left_semi")
    hits = met.groupBy("from_table", "from_column", "to_table", "to_column").agg(F.count("*").alias("hits"))
    named = ["from_table", "from_column", "to_table", "to_column"]
    out = asked.join(hits, named, "left").join(sizes, (F.col("from_table") == F.col("st")) & (F.col("from_column") == F.col("sc")), "left")
    return out.select(
        *named,
        F.round(F.coalesce(F.coalesce("hits", F.lit(0)) / F.nullif("distinct", F.lit(0)), F.lit(0.0)), 6).alias("overlap"),
        F.round(F.coalesce(F.col("distinct") / F.nullif("total", F.lit(0)), F.lit(1.0)), 6).alias("cardinality"),
    )


def confidence(name: float, overlap: float, cardinality: float) -> int:
    """0 to 100: the weighted scores, less for nearly unique columns."""
    if name < 0.3 and overlap < 0.6:
        return 0
    base = round((NAME_WEIGHT * name + OVERLAP_WEIGHT * overlap) * 100)
    if cardinality <= 0.5:
        return base
    if cardinality <= 0.7:
        return base - int((cardinality - 0.5) * 50)
    if cardinality <= 0.85:
        return base - 10 - int((cardinality - 0.7) * 66)
    return max(0, base - 20 - int((cardinality - 0.85) * 66))


def tier(points: int) -> str:
    return "high" if points >= HIGH else "medium" if points >= MEDIUM else "low"


def infer(spark: SparkSession, tables: list[Table], frames: dict[str, DataFrame]) -> DataFrame:
    """Relationships of at least medium confidence, the surest first, with scores, tier and status.

    High ones are accepted, medium ones wait for a decision. Declared keys are not inferred again.
    """
    schema = "from_table string, from_column string, to_table string, to_column string, name_score int, overlap_score int, confidence int, tier string, status string, targeted boolean"
    declared = {(t.name, c.name, c.foreign.table, c.foreign.column) for t in tables for c in t.columns if c.foreign}
    found = candidates(tables, declared)
    if not found:
        return spark.createDataFrame([], schema)
    seen = {tuple(r)[:4]: (r["overlap"], r["cardinality"]) for r in evidence(frames, [(c.table, c.column, c.target, c.target_column) for c in found]).collect()}
    rows = []
    for c in found:
        overlap, cardinality = seen[c.table, c.column, c.target, c.target_column]
        points = confidence(c.name_score, overlap, cardinality)
        if points >= MEDIUM:
            status = "auto_accepted" if tier(points) == "high" else "pending"
            rows.append((c.table, c.column, c.target, c.target_column, round(c.name_score * 100), round(overlap * 100), points, tier(points), status, c.targeted))
    rows.sort(key=lambda r: -r[6])
    return spark.createDataFrame(rows, schema)


def decide(links: DataFrame, decisions: DataFrame | None = None, accept_from: int | None = None) -> DataFrame:
    """links with their status after decisions (from_table, from_column, to_table, to_column, status), the last word.

    accept_from accepts all that are at least so sure and still wait for a decision.
    """
    on = ["from_table", "from_column", "to_table", "to_column"]
    status = F.col("status")
    if accept_from is not None:
        status = F.when((status == "pending") & (F.col("confidence") >= accept_from), "accepted").otherwise(status)
    out = links.withColumn("status", status)
    if decisions is None:
        return out
    told = decisions.select(*on, F.col("status").alias("decided"))
    return out.join(F.broadcast(told), on, "left").withColumn("status", F.coalesce("decided", "status")).drop("decided").select(*links.columns)


def listed(links: DataFrame, status: str | None = None, by: str = "confidence") -> DataFrame:
    """The relationships of one status (all without one), the surest first or by name."""
    named = [F.col(c) for c in ("from_table", "from_column", "to_table", "to_column")]
    return (links.where(F.col("status") == status) if status else links).orderBy(*([F.desc("confidence")] if by == "confidence" else []), *named)


def signals(row: dict) -> dict[str, bool | int]:
    """What speaks for a relationship: flags, and the raw scores that they come from."""
    return {
        "name_match": row["name_score"] >= 60,
        "value_overlap": row["overlap_score"] >= 60,
        "targeted": row["targeted"],
        **{k: row[k] for k in ("name_score", "overlap_score", "confidence")},
    }


def explanation(row: dict) -> list[str]:
    """Why a relationship was inferred, in words."""
    out = [f"{row['from_column']} names {row['to_table']}" if row["targeted"] else f"{row['from_column']} was compared with all keys"]
    out.append(f"its name is {row['name_score']}% like a key of {row['to_table']}")
    out.append(f"{row['overlap_score']}% of its values are in {row['to_table']}.{row['to_column']}")
    return out
