"""A project as a whole: where it stands, what a table is, its report, and one run through all stages."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.formats import kpi_text
from ..operators import cleaning, profile, quality, relationships, state, warehouse
from ..sources import files
from . import catalog, charts, kpi_match
from .design import Design, design

# The stages in their order, and from which score on quality is called what.
STAGES = ("data_source", "metadata", "relationships", "data_quality", "cleaning", "warehouse", "kpis", "sql_workspace", "dashboard", "insights")
QUALITY_LABELS = ((80, "Good"), (50, "Needs Review"), (0, "Critical"))


@dataclass(frozen=True)
class Project:
    """What is known of a project so far; statuses of items that wait for a person are pending."""

    name: str
    domain: str = "retail"
    connected: bool = False
    tables: tuple[catalog.Table, ...] = ()
    links: tuple[str, ...] = ()  # statuses
    score: int | None = None
    steps: tuple[str, ...] = ()  # statuses
    designed: bool = False
    approved: bool = False
    kpis: tuple[kpi_match.Match, ...] = ()
    queries: int = 0
    widgets: int = 0
    made: tuple[tuple[str, str], ...] = ()  # warehouse tables and how writing them went
    checks: tuple[tuple, ...] = ()  # check, table, detail, value, status
    applied: tuple[cleaning.Step, ...] = ()
    events: tuple[tuple[str, str], ...] = field(default=())  # (time, what happened)


def stage_status(p: Project) -> dict[str, str]:
    """completed, requires_review or pending for each stage; insights are not part of this library and stay pending."""

    def reviewed(items: tuple, waits) -> str:
        return "pending" if not items else "requires_review" if any(map(waits, items)) else "completed"

    def done(yes: object) -> str:
        return "completed" if yes else "pending"

    found = {
        "data_source": done(p.connected),
        "metadata": done(p.tables),
        "relationships": reviewed(p.links, lambda s: s == "pending"),
        "data_quality": done(p.score is not None),
        "cleaning": reviewed(p.steps, lambda s: s == "pending"),
        "warehouse": "pending" if not p.designed else "completed" if p.approved else "requires_review",
        "kpis": reviewed(p.kpis, lambda m: m.status != "approved"),
        "sql_workspace": done(p.queries),
        "dashboard": done(p.widgets),
    }
    return {s: found.get(s, "pending") for s in STAGES}


def quality_label(score: int) -> str:
    return next(label for least, label in QUALITY_LABELS if score >= least)


def overview(p: Project, shown: int = 8) -> dict:
    """Stages, progress in per cent, the stage to go on with, the project's status, tables and what happened last."""
    stages = stage_status(p)
    current = next((s for s in STAGES if stages[s] != "completed"), None)
    if not p.connected:
        status = "setup_incomplete"
    elif "requires_review" in stages.values():
        status = "needs_review"
    else:
        status = "active" if current else "completed"
    return {
        "status": status,
        "stages": stages,
        "current": current,
        "progress": round(100 * sum(s == "completed" for s in stages.values()) / len(STAGES)),
        "table_count": len(p.tables),
        "row_count": sum(t.rows for t in p.tables) if p.tables else None,
        "tables": [(t.name, t.rows, len(t.columns)) for t in sorted(p.tables, key=lambda t: t.name)[:shown]],
        "quality": None if p.score is None else (p.score, quality_label(p.score)),
        "activity": sorted(p.events, reverse=True),
    }


def report(p: Project) -> dict:
    """The report of a project: its score and the approved KPIs, and the same as text sections."""
    kept = [m for m in p.kpis if m.status == "approved"]
    lines = [{"name": m.kpi.name, "value": m.value, "formatted_value": kpi_text(m.value, m.kpi.unit), "unit": m.kpi.unit, "category": m.kpi.category} for m in kept]
    head = f"Project: {p.name}\nDomain: {p.domain.title()}\nData Quality Score: {p.score or 'Not assessed'}/100\nKPIs Analysed: {len(kept)}"
    return {
        "project_name": p.name,
        "domain": p.domain,
        "quality_score": p.score,
        "total_kpis": len(kept),
        "kpi_summary": lines,
        "sections": [("Project Overview", head), ("Key Performance Indicators", "\n".join(f"{k['name']}: {k['formatted_value']}" for k in lines))],
    }


def table_detail(spark: SparkSession, table: catalog.Table, df: DataFrame, stored: str | None = None) -> dict:
    """Columns, keys, sample rows and the create statement of a table; sizes too of one that the catalogue stores."""
    from ..sources.stored import statistics

    return {
        "table_name": table.name,
        "row_count": table.rows,
        "columns": [(c.name, c.type, c.nullable, c.primary, c.foreign and (c.foreign.table, c.foreign.column)) for c in table.columns],
        "sample_rows": files.sample_rows(df),
        "statistics": statistics(spark, stored) if stored else None,
        "ddl": catalog.create_statement(table),
    }


def warehouse_preview(frames: Mapping[str, DataFrame], tables: list[catalog.Table], d: Design, database: str = "warehouse") -> dict:
    """What building a design would do: its script, the checks on its sources, and the worst of their statuses."""
    from .design import create_script

    checks = [r.asDict() for r in warehouse.validate(dict(frames), d).collect()]
    found = {c["status"] for c in checks}
    return {"script": create_script(d, tables, database), "checks": checks, "status": next((s for s in ("error", "warning") if s in found), "passed")}


def run_all(spark: SparkSession, name: str, frames: dict[str, DataFrame], keys: Mapping[str, catalog.Keys], directory: str, domain: str = "retail", database: str | None = None, buckets: int | None = None, accept: tuple[str, ...] = ()) -> tuple[Project, list[charts.Chart]]:
    """A project from its sources to its dashboard, in the order of the stages, sure proposals accepted.

    Of the cleaning steps that wait for a person, those of the operations in accept are accepted too. Snapshot, profile
    and cleaned tables are stored under directory, the warehouse in database (by default called by the
    project), laid out as buckets says; sources are only read. KPIs and charts are computed over the warehouse,
    which is approved if all its tables could be written.
    """
    tables = catalog.discover(frames, keys)
    state.refresh_catalogue(catalog.as_frame(spark, tables), directory)
    links = [r.asDict() for r in relationships.infer(spark, tables, frames).collect()]
    tables = catalog.accepted(tables, [(r["from_table"], r["from_column"], r["to_table"], r["to_column"]) for r in links if r["status"] == "auto_accepted"])
    columns, whole = profile.profile_each(spark, frames)
    state.store(columns, directory, "profiles")
    state.store(whole, directory, "table_profiles")
    columns, whole = state.newest(spark, directory, "profiles"), state.newest(spark, directory, "table_profiles")
    score = quality.scores(columns, whole).first()["overall"]
    types = {(t.name, c.name): c.type for t in tables for c in t.columns}
    issues = [r.asDict() for r in quality.issues(columns, whole).collect()]
    steps = cleaning.decide(cleaning.recommend(issues, types, cleaning.medians_for(issues, types, frames)))
    steps = [replace(s, status="approved") if s.status == "pending" and s.operation in accept else s for s in steps]
    frames, told = cleaning.apply(spark, frames, [s for s in steps if s.status == "approved"], f"{directory}/cleaned")
    cleaned = catalog.recounted(tables, frames)
    d = design(cleaned)
    stored = database or f"{name}_warehouse"
    made = warehouse.materialise(spark, frames, d, stored, buckets)
    held = {n: spark.table(f"`{stored}`.`{n}`") for n, status in made.items() if status == "created"}
    frames = kpi_match.frames_of("warehouse", frames, held, d)
    checks = tuple(tuple(r) for r in warehouse.validate(frames, d).select("check", "table_name", "detail", "value", "status").collect())
    kpis = kpi_match.approve_sure(kpi_match.compute(kpi_match.match(domain, cleaned, d), frames))
    shown = charts.dashboard([m for m in kpis if m.status == "approved"], cleaned, frames)
    statuses = tuple(s.status for s in steps if s.status != "approved") + tuple(s.status for s, _ in told)
    approved = bool(made) and len(held) == len(made)
    return Project(name, domain, True, tuple(cleaned), tuple(r["status"] for r in links), score, statuses, True, approved, tuple(kpis), 0, len(shown), tuple(made.items()), checks, tuple(s for s, status in told if status == "applied")), shown
