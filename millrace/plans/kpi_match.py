"""Matching a domain's KPIs to a schema and computing them, one aggregation per table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from ..functions.formats import kpi_text
from ..functions.names import base_type, is_partition_child, keyword_score, table_score
from ..operators import kpis as aggregates
from .catalog import Column, Table
from .design import NUMERIC, Design
from .domains import DOMAINS, Kpi

ENOUGH = 50


@dataclass(frozen=True)
class Match:
    kpi: Kpi
    table: str
    measure: aggregates.Measure
    confidence: int
    value: float | None = None
    status: str = "recommended"

    @property
    def text(self) -> str | None:
        return kpi_text(self.value, self.kpi.unit)


def _best(table: Table, words: list[str], allowed: Callable[[Column], bool] = lambda c: True) -> tuple[str | None, int]:
    """The column with the best score, the first of equals, if it is enough."""
    scored = [(keyword_score(c.name, words), c.name) for c in table.columns if allowed(c)]
    score, name = max(scored, key=lambda x: x[0], default=(0, None))
    return (name, score) if score >= ENOUGH else (None, 0)


def _is_measure(c: Column) -> bool:
    return base_type(c.type) in NUMERIC and not c.primary and not c.linked


def match(domain: str, tables: list[Table], design: Design) -> list[Match]:
    """The KPIs of the domain that the schema can answer, the surest first.

    KPIs of the fact are all of the one fact table with the highest score; others are of the first
    table, warehouse tables before sources, whose name has one of their words.
    """
    by = {t.name: t for t in tables}
    facts = [p for p in design.facts if not is_partition_child(p.source)]
    fact = max(facts, key=lambda p: p.score, default=None)
    names = [p.source for p in (*facts, *design.dimensions)] + [t.name for t in tables]
    found = []
    for kpi in DOMAINS.get(domain, ()):
        table = fact and fact.source
        if not kpi.on_fact and kpi.tables:
            table = next((n for n in names if table_score(n, kpi.words("tables")) >= ENOUGH), None)
        if table is None:
            continue
        own, agg = by[table], kpi.aggregation
        column, a = _best(own, kpi.words("measure"), _is_measure)
        identifier, b = _best(own, kpi.words("identifier"))
        missing, _ = _best(own, kpi.words("missing"))
        if kpi.measure and column is None and agg not in ("COUNT", "COUNT_DISTINCT"):
            continue
        if kpi.identifier and identifier is None and agg in ("COUNT_DISTINCT", "SUM_PER_DISTINCT", "COUNT_PER_DISTINCT"):
            continue
        if agg == "NULL_RATE" and missing is None:
            continue
        sure = min([100, *[s for name, s in ((column, a), (identifier, b)) if name]])
        found.append(Match(kpi, table, aggregates.Measure(agg, missing if agg == "NULL_RATE" else column, identifier), sure))
    return sorted(found, key=lambda m: -m.confidence)


def compute(matches: list[Match], frames: dict[str, DataFrame]) -> list[Match]:
    """The matches with their values: one job per table. A table that fails leaves its KPIs without values.

    Results are told apart by place, as KPIs of several domains or columns may share a name.
    """
    value: dict[int, float | None] = {}
    for t in dict.fromkeys(m.table for m in matches):
        try:
            found = aggregates.values([aggregates.batch(frames[t], {str(k): m.measure for k, m in enumerate(matches) if m.table == t})])
            value |= {int(k): v for k, v in found.items()}
        except (PySparkException, KeyError):
            continue
    return [replace(m, value=value.get(k)) for k, m in enumerate(matches)]


def frames_of(mode: str, sources: dict[str, DataFrame], warehouse: dict[str, DataFrame], design: Design) -> dict[str, DataFrame]:
    """What KPIs are computed over: in warehouse mode a source's warehouse table, where there is one."""
    if mode not in ("source", "warehouse"):
        raise ValueError(f"unknown mode {mode}")
    made = {p.source: warehouse[p.name] for p in design.parts if p.name in warehouse} if mode == "warehouse" else {}
    return sources | made


def regenerated(old: list[Match], new: list[Match]) -> list[Match]:
    """New recommendations beside the approved ones, which stay; skipped ones stay skipped."""
    kept = {(m.kpi, m.table, m.measure): m for m in old if m.status in ("approved", "skipped")}
    fresh = [m for m in new if (m.kpi, m.table, m.measure) not in kept]
    return list(kept.values()) + fresh


def with_status(matches: list[Match], which: set[int], status: str) -> list[Match]:
    """Approves, skips or restores (recommended) the matches at some places."""
    if status not in ("approved", "skipped", "recommended"):
        raise ValueError(f"unknown status {status}")
    return [replace(m, status=status) if k in which else m for k, m in enumerate(matches)]


def confidence_label(points: int) -> str:
    return "High" if points >= 80 else "Medium" if points >= 50 else "Low"


def approve_sure(matches: list[Match], least: int = 80) -> list[Match]:
    return [replace(m, status="approved") if m.confidence >= least else m for m in matches]
