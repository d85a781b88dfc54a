"""From KPIs to a handful of charts: candidates, their form by what they return, and a varied choice."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import title
from ..operators import breakdowns
from ..operators.kpis import Measure
from .catalog import Table
from .graph import Path, dimension_paths, own_dimensions, to_parents
from .kpi_match import Match, compute

# Up to so many groups a donut, up to so many a bar chart, beyond it the first ten.
DONUT_GROUPS, BAR_GROUPS, SHOWN, MOST_CHARTS = 6, 20, 10, 5
QUERY_ROWS = 200
CUSTOMER_WORDS = ("customer", "user", "client", "member", "subscriber")
PLAIN_LABELS = ("name", "title", "label")


@dataclass(frozen=True)
class Cut:
    """A breakdown that breakdowns.by_all() can give: a date, a column or a path (of) of a table, by a measure."""

    table: str
    measure: Measure
    kind: str  # date, column or path
    of: str | Path
    shown: str | None = None

    @property
    def dimension(self) -> str:
        return self.of if isinstance(self.of, str) else self.of.table


@dataclass(frozen=True)
class Chart:
    key: str
    title: str
    form: str  # time_series, categorical or segmentation
    label: str
    unit: str
    metric: str
    frame: Callable[[], DataFrame]
    rows: tuple[dict, ...] = ()
    kind: str = ""
    error: str | None = None
    cut: Cut | None = None  # where its rows are in the one pass over its table

    def axes(self) -> dict[str, str]:
        y = f"{self.metric} ({self.unit.title()})" if self.unit and self.unit.lower() != "count" else self.metric
        x = ("period", "Date") if self.form == "time_series" else ("label", self.label or "Category")
        return {"x_field": x[0], "x_axis_label": x[1], "y_field": "value", "y_axis_label": y, "series_name": self.metric}


def dimension_title(column: str, table: str | None = None) -> str:
    """A column's name as a title; a column that is called name or title is called by its table."""
    return title(table) if table and column.lower() in PLAIN_LABELS else title(column.replace("_id", ""))


def candidates(matches: list[Match], tables: list[Table], frames: dict[str, DataFrame]) -> list[Chart]:
    """Over time, by activity, by each dimension not used before, and by an own column if none can be joined."""
    by, used, out = {t.name: t for t in tables}, set(), []
    for k, m in enumerate(matches):
        dates, groups = own_dimensions(by[m.table])
        df, name, unit = frames[m.table], m.kpi.name, m.kpi.unit
        if dates:
            out.append(Chart(f"kpi{k}_timeseries", f"{name} Over Time", "time_series", "Trend", unit, name, lambda df=df, m=m, d=dates[0]: breakdowns.by_month(df, m.measure, d), cut=Cut(m.table, m.measure, "date", dates[0])))
        buyer = next((g for g in groups if any(w in g.lower() for w in CUSTOMER_WORDS)), None)
        if buyer:
            out.append(Chart(f"kpi{k}_segments", "Customer Activity Distribution", "segmentation", "Customers", "count", "Customers", lambda df=df, g=buyer: breakdowns.by_activity(df, g)))
        paths = dimension_paths(tables, m.table)
        for p in paths:
            if p.table in used:
                continue
            used.add(p.table)
            label = dimension_title("name" if len(p.label) > 1 else p.label[0], p.table)
            out.append(Chart(f"kpi{k}_by_{p.table}", f"{name} by {label}", "categorical", label, unit, name, lambda m=m, p=p: breakdowns.by_path(frames, m.table, m.measure, p, BAR_GROUPS + 1), cut=Cut(m.table, m.measure, "path", p) if to_parents(tables, p) else None))
        if groups and not paths:
            label = dimension_title(groups[0])
            out.append(Chart(f"kpi{k}_by_{groups[0]}", f"{name} by {label}", "categorical", label, unit, name, lambda df=df, m=m, g=groups[0], n=label: breakdowns.by_column(df, m.measure, g, BAR_GROUPS + 1, n), cut=Cut(m.table, m.measure, "column", groups[0], label)))
    return out


def finished(chart: Chart, rows: list[dict]) -> Chart | None:
    """The chart with its kind by the number of rows; None for fewer than two."""
    if len(rows) < 2:
        return None
    if chart.form != "categorical":
        return replace(chart, rows=tuple(rows), kind="line" if chart.form == "time_series" else "bar")
    if len(rows) > BAR_GROUPS:
        return replace(chart, rows=tuple(rows[:SHOWN]), kind="horizontal_bar", title=f"Top {SHOWN} {chart.title}")
    return replace(chart, rows=tuple(rows), kind="donut" if len(rows) <= DONUT_GROUPS else "bar")


def curate(charts: list[Chart], most: int = MOST_CHARTS) -> list[Chart]:
    """A line, a segmentation, a ranking, the smallest donut and a bar, as far as there are such; then the first others."""
    if len(charts) <= most:
        return charts
    slots = (("line", "time_series"), ("bar", "segmentation"), ("horizontal_bar", None), ("donut", None), ("bar", "categorical"))
    picked: list[Chart] = []
    for kind, form in slots:
        fit = [c for c in charts if c not in picked and c.kind == kind and form in (None, c.form)]
        if fit and len(picked) < most:
            picked.append(min(fit, key=lambda c: len(c.rows)) if kind == "donut" else fit[0])
    return picked + [c for c in charts if c not in picked][: most - len(picked)]


def one_pass(charts: list[Chart], frames: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """The rows by key of those charts of one table that breakdowns.by_all() gives together, from one scan of the table.

    Charts whose dimensions share a name are left to themselves.
    """
    cuts = {c.key: c.cut for c in charts if c.cut}
    seen: dict[str, set] = {}
    for cut in cuts.values():
        seen.setdefault(cut.dimension, set()).add((cut.kind, cut.of))
    cuts = {k: cut for k, cut in cuts.items() if len(seen[cut.dimension]) == 1}
    if len(cuts) < 2:
        return {}
    measures = list(dict.fromkeys(cut.measure for cut in cuts.values()))
    of = {kind: tuple(dict.fromkeys(cut.of for cut in cuts.values() if cut.kind == kind)) for kind in ("date", "column", "path")}
    base = next(iter(cuts.values())).table
    titles = {cut.of: cut.shown for cut in cuts.values() if cut.kind == "column"}
    made = breakdowns.by_all(frames, base, {str(k): m for k, m in enumerate(measures)}, of["date"], of["column"], of["path"], BAR_GROUPS + 1, titles)
    found: dict[tuple, list] = {}
    for r in made.collect():
        found.setdefault((int(r["measure"]), r["dimension"]), []).append(r)
    out = {}
    for key, cut in cuts.items():
        rows = sorted(found.get((measures.index(cut.measure), cut.dimension), []), key=lambda r: r["place"])
        x = "period" if cut.kind == "date" else "label"
        out[key] = [{x: r[x], "value": r["value"]} for r in rows]
    return out


def dashboard(matches: list[Match], tables: list[Table], frames: dict[str, DataFrame], most: int = MOST_CHARTS, threads: int = 4) -> list[Chart]:
    """The curated charts with their rows (at most a few dozen each); candidates run side by side.

    Those that one pass over their table gives are cut from it; if that fails, each runs by itself. One that fails has no rows and its error, and stands behind the others as far as there is room.
    """

    asked = candidates(matches, tables, frames)
    cut: dict[str, list[dict]] = {}
    for table in dict.fromkeys(c.cut.table for c in asked if c.cut):
        try:
            cut |= one_pass([c for c in asked if c.cut and c.cut.table == table], frames)
        except (PySparkException, KeyError):
            continue

    def run(chart: Chart) -> Chart | None:
        try:
            return finished(chart, cut[chart.key] if chart.key in cut else to_rows(chart.frame()))
        except (PySparkException, KeyError) as e:
            return replace(chart, kind="empty", error=str(e).splitlines()[0])

    with ThreadPoolExecutor(threads) as pool:
        made = [c for c in pool.map(run, asked) if c]
    picked = curate([c for c in made if not c.error], most)
    return picked + [c for c in made if c.error][: most - len(picked)]


def refreshed(matches: list[Match], tables: list[Table], frames: dict[str, DataFrame], settings: dict[str, "Setting"] | None = None, queries: list[Chart] = (), most: int = MOST_CHARTS) -> tuple[list[Match], list[Chart]]:
    """The approved KPIs computed anew and the charts that follow, as chosen, with those of saved queries behind. Without an approved KPI there is nothing to refresh, which is an error."""
    approved = [m for m in matches if m.status == "approved"]
    if not approved:
        raise ValueError("no approved KPIs to refresh")
    new = dict(zip((id(m) for m in approved), compute(approved, frames)))
    shown = dashboard(list(new.values()), tables, frames, most) + list(queries)
    return [new.get(id(m), m) for m in matches], overlaid(shown, settings or {})


def to_rows(df: DataFrame) -> list[dict]:
    """A chart's rows as dictionaries; value is a float, or None where it is no number."""
    out = []
    for r in df.collect():
        row = r.asDict()
        try:
            row["value"] = None if row.get("value") is None else float(row["value"])
        except (TypeError, ValueError):
            row["value"] = None
        out.append(row)
    return out


# What a chart of a unit may be drawn as, and titles that nobody meant.
CHART_KINDS = {
    "currency": ("line", "bar", "area", "card", "table"),
    "count": ("bar", "line", "area", "card", "table"),
    "percentage": ("donut", "bar", "card"),
}
OTHER_KINDS = ("bar", "card", "table")
PLACEHOLDERS = ("my custom title", "untitled", "chart title", "new chart", "new widget", "widget title", "custom title", "title")


def kinds_for(unit: str | None) -> tuple[str, ...]:
    return CHART_KINDS.get((unit or "").lower(), OTHER_KINDS)


def meant_title(given: str | None) -> str | None:
    """A title that someone gave; None for a blank one or a placeholder."""
    text = (given or "").strip()
    return None if text.lower() in (*PLACEHOLDERS, "") else text


@dataclass(frozen=True)
class Setting:
    """What was chosen for a chart by its key; None leaves it as it is."""

    key: str
    title: str | None = None
    kind: str | None = None
    place: int | None = None
    hidden: bool | None = None


def changed(settings: dict[str, Setting], key: str, **choices) -> dict[str, Setting]:
    """settings with some choices for one chart added to the earlier ones; None changes nothing."""
    told = {k: v for k, v in choices.items() if v is not None}
    return settings | {key: replace(settings.get(key, Setting(key)), **told)}


def overlaid(charts: list[Chart], settings: dict[str, Setting]) -> list[Chart]:
    """The charts as chosen: hidden ones gone, titles and kinds replaced, those with a place first in its order."""
    shown = [c for c in charts if not (c.key in settings and settings[c.key].hidden)]

    def dressed(c: Chart) -> Chart:
        s = settings.get(c.key, Setting(c.key))
        return replace(c, title=meant_title(s.title) or c.title, kind=s.kind or c.kind)

    def place(c: Chart) -> tuple:
        at = settings[c.key].place if c.key in settings else None
        return (at is None, at or 0)

    return [dressed(c) for c in sorted(shown, key=place)]


def query_chart(spark: SparkSession, sql: str, x: str, y: str, title: str, kind: str = "bar", run: Callable[[str], DataFrame] | None = None) -> Chart:
    """A chart of a saved query: its column x as labels, y as values. Columns that it lacks are an error of the caller's.

    A query that fails gives an empty chart with the error.
    """
    base = Chart(f"query:{title}", title, "categorical", x, "", y, lambda: None, kind=kind)
    try:
        df = run(sql) if run else spark.sql(sql)
    except PySparkException as e:
        return replace(base, kind="empty", error=str(e).splitlines()[0])
    if lacking := [c for c in (x, y) if c not in df.columns]:
        raise ValueError(f"the query has no column {', '.join(lacking)}")
    frame = df.select(F.col(f"`{x}`").cast("string").alias("label"), F.col(f"`{y}`").alias("value"))
    try:
        return replace(base, rows=tuple(to_rows(frame.limit(QUERY_ROWS))))
    except PySparkException as e:
        return replace(base, kind="empty", error=str(e).splitlines()[0])


def validity(rows: list[dict]) -> str | None:
    """Why a chart's rows cannot be drawn, or None."""
    labels = [r.get("label", r.get("period")) for r in rows]
    if not rows:
        return "no rows"
    if any(r.get("value") is None for r in rows):
        return "values that are no numbers"
    if any(x is None or x == "" for x in labels):
        return "missing labels"
    if len(set(labels)) < len(labels):
        return "labels twice"
    return "a single point" if len(rows) == 1 else None
