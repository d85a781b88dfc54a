"""How values are shown: tables of rules, read by one routine for a value and one for a column.

A rule has the units it is for, steps from the largest (from which size, divisor, decimals, ending) and
what stands before the number. The first step whose size the value reaches decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    units: tuple[str, ...]
    steps: tuple[tuple[float, float, int, str], ...]
    before: str = ""
    signed: bool = False  # a step is reached by the value itself, so that negative ones are not shortened
    grouped: bool = True  # thousands are set apart


# Units, sizes from which a number is shortened, decimals, endings.
KPI_RULES = (
    Rule(("currency", "usd", "$"), ((1e6, 1e6, 1, "M"), (1e3, 1e3, 1, "K"), (0, 1, 2, "")), "$"),
    Rule(("inr", "₹"), ((1e7, 1e7, 2, "Cr"), (1e5, 1e5, 1, "L"), (0, 1, 2, "")), "₹"),
    Rule(("percentage", "%"), ((0, 1, 2, "%"),), grouped=False),
    Rule(("days", "day"), ((0, 1, 2, " days"),), grouped=False),
    Rule(("count", "integer", "int"), ((0, 1, 0, ""),)),
    Rule(("ratio", "decimal"), ((0, 1, 2, ""),), grouped=False),
)
CARD_RULES = (
    Rule(("currency",), ((1e6, 1e6, 1, "M"), (1e3, 1e3, 1, "K"), (0, 1, 2, "")), "$", signed=True, grouped=False),
    Rule(("percentage",), ((0, 1, 1, "%"),), signed=True, grouped=False),
    Rule(("count",), ((1e6, 1e6, 1, "M"), (1e3, 1e3, 1, "K"), (0, 1, 0, "")), signed=True),
)
TIP_RULES = (
    Rule(("currency",), ((1e6, 1e6, 1, "M"), (1e3, 1e3, 1, "K"), (0, 1, 2, "")), "$", grouped=False),
    Rule(("percentage", "rate", "ratio"), ((0, 1, 1, "%"),), grouped=False),
    Rule(("count", ""), ((1e6, 1e6, 1, "M"), (1e3, 1e3, 1, "K")), grouped=False),
)


def _shown(value: float, unit: str, rules: tuple[Rule, ...]) -> str | None:
    for rule in rules:
        if unit in rule.units:
            size = value if rule.signed else abs(value)
            for least, divisor, decimals, ending in rule.steps:
                if size >= least or (rule.signed and least == 0):
                    return f"{rule.before}{value / divisor:{',' if rule.grouped and divisor == 1 else ''}.{decimals}f}{ending}"
    return None


def kpi_text(value: float | None, unit: str | None) -> str | None:
    """A KPI's value by its unit; of an unknown unit with two decimals, or none if it is whole."""
    if value is None:
        return None
    return _shown(value, (unit or "").lower().strip(), KPI_RULES) or f"{value:,.{0 if float(value).is_integer() else 2}f}"


def card_text(value: float | None, unit: str | None) -> str:
    """The short form on a card; N/A without a value. A count is cut to a whole number, not rounded."""
    if value is None:
        return "N/A"
    kind = (unit or "").lower()
    return _shown(int(value) if kind == "count" and value < 1e3 else value, kind, CARD_RULES) or str(round(value, 2))


def tip_text(value: float, unit: str | None) -> str:
    """The form in a chart's tooltip."""
    kind = (unit or "").lower()
    whole = float(value).is_integer()
    plain = f"{value:,.0f}" if whole else f"{value:.2f}"
    return _shown(value, kind, TIP_RULES) or (plain if kind in ("count", "") else f"{round(value, 2):g}")


def kpi_column(value: Column, unit: Column) -> Column:
    """kpi_text() of a column of values, made by Spark: numbers at half between two forms may round the other way."""
    kind = F.lower(F.trim(F.coalesce(unit, F.lit(""))))

    def number(x: Column, decimals: int, grouped: bool) -> Column:
        made = F.format_number(x, decimals)
        return made if grouped else F.replace(made, F.lit(","), F.lit(""))

    whole = value == F.floor(value)
    out = F.when(whole, number(value, 0, True)).otherwise(number(value, 2, True))
    for rule in reversed(KPI_RULES):
        forms = [(F.abs(value) >= least, F.concat(F.lit(rule.before), number(value / divisor, decimals, rule.grouped and divisor == 1), F.lit(ending))) for least, divisor, decimals, ending in rule.steps]
        shown = reduce(lambda rest, form: F.when(form[0], form[1]).otherwise(rest), reversed(forms), F.lit(None).cast("string"))
        out = F.when(kind.isin(*rule.units), shown).otherwise(out)
    return F.when(value.isNotNull(), out)
