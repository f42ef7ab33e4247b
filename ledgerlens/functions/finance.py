"""Derived metrics as data: named inputs, a formula over their columns and a display format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    inputs: tuple[str, ...]
    formula: Callable[..., Column]
    decimals: int
    percent: bool = False
    note: str = ""


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


# What each metric is made of. A division by zero is "not computable", so it gives null.
METRICS = {
    "current ratio": Metric(("current_assets", "current_liabilities"), lambda a, b: F.try_divide(a, b), 2, note="total current assets / total current liabilities"),
    "quick ratio": Metric(
        ("cash", "receivables", "current_liabilities"), lambda c, r, b: F.try_divide(c + r, b), 2,
        note="(cash + receivables) / total current liabilities; excludes inventory, so it differs from a definition that subtracts inventory from current assets when there are other current assets",
    ),
    "working capital": Metric(("current_assets", "current_liabilities"), lambda a, b: a - b, 0, note="total current assets - total current liabilities"),
    "gross margin": Metric(("gross_profit", "revenue"), _share, 1, True, "gross profit / revenue"),
    "operating margin": Metric(("operating_income", "revenue"), _share, 1, True, "operating income / revenue"),
    "net margin": Metric(("net_income", "revenue"), _share, 1, True, "net income / revenue"),
    "debt to equity": Metric(("total_liabilities", "equity"), lambda a, b: F.try_divide(a, b), 2, note="total liabilities / total equity"),
    "return on assets": Metric(("net_income", "total_assets"), _share, 1, True, "net income / total assets; not averaged over the year"),
}

# Label patterns (ilike) of each input, best first. A pattern without a wildcard matches the whole label.
LINE_ITEMS = {
    "current_assets": ["total current assets"],
    "current_liabilities": ["total current liabilities"],
    "cash": ["cash and cash equivalents", "cash and equivalents"],
    "receivables": ["accounts receivable%", "receivables - net%", "receivables%"],
    "inventory": ["total inventories", "inventories", "inventory%net"],
    "revenue": ["total net sales", "net sales", "total revenues", "total revenue", "revenues", "revenue"],
    "cogs": ["cost of sales", "cost of goods sold", "total cost of sales"],
    "gross_profit": ["gross profit", "gross margin"],
    "operating_income": ["operating income", "income from operations", "operating income (loss)"],
    "net_income": ["net income", "net income (loss)", "net income attributable%"],
    "total_assets": ["total assets"],
    "total_liabilities": ["total liabilities"],
    "equity": ["total stockholders%equity", "total shareholders%equity", "total equity"],
}


def detect(question: Column, names: list[str] | None = None) -> Column:
    """The first metric named in a question, the longest where several begin; null without one."""
    pattern = "|".join(sorted(names or METRICS, key=len, reverse=True))
    return F.nullif(F.regexp_extract(F.lower(question), f"({pattern})", 1), F.lit(""))


def show(value: Column, metric: Metric) -> Column:
    """The value as text; thousands are grouped in whole numbers only."""
    if metric.decimals == 0:
        return grouped(value)
    return F.format_string(f"%.{metric.decimals}f" + ("%%" if metric.percent else ""), value)


def grouped(value: Column) -> Column:
    """A whole number with its thousands grouped."""
    return F.format_number(value.cast("double"), 0)


def render(metric: Column, shown: Column, note: Column, scale: Column, inputs: Column) -> Column:
    """A computed metric as text: its value, its definition and every input (key, fact_id, label, value, page, doc_name)."""
    unit = F.when((metric == "working capital") & F.coalesce(scale != "", F.lit(False)), F.concat(F.lit(" "), scale)).otherwise("")
    lines = F.transform(inputs, lambda i: F.concat(F.lit("    [F"), i["fact_id"].cast("string"), F.lit("] "), i["label"], F.lit(" = "), grouped(i["value"]), F.lit("  ("), i["doc_name"], F.lit(" p"), F.coalesce(i["page"].cast("string"), F.lit("None")), F.lit(")")))
    return F.array_join(F.concat(F.array(F.concat(metric, F.lit(": "), shown, unit), F.concat(F.lit("  "), note), F.lit("  computed from:")), lines), "\n")


def signed(value: Column, parenthesised: Column) -> Column:
    """A figure in brackets is negative."""
    return F.when(parenthesised, -value).otherwise(value)
