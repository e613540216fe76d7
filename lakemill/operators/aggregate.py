"""Grouped aggregation and series of date-truncated periods."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import NUMERIC, TEXT, DATE, WrongType, column_types, safe_name, typed_column
from .filters import apply_filters

_METRIC = re.compile(r"^\s*(COUNT|SUM|AVG|MIN|MAX|STDDEV)\s*\(\s*(\*|[a-zA-Z_][a-zA-Z0-9_]*)\s*\)\s*$", re.IGNORECASE)
UNITS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Metric:
    function: str
    column: str

    @property
    def alias(self) -> str:
        return f"{self.function.lower()}_{'all' if self.column == '*' else self.column}"


def parse_metric(text: str | Metric) -> Metric:
    """``FUNC(column)`` or ``COUNT(*)``; ValueError for anything else."""
    if isinstance(text, Metric):
        return text
    if not (m := _METRIC.match(text or "")) or m[2] == "*" and m[1].upper() != "COUNT":
        raise ValueError(f"Invalid metric {text!r}: FUNC(column) with COUNT, SUM, AVG, MIN, MAX or STDDEV, or COUNT(*)")
    return Metric(m[1].upper(), m[2])


def metric_column(metric: Metric, types: dict[str, str]) -> Column:
    """Sums, means and deviations are of doubles; least and greatest keep the column's type; STDDEV is the sample's, null under two rows."""
    if metric.column == "*":
        return F.count(F.lit(1)).alias(metric.alias)
    column = typed_column(metric.column, types)
    if metric.function == "COUNT":
        return F.count(column).alias(metric.alias)
    if metric.function in ("MIN", "MAX"):
        return (F.min if metric.function == "MIN" else F.max)(column).alias(metric.alias)
    if types.get(metric.column, NUMERIC) != NUMERIC:
        raise WrongType(f"{metric.function} needs a numeric column, not {metric.column}")
    value = column.cast("double")
    return {"SUM": F.sum, "AVG": F.avg, "STDDEV": F.stddev_samp}[metric.function](value).alias(metric.alias)


def aggregate(df: DataFrame, group_by: list[str], metrics: list[str | Metric], filters: Any = None, sort_by: str | None = None, sort_dir: str = "DESC", limit: int | None = 500, logic: str | None = None) -> DataFrame:
    """Groups with their metrics, the largest of the first metric first, nulls last, ties by the keys; at most ``limit`` groups.

    Null keys are a group. ``sort_by`` is a metric's name or a key. Partial sums are built before the one shuffle.
    """
    if not group_by or not metrics:
        raise ValueError("group_by and metrics may not be empty")
    types, parsed = column_types(df), [parse_metric(m) for m in metrics]
    keys = [typed_column(c, types).alias(safe_name(c)) for c in group_by]
    out = apply_filters(df, filters, logic).groupBy(*keys).agg(*(metric_column(m, types) for m in parsed))
    by = sort_by or parsed[0].alias
    if by not in out.columns:
        raise ValueError(f"Cannot sort by {by!r}; there are {', '.join(out.columns)}")
    first = F.col(by).asc_nulls_last() if str(sort_dir).upper() == "ASC" else F.col(by).desc_nulls_last()
    ordered = out.orderBy(first, *(F.col(c).asc_nulls_last() for c in group_by if c != by))
    return ordered if limit is None else ordered.limit(limit)


def series(df: DataFrame, date_column: str, metric: str | Metric, unit: str = "month", filters: Any = None, logic: str | None = None) -> DataFrame:
    """``(period, value)`` by ascending period: one metric of the rows of each day, week (from Monday), month, quarter or year; null dates are left out."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    types, parsed = column_types(df), parse_metric(metric)
    if types.get(safe_name(date_column)) not in (DATE, TEXT):
        raise WrongType(f"{date_column} holds no dates")
    day = typed_column(date_column, types) if types[date_column] == DATE else F.try_to_timestamp(F.col(date_column)).cast("date")
    rows = apply_filters(df, filters, logic).where(day.isNotNull())
    return rows.groupBy(F.date_trunc(unit, day).alias("period")).agg(metric_column(parsed, types).alias("value")).orderBy("period")


def summarise(df: DataFrame, metrics: list[str | Metric], group_by: list[str] | None = None, date_column: str | None = None, unit: str = "month", filters: Any = None, sort_by: str | None = None, sort_dir: str = "DESC", limit: int | None = 500, logic: str | None = None) -> DataFrame:
    """One call for both: with a ``date_column`` the :func:`series` of the one metric, else the :func:`aggregate` by ``group_by``."""
    if date_column is None:
        return aggregate(df, group_by or [], metrics, filters, sort_by, sort_dir, limit, logic)
    if group_by or len(metrics) != 1:
        raise ValueError("a series has one metric and no groups")
    return series(df, date_column, metrics[0], unit, filters, logic)
