"""Filters: a flat list of comparisons, joined by AND or OR, as one Column that Catalyst can push down."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import TEXT, canonical_text, column_types, safe_name, typed_column, value_of

#: In the order in which messages list them.
OPERATORS = ("!=", "<", "<=", "=", ">", ">=", "ILIKE", "IN", "IS NOT NULL", "IS NULL", "LIKE")
_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class FilterGroup:
    filters: list[Filter] = field(default_factory=list)
    logic: str = "AND"


def valid_operator(operator: str) -> str:
    """The operator in upper case; ValueError lists those there are."""
    name = " ".join(str(operator).upper().split())
    if name not in OPERATORS:
        raise ValueError(f"Unsupported operator {operator!r}. Allowed: {', '.join(OPERATORS)}")
    return name


def parse_filters(raw: Any, logic: str | None = None) -> FilterGroup:
    """A filter group from JSON text, a list of filters, or ``{"logic", "filters"}``; ``logic`` given here wins.

    A filter without a column or an operator raises KeyError, another shape ValueError.
    """
    if isinstance(raw, FilterGroup):
        return raw
    if raw is None or raw == "":
        return FilterGroup(logic=logic or "AND")
    if isinstance(raw, (str, bytes)):
        try:
            raw = json.loads(raw)
        except json.JSONDecodeError as e:
            raise ValueError(f"filters are not JSON: {e}") from None
    if isinstance(raw, dict):
        logic, raw = logic or raw.get("logic", "AND"), raw.get("filters", [])
    if not isinstance(raw, list) or not all(isinstance(f, (dict, Filter)) for f in raw):
        raise ValueError("filters are a list, or an object with a list of them")
    logic = str(logic or "AND").upper()
    if logic not in ("AND", "OR"):
        raise ValueError(f"logic is AND or OR, not {logic!r}")
    return FilterGroup([f if isinstance(f, Filter) else Filter(f["column"], f["operator"], f.get("value")) for f in raw], logic)


def compile_filter(f: Filter, types: dict[str, str]) -> Column:
    """One comparison. Nulls never match, but for IS NULL; values are literals, never spliced into SQL."""
    operator, column = valid_operator(f.operator), typed_column(safe_name(f.column), types)
    kind = types.get(f.column, TEXT)
    if operator == "IS NULL":
        return column.isNull()
    if operator == "IS NOT NULL":
        return column.isNotNull()
    if operator == "IN":
        if isinstance(f.value, (str, bytes)) or not hasattr(f.value, "__iter__"):
            raise ValueError("IN takes a list of values")
        values = [value_of(v, kind) for v in f.value]
        return column.isin(values) if values else F.lit(False)
    if operator in ("LIKE", "ILIKE"):
        text = canonical_text(column, kind)
        return text.like(str(f.value)) if operator == "LIKE" else text.ilike(str(f.value))
    return _COMPARE[operator](column, F.lit(value_of(f.value, kind)))


def compile_group(group: FilterGroup, types: dict[str, str]) -> Column | None:
    """All comparisons of a group as one Column; None for an empty group, which every row passes."""
    parts = [compile_filter(f, types) for f in group.filters]
    return reduce(and_ if group.logic == "AND" else or_, parts) if parts else None


def apply_filters(df: DataFrame, filters: Any = None, logic: str | None = None) -> DataFrame:
    """Rows that pass ``filters``, in any form that :func:`parse_filters` takes."""
    condition = compile_group(parse_filters(filters, logic), column_types(df))
    return df if condition is None else df.where(condition)
