"""The three logical types, numeric, text and date, and values of them."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, TEXT, DATE = "numeric", "text", "date"
_NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
ROW_ID = "_row_id"


class UnknownColumn(ValueError):
    """The dataset has no such column."""


class WrongType(ValueError):
    """The column's type does not allow the operation."""


def safe_name(name: str) -> str:
    """A column name that queries may use; others raise ValueError."""
    if not isinstance(name, str) or not _NAME.match(name):
        raise ValueError(f"Unsafe column name: {name!r}")
    return name


def logical_type(kind: T.DataType) -> str | None:
    """numeric, text or date; None for nested types."""
    if isinstance(kind, T.NumericType):
        return NUMERIC
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return TEXT if isinstance(kind, (T.StringType, T.BooleanType)) else None


def column_types(df: DataFrame) -> dict[str, str]:
    """Logical type of each column that has one, but for the row id."""
    return {f.name: t for f in df.schema.fields if f.name != ROW_ID and (t := logical_type(f.dataType))}


def typed_column(name: str, types: dict[str, str]) -> Column:
    """The column at its logical type; timestamps compare and cut at days. A column that isn't there is all null, as text."""
    safe_name(name)
    if name not in types:
        return F.lit(None).cast("string")
    return F.to_date(F.col(f"`{name}`")) if types[name] == DATE else F.col(f"`{name}`")


def canonical_text(column: Column, kind: str) -> Column:
    """A value as text: whole numbers without a fraction, others in plain decimals, dates as ISO."""
    if kind != NUMERIC:
        return column.cast("string")
    value = column.cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e18)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(value.cast("decimal(38,12)").cast("string"), "0+$", ""))


def value_of(value: Any, kind: str) -> Any:
    """A filter's value at a column's type; ValueError where it isn't one."""
    if value is None:
        raise ValueError("a comparison needs a value")
    if kind == NUMERIC:
        if isinstance(value, bool):
            raise ValueError(f"not a number: {value!r}")
        try:
            return value if isinstance(value, (int, float)) else float(str(value).replace(",", "").strip())
        except ValueError:
            raise ValueError(f"not a number: {value!r}") from None
    if kind == DATE:
        if isinstance(value, dt.datetime):
            return value.date()
        if isinstance(value, dt.date):
            return value
        try:
            return dt.date.fromisoformat(str(value).strip()[:10])
        except ValueError:
            raise ValueError(f"not a date: {value!r}") from None
    return str(value)
