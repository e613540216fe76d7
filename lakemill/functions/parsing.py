"""Cleaning of raw text cells into numbers, dates and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DATE, NUMERIC

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# Fixed: the accepted date formats, in the order in which they are tried.
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s")


def clean_number(cell: Column) -> Column:
    """A double; commas are dropped. Null where the cell isn't a finite number."""
    text = F.trim(F.replace(cell, F.lit(","), F.lit("")))
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def clean_date(cell: Column) -> Column:
    """A date by the first format that fits; the time of day is dropped."""
    text = F.trim(cell)
    return F.coalesce(*(F.try_to_date(text, f) for f in DATE_FORMATS))


def clean_text(cell: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.trim(cell), F.lit(""))


def clean(cell: Column, kind: str) -> Column:
    return clean_number(cell) if kind == NUMERIC else clean_date(cell) if kind == DATE else clean_text(cell)
