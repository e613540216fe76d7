"""Filtered, sorted pages."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import ROW_ID, column_types, safe_name, typed_column
from .filters import apply_filters


#: Rows of a page, at most.
PAGE_ROWS = 100


@dataclass(frozen=True)
class Page:
    total: int
    page: int
    page_size: int
    rows: DataFrame


def sorted_page(df: DataFrame, filters: Any = None, sort_by: str | None = None, sort_dir: str = "ASC", page: int = 1, page_size: int = 20, row_id: str = ROW_ID, logic: str | None = None) -> DataFrame:
    """One page, lazily: nulls last in both directions, ties by row id. An unknown direction is ascending.

    Spark runs it as a top-k of ``page * page_size`` rows per task, without a full sort.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    order = [F.col(row_id).asc()]
    if sort_by:
        column = typed_column(safe_name(sort_by), column_types(df) | ({row_id: "numeric"} if sort_by == row_id else {}))
        order.insert(0, column.desc_nulls_last() if str(sort_dir).upper() == "DESC" else column.asc_nulls_last())
    rows = apply_filters(df, filters, logic).orderBy(*order)
    return (rows.offset((page - 1) * page_size) if page > 1 else rows).limit(page_size)


def query(df: DataFrame, filters: Any = None, sort_by: str | None = None, sort_dir: str = "ASC", page: int = 1, page_size: int = 20, row_id: str = ROW_ID, logic: str | None = None) -> Page:
    """The page, of 1 to 100 rows, with the number of all rows that pass; beyond the last row no second job runs."""
    if not 1 <= page_size <= PAGE_ROWS:
        raise ValueError(f"a page has 1 to {PAGE_ROWS} rows")
    total = apply_filters(df, filters, logic).count()
    rows = sorted_page(df, filters, sort_by, sort_dir, page, page_size, row_id, logic)
    if total <= (page - 1) * page_size:
        rows = df.sparkSession.createDataFrame([], df.schema)
    return Page(total, page, page_size, rows)
