"""CSV and JSON sinks, and exports small enough for a string."""

from __future__ import annotations

import csv
import io
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import apply_filters
from ..types import ROW_ID

#: Rows that one export may hold.
MAX_ROWS = 100_000


def export_rows(df: DataFrame, filters: Any = None, page_size: int = 10_000, row_id: str = ROW_ID) -> DataFrame:
    """The first rows that pass, by row id: at most ``page_size``, itself at most ``MAX_ROWS``."""
    if not 1 <= page_size <= MAX_ROWS:
        raise ValueError(f"page_size is from 1 to {MAX_ROWS}")
    rest = [F.col(f"`{c}`") for c in df.columns if c != row_id]
    return apply_filters(df, filters).orderBy(row_id).limit(page_size).select(row_id, *rest)


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write part files in parallel; ``kind`` is csv or json."""
    if kind == "csv":
        df.write.csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif kind == "json":
        df.write.json(path, ignoreNullFields=False)
    else:
        raise ValueError("format is csv or json")


def to_csv(rows: list[dict[str, Any]]) -> str:
    """CSV text with the first row's columns; nothing for no rows."""
    if not rows:
        return ""
    out = io.StringIO()
    w = csv.DictWriter(out, list(rows[0]), extrasaction="ignore", lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def to_json(rows: list[dict[str, Any]], indent: int = 2) -> str:
    return json.dumps(rows, indent=indent, ensure_ascii=False, default=str)


def export(df: DataFrame, kind: str = "csv", filters: Any = None, page_size: int = 10_000, row_id: str = ROW_ID) -> str:
    """An export as text: at most ``MAX_ROWS`` rows reach the driver."""
    if kind not in ("csv", "json"):
        raise ValueError("format is csv or json")
    rows = [r.asDict() for r in export_rows(df, filters, page_size, row_id).collect()]
    return to_csv(rows) if kind == "csv" else to_json(rows)
