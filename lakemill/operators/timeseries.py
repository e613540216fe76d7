"""Resampling, moving averages and growth of series.

Windows run over a series of periods, of which there are as many as days at most, never over raw rows.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import Metric, parse_metric, series


def resample(df: DataFrame, date_column: str, value_column: str, unit: str = "day", function: str = "SUM", filters: Any = None) -> DataFrame:
    """``(period, value)``: a function of a column by period."""
    return series(df, date_column, parse_metric(f"{function}({value_column})"), unit, filters)


def moving_average(df: DataFrame, date_column: str, value_column: str, window: int = 7, unit: str = "day", filters: Any = None) -> DataFrame:
    """``(period, value, moving_avg)``: mean of the sums of this and the ``window - 1`` periods before that have rows; null until there are as many."""
    if window < 1:
        raise ValueError("window starts at 1")
    order = Window.orderBy("period")
    sums = series(df, date_column, Metric("SUM", value_column), unit, filters).withColumn("value", F.coalesce("value", F.lit(0.0)))
    mean = F.avg("value").over(order.rowsBetween(1 - window, 0))
    return sums.withColumn("moving_avg", F.when(F.row_number().over(order) >= window, F.round(mean, 4)))


def growth_rate(df: DataFrame, value_column: str, date_column: str, unit: str = "month", filters: Any = None) -> DataFrame:
    """``(period, value, growth_pct)``: change against the period before in per cent of it; null for the first and after 0."""
    sums = series(df, date_column, Metric("SUM", value_column), unit, filters).withColumn("value", F.coalesce("value", F.lit(0.0)))
    before = F.lag("value").over(Window.orderBy("period"))
    return sums.withColumn("growth_pct", F.when(before != 0, F.round((F.col("value") - before) / F.abs(before) * 100, 4)))
