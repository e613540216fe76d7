"""Column profiles: all columns in one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import NUMERIC, TEXT, UnknownColumn, canonical_text, column_types, typed_column


def _measures(name: str, kind: str, types: dict[str, str]) -> dict[str, object]:
    c = typed_column(name, types)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    length = F.length(c) if kind == TEXT else None
    low, high = (canonical_text(F.min(c), kind), canonical_text(F.max(c), kind)) if kind != TEXT else (text, text)
    of = c.cast("double") if kind == NUMERIC else length.cast("double") if kind == TEXT else None
    return {
        "total_count": F.count(F.lit(1)),
        "non_null_count": F.count(c),
        "null_count": F.count_if(c.isNull()),
        "distinct_count": F.lit(None).cast("long"),
        "min_value": low,
        "max_value": high,
        "avg_value": F.avg(of) if kind == NUMERIC else none,
        "stddev_value": F.stddev_samp(of) if kind == NUMERIC else none,
        "min_length": F.min(length).cast("long") if kind == TEXT else F.lit(None).cast("long"),
        "max_length": F.max(length).cast("long") if kind == TEXT else F.lit(None).cast("long"),
        "avg_length": F.avg(of) if kind == TEXT else none,
    }


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: its type, counts of rows, values, nulls and distinct values; least, greatest, mean and deviation of numbers; least and greatest date; lengths of texts.

    All but the distinct values is one aggregation; those are counted a column at a time, so no row is multiplied by the columns.
    """
    types = column_types(df)
    for c in columns or []:
        if c not in types:
            raise UnknownColumn(c)
    names = columns or list(types)
    structs = [F.struct(F.lit(n).alias("column_name"), F.lit(types[n]).alias("data_type"), *(m.alias(k) for k, m in _measures(n, types[n], types).items())).alias(f"c{i}") for i, n in enumerate(names)]
    told = df.agg(*structs).select(F.explode(F.array(*(f"c{i}" for i in range(len(names))))).alias("c")).select("c.*")
    kinds = [df.select(F.lit(n).alias("_name"), typed_column(n, types).alias("v")).where("v is not null").groupBy("_name", "v").agg(F.lit(1).alias("one")).groupBy("_name").agg(F.count(F.lit(1)).alias("_distinct")) for n in names]
    distinct = reduce(DataFrame.union, kinds) if kinds else df.sparkSession.createDataFrame([], "_name string, _distinct long")
    joined = told.join(F.broadcast(distinct), F.col("column_name") == F.col("_name"), "left")  # a row per column
    return joined.withColumn("distinct_count", F.coalesce("_distinct", F.lit(0))).drop("_name", "_distinct")


def distinct_ratio(df: DataFrame, column: str) -> DataFrame:
    """``(column_name, distinct_ratio)``: distinct values by rows; 0 for no rows."""
    c = typed_column(column, column_types(df))
    return df.agg(F.coalesce(F.try_divide(F.count_distinct(c), F.count(F.lit(1))), F.lit(0.0)).alias("distinct_ratio")).select(F.lit(column).alias("column_name"), "distinct_ratio")
