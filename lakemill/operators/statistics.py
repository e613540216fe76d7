"""Descriptive statistics over all rows: moments, exact quantiles, histograms, correlations, outliers."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import NUMERIC, ROW_ID, UnknownColumn, WrongType, column_types, typed_column

#: Bins that one pass over the data counts while it looks for a rank.
_BINS = 2048


def numeric_column(df: DataFrame, column: str) -> Column:
    """The column as doubles; UnknownColumn or WrongType where it isn't numeric."""
    types = column_types(df)
    if column not in types:
        raise UnknownColumn(column)
    if types[column] != NUMERIC:
        raise WrongType(f"{column} is {types[column]}, not numeric")
    return typed_column(column, types).cast("double")


#: Values that reach the driver at once when few are left between the bounds of the wanted ranks.
_FEW = 20_000


def _values(df: DataFrame, column: str) -> DataFrame:
    """``x``: the column's values as doubles; null and NaN are none."""
    x = numeric_column(df, column)
    return df.select(x.alias("x")).where("x is not null and not isnan(x)")


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles, exact however many rows there are; null without values.

    Null and NaN are no values; the infinities are the least and the greatest. Each pass counts bins of the value range that
    still hold a wanted rank, with partial sums in every task, and keeps their least and greatest value, so it shuffles a few
    thousand rows and never sorts the data. The last values, when few, are counted one by one.
    """
    values = _values(df, column)
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    n, below, inside, low, high = values.agg(F.count(F.lit(1)), F.count_if(F.col("x") == float("-inf")), F.count(finite), F.min(finite), F.max(finite)).first()
    return _quantiles(values, n, below, inside, low, high, shares)


def _quantiles(values: DataFrame, n: int, below: int, inside: int, low: float | None, high: float | None, shares: list[float]) -> list[float | None]:
    """``below`` of the ``n`` values are -inf, ``inside`` are finite and lie from ``low`` to ``high``, the rest are inf."""
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    ranks = {f(p) for p in places for f in (math.floor, math.ceil)}
    found: dict[int, float] = {r: float("-inf") if r < below else float("inf") for r in ranks if not below <= r < below + inside}
    todo: dict[tuple[float, float, int, int], set[int]] = {}  # from, to, how many values lie below, how many within
    if low is not None:
        finite = values.where(F.abs("x") < float("inf"))
        todo[low, high, below, inside] = ranks - found.keys()
    while todo := {k: v for k, v in todo.items() if v and k[0] < k[1] or found.update(dict.fromkeys(v, k[0]))}:
        spans = list(todo)
        of = F.coalesce(*(F.when(F.col("x").between(a, b), F.lit(i)) for i, (a, b, _, _) in enumerate(spans)))
        last = sum(k for _, _, _, k in spans) <= _FEW
        at = F.coalesce(*(F.when(F.col("x").between(a, b), F.least(F.floor((F.col("x") / 2 - a / 2) / (b / 2 - a / 2) * _BINS), F.lit(_BINS - 1))) for a, b, _, _ in spans))
        bins = finite.select("x", of.alias("i"), (F.col("x") if last else at).alias("bin")).where("i is not null").groupBy("i", "bin").agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        new: dict[tuple[float, float, int, int], set[int]] = {}
        by_span: dict[int, list] = {}
        for r in sorted(bins, key=lambda r: (r["i"], r["a"])):
            by_span.setdefault(r["i"], []).append(r)
        for i, span in enumerate(spans):
            under = span[2]
            for r in by_span.get(i, []):
                if mine := {k for k in todo[span] if under <= k < under + r["k"]}:
                    new.setdefault((r["a"], r["b"], under, r["k"]), set()).update(mine)
                under += r["k"]
        if new.keys() == todo.keys():
            raise RuntimeError(f"no bin between {spans[0][0]!r} and {spans[0][1]!r} is narrower")
        todo = new

    def between(p: float) -> float:
        a, b, f = found[math.floor(p)], found[math.ceil(p)], p - math.floor(p)
        return a if a == b or not f else a + (b - a) * f if math.isfinite(a) and math.isfinite(b) else a * (1 - f) + b * f

    return [between(p) for p in places]


_BASIC = "count long, mean double, median double, std double, variance double, min double, max double, skewness double, kurtosis double"


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, median, sample deviation and variance, least, greatest, skewness and excess kurtosis of the population; null without values, and the spread of one value.

    Null and NaN are no values. With an infinite one the mean is infinite or NaN and the spread NaN, as doubles have it.
    """
    values, x, n = _values(df, column), F.col("x"), F.count("x")
    two, spread = (lambda c: F.when(n > 1, c)), F.when((n > 1) & (F.max("x") > F.min("x")), F.lit(True))
    finite = F.when(F.abs("x") < float("inf"), x)
    told = values.agg(
        n, F.avg("x"), two(F.stddev_samp("x")), two(F.var_samp("x")), F.min("x"), F.max("x"), F.when(spread, F.skewness("x")), F.when(spread, F.kurtosis("x")),
        F.count_if(x == float("-inf")), F.count(finite), F.min(finite), F.max(finite),
    ).first()
    median = _quantiles(values, told[0], *told[8:], [0.5])[0]
    return df.sparkSession.createDataFrame([(*told[:2], median, *told[2:8])], _BASIC)


def quantiles(df: DataFrame, column: str) -> DataFrame:
    """One row of p25, p50, p75, p90 and p99."""
    shares = (25, 50, 75, 90, 99)
    return df.sparkSession.createDataFrame([tuple(exact_quantiles(df, column, [s / 100 for s in shares]))], ", ".join(f"p{s} double" for s in shares))


def statistics(df: DataFrame, column: str) -> DataFrame:
    """:func:`basic_stats` and :func:`quantiles` in one row."""
    return basic_stats(df, column).crossJoin(quantiles(df, column))  # one row each


def histogram(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """``(bucket, lower, upper, center, count)`` of equal widths from the least to the greatest value, the last one closed; 2 to 100 buckets, others are set to the nearer bound. Null, NaN and infinite values are in none."""
    buckets = max(2, min(100, buckets))
    values = _values(df, column).where(F.abs("x") < float("inf"))
    ends = values.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a is not null")
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * buckets), F.lit(buckets - 1)).cast("int")
    counts = values.crossJoin(F.broadcast(ends)).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))  # `ends` is one row
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / buckets
    i = F.col("bucket")
    return grid.join(counts, "bucket", "left").select("bucket", F.round(edge(i), 6).alias("lower"), F.round(edge(i + 1), 6).alias("upper"), F.round((edge(i) + edge(i + 1)) / 2, 6).alias("center"), F.coalesce("count", F.lit(0)).alias("count")).orderBy("bucket")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_a, column_b, r)`` of each pair of numeric columns, both ways, over the rows where none is null; null for a constant column. No rows with fewer than two columns or rows."""
    names = columns or [c for c, t in column_types(df).items() if t == NUMERIC]
    x = {c: numeric_column(df, c) for c in names}
    schema = "column_a string, column_b string, r double"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    rows = df.select(*(x[c].alias(c) for c in names)).dropna()
    pairs = [(a, a) for a in names] + list(combinations(names, 2))
    r = {(a, b): F.round(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), 4) for a, b in pairs}
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(v.alias(f"r{i}") for i, v in enumerate(r.values()))).where("n >= 2")
    out = [F.struct(F.lit(p).alias("column_a"), F.lit(q).alias("column_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(r) for p, q in dict.fromkeys([(a, b), (b, a)])]
    return one.select(F.explode(F.array(*out)).alias("c")).select("c.*").orderBy("column_a", "column_b")


def outlier_bounds(df: DataFrame, column: str) -> dict[str, float | None]:
    """Quartiles, their distance, and the fences at 1.5 of it beyond them."""
    q1, q3 = exact_quantiles(df, column, [0.25, 0.75])
    if q1 is None or not math.isfinite(q3 - q1):  # without values, or with an infinite quartile, nothing lies beyond
        return {"q1": q1, "q3": q3, "iqr": None, "lower": None, "upper": None}
    return {"q1": q1, "q3": q3, "iqr": q3 - q1, "lower": q1 - 1.5 * (q3 - q1), "upper": q3 + 1.5 * (q3 - q1)}


def outliers(df: DataFrame, column: str, limit: int | None = 200, row_id: str = ROW_ID) -> DataFrame:
    """``(row_id, value, q1, q3, iqr, lower, upper, outlier_total)`` of the rows beyond the fences, by value, at most ``limit``; the total counts all."""
    b, x = outlier_bounds(df, column), numeric_column(df, column)
    beyond = df.select(F.col(row_id), x.alias("value")).where(((x < F.lit(b["lower"])) | (x > F.lit(b["upper"]))) & ~F.isnan(x))
    told = [F.round(F.lit(b[k]).cast("double"), 4).alias(k) for k in b]
    total = beyond.agg(F.count(F.lit(1)).alias("outlier_total"))
    rows = beyond.orderBy("value", row_id)
    return (rows if limit is None else rows.limit(limit)).select(row_id, "value", *told).crossJoin(F.broadcast(total))  # one row
