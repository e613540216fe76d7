"""The registered queries of the tabular engine, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import STOP_WORDS
from .operators import aggregate as agg
from .operators import paging, profile, search, statistics, timeseries
from .operators.filters import apply_filters
from .session import shared_folder, table
from .sources import csv_source, export
from .sources.catalog import Catalog
from .streaming.incremental import windowed_counts
from .types import DATE, TEXT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None) -> None:
    """``run`` gets a function from a table's name to its DataFrame."""
    QUERIES[name] = lambda spark, sf_dir: run(lambda t: table(spark, sf_dir, t))
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order, so they are compared rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Filters

_ORDER = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE "
_ORDER_COLUMNS = ("o_orderkey", "o_orderstatus", "o_totalprice")


def _filtered(name: str, of: str, columns: tuple[str, ...], filters: list | dict, where: str) -> None:
    add(name, lambda t: apply_filters(t(of), filters).select(*columns), f"SELECT {', '.join(columns)} FROM {of} WHERE {where}")


def _one(column: str, operator: str, value: object = None) -> dict:
    return {"column": column, "operator": operator, "value": value}


_filtered("f_eq", "orders", _ORDER_COLUMNS, [_one("o_orderstatus", "=", "F")], "o_orderstatus = 'F'")
_filtered("f_ne", "orders", _ORDER_COLUMNS, [_one("o_orderstatus", "!=", "F")], "o_orderstatus <> 'F'")
_filtered("f_gt", "orders", _ORDER_COLUMNS, [_one("o_totalprice", ">", "250000")], "o_totalprice > 250000")
_filtered("f_lt", "orders", _ORDER_COLUMNS, [_one("o_totalprice", "<", 20000)], "o_totalprice < 20000")
_filtered("f_ge", "lineitem", ("l_orderkey", "l_linenumber", "l_quantity"), [_one("l_quantity", ">=", 49)], "l_quantity >= 49")
_filtered("f_le", "lineitem", ("l_orderkey", "l_linenumber", "l_quantity"), [_one("l_quantity", "<=", 2)], "l_quantity <= 2")
_filtered("f_in", "customer", ("c_custkey", "c_mktsegment"), [_one("c_mktsegment", "in", ["BUILDING", "MACHINERY"])], "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filtered("f_in_empty", "customer", ("c_custkey", "c_mktsegment"), [_one("c_mktsegment", "IN", [])], "FALSE")
_filtered("f_like", "part", ("p_partkey", "p_name"), [_one("p_name", "LIKE", "red%")], "p_name LIKE 'red%'")
_filtered("f_ilike", "part", ("p_partkey", "p_name"), [_one("p_name", "ILIKE", "%BOLT")], "p_name ILIKE '%BOLT'")
_filtered("f_like_number", "part", ("p_partkey", "p_size"), [_one("p_size", "LIKE", "4%")], "CAST(p_size AS VARCHAR) LIKE '4%'")
_filtered("f_and", "orders", _ORDER_COLUMNS, [_one("o_orderstatus", "=", "O"), _one("o_totalprice", ">", 300000)], "o_orderstatus = 'O' AND o_totalprice > 300000")
_filtered("f_or", "orders", _ORDER_COLUMNS, {"logic": "OR", "filters": [_one("o_orderstatus", "=", "P"), _one("o_totalprice", "<", 5000)]}, "o_orderstatus = 'P' OR o_totalprice < 5000")
_filtered("f_date", "orders", ("o_orderkey", "o_orderdate"), [_one("o_orderdate", ">=", "1995-01-01"), _one("o_orderdate", "<=", "1995-03-31")], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
_filtered("f_date_in", "orders", ("o_orderkey", "o_orderdate"), [_one("o_orderdate", "IN", ["1995-01-02", "1996-02-03"])], "CAST(o_orderdate AS DATE) IN (DATE '1995-01-02', DATE '1996-02-03')")
_filtered("f_empty", "nation", ("n_nationkey", "n_name"), [], "TRUE")
_filtered("f_absent_column", "nation", ("n_nationkey",), [_one("no_such", "=", "x")], "FALSE")


def _nullable(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))


_NULLABLE = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)"
add("f_isnull", lambda t: apply_filters(_nullable(t), [_one("status", "IS NULL")]), f"SELECT * FROM {_NULLABLE} WHERE status IS NULL")
add("f_notnull", lambda t: apply_filters(_nullable(t), [_one("status", "IS NOT NULL")]), f"SELECT * FROM {_NULLABLE} WHERE status IS NOT NULL")
add("f_ne_null", lambda t: apply_filters(_nullable(t), [_one("status", "!=", "F")]), f"SELECT * FROM {_NULLABLE} WHERE status <> 'F'")

# Sorting and paging

add("q_default_page", lambda t: paging.sorted_page(t("orders").select(*_ORDER_COLUMNS), page=2, row_id="o_orderkey"), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 20")
add("q_sort_page", lambda t: paging.sorted_page(t("orders").select(*_ORDER_COLUMNS), [_one("o_orderstatus", "=", "O")], "o_totalprice", page=3, page_size=50, row_id="o_orderkey"), _ORDER + "o_orderstatus = 'O' ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
add("q_sort_desc_page", lambda t: paging.sorted_page(t("orders").select(*_ORDER_COLUMNS), None, "o_totalprice", "DESC", 2, 100, "o_orderkey"), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 100")
add("q_sort_nulls_last", lambda t: paging.sorted_page(_nullable(t), None, "status", "DESC", 1, 30, "o_orderkey"), f"SELECT * FROM {_NULLABLE} ORDER BY status DESC NULLS LAST, o_orderkey LIMIT 30")
add("q_sort_text_date", lambda t: paging.sorted_page(t("orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), None, "o_orderdate", "asc", 1, 25, "o_orderkey"), "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 25")
add("q_count", lambda t: apply_filters(t("orders"), [_one("o_totalprice", ">", 100000)]).agg(F.count(F.lit(1)).alias("total")), "SELECT count(*) AS total FROM orders WHERE o_totalprice > 100000")

# Aggregation


def _metric(name: str, metric: str, sql: str, digits: int | None = None) -> None:
    alias = agg.parse_metric(metric).alias
    value = f"round({sql}, {digits})" if digits is not None else sql

    def run(t: Callable[[str], DataFrame]) -> DataFrame:
        out = agg.aggregate(t("lineitem"), ["l_returnflag"], [metric])
        return rounded(out, digits, alias) if digits is not None else out

    add(name, run, f"SELECT l_returnflag, {value} AS {alias} FROM lineitem GROUP BY l_returnflag")


_metric("a_count", "COUNT(*)", "count(*)")
_metric("a_count_col", "count(l_shipdate)", "count(l_shipdate)")
_metric("a_sum", "SUM(l_extendedprice)", "sum(l_extendedprice)", 2)
_metric("a_sum_int", "SUM(l_linenumber)", "CAST(sum(l_linenumber) AS DOUBLE)")
_metric("a_avg", "AVG(l_discount)", "avg(l_discount)", 6)
_metric("a_min", "MIN(l_extendedprice)", "min(l_extendedprice)")
_metric("a_max", "MAX(l_linestatus)", "max(l_linestatus)")
_metric("a_max_date", "MAX(l_shipdate)", "CAST(max(l_shipdate) AS DATE)")
_metric("a_stddev", "STDDEV(l_quantity)", "stddev_samp(l_quantity)", 6)
add(
    "a_multi_key",
    lambda t: rounded(agg.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], ["SUM(l_quantity)", "AVG(l_extendedprice)", "COUNT(*)"]), 4, "sum_l_quantity", "avg_l_extendedprice"),
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice, count(*) AS count_all FROM lineitem GROUP BY ALL",
)
add(
    "a_filtered",
    lambda t: rounded(agg.aggregate(t("orders"), ["o_orderstatus"], ["SUM(o_totalprice)", "COUNT(*)"], [_one("o_totalprice", ">", 100000)]), 2, "sum_o_totalprice"),
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice, count(*) AS count_all FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus",
)
add(
    "a_topk",
    lambda t: rounded(agg.aggregate(t("part"), ["p_brand"], ["AVG(p_retailprice)", "COUNT(*)"], limit=10), 6, "avg_p_retailprice"),
    "SELECT p_brand, round(avg(p_retailprice), 6) AS avg_p_retailprice, count(*) AS count_all FROM part GROUP BY p_brand ORDER BY avg(p_retailprice) DESC NULLS LAST, p_brand LIMIT 10",
)
add(
    "a_sort_key_asc",
    lambda t: agg.aggregate(t("part"), ["p_size"], ["COUNT(*)"], sort_by="p_size", sort_dir="ASC", limit=12),
    "SELECT p_size, count(*) AS count_all FROM part GROUP BY p_size ORDER BY p_size LIMIT 12",
)
add("a_null_group", lambda t: agg.aggregate(_nullable(t), ["status"], ["COUNT(*)", "COUNT(status)"]), f"SELECT status, count(*) AS count_all, count(status) AS count_status FROM {_NULLABLE} GROUP BY status")

# Time series

for _unit in agg.UNITS:
    add(
        f"t_{_unit}",
        lambda t, unit=_unit: rounded(agg.series(t("orders"), "o_orderdate", "SUM(o_totalprice)", unit), 2, "value"),
        f"SELECT date_trunc('{_unit}', CAST(o_orderdate AS TIMESTAMP)) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1",
    )
add("t_count_filtered", lambda t: agg.series(t("orders"), "o_orderdate", "COUNT(*)", "quarter", [_one("o_orderstatus", "=", "F")]), "SELECT date_trunc('quarter', CAST(o_orderdate AS TIMESTAMP)) AS period, count(*) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
add("t_resample_avg", lambda t: rounded(timeseries.resample(t("orders"), "o_orderdate", "o_totalprice", "month", "AVG"), 4, "value"), "SELECT date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS period, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
_MONTHS = "(SELECT date_trunc('month', CAST(o_orderdate AS TIMESTAMP)) AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1)"
add(
    "t_moving_avg",
    lambda t: rounded(timeseries.moving_average(t("orders"), "o_orderdate", "o_totalprice", 3, "month"), 2, "value", "moving_avg"),
    f"SELECT period, round(v, 2) AS value, CASE WHEN row_number() OVER (ORDER BY period) >= 3 THEN round(round(avg(v) OVER (ORDER BY period ROWS 2 PRECEDING), 4), 2) END AS moving_avg FROM {_MONTHS}",
)
add(
    "t_moving_avg_daily",
    lambda t: rounded(timeseries.moving_average(t("events"), "ts", "value", 7, "day"), 2, "value", "moving_avg"),
    "SELECT period, round(v, 2) AS value, CASE WHEN row_number() OVER (ORDER BY period) >= 7 THEN round(round(avg(v) OVER (ORDER BY period ROWS 6 PRECEDING), 4), 2) END AS moving_avg FROM (SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS period, sum(value) AS v FROM events GROUP BY 1)",
)
add(
    "t_growth",
    lambda t: rounded(timeseries.growth_rate(t("orders"), "o_totalprice", "o_orderdate", "month"), 2, "value", "growth_pct"),
    f"SELECT period, round(v, 2) AS value, round(round(CASE WHEN p <> 0 THEN (v - p) / abs(p) * 100 END, 4), 2) AS growth_pct FROM (SELECT period, v, lag(v) OVER (ORDER BY period) AS p FROM {_MONTHS})",
)

# Profiles


def _profile_sql(of: str, column: str, kind: str) -> str:
    length = f"length({column})"
    return (
        f"SELECT '{column}' AS column_name, '{kind}' AS data_type, count(*) AS total_count, count({column}) AS non_null_count, count(*) - count({column}) AS null_count, count(DISTINCT {f'CAST({column} AS DATE)' if kind == 'date' else column}) AS distinct_count, "
        + (f"CAST(CAST(min({column}) AS DATE) AS VARCHAR) AS min_value, CAST(CAST(max({column}) AS DATE) AS VARCHAR) AS max_value, " if kind == "date" else "NULL::VARCHAR AS min_value, NULL::VARCHAR AS max_value, ")
        + (f"round(avg({column}), 6) AS avg_value, round(stddev_samp({column}), 6) AS stddev_value, " if kind == "numeric" else "NULL::DOUBLE AS avg_value, NULL::DOUBLE AS stddev_value, ")
        + (f"CAST(min({length}) AS BIGINT) AS min_length, CAST(max({length}) AS BIGINT) AS max_length, round(avg({length}), 6) AS avg_length " if kind == "text" else "NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, NULL::DOUBLE AS avg_length ")
        + f"FROM {of}"
    )


def _profiled(name: str, of: str, columns: dict[str, str]) -> None:
    def run(t: Callable[[str], DataFrame]) -> DataFrame:
        out = rounded(profile.profile(t(of), list(columns)), 6, "avg_value", "stddev_value", "avg_length")
        number = F.col("data_type") == "numeric"
        return out.withColumns({c: F.when(number, F.round(F.col(c).cast("double"), 2).cast("string")).otherwise(F.col(c)) for c in ("min_value", "max_value")})

    parts = [_profile_sql(of, c, k) for c, k in columns.items()]
    parts = [p.replace("NULL::VARCHAR AS min_value, NULL::VARCHAR AS max_value", f"CAST(round(CAST(min({c}) AS DOUBLE), 2) AS VARCHAR) AS min_value, CAST(round(CAST(max({c}) AS DOUBLE), 2) AS VARCHAR) AS max_value") if k == "numeric" else p for p, (c, k) in zip(parts, columns.items())]
    add(name, run, " UNION ALL ".join(parts))


_profiled("p_numeric", "orders", {"o_totalprice": "numeric"})
_profiled("p_text", "part", {"p_name": TEXT})
_profiled("p_date", "orders", {"o_orderdate": DATE})
_profiled("p_dataset", "customer", {"c_custkey": "numeric", "c_name": TEXT, "c_nationkey": "numeric", "c_mktsegment": TEXT, "c_acctbal": "numeric"})
add("o_distinct_ratio", lambda t: profile.distinct_ratio(t("part"), "p_name"), "SELECT 'p_name' AS column_name, coalesce(count(DISTINCT p_name) / nullif(count(*), 0), 0)::DOUBLE AS distinct_ratio FROM part")

# Statistics

_MOMENTS = "(SELECT count(x) AS n, avg(x) AS m, min(x) AS low, max(x) AS high, median(x) AS mid, stddev_samp(x) AS s, var_samp(x) AS v, kurtosis_pop(x) AS k FROM d)"
_BASIC = """WITH d AS (SELECT CAST({c} AS DOUBLE) AS x FROM {t} WHERE {c} IS NOT NULL), e AS MATERIALIZED (SELECT * FROM """ + _MOMENTS + """)
SELECT any_value(n) AS count, round(any_value(m), 6) AS mean, round(any_value(mid), 6) AS median, round(any_value(s), 6) AS std, round(any_value(v), 2) AS variance, any_value(low) AS min, any_value(high) AS max,
round(avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5), 6) AS skewness, round(any_value(k), 6) AS kurtosis FROM d, e"""


def _basic(name: str, of: str, column: str) -> None:
    add(name, lambda t: rounded(rounded(statistics.basic_stats(t(of), column), 6, "mean", "median", "std", "skewness", "kurtosis"), 2, "variance"), _BASIC.format(c=column, t=of))


def _quantiles(name: str, of: str, column: str) -> None:
    told = ", ".join(f"round(quantile_cont({column}, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 99))
    add(name, lambda t: rounded(statistics.quantiles(t(of), column), 6, "p25", "p50", "p75", "p90", "p99"), f"SELECT {told} FROM {of}")


_basic("s_basic", "events", "value")
_basic("s_basic_orders", "orders", "o_totalprice")
_quantiles("s_quantiles", "lineitem", "l_extendedprice")
_quantiles("s_quantiles_ties", "lineitem", "l_quantity")
add(
    "s_hist",
    lambda t: statistics.histogram(t("events"), "value", 20),
    """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events),
    c AS (SELECT least(floor((value - a) / (b - a) * 20), 19)::INT AS bucket, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1)
    SELECT g.bucket::INT AS bucket, round(a + (b - a) * g.bucket / 20, 6) AS lower, round(a + (b - a) * (g.bucket + 1) / 20, 6) AS upper,
    round((a + (b - a) * g.bucket / 20 + a + (b - a) * (g.bucket + 1) / 20) / 2, 6) AS center, coalesce(n, 0) AS count
    FROM range(20) AS g(bucket) CROSS JOIN e LEFT JOIN c ON c.bucket = g.bucket""",
)
_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
add(
    "s_corr",
    lambda t: statistics.correlations(t("lineitem"), list(_FOUR)).withColumn("r", F.round("r", 3) + 0.0),
    " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {'1.0' if a == b else f'round(round(corr({a}, {b}), 4), 3) + 0.0'}::DOUBLE AS r FROM {'(SELECT 1)' if a == b else 'lineitem'}" for a in _FOUR for b in _FOUR),
)


def _outliers(name: str, of: str, column: str, key: str) -> None:
    add(
        name,
        lambda t: rounded(statistics.outliers(t(of), column, row_id=key), 4, "value"),
        f"""WITH q AS (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {of}),
        f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q),
        o AS (SELECT t.{key}, CAST(t.{column} AS DOUBLE) AS v, f.* FROM {of} t, f WHERE t.{column} < f.lower OR t.{column} > f.upper)
        SELECT {key}, round(v, 4) AS value, round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(lower, 4) AS lower, round(upper, 4) AS upper, (SELECT count(*) FROM o) AS outlier_total
        FROM o ORDER BY v, {key} LIMIT 200""",
    )


_outliers("s_outliers", "documents", "n_chars", "doc_id")
_outliers("s_outliers_capped", "events", "value", "event_id")

# Search

_WORDS = "(SELECT doc_id, [w for w in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if w <> ''] AS w FROM documents)"
_PART_WORDS = "(SELECT p_partkey, [w for w in regexp_split_to_array(lower(concat_ws(' ', coalesce(p_name, ''), coalesce(p_type, ''))), '[^\\p{L}\\p{N}]+') if w <> ''] AS w FROM part)"
_NONE: frozenset[str] = frozenset()


def _found(name: str, text: str, condition: str) -> None:
    add(name, lambda t: search.matching_rows(t("documents"), text, ["text"], _NONE, stems=False).select("doc_id"), f"SELECT doc_id FROM {_WORDS} WHERE {condition}")


_found("g_term", "clown", "list_contains(w, 'clown')")
_found("g_and", "the und", "list_contains(w, 'the') AND list_contains(w, 'und')")
_found("g_or", "clown OR bleed", "list_contains(w, 'clown') OR list_contains(w, 'bleed')")
_found("g_not", "the -was", "list_contains(w, 'the') AND NOT list_contains(w, 'was')")
_found("g_phrase", '"the on"', "contains(' ' || array_to_string(w, ' ') || ' ', ' the on ')")
_found("g_phrase_not", 'the -"of the"', "list_contains(w, 'the') AND NOT contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
add("g_stop_words", lambda t: search.matching_rows(t("documents"), "the und of", ["text"], STOP_WORDS, stems=False).select("doc_id"), f"SELECT doc_id FROM {_WORDS} WHERE list_contains(w, 'und')")
add("g_multi_col", lambda t: search.matching_rows(t("part"), "red economy", ["p_name", "p_type"], _NONE, stems=False).select("p_partkey"), f"SELECT p_partkey FROM {_PART_WORDS} WHERE list_contains(w, 'red') AND list_contains(w, 'economy')")
add(
    "g_ranked",
    lambda t: search.search(t("documents"), "und", ["text"], "doc_id", _NONE, stems=False).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50),
    f"""SELECT doc_id, round(s / (s + 1), 6) AS score FROM (SELECT doc_id, list_sum([0.1 / (j * j) for j in range(1, least(n, 255) + 1)]) / 1.64493406685 AS s FROM
    (SELECT doc_id, len([x for x in w if x = 'und']) AS n FROM {_WORDS}) WHERE n > 0) ORDER BY round(s / (s + 1), 6) DESC, doc_id LIMIT 50""",
)
add(
    "g_ranked_and",
    lambda t: search.search(t("part"), "red economy", ["p_name", "p_type"], "p_partkey", _NONE, stems=False).select("p_partkey", F.round("score", 6).alias("score")),
    f"""WITH placed AS (SELECT p_partkey, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM {_PART_WORDS}),
    pairs AS (SELECT a.p_partkey, greatest(abs(a.p - b.p), 1)::DOUBLE AS d FROM placed a JOIN placed b USING (p_partkey) WHERE a.word = 'red' AND b.word = 'economy'),
    s AS (SELECT p_partkey, 1 - product(1 - sqrt(0.01 * CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)) AS s FROM pairs GROUP BY p_partkey)
    SELECT p_partkey, round(s / (s + 1), 6) AS score FROM s""",
)
add(
    "g_index",
    lambda t: search.inverted_index(t("part"), "p_name", "p_partkey").select("term", "p_partkey", F.size("places").cast("long").alias("n")),
    "SELECT term, p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest([w for w in regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+') if w <> '']) AS term FROM part) GROUP BY ALL",
)

_ON_FORMS = "'^on(e|es|ed|ing|ingly|edly)$'"
_STEMS_RANKED = f"""SELECT doc_id, round(s / (s + 1), 6) AS score FROM (SELECT doc_id, list_sum([0.1 / (j * j) for j in range(1, least(n, 255) + 1)]) / 1.64493406685 AS s FROM
    (SELECT doc_id, len([x for x in w if regexp_matches(x, {_ON_FORMS})]) AS n FROM {_WORDS}) WHERE n > 0)"""
add("g_stems", lambda t: search.matching_rows(t("documents"), "oning", ["text"]).select("doc_id"), f"SELECT doc_id FROM {_WORDS} WHERE len([x for x in w if regexp_matches(x, {_ON_FORMS})]) > 0")
add("g_stems_phrase", lambda t: search.matching_rows(t("part"), '"blue bolts"', ["p_name", "p_type"]).select("p_partkey"), f"SELECT p_partkey FROM {_PART_WORDS} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' blue bolt ')")
add("g_stems_ranked", lambda t: search.search(t("documents"), "oned", ["text"], "doc_id").select("doc_id", F.round("score", 6).alias("score")), _STEMS_RANKED)


def _indexed(name: str, of: str, columns: list[str], key: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = search.SearchIndex(spark, shared_folder(spark, "search-index")).build(table(spark, sf_dir, of), columns, key)
        return index.search(text).select(F.col("row_id").alias(key), F.round("score", 6).alias("score"))

    QUERIES[name], ORACLES[name] = run, sql


_indexed("g_index_ranked", "documents", ["text"], "doc_id", "oning", _STEMS_RANKED)
_indexed("g_index_and", "part", ["p_name", "p_type"], "p_partkey", "red economy", ORACLES["g_ranked_and"])

# Export, ingest, catalog, streams


def _raw_csv(spark: SparkSession, text: str) -> str:
    """A folder with one CSV file of this text."""
    folder = f"{shared_folder(spark, 'csv')}/raw.csv"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    return folder


def _csv_case(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _raw_csv(spark, text)
        csv_source.ingest_csv(spark, path, f"{path}.typed")
        return spark.read.parquet(f"{path}.typed")

    QUERIES[name], ORACLES[name] = run, sql


_csv_case("i_headers", " n ,n,t\n1,2,x\n3,,y", "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 2::BIGINT, 'x'), (2, 3, NULL, 'y')) AS v(_row_id, n, n_1, t)")
_csv_case("i_quotes", 'a,b\n"x, y","say ""hi"""\n"two\nlines",z', """SELECT * FROM (VALUES (1::BIGINT, 'x, y', 'say "hi"'), (2, 'two' || chr(10) || 'lines', 'z')) AS v(_row_id, a, b)""")
_csv_case("i_dates_and_numbers", 'd,n\n15/01/2024,"1,234.5"\n2024-01-16,1e3', "SELECT * FROM (VALUES (1::BIGINT, DATE '2024-01-15', 1234.5::DOUBLE), (2, DATE '2024-01-16', 1000)) AS v(_row_id, d, n)")


def _row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("n"))
    return rows.select("k", F.explode(csv_source.row_errors({"k": "numeric", "n": "numeric"})).alias("error"))


QUERIES["i_row_errors"] = _row_errors
ORACLES["i_row_errors"] = "SELECT CAST(c_custkey AS VARCHAR) AS k, '''n'': cannot parse ''' || c_name || ''' as numeric' AS error FROM customer"


def _exported(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    text = export.export(rows, kind, [_one("n_nationkey", "<", 5)], row_id="n_nationkey")
    return spark.createDataFrame([(text,)], "text string")


QUERIES["o_csv_text"] = lambda spark, sf_dir: _exported(spark, sf_dir, "csv").select(F.explode(F.split(F.translate("text", "\r", ""), "\n")).alias("line")).where("line <> ''")
ORACLES["o_csv_text"] = "SELECT 'n_nationkey,n_name' AS line UNION ALL SELECT n_nationkey || ',' || n_name FROM nation WHERE n_nationkey < 5"
QUERIES["o_json_text"] = lambda spark, sf_dir: _exported(spark, sf_dir, "json").select(F.explode(F.from_json("text", "array<struct<n_nationkey: bigint, n_name: string>>")).alias("r")).select("r.*")
ORACLES["o_json_text"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey < 5"


def _catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark, "catalog")
    for of in ("orders", "part", "nation"):
        Catalog(spark, root).register_parquet(f"{sf_dir}/{of}.parquet", of, owner=1 if of != "nation" else 2)
    return Catalog(spark, root).datasets(1).select("id", "name", "row_count")


QUERIES["c_datasets"] = _catalogued
ORACLES["c_datasets"] = "SELECT 1::BIGINT AS id, 'orders' AS name, (SELECT count(*) FROM orders) AS row_count UNION ALL SELECT 2, 'part', (SELECT count(*) FROM part)"


def _catalogued_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Catalog(spark, shared_folder(spark, "catalog")).register_parquet(f"{sf_dir}/part.parquet", "part")
    return spark.createDataFrame([(c["name"], c["type"], c["name"] in found.text_columns) for c in found.schema["columns"]], "name string, type string, searched boolean")


QUERIES["c_columns"] = _catalogued_columns
ORACLES["c_columns"] = "SELECT column_name AS name, CASE WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'numeric' END AS type, data_type = 'VARCHAR' AS searched FROM information_schema.columns WHERE table_name = 'part'"


def _page_with_total(t: Callable[[str], DataFrame]) -> DataFrame:
    page = paging.query(t("orders").select(*_ORDER_COLUMNS), [_one("o_orderstatus", "=", "P")], "o_totalprice", "DESC", 1, 10, "o_orderkey")
    return page.rows.withColumn("total", F.lit(page.total).cast("long"))


add("q_page_with_total", _page_with_total, "SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
add(
    "s_all",
    lambda t: statistics.statistics(t("lineitem"), "l_quantity").select("count", "median", "min", "max", "p25", "p75", "p99"),
    "SELECT count(l_quantity) AS count, median(l_quantity)::DOUBLE AS median, min(l_quantity)::DOUBLE AS min, max(l_quantity)::DOUBLE AS max, quantile_cont(l_quantity, 0.25)::DOUBLE AS p25, quantile_cont(l_quantity, 0.75)::DOUBLE AS p75, quantile_cont(l_quantity, 0.99)::DOUBLE AS p99 FROM lineitem",
)
add("a_summary", lambda t: rounded(agg.summarise(t("orders"), ["SUM(o_totalprice)"], date_column="o_orderdate", unit="year"), 2, "value"), "SELECT date_trunc('year', CAST(o_orderdate AS TIMESTAMP)) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")

add("o_export_flat", lambda t: export.export_rows(t("nation"), [_one("n_regionkey", "=", 1)], row_id="n_nationkey"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
add(
    "e_windowed_counts",
    lambda t: rounded(windowed_counts(t("events"), width="7 days"), 2, "total"),
    "SELECT time_bucket(INTERVAL 7 DAY, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') AS period, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), F.round("o_totalprice", 2).alias("o_totalprice"))
    rows.orderBy("o_orderkey").write.csv(f"{folder}/raw.csv", header=True)
    csv_source.ingest_csv(spark, f"{folder}/raw.csv", f"{folder}/typed")
    return spark.read.parquet(f"{folder}/typed")


QUERIES["i_csv_infer"] = _csv_round_trip
ORACLES["i_csv_infer"] = "SELECT row_number() OVER (ORDER BY o_orderkey) AS _row_id, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders"
