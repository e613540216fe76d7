import numpy as np
import pytest

from lakemill.operators import profile, statistics, timeseries
from lakemill.types import UnknownColumn, WrongType


@pytest.fixture(scope="module")
def hundred(spark):
    return spark.range(1, 101).selectExpr("id AS _row_id", "double(id) AS x", "double(2 * id) AS y", "double(-id) AS z", "5.0D AS c", "string(id) AS t")


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "_row_id long, x double")


def test_quantiles(hundred):
    assert statistics.quantiles(hundred, "x").first().asDict() == pytest.approx({"p25": 25.75, "p50": 50.5, "p75": 75.25, "p90": 90.1, "p99": 99.01})


@pytest.mark.parametrize("kind", ["normal", "ties", "wild", "one"])
def test_exact_quantiles_are_numpys(spark, kind):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float), "wild": np.exp(rng.normal(0, 60, 3000)) * rng.choice([-1, 1], 3000), "one": np.array([3.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    shares = [0, 0.01, 0.25, 0.5, 0.9, 1]
    assert statistics.exact_quantiles(df, "x", shares) == pytest.approx([float(np.percentile(values, 100 * p)) for p in shares], rel=1e-12)


@pytest.mark.parametrize("values, want", [([1.0, 2.0, float("inf")], 2.0), ([float("inf")] * 3, float("inf")), ([float("-inf"), 1.0, 5.0], 1.0), ([float("-inf"), float("inf"), 3.0, float("nan")], 3.0), ([1.0, float("nan"), 3.0, None], 2.0), ([float("nan")], None), ([5e-324, 1e-323, 5e-324], 5e-324), ([-1.7e308, 1.7e308, 0.0], 0.0)])
def test_infinite_and_odd_values(spark, values, want):
    df = numbers(spark, values)
    assert statistics.exact_quantiles(df, "x", [0.5]) == [want] and statistics.basic_stats(df, "x").first()["median"] == want
    statistics.quantiles(df, "x").collect(), statistics.histogram(df, "x", 4).collect()
    assert statistics.outliers(df, "x").where("isnan(value)").count() == 0
    low, high = statistics.exact_quantiles(df, "x", [0, 1])
    kept = [v for v in values if v is not None and v == v]
    assert (low, high) == ((min(kept), max(kept)) if kept else (None, None))


def test_outliers_beyond_infinite_values(spark):
    rows = statistics.outliers(numbers(spark, [1.0, 2.0, 3.0, 2.0, 1.0, 2.0, float("inf")]), "x").collect()
    assert [(r["_row_id"], r["value"]) for r in rows] == [(6, float("inf"))]


def test_statistics_in_one_row(hundred):
    row = statistics.statistics(hundred, "x").first()
    assert row["median"] == 50.5 and row["p75"] == 75.25 and row["count"] == 100


def test_basic_stats(spark):
    got = statistics.basic_stats(numbers(spark, [float(i) for i in range(1, 11)]), "x").first()
    assert (got["count"], got["mean"], got["median"], got["min"], got["max"]) == (10, 5.5, 5.5, 1, 10)
    assert got["std"] == pytest.approx(np.std(range(1, 11), ddof=1)) and abs(got["skewness"]) < 1e-9
    one = statistics.basic_stats(numbers(spark, [4.0]), "x").first()
    assert one["mean"] == 4.0 and one["std"] is None and one["skewness"] is None
    none = statistics.basic_stats(numbers(spark, []), "x").first()
    assert none["count"] == 0 and none["mean"] is None


def test_histogram(spark, hundred):
    rows = statistics.histogram(hundred, "x", 10).collect()
    want, edges = np.histogram(range(1, 101), 10)
    assert [r["count"] for r in rows] == want.tolist() and [r["lower"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert sum(r["count"] for r in statistics.histogram(numbers(spark, [5.0] * 10), "x", 5).collect()) == 10
    assert statistics.histogram(numbers(spark, []), "x", 5).count() == 0


def test_correlations(hundred):
    r = {(x["column_a"], x["column_b"]): x["r"] for x in statistics.correlations(hundred, ["x", "y", "z", "c"]).collect()}
    assert r["x", "y"] == 1.0 and r["x", "z"] == -1.0 and r["y", "x"] == 1.0 and r["x", "c"] is None and len(r) == 16
    assert statistics.correlations(hundred, ["x"]).count() == 0


def test_outliers(spark, hundred):
    b = statistics.outlier_bounds(hundred, "x")
    assert b["iqr"] == 49.5 and statistics.outliers(hundred, "x").count() == 0
    rows = statistics.outliers(numbers(spark, [1.0, 2.0, 3.0, 2.0, 1.0, 1000.0]), "x").collect()
    assert [(r["_row_id"], r["value"], r["outlier_total"]) for r in rows] == [(5, 1000.0, 1)]
    assert statistics.outliers(numbers(spark, []), "x").count() == 0


def test_guards(hundred):
    with pytest.raises(UnknownColumn):
        statistics.quantiles(hundred, "nope")
    with pytest.raises(WrongType):
        statistics.quantiles(hundred, "t")


def days(spark, values):
    return spark.createDataFrame([(f"2024-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)], "d string, v double").selectExpr("to_date(d) AS d", "v")


def test_moving_average(spark):
    df = days(spark, [1, 2, 3, 4, 5, 6])
    assert [r["moving_avg"] for r in timeseries.moving_average(df, "d", "v", 3).collect()] == [None, None, 2, 3, 4, 5]
    assert {r["moving_avg"] for r in timeseries.moving_average(df, "d", "v", 9).collect()} == {None}
    with pytest.raises(ValueError):
        timeseries.moving_average(df, "d", "v", 0)


def test_growth(spark):
    assert [r["growth_pct"] for r in timeseries.growth_rate(days(spark, [100, 110, 99]), "v", "d", "day").collect()] == [None, 10, -10]
    assert [r["growth_pct"] for r in timeseries.growth_rate(days(spark, [0, 5]), "v", "d", "day").collect()] == [None, None]


def test_profile(people):
    rows = {r["column_name"]: r for r in profile.profile(people).collect()}
    assert (rows["age"]["total_count"], rows["age"]["null_count"], rows["age"]["min_value"], rows["age"]["max_value"]) == (6, 1, "22", "35")
    assert rows["city"]["distinct_count"] == 3 and rows["city"]["max_length"] == 7
    assert rows["joined"]["min_value"] == "2021-07-01"
    with pytest.raises(UnknownColumn):
        profile.profile(people, ["nope"])
    assert profile.distinct_ratio(people.limit(0), "city").first()["distinct_ratio"] == 0
