import json

import pytest

from lakemill.operators.aggregate import aggregate, parse_metric, series
from lakemill.operators.filters import apply_filters, parse_filters
from lakemill.operators.paging import query


def names(df):
    return {r["name"] for r in df.collect()}


def one(column, operator, value=None):
    return {"column": column, "operator": operator, "value": value}


@pytest.mark.parametrize(
    "filters, expected",
    [
        ([one("age", ">", 25)], {"Alice", "Charlie", "Diana"}),
        ([one("age", ">", "25")], {"Alice", "Charlie", "Diana"}),
        ([one("city", "!=", "NYC")], {"Bob", "Charlie", "Eve"}),
        ([one("city", "in", ["LA", "Chicago"])], {"Bob", "Charlie", "Eve"}),
        ([one("city", "IN", [])], set()),
        ([one("name", "LIKE", "%e")], {"Alice", "Charlie", "Eve"}),
        ([one("name", "ilike", "a%")], {"Alice"}),
        ([one("age", "LIKE", "2%")], {"Bob", "Diana", "Eve"}),
        ([one("name", "IS NULL")], {None}),
        ([one("joined", ">=", "2023-01-10")], {"Charlie", "Eve"}),
        ({"logic": "OR", "filters": [one("age", "<", 23), one("city", "=", "Chicago")]}, {"Eve", "Charlie"}),
        (json.dumps([one("score", "<=", 87)]), {"Bob", "Charlie"}),
        ([one("nothing", "=", "x")], set()),
    ],
)
def test_filters(people, filters, expected):
    assert names(apply_filters(people, filters)) == expected


def test_everything_passes_an_empty_group(people):
    assert apply_filters(people, []).count() == apply_filters(people, None).count() == 6


@pytest.mark.parametrize("column", ["age; DROP TABLE users--", "col'injection", "col OR 1=1", "bad-name", "1starts_with_num"])
def test_unsafe_names(people, column):
    with pytest.raises(ValueError, match="Unsafe"):
        apply_filters(people, [one(column, "=", 1)])


@pytest.mark.parametrize("filters", [[one("age", "BETWEEN", 1)], [one("age", "=", "abc")], [one("joined", "=", "soon")], [one("city", "IN", "LA")], "[", 7, {"logic": "XOR", "filters": []}])
def test_bad_filters(people, filters):
    with pytest.raises(ValueError):
        apply_filters(people, filters)


def test_missing_keys():
    with pytest.raises(KeyError):
        parse_filters([{"column": "a"}])


def test_pages_partition_the_result(people):
    seen = [r["_row_id"] for p in range(1, 4) for r in query(people, None, "age", "DESC", p, 2).rows.collect()]
    assert seen == [3, 1, 4, 2, 5, 6]
    beyond = query(people, None, page=9, page_size=2)
    assert beyond.total == 6 and beyond.rows.count() == 0


def test_metrics():
    assert parse_metric("SUM(revenue)").alias == "sum_revenue"
    assert parse_metric("count(*)").alias == "count_all"
    for bad in ("revenue", "SUM()", "MEDIAN(age)", "SUM(*)", "", None):
        with pytest.raises(ValueError):
            parse_metric(bad)


def test_aggregate(people):
    got = {r["city"]: (r["count_all"], r["avg_age"], r["stddev_age"]) for r in aggregate(people, ["city"], ["COUNT(*)", "AVG(age)", "STDDEV(age)"]).collect()}
    assert got["NYC"] == (2, 29.0, pytest.approx(2**0.5)) and got["Chicago"] == (1, 35.0, None) and got[None] == (1, None, None)
    with pytest.raises(ValueError):
        aggregate(people, [], ["COUNT(*)"])
    with pytest.raises(ValueError):
        aggregate(people, ["city"], ["COUNT(*)"], sort_by="1; DROP")
    with pytest.raises(ValueError):
        aggregate(people, ["city"], ["SUM(name)"])


def test_series(people):
    assert [(str(r["period"])[:4], r["value"]) for r in series(people, "joined", "COUNT(*)", "year").collect()] == [("2021", 1), ("2022", 2), ("2023", 2)]
    with pytest.raises(ValueError):
        series(people, "joined", "COUNT(*)", "hour")
