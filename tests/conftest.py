import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    rows = [
        (1, "Alice", 30, "NYC", 95.5, "2022-03-15"),
        (2, "Bob", 25, "LA", 87.0, "2021-07-01"),
        (3, "Charlie", 35, "Chicago", 72.3, "2023-01-10"),
        (4, "Diana", 28, "NYC", 91.0, "2022-11-20"),
        (5, "Eve", 22, "LA", 88.5, "2023-06-05"),
        (6, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "_row_id long, name string, age long, city string, score double, joined string").selectExpr("_row_id", "name", "age", "city", "score", "to_date(joined) AS joined")
