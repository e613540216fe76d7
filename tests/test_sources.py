import json

import pytest

from lakemill.functions.parsing import clean
from lakemill.sources import csv_source, export
from lakemill.sources.catalog import Catalog, NotFound
from pyspark.sql import functions as F

SAMPLE = "name,age,city,score,joined\nAlice,30,NYC,95.5,2022-03-15\nBob,25,LA,87.0,2021-07-01\nCharlie,35,Chicago,72.3,2023-01-10\n"


def ingest(spark, tmp_path, text, name="a.csv"):
    (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    types = csv_source.ingest_csv(spark, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}.typed")
    return types, spark.read.parquet(f"file://{tmp_path}/{name}.typed")


def test_sample(spark, tmp_path):
    types, df = ingest(spark, tmp_path, SAMPLE)
    assert types == {"name": "text", "age": "numeric", "city": "text", "score": "numeric", "joined": "date"}
    assert dict(df.dtypes) == {"_row_id": "bigint", "name": "string", "age": "bigint", "city": "string", "score": "double", "joined": "date"}
    assert [r["_row_id"] for r in df.orderBy("_row_id").collect()] == [1, 2, 3]


@pytest.mark.parametrize("text", ["", "name,age\n"])
def test_empty(spark, tmp_path, text):
    with pytest.raises(ValueError, match="empty"):
        ingest(spark, tmp_path, text)


def test_quotes_breaks_and_empty_cells(spark, tmp_path):
    _, df = ingest(spark, tmp_path, 'name,address,n\nA,"123 Main St, Apt 4",1\nB,"two\nlines",\nC,"say ""hi""",3\n')
    rows = {r["name"]: (r["address"], r["n"]) for r in df.collect()}
    assert rows == {"A": ("123 Main St, Apt 4", 1), "B": ("two\nlines", None), "C": ('say "hi"', 3)}


def test_latin1_and_mark(spark, tmp_path):
    _, df = ingest(spark, tmp_path, ("name,note\n" + "café,entrée\n" * 3).encode("latin-1"), "l.csv")
    assert {r["name"] for r in df.collect()} == {"café"}
    _, df = ingest(spark, tmp_path, b"\xef\xbb\xbfname,age\nA,1\n", "b.csv")
    assert df.columns == ["_row_id", "name", "age"]


def test_first_rows_are_strict_and_later_ones_lenient(spark, tmp_path):
    with pytest.raises(ValueError, match="'n': cannot parse 'x' as numeric"):
        ingest(spark, tmp_path, "n\n" + "1\n" * 9 + "x\n", "s.csv")
    _, df = ingest(spark, tmp_path, "n\n" + "1\n" * 200 + "x\n", "t.csv")
    assert df.where("n IS NULL").count() == 1


def test_headers():
    assert csv_source.normalise_header(["score", "score", "score"]) == ["score", "score_1", "score_2"]
    assert csv_source.normalise_header([" name ", "age "]) == ["name", "age"]
    assert len(set(csv_source.normalise_header(["a", "a", "a_1"]))) == 3


def test_inference(spark):
    kinds = csv_source.infer_types(spark.createDataFrame([("1,234.56", "1", None, "2024-01-15")] * 2 + [("2,000", "x", None, "01/15/2024")] * 2, "a string, b string, c string, d string"))
    assert kinds == {"a": "numeric", "b": "text", "c": "text", "d": "date"}


@pytest.mark.parametrize(
    "cell, kind, value",
    [("0", "numeric", 0), ("-1", "numeric", -1), ("1e3", "numeric", 1000), ("1.5e-2", "numeric", 0.015), ("1,000", "numeric", 1000), ("-0", "numeric", 0), ("N/A", "numeric", None), ("nan", "numeric", None), ("inf", "numeric", None), ("1d", "numeric", None), ("1e400", "numeric", None), ("  ", "text", None), (" a ", "text", "a")]
    + [(d, "date", "2024-01-15") for d in ("2024-01-15", "01/15/2024", "15/01/2024", "2024/01/15", "15-01-2024", "2024-01-15T10:30:00")]
    + [(d, "date", None) for d in ("not-a-date", "32/01/2024", "n/a")],
)
def test_cleaning(spark, cell, kind, value):
    got = spark.createDataFrame([(cell,)], "c string").select(clean(F.col("c"), kind).alias("v")).first()["v"]
    assert (str(got) if kind == "date" and got else got) == value


def test_catalog(spark, tmp_path):
    (tmp_path / "x.csv").write_text(SAMPLE)
    catalog = Catalog(spark, f"file://{tmp_path}/sets")
    found = catalog.ingest_csv(f"file://{tmp_path}/x.csv", "people", owner=7)
    assert found.row_count == 3 and found.text_columns == ["name", "city"] and catalog.frame(found.id, 7).count() == 3
    assert [r["name"] for r in catalog.datasets(7).collect()] == ["people"] and catalog.datasets(8).count() == 0
    with pytest.raises(NotFound):
        catalog.info(found.id, 8)
    with pytest.raises(ValueError):
        catalog.ingest_csv("x.txt", "no")


def test_second_catalog_on_one_root(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n1\n2\n")
    (tmp_path / "b.csv").write_text("n\n7\n8\n9\n")
    root = f"file://{tmp_path}/sets"
    first = Catalog(spark, root).ingest_csv(f"file://{tmp_path}/a.csv", "a")
    other = Catalog(spark, root)
    second = other.ingest_csv(f"file://{tmp_path}/b.csv", "b")
    assert [r["n"] for r in other.frame(second.id, 1).orderBy("n").collect()] == [7, 8, 9]
    assert [r["n"] for r in other.frame(first.id, 1).orderBy("n").collect()] == [1, 2] and second.id != first.id
    assert [r["name"] for r in Catalog(spark, root).datasets(1).collect()] == ["b", "a"] and other.info(first.id, 1) == first
    with pytest.raises(ValueError, match="exists"):
        csv_source.ingest_csv(spark, f"file://{tmp_path}/b.csv", first.path)
    assert other.frame(first.id, 1).count() == 2
    (tmp_path / "c.csv").write_text("n\n" + "1\n" * 9 + "x\n")
    with pytest.raises(ValueError, match="cannot parse"):
        other.ingest_csv(f"file://{tmp_path}/c.csv", "c")
    assert other.datasets(1).count() == 2 and sorted(p.name for p in (tmp_path / "sets").iterdir()) == ["1-1", "1-2", "_catalog"]


def test_row_numbers_follow_files_and_lines(spark, tmp_path):
    (tmp_path / "many.csv").mkdir()
    for k in range(3):
        (tmp_path / "many.csv" / f"part-{k}.csv").write_text("n,t\n" + "".join(f"{k * 40_000 + i},{'x' * (3 - k)}\n" for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        _, df = csv_source.ingest_csv(spark, f"file://{tmp_path}/many.csv", f"file://{tmp_path}/typed"), spark.read.parquet(f"file://{tmp_path}/typed")
        assert df.count() == 120_000 and df.where("_row_id <> n + 1").count() == 0
        assert csv_source.read_csv(spark, f"file://{tmp_path}/many.csv").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_export(people):
    text = export.export(people, "csv", [{"column": "age", "operator": ">", "value": 29}])
    assert text.splitlines()[0] == "_row_id,name,age,city,score,joined" and len(text.splitlines()) == 3
    assert json.loads(export.export(people, "json", page_size=2))[1]["name"] == "Bob"
    assert export.to_csv([]) == ""
    for bad in ({"kind": "xml"}, {"page_size": 0}):
        with pytest.raises(ValueError):
            export.export(people, **bad)
