"""CSV ingest: header, encoding, type inference, validation and a typed Parquet dataset."""

from __future__ import annotations

import codecs
import csv
import io
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import clean, clean_date, clean_number, clean_text
from ..types import DATE, NUMERIC, ROW_ID, TEXT

#: Values looked at for a column's type, and the share of them that has to fit.
INFERENCE_ROWS, INFERENCE_SHARE = 500, 0.8
#: Rows that have to be valid; later cells that don't parse become null.
VALIDATED_ROWS = 100
_HEAD = 20_000


def normalise_header(names: list[str]) -> list[str]:
    """Trimmed names, repeated ones numbered ``x, x_1, x_2``; a number that another column bears is left out."""
    out: list[str] = []
    names = [n.strip() for n in names]
    for n in names:
        k, new = 0, n
        while new in out or k and new in names:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def detect_encoding(raw: bytes) -> str:
    """UTF-8 where the first bytes are, with or without a mark; else Latin-1."""
    if raw.startswith(codecs.BOM_UTF8):
        return "UTF-8"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(raw[:_HEAD], final=len(raw) <= _HEAD)
    except UnicodeDecodeError:
        return "ISO-8859-1"
    return "UTF-8"


def read_header(raw: bytes) -> list[str]:
    """Column names from a file's first bytes."""
    text = raw.decode("utf-8-sig" if detect_encoding(raw) == "UTF-8" else "latin-1", "replace")
    return normalise_header(next(csv.reader(io.StringIO(text), skipinitialspace=True), []))


def _first_file(spark: SparkSession, path: str):  # noqa: ANN202
    """File system and first file of a path, which may be a folder or a pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    told = sorted((s for s in (fs.globStatus(where) or [])), key=lambda s: s.getPath().toString())
    for s in told:
        inner = sorted(fs.listStatus(s.getPath()), key=lambda x: x.getPath().toString()) if s.isDirectory() else [s]
        for f in inner:
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")) and (f.getLen() or len(inner) == 1):
                return fs, f.getPath()
    raise ValueError(f"no file at {path}")


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the first file, read as a stream from any store that Hadoop reaches."""
    fs, first = _first_file(spark, path)
    stream = fs.open(first)
    try:
        return bytes(stream.readNBytes(4 * _HEAD))
    finally:
        stream.close()


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, so that a quoted cell may go on in the next line."""
    quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    return bool(spark.read.text(path).where(F.col("value").contains('"') & (quotes % 2 == 1)).head(1))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; an empty cell is null. Quotes and line breaks in quotes are read.

    Files are cut into splits; only where a line shows a line break in quotes is a file read by one task.
    """
    head = _head(spark, path)
    names = read_header(head)
    if not names or names == [""]:
        raise ValueError("CSV file is empty or has no data rows")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, schema=schema, header=True, multiLine=_breaks_in_quotes(spark, path), escape='"', ignoreLeadingWhiteSpace=True, nullValue="", encoding=detect_encoding(head), enforceSchema=True)


def infer_types(rows: DataFrame) -> dict[str, str]:
    """numeric, else date, where at least 0.8 of a sample's values are; else text. No rows, no types."""
    sample = rows.limit(INFERENCE_ROWS)
    fits = [F.avg(F.when(clean_text(F.col(f"`{c}`")).isNotNull(), f(F.col(f"`{c}`")).isNotNull().cast("int"))) for c in rows.columns for f in (clean_number, clean_date)]
    found = sample.agg(F.count(F.lit(1)), *fits).first()
    if not found[0]:
        return {}
    share = [v or 0.0 for v in found[1:]]
    return {c: NUMERIC if share[2 * i] >= INFERENCE_SHARE else DATE if share[2 * i + 1] >= INFERENCE_SHARE else TEXT for i, c in enumerate(rows.columns)}


def row_errors(types: dict[str, str]) -> Column:
    """An array of what doesn't parse: ``'col': cannot parse 'v' as type``."""
    told = [F.when((F.col(f"`{c}`") != "") & clean(F.col(f"`{c}`"), t).isNull(), F.concat(F.lit(f"'{c}': cannot parse '"), F.col(f"`{c}`"), F.lit(f"' as {t}"))) for c, t in types.items()]
    return F.filter(F.array(*told), lambda e: e.isNotNull())


_FILE, _AT, _NO = "_file", "_at", "_no"


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with where they come from: their file, their split's first byte, and ascending numbers within the task."""
    return rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_AT), F.monotonically_increasing_id().alias(_NO))


def _first_numbers(placed: DataFrame) -> DataFrame:
    """``(file, at, shift)``: what to add to a split's row numbers so that all rows are numbered from 1 in the order of files and places."""
    splits = placed.groupBy(_FILE, _AT).agg(F.count(F.lit(1)).alias("n"), F.min(_NO).alias("first"))
    before = F.sum("n").over(Window.orderBy(_FILE, _AT).rowsBetween(Window.unboundedPreceding, -1))  # a row per split
    return splits.select(_FILE, _AT, (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("shift"))


def ingest_csv(spark: SparkSession, path: str, target: str, validate_rows: int = VALIDATED_ROWS) -> dict[str, str]:
    """Write a typed Parquet dataset under ``target`` and return its types; nothing is left there if rows are invalid. An existing target is refused.

    Whole numbers below 2**53 become longs, other numbers doubles. The first ``validate_rows`` rows have to parse. Rows are numbered
    from 1 in the order of files and lines. The CSV is parsed once, into a staged table of texts that all other steps read.
    """
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path_of(target)):
        raise ValueError(f"{target} exists")
    parsed, staged = (f"{target.rstrip('/')}-{kind}-{uuid.uuid4().hex}" for kind in ("parsed", "staged"))
    try:
        raw = read_csv(spark, path)
        _placed(raw).write.parquet(parsed)
        told = spark.read.parquet(parsed)
        order = [_FILE, _AT, _NO]
        first = told.orderBy(*order).limit(max(INFERENCE_ROWS, validate_rows)).select(*(F.col(f"`{c}`") for c in raw.columns)).cache()  # a top-k of each task
        types = infer_types(first)
        if not types:
            raise ValueError("CSV file is empty or has no data rows")
        wrong = first.limit(validate_rows).select(F.explode(row_errors(types)).alias("e")).limit(10).collect()
        first.unpersist()
        if wrong:
            raise ValueError("; ".join(r["e"] for r in wrong))
        values = {c: clean(F.col(f"`{c}`"), t) for c, t in types.items()}
        numbers = [c for c, t in types.items() if t == NUMERIC]
        if numbers:
            whole = told.agg(*(F.bool_and((values[c] == F.floor(values[c])) & (F.abs(values[c]) <= 2**53)).alias(f"w{i}") for i, c in enumerate(numbers))).first()
            values |= {c: values[c].cast("long") for i, c in enumerate(numbers) if whole[i]}
        numbered = told.join(_first_numbers(told), [_FILE, _AT])
        numbered.select((F.col(_NO) + F.col("shift")).alias(ROW_ID), *(v.alias(c) for c, v in values.items())).write.parquet(staged)
        fs.mkdirs(path_of(target).getParent())
        if fs.exists(path_of(target)) or not fs.rename(path_of(staged), path_of(target)):
            raise ValueError(f"{target} exists")
    finally:
        for folder in (parsed, staged):
            fs.delete(path_of(folder), True)
    return types
