"""Vectors in Arrow batches: which of them count, and their bytes as doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kind_of(table: DataFrame, vector_col: str) -> str:
    """The numpy type that holds the vectors' components as they are: single precision where the column has it."""
    return "<f4" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def usable(table: DataFrame, id_col: str, vector_col: str, kind: str = "<f8") -> DataFrame:
    """``(id, raw)`` of every row; ``raw`` are the vector's numbers, null where it takes no part in comparisons.

    That is: a null id, or a vector that is null, empty, zero, or holds a null or non-finite component. -0.0 counts as 0.0.
    """
    value = F.col("v")
    fine = F.col("id").isNotNull() & value.isNotNull() & (F.size(value) > 0) & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.select("id", F.when(fine, value).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            offs = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
            ok = column.is_valid().to_numpy(zero_copy_only=False)
            raw = [values[a:b].tobytes() if valid else None for a, b, valid in zip(offs[:-1].tolist(), offs[1:].tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "raw"])

    return rows.mapInArrow(pack, "id long, raw binary")


def matrix(raw: list[bytes], kind: str = "<f8") -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(raw), kind).astype(float, copy=False).reshape(len(raw), -1)
