"""Written tables in the shared checkpoint folder, and broadcasts whose size is checked.

``spark.checkpoint.dir`` is read from the session; only where it is unset (tests, a laptop) a temporary
folder is made. Lineage is cut by writing Parquet there: the files survive lost executors, and a retry of
a later stage reads them again instead of recomputing what came before.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest object that an operator broadcasts, in bytes. What may grow with the data is joined beyond it.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured and driver and tasks are one machine's."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        if base := conf.get("spark.checkpoint.dir", None):
            return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="lakemill-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Tables of one run of an operator. ``drop`` frees one early; the rest go when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = f"{self.root}/{name}"
        self._fs(path).delete(self._path(path), True)


def bounded_broadcast(spark: SparkSession, value, size: int):
    """Broadcast ``value``, whose size in bytes the caller knows; larger ones are refused."""
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes are more than may be broadcast ({BROADCAST_BYTES})")
    return spark.sparkContext.broadcast(value)


def trim() -> None:
    """Give back to the machine what this worker has freed: Python workers outlive their tasks, and keep the most that any of them held."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of the GNU C library alone
        ctypes.CDLL(None).malloc_trim(0)


#: What this Python worker keeps from one task to the next: one thing, and its name.
_KEPT: dict[tuple, object] = {}


def kept(name: tuple, make: Callable[[], object]) -> object:
    """What ``make`` made for a task of this worker, kept until another thing is, or a :func:`lean` task of another operator starts; the first part of ``name`` is the operator's."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go(keep: str = "") -> None:
    """Drop what is kept but for things of ``keep``, and give back what is free."""
    for name in [x for x in _KEPT if x[0] != keep]:
        del _KEPT[name]
    trim()


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for ``mapInArrow``, around which its worker gives memory back: before it, with what other operators keep, and when it ends, as an idle worker stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keep)
        yield from task(batches)
        trim()

    return run


def lean_group(task: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same of a function of a group's rows, for ``applyInPandas``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        let_go()
        out = task(rows)
        trim()
        return out

    return run


def sampled(rows: DataFrame, columns: list[str], wanted: int, n: int) -> DataFrame:
    """About ``wanted`` of the ``n`` rows, or all if there are no more: those under a bound of 63 bits of their hash, the same each time."""
    if n <= wanted:
        return rows
    return rows.where(F.xxhash64(*columns).bitwiseAND((1 << 63) - 1) < max(1, (wanted << 63) // n))


#: Ids that are broadcast to prune a large table, at most; more are joined by shuffles. Of strings, as many as take 16 bytes each.
PRUNED_IDS = 4_000_000


def matching(table: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``table`` whose ``column`` is among the ``ids`` (one column), or with ``left_anti`` those whose isn't.

    Up to ``PRUNED_IDS`` ids are broadcast, so the table isn't shuffled; null is never among them.
    """
    ids = ids.toDF("_id")
    if ids.schema["_id"].dataType.simpleString() == "string":
        few = (ids.agg(F.sum(16 + F.octet_length("_id"))).first()[0] or 0) <= 16 * PRUNED_IDS
    else:
        few = ids.limit(PRUNED_IDS + 1).count() <= PRUNED_IDS
    return table.join(F.broadcast(ids) if few else ids, F.col(column) == F.col("_id"), how)
