"""Session helpers: table access and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that Spark hands a Python worker at a time, unless the session says otherwise: texts are long, and a worker holds a batch several times over.
ARROW_ROWS = 2500
_ARROW_ROWS_KEY, _ARROW_ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: And bytes, about, as executor and worker hold a batch of long texts beside each other.
ARROW_BYTES = 4 << 20
_ARROW_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once a Spark application, as ``--py-files`` would, and keep Arrow batches small."""
    context = spark.sparkContext
    if spark.conf.get(_ARROW_ROWS_KEY, _ARROW_ROWS_DEFAULT) == _ARROW_ROWS_DEFAULT:
        spark.conf.set(_ARROW_ROWS_KEY, str(ARROW_ROWS))
    if spark.conf.get(_ARROW_BYTES_KEY, None) is None:
        spark.conf.set(_ARROW_BYTES_KEY, str(ARROW_BYTES))
    if getattr(context, "_lakemill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="lakemill-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("lakemill", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._lakemill_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); a local one where none is set and all is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakemill-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
