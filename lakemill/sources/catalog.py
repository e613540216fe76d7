"""Datasets by owner: registration, listing, and access that checks the owner."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import ROW_ID, TEXT, column_types
from .csv_source import ingest_csv


class NotFound(LookupError):
    """No such dataset for this owner."""


@dataclass(frozen=True)
class Dataset:
    id: int
    owner: int
    name: str
    path: str
    types: dict[str, str]
    row_count: int
    row_id: str = ROW_ID
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @property
    def schema(self) -> dict:
        return {"columns": [{"name": n, "type": t} for n, t in self.types.items()]}

    @property
    def text_columns(self) -> list[str]:
        return [n for n, t in self.types.items() if t == TEXT]


class Catalog:
    """Datasets live in Parquet folders of their own, so a scan reads one dataset's columns and no other's rows.

    What is known of each is a small JSON file under ``root/_catalog``, which any later session reads; its number is taken by creating it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._home = f"{self.root}/_catalog"
        self._fs = self._path(self._home).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self._home)):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path(self._home)) if s.getPath().getName()[:-5].isdigit())

    def _write(self, file: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._path(file), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _take(self) -> int:
        """A number that no dataset has; creating a file that exists fails, so two sessions never take one."""
        number = max(self._numbers(), default=0) + 1
        while True:
            try:
                self._write(f"{self._home}/{number}.json", "", False)
                return number
            except Exception:  # Hadoop's file systems differ in what they raise
                if not self._fs.exists(self._path(f"{self._home}/{number}.json")):
                    raise
                number += 1

    def _read(self, number: int) -> Dataset | None:
        file = self._path(f"{self._home}/{number}.json")
        if not self._fs.exists(file):
            return None
        stream = self._fs.open(file)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if not text:  # being registered
            return None
        told = json.loads(text)
        return Dataset(**{**told, "created_at": datetime.fromisoformat(told["created_at"])})

    def _add(self, number: int, owner: int, name: str, path: str, row_id: str) -> Dataset:
        df = self.spark.read.parquet(path)
        found = Dataset(number, owner, name, path, {c: t for c, t in column_types(df).items() if c != row_id or row_id != ROW_ID}, df.count(), row_id)
        self._write(f"{self._home}/{number}.json", json.dumps({**asdict(found), "created_at": found.created_at.isoformat()}), True)
        return found

    def _given_up(self, number: int) -> None:
        self._fs.delete(self._path(f"{self._home}/{number}.json"), False)

    def register_parquet(self, path: str, name: str, owner: int = 1, row_id: str = ROW_ID) -> Dataset:
        number = self._take()
        try:
            return self._add(number, owner, name, path, row_id)
        except Exception:
            self._given_up(number)
            raise

    def ingest_csv(self, path: str, name: str, owner: int = 1) -> Dataset:
        """A new dataset of a CSV file; an invalid one leaves nothing."""
        if not path.lower().endswith(".csv"):
            raise ValueError("Only .csv files are accepted")
        number = self._take()
        try:
            target = f"{self.root}/{owner}-{number}"
            ingest_csv(self.spark, path, target)
            return self._add(number, owner, name, target, ROW_ID)
        except Exception:
            self._given_up(number)
            raise

    def datasets(self, owner: int) -> DataFrame:
        """``(id, name, row_count, created_at)``, the newest first."""
        rows = [(d.id, d.name, d.row_count, d.created_at) for d in map(self._read, self._numbers()) if d and d.owner == owner]
        return self.spark.createDataFrame(rows, "id long, name string, row_count long, created_at timestamp").orderBy(F.desc("created_at"), F.desc("id"))

    def info(self, dataset: int, owner: int) -> Dataset:
        if (found := self._read(dataset)) is None or found.owner != owner:
            raise NotFound(dataset)
        return found

    def frame(self, dataset: int, owner: int) -> DataFrame:
        return self.spark.read.parquet(self.info(dataset, owner).path)
