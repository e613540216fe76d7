"""Running and watching queries: timing, plan facts, a cache of small results, and advice on layouts."""

from __future__ import annotations

import hashlib
import json
import logging
import re
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import DATE, NUMERIC, TEXT, column_types, safe_name

log = logging.getLogger("lakemill")
#: Seconds from which a query is logged as slow.
SLOW = 1.0


def timed(action: Callable[[], Any], label: str = "query") -> tuple[Any, float]:
    """An action's result and its seconds; slow ones are warned of."""
    began = time.perf_counter()
    out = action()
    took = time.perf_counter() - began
    log.log(logging.WARNING if took >= SLOW else logging.DEBUG, "%s took %.3f s", label, took)
    return out, took


def run_seconds(df: DataFrame, label: str = "query") -> float:
    """Seconds of computing every row, without keeping any."""
    return timed(lambda: df.write.format("noop").mode("overwrite").save(), label)[1]


@dataclass(frozen=True)
class PlanFacts:
    text: str
    scans: list[str]
    pushed: list[str]
    shuffles: int
    python: bool
    advice: list[str] = field(default_factory=list)


def plan_facts(df: DataFrame) -> PlanFacts:
    """What Spark's formatted plan says of scans, pushed filters, shuffles and Python; scans without a pushed filter come with advice."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = re.split(r"\n(?=\(\d+\) )", text)
    scans = [p for p in parts if re.match(r"\(\d+\) Scan", p)]
    pushed = [m[1] for p in scans if (m := re.search(r"PushedFilters: (\[.+\])", p))]
    where = [m[1] if (m := re.search(r"Location: \w+ \[?([^\]\s]+)", p)) else "memory" for p in scans]
    advice = [f"{w}: no filter reaches the scan; sort or partition it by the column that queries filter on" for p, w in zip(scans, where) if "PushedFilters: [" not in p]
    return PlanFacts(text, where, pushed, sum(bool(re.match(r"\(\d+\) Exchange", p)) for p in parts), bool(re.search(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroupsInPandas", text)), list(dict.fromkeys(advice)))


def params_key(params: dict[str, Any]) -> str:
    """16 hex digits that name a query's parameters."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


class ResultCache:
    """Small collected results by dataset and parameters: the least recently used go first, and all after ``ttl`` seconds. Safe for threads."""

    def __init__(self, size: int = 256, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self._clock = size, ttl, clock
        self._kept: OrderedDict[tuple[Any, str], tuple[float, Any]] = OrderedDict()
        self._lock, self._hits, self._misses = threading.Lock(), 0, 0

    def get(self, dataset: Any, key: str) -> Any:
        with self._lock:
            kept = self._kept.get((dataset, key))
            if kept is None or kept[0] < self._clock():
                self._kept.pop((dataset, key), None)
                self._misses += 1
                return None
            self._kept.move_to_end((dataset, key))
            self._hits += 1
            return kept[1]

    def set(self, dataset: Any, key: str, value: Any, ttl: float | None = None) -> None:
        with self._lock:
            self._kept[dataset, key] = (self._clock() + (self.ttl if ttl is None else ttl), value)
            self._kept.move_to_end((dataset, key))
            while len(self._kept) > self.size:
                self._kept.popitem(last=False)

    def get_or_compute(self, dataset: Any, params: dict[str, Any], compute: Callable[[], Any], ttl: float | None = None) -> Any:
        key = params_key(params)
        if (out := self.get(dataset, key)) is None:
            self.set(dataset, key, out := compute(), ttl)
        return out

    def warm(self, dataset: Any, queries: Iterable[tuple[dict[str, Any], Callable[[], Any]]]) -> int:
        """Compute what is not there yet; a query that fails is logged and left out. How many were added."""
        added = 0
        for params, compute in queries:
            key = params_key(params)
            if self.get(dataset, key) is None:
                try:
                    self.set(dataset, key, compute())
                    added += 1
                except Exception:
                    log.exception("warming %s failed", params)
        return added

    def invalidate(self, dataset: Any) -> int:
        with self._lock:
            gone = [k for k in self._kept if k[0] == dataset]
            for k in gone:
                del self._kept[k]
            return len(gone)

    def clear(self) -> None:
        with self._lock:
            self._kept.clear()

    def stats(self) -> dict[str, float]:
        with self._lock:
            asked = self._hits + self._misses
            return {"size": len(self._kept), "hits": self._hits, "misses": self._misses, "hit_rate": self._hits / asked if asked else 0.0}


@dataclass(frozen=True)
class Advice:
    column: str
    layout: str
    reason: str
    together_with: str | None = None


def layout_advice(df: DataFrame, searched: Iterable[str] = (), distinct_share: float = 0.05) -> list[Advice]:
    """Layouts that serve filters: ``sort`` for numbers and dates, ``bloom`` for texts of many values, ``partition`` for few; searched texts have their index. One approximate aggregation."""
    types, searched = column_types(df), set(searched)
    texts = [c for c, t in types.items() if t == TEXT and c not in searched]
    shares = df.agg(*(F.coalesce(F.try_divide(F.approx_count_distinct(F.col(f"`{c}`")), F.count(F.lit(1))), F.lit(0.0)).alias(c) for c in texts)).first() if texts else {}
    out = []
    for c, t in types.items():
        if t in (NUMERIC, DATE):
            out.append(Advice(c, "sort", f"{t} columns are filtered by range"))
        elif c in texts:
            out.append(Advice(c, "bloom", f"{shares[c]:.0%} of its values are distinct") if shares[c] >= distinct_share else Advice(c, "partition", "few distinct values"))
    numbers, dates = ([c for c, t in types.items() if t == kind] for kind in (NUMERIC, DATE))
    if dates and numbers:
        out.append(Advice(dates[0], "sort", "ranges of dates with a number", numbers[0]))
    if len(numbers) > 1:
        out.append(Advice(numbers[0], "sort", "two numbers filtered together", numbers[1]))
    return out


def write_sorted(df: DataFrame, column: str, path: str, partitions: int | None = None) -> None:
    """A copy laid out by ranges of a column, whose row groups' least and greatest values let scans skip."""
    by = F.col(f"`{safe_name(column)}`")
    (df.repartitionByRange(partitions, by) if partitions else df.repartitionByRange(by)).sortWithinPartitions(by).write.parquet(path)


def layout_bytes(df: DataFrame) -> DataFrame:
    """``(file, bytes)`` of the files behind a dataset, by Spark's own file listing."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
