"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing (operator 9).

Vectors are put on the unit sphere of one dimension more, where the largest inner product is the least
distance (Bachrach et al., 2014). A table cuts that space by ``m`` random projections into slots of width
``w`` (Datar et al., 2004), placed so that an edge lies in the middle of a sample; ``m`` grows with the logarithm of the number
of rows. A query visits buckets in the order of the chance that a neighbour lies there, until these
chances add up to the table's share of ``recall`` (Lv et al., 2007), for a neighbour as far as the query's own k-th is expected among all rows,
from its distances to a sample. Visits meet the buckets' contents by bucket, and only visited buckets are scored, exactly, on the vectors as
given; buckets over ``BLOCK`` are dealt over several groups. A query that is left without ``k`` is scored against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .bytewords import mix
from .scratch import BROADCAST_BYTES, Scratch, bounded_broadcast, matching
from .vectors import matrix, usable

#: Vectors that the slots and each query's distance are fitted on, at most.
SAMPLE = 4000
#: Vectors that a task scores at a time, about.
BLOCK = 16_384
_QUERIES = 128
#: Bytes of queries, with the buckets that they visit, that a task holds, about.
QUERY_BYTES = 32 << 20
#: Pairs that a task holds before it keeps only the best of each query.
_PENDING = 1 << 20
#: Rows within the expected distance of so many times ``k`` leave the groups. A query for which they turn out to be fewer than ``k`` is scored against all rows.
_WIDE = 3
_FOUND = "query_id long, vec_id long, score double"


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def _combinations(cost: np.ndarray, first: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Costs, ascending, and codes of one slot each of some projections; those over the cheapest by more than ``most`` have next to no chance."""
    total, code = np.zeros(1), np.zeros(1, np.int64)
    for i, own in enumerate(cost):
        some = np.flatnonzero(own - own.min() <= most)
        total = (total[:, None] + own[some][None, :]).ravel()
        code = (code[:, None] + (some << 2 * (first + i))[None, :]).ravel()
        near = total - total.min() <= most
        total, code = total[near], code[near]
    order = np.argsort(total, kind="stable")
    return total[order], code[order]


def probes(chance: np.ndarray, share: float) -> np.ndarray:
    """Codes of the likeliest combinations of slots that have ``share`` of the chances together, from each projection's chances by slot.

    Either half of the projections has its combinations by cost, the negative logarithm of their chance; the cost up to which sums of two
    are visited is found by halving. Combinations under exp(-10) of the likeliest are left out of a half.
    """
    cost = -np.log(np.maximum(chance, 1e-12))
    m = len(cost)
    (a, code_a), (b, code_b) = _combinations(cost[: m // 2], 0, 10.0), _combinations(cost[m // 2 :], m // 2, 10.0)
    p, gathered = np.exp(-a), np.append(0, np.cumsum(np.exp(-b)))
    low, high = a[0] + b[0], a[-1] + b[-1]
    for _ in range(16):
        middle = (low + high) / 2
        if p @ gathered[np.searchsorted(b, middle - a, side="right")] >= share:
            high = middle
        else:
            low = middle
    n = np.searchsorted(b, high - a + 1e-9, side="right")
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(code_a, n) + code_b[j]


@dataclass
class Tables:
    """Projections of each table with their three slot edges, and the fitted sample: a bounded number of vectors."""

    axes: np.ndarray  # tables x dims + 1 x m
    edges: np.ndarray  # tables x m x 3
    longest: float
    ids: np.ndarray
    points: np.ndarray
    rows: int
    k: int

    @classmethod
    def fit(cls, ids: np.ndarray, x: np.ndarray, longest: float, rows: int, k: int, tables: int) -> Tables:
        m = min(30, max(2, math.ceil(math.log2(max(rows, 2) / 16)) + 1))
        rng = np.random.Generator(np.random.PCG64(9))
        axes = rng.standard_normal((tables, x.shape[1] + 1, m))
        out = cls(axes, np.empty(0), longest, *(y[np.unique(ids, return_index=True)[1]] for y in (ids, x)), rows, k)
        out.points = out.lifted(out.points)
        placed = np.einsum("nd,tdm->tmn", out.points, axes)
        width = np.maximum(2.5 * placed.std(axis=2), 1e-9)  # two slots hold nearly all, two more the rest
        out.edges = np.median(placed, axis=2)[:, :, None] + width[:, :, None] * np.array([-1, 0, 1])  # floors of (place - shift) / width, the outer ones open
        return out

    @property
    def nbytes(self) -> int:
        return self.axes.nbytes + self.edges.nbytes + self.ids.nbytes + self.points.nbytes

    def lifted(self, v: np.ndarray) -> np.ndarray:
        v = v / self.longest
        return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))[:, None]], axis=1)

    def asked(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v / np.sqrt((v * v).sum(axis=1))[:, None], np.zeros((len(v), 1))], axis=1)

    def buckets(self, v: np.ndarray) -> np.ndarray:
        """The code of each vector's bucket in each table."""
        up, out = self.lifted(v), np.zeros((len(self.axes), len(v)), np.int64)
        for t, (axes, edges) in enumerate(zip(self.axes, self.edges)):
            slot = (up @ axes)[:, :, None] >= edges
            out[t] = slot.sum(axis=2) @ (1 << 2 * np.arange(axes.shape[1], dtype=np.int64))
        return out

    def expected(self, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of asked queries the inner product expected of their ``_WIDE * k``-th of all rows and of their k-th; -inf with fewer than k in the sample.

        Also the mean of the k nearest of the sample without its part along the query, and the root mean square distance from both parts: vectors
        of unlike lengths all have a large last component, which no query has.

        Near a query the number of rows within a distance goes with a power of it, which the sample's k nearest tell (Levina and Bickel, 2004). A
        sample of a third of the rows or more holds a row of about the first distance itself, or too few rows for any limit (-inf).
        """
        least, there = np.full(len(q), -np.inf), np.full(len(q), -np.inf)
        drift, spread = np.zeros_like(q), np.ones(len(q))
        share = len(self.ids) / max(self.rows, len(self.ids))
        deep = max(self.k, math.ceil(_WIDE * self.k * share))
        for a in range(0, len(q), _QUERIES):
            near = np.where(self.ids[None, :] == own[a : a + _QUERIES, None], -np.inf, q[a : a + _QUERIES] @ self.points.T)
            if near.shape[1] < self.k:
                continue
            some = min(deep, near.shape[1])
            at = np.argpartition(near, near.shape[1] - some, axis=1)[:, near.shape[1] - some :]
            at = np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, axis=1), axis=1), axis=1)
            best = np.take_along_axis(near, at, axis=1)
            far = np.sqrt(np.maximum(2 - 2 * best[:, : self.k], 1e-12))
            power = max(self.k - 1, 1) / np.maximum(np.log(far[:, -1:] / far).sum(axis=1), 1e-9)
            power = 1 / np.clip(power, 1, 500)
            shrunk, wide = far[:, -1] * share**power, far[:, -1] * (_WIDE * share) ** power
            if deep > self.k:
                wide = np.sqrt(np.maximum(2 - 2 * best[:, -1], 1e-12)) if some == deep else np.full(len(best), np.inf)
            fits = best[:, self.k - 1] > -np.inf
            least[a : a + _QUERIES][fits], there[a : a + _QUERIES][fits] = (1 - wide * wide / 2 - 1e-9)[fits], (1 - shrunk * shrunk / 2)[fits]
            mean = self.points[at[:, : self.k]].mean(axis=1)
            along = np.where(fits[:, None], best[:, : self.k], 0)
            mean -= along.mean(axis=1)[:, None] * q[a : a + _QUERIES]
            left = 1 - (along * along).mean(axis=1) - (mean * mean).sum(axis=1)
            drift[a : a + _QUERIES], spread[a : a + _QUERIES] = mean, np.sqrt(np.maximum(left * (1 + 2 / self.k), 1e-6))
        return least, there, drift, spread

    def visits(self, q: np.ndarray, there: float, drift: np.ndarray, spread: float, recall: float) -> list[np.ndarray]:
        """The buckets that one asked query visits in each table, for a neighbour at the inner product ``there``.

        On a projection such a neighbour lies normally about the place of ``there * q + drift``, with the deviation ``spread``.
        """
        share = 1 - (1 - recall) ** (1 / len(self.axes))
        mean = there * q + drift
        out = []
        for axes, edges in zip(self.axes, self.edges):
            below = _normal((edges - (mean @ axes)[:, None]) / spread)
            out.append(probes(np.diff(below, axis=1, prepend=0, append=1), share))
        return out


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query, an id once with its best score, ties to the smaller id."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[once], ids[once], score[once]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], score[kept]


def _scored(have: pd.DataFrame, want: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of each query the ``k`` best rows of the buckets that it visits, bucket by bucket."""
    if not len(have) or not len(want):
        return pd.DataFrame({"query_id": pd.Series(dtype=np.int64), "vec_id": pd.Series(dtype=np.int64), "score": pd.Series(dtype=float)})
    have = have.sort_values("bucket", kind="stable", ignore_index=True)
    v, ids, bucket = matrix(have["raw"].tolist()), have["id"].to_numpy(np.int64), have["bucket"].to_numpy(np.int64)
    q, own, least = matrix(want["raw"].tolist()), want["id"].to_numpy(np.int64), want["least"].to_numpy(float).copy()
    of = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(of[1:], len(bucket))
    visits = [np.frombuffer(b, np.int64) for b in want["buckets"]]
    who, names = np.repeat(np.arange(len(q)), [len(b) for b in visits]), np.concatenate(visits)
    at = np.minimum(np.searchsorted(bucket[of], names), len(of) - 1)
    hit = bucket[of][at] == names
    who, at = who[hit], at[hit]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    pending: list[tuple] = []
    held = 0
    for b in np.unique(at).tolist():
        asking = who[np.searchsorted(at, b) : np.searchsorted(at, b, side="right")]
        for a in range(0, len(asking), _QUERIES):
            some = asking[a : a + _QUERIES]
            near = q[some] @ v[of[b] : ends[b]].T
            i, j = np.nonzero((near >= (least[some] - 1e-9 * (1 + np.abs(least[some])))[:, None]) & (ids[None, of[b] : ends[b]] != own[some][:, None]))
            if len(i):
                i, j = some[i], of[b] + j
                pending.append((i, ids[j], (q[i] * v[j]).sum(axis=1)))
                held += len(i)
            if held > _PENDING:  # what is not among a query's k best here is not among its k best of all
                pending = [_best(*map(np.concatenate, zip(*pending)), k)]
                i, _, s = pending[0]
                last = np.flatnonzero(np.append(i[1:] != i[:-1], True))
                full = last[np.diff(np.append(-1, last)) == k]
                least[i[full]] = np.maximum(least[i[full]], s[full])
                held = len(i)
    query, found, score = _best(*map(np.concatenate, zip(*pending)), k) if pending else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pd.DataFrame({"query_id": own[query], "vec_id": found, "score": score})


_CELL = ["t", "part", "sub"]


def _answers(want: DataFrame, have: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """``(query_id, vec_id, score)``, repeated ones possible: the queries of ``want (t, part, sub, id, raw, least, buckets)`` in blocks of bounded bytes meet the rows of ``have (t, part, sub, bucket, id, raw)``."""
    load = want.groupBy(*_CELL).agg(F.ceil(F.sum(F.length("raw") + F.length("buckets")) / QUERY_BYTES).cast("int").alias("blocks"))
    load = scratch.table(load, f"{name}-load")  # only cells that are asked
    have = have.join(load, _CELL).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    want = want.join(load, _CELL).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int")).drop("blocks")
    met = have.groupBy(*_CELL, "block").cogroup(want.groupBy(*_CELL, "block"))
    return met.applyInPandas(lambda have, want: _scored(have, want, k), _FOUND)


def _all_rows(want: DataFrame, have: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
    """The queries ``(id, raw)`` against all rows ``(id, raw)`` of their own length."""
    parts = have.groupBy(F.length("raw").alias("part")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    zero = F.lit(0).alias("t"), F.col("part").cast("long").alias("part")
    have = have.withColumn("part", F.length("raw")).join(parts, "part").select(*zero, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("sub"), F.lit(0).cast("long").alias("bucket"), "id", "raw")
    want = want.withColumn("part", F.length("raw")).join(parts, "part").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    want = want.select(*zero, "sub", "id", "raw", F.lit(float("-inf")).alias("least"), F.lit(bytes(8)).alias("buckets"))
    return _answers(want, have, k, scratch, name)


def _indexed(rows: DataFrame, queries: DataFrame, n: int, k: int, recall: float, tables: int, scratch: Scratch, name: str) -> DataFrame:
    """The queries of one length against the buckets that they visit; those for which the sample holds too few are left out."""
    spark = rows.sparkSession
    size = rows.select(F.length("raw").alias("n")).first()["n"]
    sample = rows.orderBy(F.xxhash64("id"), "id", "raw").limit(max(1, min(SAMPLE, BROADCAST_BYTES // (2 * size + 64)))).collect()  # a bounded number of vectors

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("raw").to_pylist()) if batch.num_rows else np.zeros((1, 1))
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((v * v).sum(axis=1)).max())])], ["norm"])

    longest = rows.select("raw").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    fitted = Tables.fit(np.array([r["id"] for r in sample], np.int64), matrix([r["raw"] for r in sample]), longest, n, k, tables)
    shared = bounded_broadcast(spark, fitted, fitted.nbytes)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, code in enumerate(shared.value.buckets(matrix(batch.column("raw").to_pylist()))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t, np.int32)), pa.array(code), batch.column("id"), batch.column("raw")], ["t", "bucket", "id", "raw"])

    index = rows.mapInArrow(filed, "t int, bucket long, id long, raw binary")
    # a bucket over this size is dealt over groups of its own; there are no more of them than may be broadcast
    large = max(BLOCK, 32 * tables * n // BROADCAST_BYTES)
    hot = index.groupBy("t", "bucket").count().where(F.col("count") > large).toPandas().sort_values(["t", "bucket"])
    by_table = [(own["bucket"].to_numpy(np.int64), -(-own["count"].to_numpy(np.int64) // large)) for own in (hot[hot["t"] == t] for t in range(tables))]
    split = bounded_broadcast(spark, by_table, 32 * len(hot))
    parts = max(1, -(-n // BLOCK))

    def place(t: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each bucket, and into how many groups it is dealt: 0 where it shares one with others."""
        names, into = split.value[t]
        part, subs = (mix(code.view(np.uint64)) % np.uint64(parts)).astype(np.int64), np.zeros(len(code), np.int64)
        if len(names):
            at = np.minimum(np.searchsorted(names, code), len(names) - 1)
            subs = np.where(names[at] == code, into[at], 0)
            part = np.where(subs > 0, code, part)
        return part, subs

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, code, ids = (batch.column(c).to_numpy() for c in ("t", "bucket", "id"))
            part, sub = np.zeros(len(t), np.int64), np.full(len(t), -1, np.int64)
            for own in np.unique(t).tolist():
                at = np.flatnonzero(t == own)
                part[at], subs = place(own, code[at])
                deal = (mix(ids[at].astype(np.int64).view(np.uint64)) % np.maximum(subs, 1).astype(np.uint64)).astype(np.int64)
                sub[at] = np.where(subs > 0, deal, -1)
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(part), pa.array(sub.astype(np.int32)), *(batch.column(c) for c in ("bucket", "id", "raw"))], [*_CELL, "bucket", "id", "raw"])

    have = index.mapInArrow(placed, "t int, part long, sub int, bucket long, id long, raw binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, ids = batch.column("raw").to_pylist(), batch.column("id").to_numpy()
            v = matrix(raw)
            q = shared.value.asked(v)
            least, there, drift, spread = shared.value.expected(q, ids)
            least = least * np.sqrt((v * v).sum(axis=1)) * longest  # of the vectors as they are
            out = []
            for i in np.flatnonzero(there > -np.inf).tolist():
                for t, code in enumerate(shared.value.visits(q[i], float(there[i]), drift[i], float(spread[i]), recall)):
                    part, subs = place(t, code)
                    for hit in np.flatnonzero(subs).tolist():
                        out += [(t, int(part[hit]), s, ids[i], raw[i], least[i], code[hit : hit + 1].tobytes()) for s in range(subs[hit])]
                    order = np.argsort(part, kind="stable")
                    order = order[subs[order] == 0]
                    cuts = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(order) else order
                    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                        out.append((t, int(part[order[a]]), -1, ids[i], raw[i], least[i], code[order[a:b]].tobytes()))
                if len(out) > 4096 or i == len(q) - 1:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [*_CELL, "id", "raw", "least", "buckets"])

    want = queries.repartition(max(1, min(n // 20_000 + 1, 10_000)), "id").mapInArrow(ask, "t int, part long, sub int, id long, raw binary, least double, buckets binary")
    return _answers(scratch.table(want, f"{name}-visits"), have, k, scratch, name)


def nearest(table: DataFrame, is_query: Column, k: int = 20, recall: float = 0.94, tables: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query row the ``k`` rows found with the largest inner product.

    Nearest first, equal scores by the smaller id. Candidates are all rows with another id and a vector of the query's length, scored in double precision
    on the vectors as they are; with fewer than ``k`` such ids, all of them. A null id, and a vector that is null, empty,
    zero or holds a null or non-finite component, takes no part. A repeated id
    counts once, with its best score, and queries once per id with the vector of the fewest bytes, then the smallest. No rows give none.

    Each length of more than ``BLOCK`` rows has an index of its own (at least the most frequent one has); rows of the others are compared with all of their length.
    ``recall`` is the chance that a visited bucket holds a neighbour as far as the query's k-th is expected, from at most ``SAMPLE`` rows.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "neighbours")
    ready = usable(table.where(F.col(id_col).isNotNull()), id_col, vector_col).where("raw is not null")
    rows = scratch.table(ready.distinct(), "rows")
    lengths = rows.groupBy(F.length("raw").alias("bytes")).count().orderBy(F.desc("count"), "bytes")
    first = lengths.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed = {r["bytes"]: r["count"] for r in lengths.where(F.col("count") > BLOCK).collect()} or {first[0]["bytes"]: first[0]["count"]}
    queries = rows.withColumnRenamed("id", id_col).where(is_query).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.length("raw"), "raw")).getField("raw").alias("raw"))
    queries = scratch.table(queries, "queries")

    def ranked(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        told = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return told.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    parts = []
    for size, n in indexed.items():
        of_size = F.length("raw") == size
        parts.append(_indexed(rows.where(of_size), queries.where(of_size), n, k, recall, tables, scratch, f"of-{size}"))
    found = parts[0]
    for other in parts[1:]:
        found = found.union(other)
    found = scratch.table(ranked(found), "found")
    enough = found.where(F.col("rank") == k).select("query_id")
    short = scratch.table(matching(queries, "id", enough, "left_anti"), "short")
    if not short.head(1):
        return found
    return matching(found, "query_id", enough).union(ranked(_all_rows(short, rows, k, scratch, "short")))
