"""Near-duplicate vectors by random hyperplanes in several tables (operator 7).

A vector's sign pattern against ``bits`` random hyperplanes names its bucket in a table (Charikar, 2002).
Vectors that share a bucket are compared by exact cosine, in numpy blocks of bounded size: pairs are counted
there, never sent. A pair counts in the first table where it meets, so each link counts once. Of a
bucket's links only one edge per vector leaves the task, to its block's smallest linked vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, least_linked
from .scratch import Scratch
from .vectors import kind_of, matrix, usable

#: Vectors of one bucket that are held against each other at a time.
BLOCK = 2048
#: Rows that one task compares, about.
_BIN = 8192
#: Buckets over ``BLOCK`` that are broadcast, at most; of more, all are joined by shuffles.
_HOT = 200_000


def table_sizes(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits and tables: buckets of about 256 unlike vectors, and a pair at ``cosine`` met with probability ``recall``."""
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2) / 256))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _planes(dims: int, columns: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dims)).standard_normal((dims, columns))


def near_duplicate_vectors(table: DataFrame, cosine: float = 0.95, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``table``.

    Two rows link when they were found and their cosine, in double precision, is ``cosine`` or more; ``recall`` is the chance
    that a pair just there is found, and closer pairs are found more surely. Rows with equal vectors are one
    node with their number and always link. ``n_links`` counts the other rows linked directly. A vector that is null, empty, zero
    or holds a null or non-finite component links with nothing and is its own component; so does a row with a null
    id, whose component is null and which is not kept. Rows with the same id and unlike vectors stay two nodes
    of one name. Vectors of unlike lengths link with none of the others. Other columns are ignored; no rows give none.
    """
    scratch = Scratch(table.sparkSession, "embedding-dedup")
    kind = kind_of(table, vector_col)
    named = usable(table, id_col, vector_col, kind).withColumns({"high": F.xxhash64("raw"), "low": F.xxhash64(F.lit(7), "raw")})
    rows = scratch.table(named, "rows")
    alike = rows.where("raw is not null").groupBy("high", "low", F.length("raw").alias("bytes"))
    nodes = scratch.table(alike.agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")), "nodes")
    n = nodes.count()
    bits, tables = table_sizes(n, cosine, recall)
    weights, size = 1 << np.arange(bits, dtype=np.int64), np.dtype(kind).itemsize
    code = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            where = np.array([len(r) // size for r in raw])
            signs = np.empty((len(raw), tables), np.int64)
            for dims in np.unique(where).tolist():
                at = np.flatnonzero(where == dims)
                up = (matrix([raw[i] for i in at], kind) @ _planes(dims, bits * tables) >= 0).reshape(len(at), tables, bits)
                signs[at] = up @ weights
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(signs.tolist(), pa.list_(pa.int64())), pa.array([row.tobytes() for row in signs.astype(code)], pa.binary()), batch.column("raw")], ["node", "copies", "buckets", "signs", "raw"])

    signed = nodes.select("node", "copies", "raw").mapInArrow(hashed, "node long, copies long, buckets array<long>, signs binary, raw binary")
    spread = signed.select("node", "copies", "signs", "raw", F.length("raw").alias("bytes"), F.posexplode("buckets").alias("t", "bucket"))
    hot = scratch.table(spread.groupBy("bytes", "t", "bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    many = hot.where(F.col("size") > BLOCK).select("bytes", "t", "bucket", blocks.alias("blocks"))
    many = F.broadcast(many) if many.limit(_HOT + 1).count() <= _HOT else many
    dealt = spread.join(many, ["bytes", "t", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "copies", "signs", "raw", "t", "own", "bucket", "bytes", "blocks", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    large = hot.where(F.col("size") > BLOCK).agg(F.sum("size")).first()[0] or 0
    bins = max(1, int((n * tables - large) / _BIN))
    cell = F.xxhash64("t", "bucket", "bytes", "x", "y")  # two blocks of a large bucket are a group of rows of their own
    dealt = dealt.withColumn("bin", F.when(F.col("blocks") > 1, cell).otherwise(F.pmod(cell, F.lit(bins)))).drop("blocks")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "bucket", "bytes", "x", "y"], ignore_index=True)
        cell = rows[["t", "bucket", "bytes", "x", "y"]].to_numpy(np.int64)
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(rows)] if len(rows) else []
        raw, own = rows["raw"].tolist(), rows["own"].to_numpy()
        node, copies = rows["node"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            v = matrix(raw[a:b], kind)
            near = v @ v.T
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            near /= norm[:, None]
            near /= norm[None, :]
            i, j = np.nonzero(np.triu(near >= cosine, 1))
            if cell[a, 3] != cell[a, 4]:  # two blocks: only what lies across
                across = own[a + i] != own[a + j]
                i, j = i[across], j[across]
            if not len(i):
                continue
            root = least_linked(b - a, i, j)
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, root, node[a:b])
            signs = np.frombuffer(b"".join(rows["signs"].iloc[a:b]), code).reshape(b - a, -1)[:, : cell[a, 0]]
            new = ~(signs[i] == signs[j]).any(axis=1)
            links = np.bincount(i[new], copies[a + j[new]], b - a) + np.bincount(j[new], copies[a + i[new]], b - a)
            at = np.unique(np.concatenate([i, j]))
            out.append(np.stack([node[a + at], least[root[at]], links[at].astype(np.int64)]))
        return pd.DataFrame(np.concatenate(out, axis=1).T if out else np.empty((0, 3), np.int64), columns=["a", "b", "links"])

    found = scratch.table(dealt.groupBy("bin").applyInPandas(compare, "a long, b long, links long"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    components = connected_components(found.select("a", "b"), scratch)
    known = nodes.select("high", "low", "node", "copies").join(counts, "node", "left").join(components, "node", "left")
    out = rows.select("id", "high", "low", F.col("raw").isNull().alias("out")).join(known.withColumn("out", F.lit(False)), ["high", "low", "out"], "left")
    component = F.coalesce("component", "node", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
