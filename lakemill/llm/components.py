"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one grouped aggregation and one join, in which the edges of one node are dealt over several tasks; every node only ever points at a smaller one, and the
steps stop when a pass changes nothing. No link, label or component reaches the driver: it sees one
count and one checksum a pass. Each pass is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Tasks over which the edges of one node are dealt, at least; Spark splits what is still uneven when it joins.
SALTS = 8


def _with_least(edges: DataFrame, key: str) -> DataFrame:
    """``edges (a, b)``, a > b, with ``m``: the smallest node that ``key`` is linked to among smaller ones, itself if there is none.

    The edges of a node are dealt by their other end, and the node's smallest goes to each share, so a star's centre is no task's alone.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("_node"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    told = edges.withColumn("_of", F.pmod(F.xxhash64("a" if key == "b" else "b"), F.lit(SALTS)).cast("int"))
    return told.join(least, (F.col(key) == F.col("_node")) & (F.col("_of") == F.col("_salt")), "left").select("a", "b", F.coalesce("m", key).alias("m"))


def _pass(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step: every larger neighbour of a node, then every smaller one, points at the node's smallest."""
    large = _with_least(edges, "b").select("a", F.col("m").alias("b")).distinct()
    small = _with_least(large, "a")
    pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return small.select(pairs.alias("e")).select("e.*").where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", passes: int = 50) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)`` with another neighbour; component is the smallest node.

    Null ends and loops are ignored, repeated edges count once. The number of passes grows with the
    logarithm of a component's size; ``passes`` only guards against a fault and raises.
    """
    now = scratch.table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark = None
    for i in range(1, passes + 1):
        new = scratch.table(_pass(now), f"{name}-{i}")
        found = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{i - 1}")
        now = new
        if tuple(found) == mark:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return out.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(found)
    raise RuntimeError(f"components did not settle in {passes} passes")


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n items the smallest that links reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
