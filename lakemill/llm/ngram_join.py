"""Exact Jaccard join of word n-gram sets over a token-group matrix (operator 2).

Documents whose sets have ``100 * |A & B| >= percent * |A | B|`` link; the result is the connected
components. Similar documents are put into groups, each with the union of its members' tokens; a query
group is held against the groups that share a token, its overlap with their unions is bounded, and only
groups that qualify are opened and compared set by set. No link between different sets is lost:

1. Tokens that many documents hold are found by exact counts over most of the hash range. They come last in
   the one order of tokens that all documents use: tokens held by few, by hash, then the others, by hash.
2. Two linked sets share a token among the first ``n - ceil(percent * n / 100) + 1`` of each in that order,
   so those tokens, and all rare ones under a bound of the hash range, are a document's *sketch*.
3. Documents with equal sets are one node. Nodes with equal least hashes are compared with the smallest of
   them; what links is a group (its tokens count once, so thousands of near copies are one row per token).
4. Sketch tokens meet by hash. Between two groups the shared rare tokens under the bound are counted: the rest of
   the tokens there differ, and linked sets can differ in few. Only groups that pass are opened.

Tokens are 64-bit hashes of runs of words; sets are named by 128 bits. At n documents a wrong link takes a
collision inside two documents' sets, about 10**-14 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import SMALL_SLICE, mix, shingle_hashes, slices, span_hashes, text_bytes, word_spans
from .components import connected_components, least_linked
from .scratch import Scratch, bounded_broadcast, lean, lean_group, matching

#: Documents that hold a token, from which it comes last in the order.
FREQUENT = 32
#: Shares of the hash range: frequent tokens are looked for under the first; rare shared ones are counted under the second.
_COUNTED, _BOUNDED = np.uint64(int(0.6 * 2**64)), np.uint64(int(0.22 * 2**64))
#: Each gives a least hash of a set.
_KEYS = np.array([0, 0x7F4A7C159E3779B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Frequent tokens that are broadcast, at most; of more, the most frequent ones come last, and any choice is right.
_LISTED = 4_000_000
#: Groups that share a token, from which they are compared in blocks of so many nodes instead of as pairs.
LONG, BLOCK = 64, 512
#: Tokens of the nodes of a block, about.
BLOCK_TOKENS = 500_000
#: Shares that the pairs of one node are dealt over.
_SHARES = 16
#: Tokens that one task sorts, about.
_BUCKET = 600_000


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    data, offs = text_bytes(batch.column("text"))
    starts, ends, of = word_spans(data, offs)
    return shingle_hashes(span_hashes(data, starts, ends), of, words)


def _name(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    two = [int(mix(tokens + np.uint64(c)).sum(dtype=np.uint64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return two[0] - (1 << 63), two[1] - (1 << 63)


def _at_most(run_ids: np.ndarray, most: int) -> np.ndarray:
    """Of sorted values, those that are among the first ``most`` of their kind."""
    first = np.concatenate([[True], run_ids[1:] != run_ids[:-1]]) if len(run_ids) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(run_ids)), 0))
    return np.arange(len(run_ids)) - begin < most


def _buckets(tokens: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """``(bucket, begin, end)`` of the buckets, equal shares of the hash range, that sorted tokens fall into."""
    bucket = (tokens >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(tokens) else np.empty(0, np.int64)
    return list(zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(tokens)]))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def frequent_tokens(rows: DataFrame, words: int, buckets: int) -> DataFrame:
    """``(token, held)`` of the tokens under ``_COUNTED`` that more than ``FREQUENT`` documents hold.

    A task sends each bucket its tokens as one array, of a token at most ``FREQUENT + 1``: that many show that it is frequent.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            all_sets = [s[: np.searchsorted(s, _COUNTED)] for s in _sets(batch, words)]
            tokens = np.sort(np.concatenate([np.empty(0, np.uint64), *all_sets]))
            tokens = tokens[_at_most(tokens, FREQUENT + 1)]
            cuts = _buckets(tokens, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([tokens[a:b].tobytes() for _, a, b in cuts], pa.binary())], ["bucket", "tokens"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, held = np.unique(np.frombuffer(b"".join(rows["tokens"]), np.uint64), return_counts=True)
        return pd.DataFrame({"token": tokens[held > FREQUENT].view(np.int64), "held": held[held > FREQUENT]})

    return rows.select("text").mapInArrow(lean(send), "bucket int, tokens binary").groupBy("bucket").applyInPandas(lean_group(count), "token long, held long")


def sketches(rows: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """Of each document: number of tokens, name of its set, least hashes, and the sketch, which has ``rare`` rare tokens first, ``under`` of them under the bound; ``late`` are the frequent ones there."""
    shared = bounded_broadcast(rows.sparkSession, frequent, frequent.nbytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in slices(batches, limit=SMALL_SLICE):
            out = []
            for s in _sets(batch, words):
                n = len(s)
                if not n:
                    out.append((0, None, None, None, None, 0, 0, None))
                    continue
                at = np.minimum(np.searchsorted(late, s), max(len(late) - 1, 0))
                often = late[at] == s if len(late) else np.zeros(n, bool)
                rare, rest = s[~often], s[often]
                p = n - -(-percent * n // 100) + 1
                q = int(np.searchsorted(rare, _BOUNDED))
                sketch = rare[: max(p, q)]
                known = len(sketch)
                if known < p:
                    sketch = np.concatenate([sketch, rest[: p - known]])
                least = [int(mix(s ^ c).min().view(np.int64)) for c in _KEYS]
                out.append((n, *_name(s), least, sketch.view(np.int64), known, q, rest[: np.searchsorted(rest, _BOUNDED)].view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            names = ("n", "high", "low", "least", "sketch", "rare", "under", "late")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", *names])

    return rows.mapInArrow(lean(run), "doc_id long, n long, high long, low long, least array<long>, sketch array<long>, rare int, under int, late array<long>")


def _stars(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: each node with the smallest node that has the same least hashes: one, two or three of four."""
    h = [F.col("least")[i] for i in range(len(_KEYS))]
    keys = [F.xxhash64(F.lit(k), *(h[i] for i in some)) for k, some in enumerate(c for m in (1, 2, 3) for c in combinations(range(len(_KEYS)), m))]
    least = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    pivots = least.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "b")
    return least.join(pivots, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _node_sets(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, tokens)`` of the ``nodes (node)``, built anew from their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            own = _sets(batch, words)
            offs = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
            values = np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(values))], ["node", "tokens"])

    return matching(rows, "doc_id", nodes).mapInArrow(lean(sets), "node long, tokens array<long>")


def _with_both(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the columns of ``info (node, ...)`` of either end, named by it.

    Many pairs may have one ``b``, the first of a group: they are dealt by ``a``, and what ``b`` has goes once to each share that holds one of its pairs.
    """
    left, right = (info.select(*(F.col(c).alias(k if c == "node" else f"{c}_{k}") for c in info.columns)) for k in "ab")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(_SHARES)).cast("int").alias("share"))
    return dealt.join(left, "a").join(right.join(dealt.select("b", "share").distinct(), "b"), ["b", "share"]).drop("share")


def _linked(pairs: DataFrame, rows: DataFrame, words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets link; sets are built anew for the nodes in question."""
    nodes = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-nodes")

    found = _node_sets(rows, nodes, words)
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    either = F.size("tokens_a") + F.size("tokens_b") - both
    return _with_both(pairs, found).where((both > 0) & (100 * both >= percent * either)).select("a", "b").distinct()


def _sketch_bound(pairs: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs that sizes and the tokens under the bound leave possible: few may differ."""
    some = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}-nodes")
    low = F.concat(F.slice("sketch", F.lit(1), F.col("under")), "late")  # all tokens under the bound
    info = matching(nodes, "node", some).select("node", "n", low.alias("low"))
    apart = F.size("low_a") + F.size("low_b") - 2 * F.size(F.array_intersect("low_a", "low_b"))
    sized = _with_both(pairs, info).where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _meet(grouped: DataFrame, percent: int, buckets: int) -> DataFrame:
    """``(g, h, hub)`` of pairs of groups whose sketches share a token and whose overlap's bound leaves a link possible.

    ``hub`` marks those to be compared in blocks: a group of several, and groups tied to the first of many that share a token.

    ``grouped`` has a row per node with its group, size (0 in a group of several) and sketch. A task sends each bucket its tokens with places in a list of
    groups; a bucket sorts them, so each group counts once per token, and pairs up those that meet.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, size, slack, rare = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "size", "slack", "rare"))
            length = np.diff(batch.column("sketch").offsets.to_numpy())
            tokens = batch.column("sketch").flatten().to_numpy().view(np.uint64)
            place = np.repeat(np.arange(len(length), dtype=np.uint32), length)
            # the top bit of a place tells a rare token under the bound
            within = np.arange(len(tokens)) - np.repeat(np.cumsum(length) - length, length) < np.repeat(rare, length)
            place |= (within & (tokens < _BOUNDED)).astype(np.uint32) << np.uint32(31)
            order = np.argsort(tokens, kind="stable")
            tokens, place = tokens[order], place[order]
            out = []
            for k, a, b in _buckets(tokens, buckets):
                used, new = np.unique(place[a:b] & np.uint32(0x7FFFFFFF), return_inverse=True)
                out.append((k, tokens[a:b].tobytes(), (new.astype(np.uint32) | (place[a:b] & np.uint32(1 << 31))).tobytes(), np.stack([group[used], size[used], slack[used]]).astype(np.int64).tobytes(), len(used)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()))], ["bucket", "tokens", "places", "groups", "n"])

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(rows["tokens"]), np.uint64)
        lists = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in rows["groups"]], axis=1)
        base = np.cumsum(rows["n"].to_numpy()) - rows["n"].to_numpy()
        coded = [np.frombuffer(x, np.uint32) for x in rows["places"]]
        low = np.concatenate([c >= np.uint32(1 << 31) for c in coded])
        place = np.concatenate([(c & np.uint32(0x7FFFFFFF)) + np.uint32(b) for c, b in zip(coded, base)])
        del coded
        _, kind, held = np.unique(tokens, return_inverse=True, return_counts=True)
        met = held[kind] > 1
        del tokens, held
        kind, place, low = kind[met], place[met], low[met]
        group, size, slack = lists[:, place]
        del met, place, lists
        order = np.lexsort((-slack, group, kind))
        kind, group, size, slack, low = (x[order] for x in (kind, group, size, slack, low))
        del order
        once = np.concatenate([[True], (kind[1:] != kind[:-1]) | (group[1:] != group[:-1])]) if len(kind) else np.empty(0, bool)
        kind, group, size, slack, low = (x[once] for x in (kind, group, size, slack, low))
        run = np.bincount(kind)[kind] if len(kind) else kind
        hub = np.flatnonzero(run > LONG)
        out = []
        if len(hub):  # many groups: each is tied to the first, and their clusters are compared in blocks
            first = np.concatenate([[True], kind[hub][1:] != kind[hub][:-1]])
            to = group[hub][np.maximum.accumulate(np.where(first, np.arange(len(hub)), 0))]
            zero = np.zeros((len(hub),), np.int64)
            out.append(np.stack([to, group[hub], zero, zero, zero, zero + 1, zero])[:, group[hub] != to])
            few = run <= LONG
            kind, group, size, slack, low = (x[few] for x in (kind, group, size, slack, low))
        gap = 1
        while gap < len(kind):  # all pairs of a token's groups: those that stand `gap` apart
            at = np.flatnonzero(kind[gap:] == kind[:-gap])
            if not len(at):
                break
            x, y = size[at], size[at + gap]
            at = at[(x == 0) | (y == 0) | (100 * np.minimum(x, y) >= percent * np.maximum(x, y))]
            out.append(np.stack([group[at], group[at + gap], low[at].astype(np.int64), slack[at], slack[at + gap], np.zeros(len(at), np.int64), ((size[at] == 0) | (size[at + gap] == 0)).astype(np.int64)]))
            gap += 1
        found = pd.DataFrame(np.concatenate(out, axis=1).T if out else np.empty((0, 7), np.int64), columns=["g", "h", "shared", "slack_g", "slack_h", "hub", "several"])
        return found.groupby(["g", "h"], as_index=False).agg({"shared": "sum", "slack_g": "max", "slack_h": "max", "hub": "max", "several": "max"})

    sent = grouped.mapInArrow(lean(send), "bucket int, tokens binary, places binary, groups binary, n int")
    met = sent.groupBy("bucket").applyInPandas(lean_group(pair), "g long, h long, shared long, slack_g long, slack_h long, hub long, several long")
    bound = F.sum("shared") * 2 * (100 + percent) + F.max("slack_g") + F.max("slack_h")
    found = met.groupBy("g", "h").agg(bound.alias("bound"), (F.max("hub") > 0).alias("hub"), (F.max("several") > 0).alias("several"))
    return found.where("bound >= 0 or hub").select("g", "h", (F.col("hub") | F.col("several")).alias("hub"))


def _compared_in_blocks(members: DataFrame, rows: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links ``(a, b)`` that join what links among the nodes of each cluster of ``members (cluster, node, n)``.

    A cluster is cut into blocks of about ``BLOCK`` nodes and ``BLOCK_TOKENS`` tokens at most, and two blocks meet in one group of rows of
    their own, where a matrix product counts the shared tokens of all pairs; a pair is never a row. Blocks hold sets of like sizes: linked ones
    are of the same class of sizes or of two that follow each other, so no other blocks of a large cluster meet. Clusters of one block share groups of about a
    block's size. Of what links in two blocks one link per node leaves the task.
    """
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    sums = F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("tokens")
    classes = members.select("cluster", "node", "n", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99)) + 1e-9).cast("int").alias("class"))
    dealt = scratch.table(classes.groupBy("cluster", "class").agg(*sums), "blocks")
    whole = dealt.groupBy("cluster").agg(F.sum("nodes").alias("nodes"), F.sum("tokens").alias("tokens")).withColumn("blocks", blocks)
    small = whole.where("blocks = 1").agg(F.sum("nodes"), F.sum("tokens")).first()
    bins = max(1, int((small[0] or 0) / BLOCK), int((small[1] or 0) / BLOCK_TOKENS))
    of_class = dealt.withColumn("own_blocks", blocks).drop("nodes", "tokens")
    of_class = of_class.join(whole.where("blocks > 1").select("cluster", F.lit(True).alias("large")), "cluster", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    told = of_class.where("large").select("cluster", F.explode(F.array(F.col("class") - 1, F.col("class") + 1)).alias("class"), F.col("class").alias("next"), F.col("own_blocks").alias("n"))
    told = told.groupBy("cluster", "class").agg(F.max(F.when(F.col("next") < F.col("class"), F.col("n"))).alias("lower"), F.max(F.when(F.col("next") > F.col("class"), F.col("n"))).alias("upper"))
    plan = of_class.join(told, ["cluster", "class"], "left")
    own = F.when(F.col("large"), F.pmod(F.xxhash64("node"), F.col("own_blocks"))).otherwise(0).cast("int")
    placed = classes.select("cluster", "node", "class").join(plan, ["cluster", "class"]).withColumn("own", own)
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda kind, x, y: F.struct(kind.cast("int").alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    at, mine = F.col("class") * 2, F.col("own")
    # twice a class: its own blocks; twice a class and one: its blocks against those of the next class
    cells = F.concat(
        F.transform(each(F.col("own_blocks")), lambda k: cell(at, F.least(mine, k), F.greatest(mine, k))),
        F.transform(each(F.coalesce("upper", F.lit(0))), lambda k: cell(at + 1, mine, k)),
        F.transform(each(F.coalesce("lower", F.lit(0))), lambda k: cell(at - 1, k, mine)),
    )
    placed = placed.select("cluster", "node", "large", F.explode(F.when(F.col("large"), cells).otherwise(F.array(cell(F.lit(0), F.lit(0), F.lit(0))))).alias("cell"))
    sets = _node_sets(rows, members.select("node"), words).join(placed, "node").select("cluster", "node", "tokens", "large", "cell.kind", "cell.x", "cell.y")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        cells = [one_cell(got) for _, got in rows.groupby(["cluster", "kind", "x", "y"]) if len(got) > 1]
        return pd.concat(cells) if cells else pd.DataFrame({"a": pd.Series(dtype=np.int64), "b": pd.Series(dtype=np.int64)})

    def one_cell(got: pd.DataFrame) -> pd.DataFrame:
        node = got["node"].to_numpy(np.int64)
        n = np.array([len(t) for t in got["tokens"]], np.int64)
        _, kind, held = np.unique(np.concatenate(got["tokens"].to_list()), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(n)), n)
        both = np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(kind, kind="stable")  # tokens of one document alone are shared by none
        order = order[held[kind[order]] > 1]
        _, kind = np.unique(kind[order], return_inverse=True)
        doc = doc[order]
        for k in range(0, int(kind[-1]) + 1 if len(kind) else 0, 4096):
            a, b = np.searchsorted(kind, (k, k + 4096))
            part = np.zeros((len(n), 4096), np.float32)
            part[doc[a:b], kind[a:b] - k] = 1
            both += part @ part.T
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        i, j = np.nonzero(np.triu(linked & (both > 0), 1))
        root = least_linked(len(n), i, j)
        return pd.DataFrame({"a": node, "b": node[root]})[root != np.arange(len(n))]

    name = F.xxhash64("cluster", "kind", "x", "y")  # two blocks are a group of rows of their own, however many there are
    return sets.withColumn("bin", F.when(F.col("large"), name).otherwise(F.pmod(name, F.lit(bins)))).drop("large").groupBy("bin").applyInPandas(lean_group(compare), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``.

    Words are lower-cased (A-Z) runs of bytes other than 0x20 and 0x09-0x0D; a document's set holds its distinct
    runs of ``words`` words, or its whole sequence if that is shorter. A null or empty text, and one without
    words, has 0 shingles and links with nothing: its component is its own id. A row with a null id has its
    number of shingles and a null component and takes no part in links. Repeated ids count as one document, which links
    where any of its texts does. Other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(total / 6 * 0.6 / _BUCKET) + 1)

    counted = scratch.table(frequent_tokens(rows, words, buckets), "frequent").orderBy(F.desc("held"), "token").limit(_LISTED)
    frequent = np.sort(counted.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    signed = scratch.table(sketches(rows, frequent, words, percent), "sketches")
    ids = scratch.table(signed.select("doc_id", "n", "high", "low"), "ids")
    some = signed.where("doc_id is not null and n > 0")
    firsts = [F.first(c).alias(c) for c in ("n", "least", "sketch", "rare", "under", "late")]
    nodes = scratch.table(some.groupBy("high", "low").agg(F.min("doc_id").alias("node"), *firsts), "nodes")
    scratch.drop("sketches")

    stars = scratch.table(_stars(nodes), "stars")
    likely = scratch.table(_sketch_bound(stars, nodes, percent, scratch, "stars"), "likely")
    links = scratch.table(_linked(likely, rows, words, percent, scratch, "likely"), "links")
    groups = scratch.table(connected_components(links, scratch, "groups"), "groups")

    slack = (100 - percent) * F.col("n") - (100 + percent) * F.col("under")
    grouped = nodes.join(groups, "node", "left").select("node", "n", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("n")).otherwise(0).alias("size"), slack.alias("slack"), "rare", "sketch")
    met = scratch.table(_meet(grouped.drop("node", "n"), percent, buckets), "met")
    opened = met.where("not hub").select(F.col("g").alias("a"), F.col("h").alias("b"))
    possible = scratch.table(_sketch_bound(opened, nodes, percent, scratch, "opened"), "possible")
    more = scratch.table(_linked(possible, rows, words, percent, scratch, "possible"), "more")
    clusters = connected_components(met.where("hub").select(F.col("g").alias("a"), F.col("h").alias("b")), scratch, "clusters").select(F.col("node").alias("group"), F.col("component").alias("cluster"))
    every = links.union(more)
    if clusters.head(1):
        inside = grouped.select("node", "n", "group").join(clusters, "group").select("cluster", "node", "n")
        every = every.union(scratch.table(_compared_in_blocks(scratch.table(inside, "clusters"), rows, words, percent, scratch), "joined"))
    names = nodes.select("high", "low", "node")
    alike = ids.where("doc_id is not null and n > 0").join(names, ["high", "low"])
    # a repeated id may stand for several sets: its row links them
    repeated = alike.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    repeated = alike.join(repeated, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    components = connected_components(every.union(repeated), scratch)
    out = ids.join(names, ["high", "low"], "left").join(components, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")).withColumnRenamed("doc_id", id_col)
