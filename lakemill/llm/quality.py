"""Quality classifier by hierarchical empirical Bayes (operator 1).

A document's probability of being good joins two things: the evidence of a classifier of its text, and how
good its site is. Sites have two levels, hosts and paths within them. A path's share of good documents is shrunk
towards its host's, and a host's towards the whole corpus's, by as much as the shares' spread over
the groups warrants (beta-binomial, by the method of moments). All shares are sums of one grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SMALL_SLICE, slices, span_hashes, sums, text_bytes, word_spans
from .scratch import BROADCAST_BYTES, Scratch, bounded_broadcast, lean, sampled

#: Labelled documents that the classifier is fitted on, at most (about: they are taken by a hash of the id).
TRAINING_ROWS = 20_000
#: A document without a label counts at its site as so much of one, with the classifier's probability.
UNLABELLED = 0.25

_KINDS = np.full(256, 8, np.uint8)  # other punctuation
for _k, _of in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"|", b"!", b"*#%&$@^~<>{}=_\\")):
    _KINDS[list(_of)] = _k
_KINDS[128:] = 9


def _distinct_share(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    order = np.lexsort((values, doc))
    new = np.ones(len(values))
    new[1:] = (values[order][1:] != values[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    return sums(new, of) / np.maximum(np.diff(of), 1)


def features(column: pa.Array) -> np.ndarray:
    """Of each whole text: shares of kinds of bytes, lengths, and how much its words repeat."""
    data, offs = text_bytes(column)
    starts, ends, of = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    n, m = np.maximum(np.diff(offs), 1), np.maximum(np.diff(of), 1)
    rows = len(column)
    doc = np.repeat(np.arange(rows), np.diff(offs))
    shares = np.bincount(doc * 10 + _KINDS[data], minlength=10 * rows).reshape(rows, 10) / n[:, None]
    inner = np.ones(len(words), bool)
    inner[of[:-1][of[:-1] < len(words)]] = False
    same = np.zeros(len(words))
    pair = words.copy()
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & inner[1:]
        pair[1:] = np.where(inner[1:], words[:-1] * np.uint64(0x9E3779B97F4A7C15), np.uint64(0)) + words[1:]  # a text's first word has none before it
    last = _KINDS[data[ends - 1]] if len(ends) else np.empty(0, np.uint8)
    first = _KINDS[data[starts]] if len(starts) else np.empty(0, np.uint8)
    told = np.stack([
        sums(same, of) / m,
        _distinct_share(words, of),
        _distinct_share(pair, of),
        sums(((last == 6) | (last == 7)).astype(float), of) / m,
        sums((first == 1).astype(float), of) / m,
        np.log1p(np.diff(of)) / 10,
        sums((ends - starts).astype(float), of) / m / 20,
    ], axis=1)
    x = np.concatenate([shares, told], axis=1)
    return np.concatenate([x, np.sqrt(x), x * x], axis=1)


@dataclass
class Classifier:
    """Logistic regression on :func:`features`; ``prior`` is the log-odds of its training rows."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def evidence(self, column: pa.Array) -> np.ndarray:
        """Log-odds that the text adds to those of its site, within +-12."""
        if not len(self.weights):
            return np.zeros(len(column))
        x = np.clip((features(column) - self.mean) / self.scale, -20, 20)
        return np.clip(x @ self.weights[1:] + self.weights[0] - self.prior, -12, 12)


def fit_rows(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> Classifier:
    """Newton's method on the ridge-penalised likelihood. Of one kind of label, or none, nothing is learnt."""
    if not len(y) or y.min() == y.max():
        return Classifier(np.empty(0), np.empty(0), np.empty(0), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / scale, -20, 20)], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, w, float(np.log(y.mean() / (1 - y.mean()))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Fit on labelled documents, or on about ``rows`` of them: those whose id's hash is under a bound, the same each time."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col)).alias("y"))
    n = known.count()
    known = sampled(known, ["id"], rows, n)
    known = F.broadcast(known) if rows <= 100_000 else known  # about `rows` pairs of numbers
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id").where("text is not null")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("y"), pa.array(list(features(batch.column("text"))), pa.list_(pa.float64()))], ["id", "y", "x"])

    found = some.select("id", "y", "text").mapInArrow(lean(told), "id long, y double, x array<double>").toPandas().sort_values("id")
    return fit_rows(np.stack(found["x"].to_list()) if len(found) else np.empty((0, 1)), (found["y"].to_numpy() >= 0.5).astype(float))


def _strength(groups: DataFrame, share: str, good: str, n: str) -> float:
    """Pseudo-documents that a group's parent is worth, from the spread of the groups' shares about the parents'."""
    p = F.col(good) / F.col(n)
    s, g, total, squares = groups.where(F.col(n) > 0).agg(
        F.sum(F.col(n) * F.pow(p - F.col(share), 2) / F.greatest(F.col(share) * (1 - F.col(share)), F.lit(1e-9))), F.count(F.lit(1)), F.sum(n), F.sum(F.pow(F.col(n), 2))
    ).first()
    if not g or g < 2 or total <= g:
        return 1e4
    free = total - squares / total - (g - 1)
    rho = (s - (g - 1)) / free if free > 0 else 0.0
    return float(min(1e4, max(1.0, 1 / rho - 1))) if rho > 0 else 1e4


def site_shares(told: DataFrame, unlabelled: float = UNLABELLED) -> DataFrame:
    """``(host, path, host_share, path_share)`` from rows ``(host, path, y, p)``: a label, if any, and the classifier's probability."""
    weight, good = F.when(F.col("y").isNotNull(), 1.0).otherwise(unlabelled), F.coalesce("y", F.col("p"))
    paths = told.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * good).alias("good"))
    scratch = Scratch(told.sparkSession, "quality-sites")
    paths = scratch.table(paths, "paths")
    hosts = scratch.table(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "hosts")
    n, y = hosts.agg(F.sum("host_n"), F.sum("host_good")).first()
    mean = min(1 - 1e-6, max(1e-6, (y + 0.5) / (n + 1))) if n else 0.5
    hosts = hosts.withColumn("mean", F.lit(mean))
    worth = _strength(hosts, "mean", "host_good", "host_n")
    hosts = hosts.select("host", ((F.col("host_good") + worth * mean) / (F.col("host_n") + worth)).alias("host_share"))
    paths = paths.join(hosts, "host")
    worth = _strength(paths, "host_share", "good", "n")
    return paths.select("host", "path", "host_share", ((F.col("good") + worth * F.col("host_share")) / (F.col("n") + worth)).alias("path_share"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, classifier: Classifier | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """``(doc_id, evidence, host_share, path_share, score, keep)`` of every row of ``docs``.

    ``score`` is the probability that the document is good, ``keep`` whether it reaches ``threshold``. Null hosts and
    paths are a site of their own. A null or empty text has the evidence of an empty one; without labels of both kinds
    evidence is 0. Labels may repeat (their mean counts), be null or name absent documents (then they don't). Rows
    with a null id have no label; repeated ids are rows like others. No rows give none.

    ``documents`` has no paths: by default the column ``lang`` stands for the level below the host, its source. A document's own label
    is one of those that its site's share is made of.

    Texts are read twice at most, for the fit and for the evidence; only ids, sites and numbers are shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    if classifier is None:
        classifier = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = bounded_broadcast(spark, classifier, 8 * (len(classifier.weights) + 3 * len(classifier.mean)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SMALL_SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array(shared.value.evidence(batch.column("text")), pa.float64())], ["id", "host", "path", "evidence"])

    site = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((host_col, "host"), (path_col, "path"))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *site, F.col(text_col).cast("string").alias("text"))
    told = scratch.table(rows.mapInArrow(lean(tell), "id long, host string, path string, evidence double"), "evidence")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    p = 1 / (1 + F.exp(-(F.col("evidence") + classifier.prior)))
    sites = scratch.table(site_shares(told.join(known, "id", "left").withColumn("p", p).select("host", "path", "y", "p")), "sites")
    few = (sites.agg(F.sum(64 + F.octet_length("host") + F.octet_length("path"))).first()[0] or 0) <= BROADCAST_BYTES  # more are joined by a shuffle
    joined = told.join(F.broadcast(sites) if few else sites, ["host", "path"])
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_share")))))
    return joined.withColumn("score", score).select(F.col("id").alias(id_col), "evidence", "host_share", "path_share", "score", (F.col("score") >= threshold).alias("keep"))
