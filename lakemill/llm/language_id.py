"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 6).

Characters are code points, folded to lower case one by one. Every 1-, 2- and 3-gram inside a text falls
into one of ``2**bits`` buckets. Training counts buckets by language; scoring adds rows of the broadcast
matrix of log probabilities, for a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SMALL_SLICE, slices, sums, text_bytes
from .scratch import BROADCAST_BYTES, bounded_broadcast, lean, lean_group, let_go, sampled, trim

#: Labelled rows that a model is fitted on, at most (about: rows are taken by a hash of their text and id).
TRAINING_ROWS = 20_000
UNDETERMINED = "und"
#: Bytes of text whose n-grams are scored at a time, and numbers that their rows of the matrix take at a time.
_SLICE, _CELLS = SMALL_SLICE, 1 << 20
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(0x3000, dtype=np.uint32)
for _i in range(0x3000):
    if len(_low := chr(_i).lower()) == 1:
        _FOLD[_i] = ord(_low)
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(data: np.ndarray, offs: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3 the bucket of every n-gram and the n + 1 offsets of the texts' n-grams."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    of = lead[offs]
    if of[-1] != len(points):  # not UTF-8: bytes stand for characters
        points, of = data.astype(np.uint32), offs
    points = np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points).astype(np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(of))
    for n in (1, 2, 3):
        m = len(points) - n + 1
        if m <= 0:
            return
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h += points[j : j + m] * _MULTIPLY[j]
            h *= _MULTIPLY[2]
            h ^= h >> np.uint64(29)
        h *= _MULTIPLY[0]
        whole = doc[:m] == doc[n - 1 :]
        yield (h >> np.uint64(64 - bits)).astype(np.int64)[whole], np.concatenate([[0], np.cumsum(np.maximum(np.diff(of) - n + 1, 0))])


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages, single precision
    prior: np.ndarray
    bits: int
    #: Evidence counts in proportion to the root of the number of n-grams, as neighbouring ones are dependent.
    evidence: float = 4.0

    def scores(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability of each text; ``und`` and 0 without a letter."""
        data, offs = text_bytes(column)
        total, n = np.zeros((len(column), len(self.languages))), np.zeros(len(column))
        step = max(1024, _CELLS // max(1, len(self.languages)))
        for bucket, of in grams(data, offs, self.bits):
            for a in range(0, len(bucket), step):  # however long a text is and however many languages there are
                total += sums(self.log_p[bucket[a : a + step]].astype(float), np.clip(of, a, a + step) - a)
            n += np.diff(of)
        n = np.maximum(n, 1)
        logit = total / n[:, None] * (self.evidence * np.sqrt(n))[:, None] + self.prior
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        raw = data.tobytes()
        letters = [bool(_LETTER.search(raw[a : min(b, a + 400)].decode("utf-8", "ignore")) or b - a > 400 and _LETTER.search(raw[a:b].decode("utf-8", "ignore"))) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letters)], np.where(letters, p[np.arange(len(p)), best], 0.0) if len(p) else np.empty(0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16, rows: int = TRAINING_ROWS, alpha: float = 0.5, id_col: str | None = None) -> LanguageModel:
    """Count n-grams by language over ``labelled``, or over a sample of about ``rows`` rows of it.

    The sample is those rows whose text's hash, with that of ``id_col`` if there is one, is under a bound, so it is the same each time. Null and empty
    texts and null languages teach nothing. Without a labelled row the model holds no language; one with more languages than may be
    broadcast (``4 << bits`` bytes each of ``BROADCAST_BYTES``) is refused.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & (F.length(F.col(text_col).cast("string")) > 0))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), (F.col(id_col) if id_col else F.lit(0)).alias("id"))
    most = BROADCAST_BYTES // (4 << bits)
    sizes = known.groupBy("lang").count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages of {4 << bits} bytes each are more than may be broadcast")
    languages = sorted(r["lang"] for r in sizes)
    n = sum(r["count"] for r in sizes)
    if not n:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits)
    known = sampled(known, ["text", "id"], rows, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in slices(batches, limit=_SLICE):
            data, offs = text_bytes(batch.column("text"))
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            for bucket, of in grams(data, offs, bits):
                of_gram = np.repeat(code, np.diff(of))
                for k, lang in enumerate(names.tolist()):
                    seen[lang] = seen.get(lang, 0) + np.bincount(bucket[of_gram == k], minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in seen.values()], pa.binary())], ["lang", "counts"])

    def add(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "counts": [sum(np.frombuffer(c, np.int64) for c in own["counts"]).tobytes()]})

    counted = known.select("lang", "text").repartition(6).mapInArrow(lean(count), "lang string, counts binary")
    found = counted.groupBy("lang").applyInPandas(lean_group(add), "lang string, counts binary").collect()  # of fixed size: a language's buckets
    log_p = np.empty((1 << bits, len(languages)), np.float32)
    log_p[:] = np.log(1 / (1 << bits))
    for r in found:
        own = np.frombuffer(r["counts"], np.int64) + alpha
        log_p[:, languages.index(r["lang"])] = np.log(own / own.sum())
    prior = np.array([next(r["count"] for r in sizes if r["lang"] == x) for x in languages], float)
    return LanguageModel(languages, log_p, np.log(prior / n), bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> tuple[Column, Column]:
    """Columns ``(language, score)`` of a text column, see :func:`with_language`."""
    spark = docs.sparkSession
    shared = bounded_broadcast(spark, model, model.log_p.nbytes)

    @F.pandas_udf("lang string, score double")
    def predict(texts):  # noqa: ANN001, ANN202
        let_go()
        out = []
        for piece in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], limit=_SLICE):
            lang, score = shared.value.scores(piece.column("text")) if shared.value.languages else ([UNDETERMINED] * piece.num_rows, np.zeros(piece.num_rows))
            out.append(pd.DataFrame({"lang": lang, "score": score}))
        trim()
        return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "score": pd.Series(dtype=float)})

    found = predict(F.col(text_col).cast("string"))
    return found["lang"], found["score"]


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, its language and the language's probability (0 to 1).

    ``und`` with score 0 for a null text, one without a letter, or a model that holds no language. Rows stay as they are,
    also repeated ones and those with null ids; only the text decides. One pass without a shuffle.
    """
    spark = docs.sparkSession
    shared = bounded_broadcast(spark, model, model.log_p.nbytes)
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]
    whole = "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=_SLICE):
            if shared.value.languages:
                lang, score = shared.value.scores(piece.column("text"))
            else:
                lang, score = [UNDETERMINED] * piece.num_rows, np.zeros(piece.num_rows)
            kept = [piece.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(f"k{i}" for i in range(len(keep))), "lang_out", "score_out"])

    if whole:
        raise ValueError("keep an id and join, or use identify()")
    out = rows.mapInArrow(lean(run), ", ".join([*(f"k{i} {kind}" for i, kind in enumerate(kinds)), "lang_out string, score_out double"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("lang_out").alias(lang_out), F.col("score_out").alias(score_out))
