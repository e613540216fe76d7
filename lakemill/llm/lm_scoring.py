"""Language-model scores by a sharded Elias-Fano n-gram trie (operator 8).

An interpolated bigram model: ``p(w | h) = (c(h w) + mu * p(w)) / (c(h) + mu)``. :func:`train` deals the training bigrams by their last word
into shards that grow in number with the corpus; each shard's trie (last word first, then the words before it) is built once and written to
the shared folder. :meth:`LanguageModel.score` deals the bigrams of texts in the same way; a task maps its shard's trie into memory and
looks each of them up between its last word's pointers. No task holds the model whole. Words that would fill a shard of their own are dealt by the
word before them.

A shard knows the exact training count of each of its words, seldom ones too: its own ``p(w)`` and base score. As every
word is the context of the token after it, ``c(h) + mu`` is taken off where ``h`` is scored, which no other shard need know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import mix, slices, span_hashes, sums, text_bytes, word_spans
from .elias_fano import BigramTrie
from .scratch import BROADCAST_BYTES, Scratch, bounded_broadcast, trim

#: Words that are dealt over shards by the word before them, at most; their counts are broadcast. Any number gives the same scores:
#: a word that comes after the first ``HEAD`` by count has under a ``HEAD``-th of all tokens, and stays with its shard.
HEAD = BROADCAST_BYTES // 32
#: Tokens of a shard, about.
SHARD = 2_500_000
#: Bytes of text that a task sorts at a time.
_SLICE = 8 << 20
#: Tokens that are dealt at a time.
_STEP = 1 << 18
#: Tokens that a task looks up in a shard's trie at a time, about: whole slices' rows.
_ASKED = 1 << 19
_BEGIN, _END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35)
#: The word before is told from others before the same word by so many bits of its hash, as bytes.
_BEFORE = 6


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and their n + 1 offsets."""
    data, offs = text_bytes(batch.column("text"))
    starts, ends, of = word_spans(data, offs)
    return np.insert(span_hashes(data, starts, ends), of[1:], _END), of + np.arange(len(of))


def _short(words: np.ndarray) -> np.ndarray:
    return words & np.uint64((1 << 8 * _BEFORE) - 1)


def _short_bytes(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BEFORE].tobytes()


def _from_short(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _BEFORE, 8), np.uint8)
    out[:, :_BEFORE] = np.frombuffer(raw, np.uint8).reshape(-1, _BEFORE)
    return out.view("<u8").ravel()


def _small(numbers: np.ndarray) -> bytes:
    """A byte each, and those over 254 behind them: nearly all are ones."""
    large = numbers > 254
    return np.where(large, 255, numbers).astype(np.uint8).tobytes() + numbers[large].astype("<u4").tobytes()


def _from_small(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=n)
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where columns sorted together change."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _packed(word: np.ndarray, before: np.ndarray, doc: np.ndarray) -> tuple[bytes, ...]:
    """Tokens as ``(word, fan, before, times, docs)``: each word, how many words come before it, those, how often each does, and the texts of them all."""
    order = np.lexsort((before, word))
    word, before = word[order], before[order]
    pair, first = _runs(word, before), _runs(word)
    fan = np.diff(np.append(np.searchsorted(pair, first), len(pair)))
    return word[first].tobytes(), _small(fan), _short_bytes(before[pair]), _small(np.diff(np.append(pair, len(word)))), doc[order].tobytes()


def _pairs(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and the words before them of all packed rows, end to end."""
    ends = np.cumsum(got["before"].map(len).to_numpy(np.int64) // _BEFORE)
    word, before = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint64)
    for b, r in zip(ends.tolist(), got.itertuples()):
        n = len(r.before) // _BEFORE
        words = np.frombuffer(r.word, np.uint64)
        word[b - n : b] = np.repeat(words, _from_small(r.fan, len(words)))
        before[b - n : b] = _from_short(r.before)
    return word, before


def _count_words(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            parts = [np.unique(_tokens(piece)[0], return_counts=True) for piece in slices([batch])]
            if parts:
                words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return rows.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class _Dealing:
    """How bigrams are dealt: over all shards those of the words in ``spread``, by last word the others."""

    shards: int
    trained: int
    spread: Broadcast  # ascending words and their training counts

    def counts(self, w: np.ndarray) -> np.ndarray:
        """Training counts of the words that are dealt over shards, -1 of the others. A text's end always is."""
        table, n = self.spread.value
        out = np.full(len(w), -1, np.int64)
        if len(table):
            at = np.minimum(np.searchsorted(table, w), len(table) - 1)
            out = np.where(table[at] == w, n[at], out)
        return np.where(w == _END, self.trained, out)

    def shard_of(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        kind = np.uint16 if self.shards <= 1 << 16 else np.uint32  # numpy sorts short numbers by their digits
        out = np.empty(len(tokens), kind)
        for a in range(0, len(tokens), _STEP):
            w = tokens[a : a + _STEP]
            to, spread = mix(w), np.flatnonzero(self.counts(w) >= 0)
            to[spread] = mix(before[a : a + _STEP][spread] ^ to[spread])
            out[a : a + _STEP] = to % np.uint64(self.shards)
        return out

    def bigrams(self, batch: pa.RecordBatch) -> tuple[np.ndarray, Iterator[tuple]]:
        """How many tokens each text has, and ``(shard, word, fan, before, times, docs)`` of each shard with a token, as :func:`_packed` has them.

        Texts are cut into words a megabyte at a time and each shard's tokens are sorted by themselves, so little more than the tokens is held.
        """
        parts = [_tokens(piece) for piece in slices([batch])]
        tokens = np.concatenate([t for t, _ in parts]) if parts else np.empty(0, np.uint64)
        length = np.concatenate([np.diff(of) for _, of in parts]) if parts else np.empty(0, np.int64)
        del parts
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(length) - length] = _BEGIN
        before = _short(before)
        shard = self.shard_of(tokens, before)
        order = np.argsort(shard, kind="stable").astype(np.uint32)
        ends = np.cumsum(np.bincount(shard, minlength=self.shards))
        doc = np.repeat(np.arange(batch.num_rows, dtype=np.uint16 if batch.num_rows <= 1 << 16 else np.uint32), length)
        del shard

        def shards() -> Iterator[tuple]:
            for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                some = order[ends[k - 1] if k else 0 : ends[k]]
                yield k, *_packed(tokens[some], before[some], doc[some])

        return length, shards()


def _found(dealing: _Dealing, got: pd.DataFrame, trie: BigramTrie | None, mu: float, alpha: float, size: float) -> Iterator[tuple]:
    """``(slice, texts, score, base, known)`` of each packed row of a shard: the sums over its tokens in each of those texts.

    Rows of about ``_ASKED`` tokens are looked up at a time, so a task holds little beside the rows and the trie.
    """
    step = np.cumsum(got["before"].map(len).to_numpy(np.int64) // _BEFORE) // _ASKED
    cuts = [*_runs(step).tolist(), len(got)]
    for first, last in zip(cuts, cuts[1:]):
        some = got.iloc[first:last]
        word, before = _pairs(some)
        order = np.lexsort((before, word))
        word, before = word[order], before[order]
        new = _runs(word, before)
        back = np.empty(len(order), np.uint32)
        back[order] = np.repeat(np.arange(len(new), dtype=np.uint32), np.diff(np.append(new, len(order))))
        del order
        word, before = word[new], before[new]
        del new
        counts, has, log_p = trie.find(word, before) if trie else (np.zeros(len(word), np.int64), np.zeros(len(word), bool), np.zeros(len(word)))
        spread = dealing.counts(word)
        known = np.where(spread >= 0, spread, counts)
        # the token's own share, without the context's count, which the context's shard takes off: the end is no context
        log_p = np.where(has, log_p, np.log10(mu * (known + alpha) / size)) - np.where(word == _END, 0.0, np.log10(known + mu))
        log_base = np.log10(known + alpha)
        learns = known > 0
        del word, before, counts, has, spread, known
        at = 0
        for r in some.itertuples():
            times = _from_small(r.times, len(r.before) // _BEFORE)
            doc = np.frombuffer(r.docs, np.uint16 if len(r.docs) == 2 * int(times.sum()) else np.uint32)
            each = np.repeat(back[at : at + len(times)], times)
            at += len(times)
            m = int(doc.max()) + 1
            score, base, learnt = np.bincount(doc, log_p[each], m), np.bincount(doc, log_base[each], m), np.bincount(doc, learns[each], m)
            held = np.flatnonzero(np.bincount(doc, minlength=m))
            yield r.slice, held.astype(np.uint32), score[held], base[held], learnt[held].astype(np.uint32)


@dataclass
class LanguageModel:
    """A trained model: ``tries (shard, trie)`` is a table in the shared folder with a row per shard, some megabytes each."""

    tries: DataFrame
    dealing: _Dealing
    tokens: int
    vocabulary: int
    mu: float
    alpha: float

    @property
    def size(self) -> float:
        return self.tokens + self.alpha * (self.vocabulary + 1)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
        """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row, see :func:`score_texts`; without a column for it all rows count as held out."""
        spark, dealing, mu, alpha, size, n = docs.sparkSession, self.dealing, self.mu, self.alpha, self.size, self.tokens
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(True) if held_out is None else held_out).alias("held"))
        asked = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
        # of more texts than the model is made for, each shard's queries are cut and meet the shard's trie in several tasks
        cuts = int(((asked[1] or 0) / 6 + asked[0]) / dealing.shards / (2 * SHARD)) + 1

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trim()
            part, k = TaskContext.get().partitionId(), 0
            for batch in slices(batches, limit=_SLICE):
                length, shards = dealing.bigrams(batch)
                here = (part << 24) + k
                cut = (part + k) % cuts
                k += 1
                ids = batch.column("doc_id")
                null, held = (np.packbits(x.to_numpy(zero_copy_only=False).astype(bool)).tobytes() for x in (ids.is_null(), batch.column("held")))
                out = [(-1 - (part + k) % dealing.shards, cut, here, ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), null, length.astype(np.int64).tobytes(), held, b"")]
                out += [(shard, cut, here, *packed) for shard, *packed in shards]  # only shards that the slice has a token for
                kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["shard", "cut", "slice", "word", "fan", "before", "times", "docs"])
                del out, shards  # before the next slice is made

        sent = rows.mapInArrow(send, "shard int, cut int, slice long, word binary, fan binary, before binary, times binary, docs binary")

        def look_up(key: tuple, got: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
            trim()
            if not len(got):
                return pd.DataFrame({"slice": pd.Series(dtype=np.int64), "own": pd.Series(dtype=bool), **{c: pd.Series(dtype=object) for c in "abcd"}})
            if key[0] < 0:  # the slices' own rows pass through, dealt as evenly as the shards
                return pd.DataFrame({"slice": got["slice"], "own": True, "a": got["word"], "b": got["fan"], "c": got["before"], "d": got["times"]})
            trie = BigramTrie.mapped(tries["trie"].iloc[0]) if len(tries) else None
            rows = [(r, False, *(x.tobytes() for x in found)) for r, *found in _found(dealing, got, trie, mu, alpha, size)]
            return pd.DataFrame(rows, columns=["slice", "own", "a", "b", "c", "d"])

        tries = self.tries.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
        met = sent.groupBy("shard", "cut").cogroup(tries.groupBy("shard", "cut"))
        partial = met.applyInPandas(look_up, "slice long, own boolean, a binary, b binary, c binary, d binary")
        begin = -float(np.log10(dealing.trained + mu))  # of the context before the first token

        def gather(got: pd.DataFrame) -> pd.DataFrame:
            trim()
            own = got[got["own"]].iloc[0]
            ids, tokens = np.frombuffer(own["a"], np.int64), np.frombuffer(own["c"], np.int64)
            m = len(ids)
            null, held = (np.unpackbits(np.frombuffer(own[c], np.uint8))[:m].astype(bool) for c in "bd")
            score, base, known = np.full(m, begin), np.zeros(m), np.zeros(m, np.int64)
            for r in got[~got["own"]].sort_values("a").itertuples():
                at = np.frombuffer(r.a, np.uint32)
                score[at] += np.frombuffer(r.b, float)
                base[at] += np.frombuffer(r.c, float)
                known[at] += np.frombuffer(r.d, np.uint32)
            return pd.DataFrame({"doc_id": pd.array([None if x else int(i) for i, x in zip(ids, null)] if null.any() else ids.copy(), "Int64"), "held_out": held, "n_tokens": tokens, "n_known": known, "train_tokens": n, "base_score": base - tokens * np.log10(size), "score": score})

        return partial.groupBy("slice").applyInPandas(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("doc_id", id_col)


def train(docs: DataFrame, mu: float = 20.0, alpha: float = 0.1, text_col: str = "text") -> LanguageModel:
    """Counts over all rows of ``docs``; null texts are empty. Reads the texts twice, for words and for bigrams."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-model")
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = scratch.table(_count_words(rows), "words")
    n, v, trained = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == int(_END.view(np.int64)), F.col("n"))), F.lit(0))).first()
    shards = int(n / SHARD) + 1
    hot = counts.where(F.col("n") > max(1, n / shards / 8)).orderBy(F.desc("n"), "word").limit(HEAD).toPandas()  # 8 * shards rows at most
    order = np.argsort(hot["word"].to_numpy(np.int64).view(np.uint64))
    words, held = hot["word"].to_numpy(np.int64).view(np.uint64)[order], hot["n"].to_numpy(np.int64)[order]
    dealing = _Dealing(shards, trained, bounded_broadcast(spark, (words, held), words.nbytes + held.nbytes))
    scratch.drop("words")
    size = n + alpha * (v + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in slices(batches, limit=_SLICE):
            out = [packed[:5] for packed in dealing.bigrams(batch)[1]]
            kinds = (pa.int32(), *[pa.binary()] * 4)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["shard", "word", "fan", "before", "times"])
            del out  # before the next slice is made

    def build(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        trim()
        word, before = _pairs(got)
        times = np.concatenate([_from_small(r.times, len(r.before) // _BEFORE).astype(np.uint32) for r in got.itertuples()])
        order = np.lexsort((before, word))
        word, before, times = word[order], before[order], times[order]
        del order
        new = _runs(word, before)
        word, before, times = word[new], before[new], sums(times, np.append(new, len(times)))
        del new
        first = _runs(word)
        of = np.append(first, len(word))
        spread = dealing.counts(word[first])
        known = np.where(spread >= 0, spread, sums(times, of))
        value = np.log10(times + np.repeat(mu * (known + alpha) / size, np.diff(of)))
        del times
        return pd.DataFrame({"shard": [key[0]], "trie": [BigramTrie.of(word, before, value, known).to_bytes()]})

    built = rows.mapInArrow(send, "shard int, word binary, fan binary, before binary, times binary").groupBy("shard").applyInPandas(build, "shard int, trie binary")
    return LanguageModel(scratch.table(built, "tries"), dealing, n, v, mu, alpha)


def score_texts(docs: DataFrame, held_out: Column, mu: float = 20.0, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    The model learns from the rows where ``held_out`` is false (null counts as held out). Tokens are the lower-cased (A-Z)
    runs of bytes other than 0x20 and 0x09-0x0D, and one end per text; a null text is empty, which is its end alone.
    ``n_known`` of the tokens were learnt. ``base_score`` sums ``log10((c + alpha) / (N + alpha * (V + 1)))``; ``score`` is the model's
    log10 probability, from one-byte codes of ``c(h w) + mu * p(w)``; ``p(w)`` is that of ``base_score``. Ids are longs; null and repeated ones are rows like others. Without a
    row to learn from every count is 0 and both scores rest on ``alpha``. Other columns are ignored; no rows give none.

    Words are known by 64 bits of hash and the words before one by 48, so of a word's contexts two are one with a chance of 2**-48 a pair.
    """
    held_out = F.coalesce(held_out, F.lit(True))
    return train(docs.where(~held_out), mu, alpha, text_col).score(docs, id_col, text_col, held_out)
