"""Greedy word-piece token counts by a linear longest-match automaton (operator 10).

The vocabulary is a byte trie with two roots, one for pieces that begin a word and one for pieces that go
on. Each node has a failure link, the node that is left when the longest pieces have been cut off the
string read so far, and the number of pieces cut off on that way (Song et al., "Fast WordPiece
Tokenization", 2021). Reading a word takes a step a byte, and adding the counts of the links taken gives
the number of its pieces; no piece is built. A batch's distinct words run in step with each other, as
numpy arrays of states.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import slices, span_hashes, sums, text_bytes, word_spans
from .scratch import bounded_broadcast

_FIRST, _NEXT = 0, 1
#: Words of more bytes than this are few and read one at a time.
LONG = 256


class LongestMatch:
    """The automaton of a vocabulary.

    ``initial`` are the pieces that can begin a word, ``following`` those that can go on. A word with a
    rest that no piece begins counts as one unknown token.
    """

    def __init__(self, initial: Iterable[bytes], following: Iterable[bytes]):
        go: dict[tuple[int, int], int] = {}
        parent, byte, depth, ends = [-1, -1], [0, 0], [0, 0], [False, False]
        for root, pieces in ((_FIRST, initial), (_NEXT, following)):
            for piece in pieces:
                node = root
                for b in piece:
                    if (child := go.get((node, b))) is None:
                        child = go[node, b] = len(parent)
                        parent.append(node)
                        byte.append(b)
                        depth.append(depth[node] + 1)
                        ends.append(False)
                    node = child
                ends[node] = ends[node] or bool(piece)
        fail, pops = [-1] * len(parent), [0] * len(parent)
        for node in sorted(range(2, len(parent)), key=depth.__getitem__):
            if ends[node]:
                fail[node], pops[node] = _NEXT, 1
                continue
            back, popped = fail[parent[node]], pops[parent[node]]
            while back >= 0 and (back, byte[node]) not in go:
                popped += pops[back]
                back = fail[back]
            if back >= 0:
                fail[node], pops[node] = go[back, byte[node]], popped
        keys = np.array([n * 256 + b for n, b in go], np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.array(list(go.values()), np.int32)[order]
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        self._lists: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None}

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.children, self.fail, self.pops))

    def _step(self, states: np.ndarray, read: np.ndarray) -> np.ndarray:
        want = states.astype(np.int64) * 256 + read
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.children[at], -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[start:end]``; -1 where it is unknown."""
        n = ends - starts
        if n.max(initial=0) > LONG:
            out, short = np.empty(len(n), np.int64), n <= LONG
            out[short] = self.lengths(data, starts[short], ends[short])
            for i in np.flatnonzero(~short).tolist():
                out[i] = self._length(data[starts[i] : ends[i]].tobytes())
            return out
        order = np.argsort(-n, kind="stable")
        longest = n[order]
        state, count = np.full(len(n), _FIRST, np.int32), np.zeros(len(n), np.int64)
        if not len(self.keys):
            return np.full(len(n), -1, np.int64)
        for p in range(int(longest[0]) if len(n) else 0):
            at = order[: int(np.searchsorted(-longest, -p, side="left"))]  # words of more than p bytes
            at = at[state[at] >= 0]
            read = data[starts[at] + p]
            while len(at):
                to = self._step(state[at], read)
                hit = to >= 0
                state[at[hit]] = to[hit]
                at, read = at[~hit], read[~hit]
                count[at] += self.pops[state[at]]
                state[at] = self.fail[state[at]]
                live = state[at] >= 0
                at, read = at[live], read[live]
        at = np.flatnonzero((state >= 0) & (state != _NEXT))
        while len(at):
            count[at] += self.pops[state[at]]
            state[at] = self.fail[state[at]]
            at = at[(state[at] >= 0) & (state[at] != _NEXT)]
        return np.where(state == _NEXT, count, -1)


    def _length(self, word: bytes) -> int:
        """The same for one word, byte by byte."""
        if self._lists is None:
            self._lists = dict(zip(self.keys.tolist(), self.children.tolist())), self.fail.tolist(), self.pops.tolist()
        go, fail, pops = self._lists
        state, count = _FIRST, 0
        for b in word:
            while (to := go.get(state << 8 | b)) is None:
                count += pops[state]
                state = fail[state]
                if state < 0:
                    return -1
            state = to
        while state != _NEXT:
            count += pops[state]
            state = fail[state]
            if state < 0:
                return -1
        return count


def pieces_of_model(path: str) -> tuple[list[bytes], list[bytes]]:
    """The pieces of a SentencePiece model that begin a word (marked U+2581) and those that go on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    initial = [p[1:].encode() for p in plain if p.startswith("▁") and "▁" not in p[1:] and len(p) > 1]
    return initial, [p.encode() for p in plain if "▁" not in p]


def count_tokens(docs: DataFrame, automaton: LongestMatch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)`` longs of every row of ``docs``, over its whole text.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), with their case. A null or empty text
    has no words and no tokens; an unknown word counts as one token. Rows are kept as they are, also
    repeated ones and those with a null id; other columns are ignored. One pass over the texts without a shuffle.
    """
    spark = docs.sparkSession
    shared = bounded_broadcast(spark, automaton, automaton.nbytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in slices(batches):
            data, offs = text_bytes(batch.column("text"))
            starts, ends, of = word_spans(data, offs)
            _, first, again = np.unique(span_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
            n = machine.lengths(data, starts[first], ends[first])
            tokens = sums(np.maximum(n, 1)[again], of)
            unknown = sums((n < 0).astype(np.int64)[again], of)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (of[1:] - of[:-1], tokens, unknown))], ["id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
