"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding (operator 3).

For every prefix of a byte string exactly one token can end its encoding: a token ``t`` whose forerunner,
the last token of the prefix without ``t``, stays apart from ``t`` when the merges run over both. Keeping
that token for each prefix gives the encoding by walking back from the end; appending bytes extends the
table and changes nothing before, and after an edit only the entries near it are computed again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import cut_contractions, distinct_pieces, latin_bytes, latin_kinds, slices, spread
from .scratch import bounded_broadcast

#: Pieces whose encoding a task remembers, at most; it starts anew beyond that.
REMEMBERED = 150_000
_NEVER = 1 << 62
#: Bytes of text that a task encodes at a time.
_SLICE = 4 << 20


class PrefixBpe:
    """Ranks of tokens, with what the merges of each token look like at its two edges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, int], list[int]] = {}
        self._apart: dict[int, bool] = {}
        # An Aho-Corasick automaton: state * 256 + byte -> state, and of each state the tokens that end there, longest first, as (token, bytes, rest).
        self._go: dict[int, int] = {}
        own, parent, depth = [-1], [(0, 0)], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if (child := self._go.get(node << 8 | b)) is None:
                    child = self._go[node << 8 | b] = len(own)
                    own.append(-1)
                    parent.append((node, b))
                    depth.append(depth[node] + 1)
                node = child
            own[node] = rank
        self._fail = [0] * len(own)
        self._ending: list[tuple | None] = [None] * len(own)
        for node in sorted(range(1, len(own)), key=depth.__getitem__):
            up, b = parent[node]
            fail = self._step(self._fail[up], b) if up else 0
            self._fail[node] = fail
            self._ending[node] = (own[node], depth[node], self._ending[fail]) if own[node] >= 0 else self._ending[fail]
        self._made = len(self._go)

    def _step(self, state: int, byte: int) -> int:
        while (child := self._go.get(state << 8 | byte)) is None and state:
            state = self._fail[state]
        return child or 0

    def _learnt_step(self, state: int, byte: int) -> int:
        """A step by failure links, kept as a direct one; some hundred thousand of them at most."""
        to = self._step(state, byte)
        if len(self._go) < self._made + 2 * REMEMBERED:
            self._go[state << 8 | byte] = to
        return to

    @classmethod
    def from_rank_file(cls, data: bytes) -> PrefixBpe:
        """Lines of a token in base 64 and its rank."""
        return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte, and (-1, -1) where no merges lead to it."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self._halves[token]

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at an edge while ``token`` is merged: first a byte, last itself. side: 0 left, 1 right."""
        if (known := self._edges.get((token, side))) is None:
            halves = self.halves(token)
            known = self._edges[token, side] = ([] if halves is None else self.edge(halves[side], side)) + [token]
        return known

    def reachable(self, token: int) -> bool:
        """Whether merges lead to the token, so that it encodes its own bytes."""
        return self.halves(token) != (-1, -1)

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether encoding both tokens' bytes gives just these two tokens; ``left`` is reachable."""
        known = self._apart.get(left << 20 | right)
        if known is None:
            if len(self._apart) >= 2 * REMEMBERED:
                self._apart.clear()
            known = self._apart[left << 20 | right] = self.reachable(right) and self._merge_apart(left, right)
        return known

    def _merge_apart(self, left: int, right: int) -> bool:
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:  # in the order in which the merges of either token happen
            across = self.ranks.get(self.tokens[a[i]] + self.tokens[b[j]], _NEVER)
            next_a, next_b = a[i + 1] if i + 1 < len(a) else _NEVER, b[j + 1] if j + 1 < len(b) else _NEVER
            if across < next_a and across <= next_b:  # of equal merges the leftmost comes first
                return False
            if next_a == next_b == _NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], states: list[int], stop: int) -> None:
        """Append to ``last`` the token that ends each further prefix of ``data``, up to ``stop`` bytes, and to ``states`` the automaton's state."""
        go, ending, apart = self._go, self._ending, self._apart
        state = states[-1] if states else 0
        for end in range(len(last) + 1, stop + 1):
            b = data[end - 1]
            if (to := go.get(state << 8 | b)) is None:
                to = self._learnt_step(state, b)
            state = to
            tokens = ending[state]
            while tokens is not None:  # just one fits
                token, size, tokens = tokens
                if size == end:
                    if self.reachable(token):
                        break
                elif (fits := apart.get(last[end - size - 1] << 20 | token)) or fits is None and self.stay_apart(last[end - size - 1], token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            states.append(state)

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        return Prefixes(self, data).ids()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last, self.states = bpe, b"", [], []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; entries so far stay as they are."""
        self.data += data
        self.bpe.extend(self.data, self.last, self.states, len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of ``[start:end]``; returns how many entries were computed.

        An entry depends on as many before it as the longest token has bytes; once so many in a row agree
        with the old ones behind the edit, all that follow do.
        """
        old, kept, shift = self.last, self.states, start + len(data) - end
        self.data = self.data[:start] + data + self.data[end:]
        self.last, self.states = old[:start], kept[:start]
        same = 0
        for stop in range(start + 1, len(self.data) + 1):
            self.bpe.extend(self.data, self.last, self.states, stop)
            if stop <= start + len(data):
                continue
            same = same + 1 if old[stop - shift - 1] == self.last[-1] else 0
            if same >= self.bpe.longest:
                self.last += old[stop - shift :]
                self.states += kept[stop - shift :]
                return stop - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.bpe.tokens[out[-1]])
        return out[::-1]


# Letters, numbers and white space below U+0250, as the Unicode classes L, N and White_Space have them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_BEYOND = re.compile("[^\\x00-ɏ]")
_LATIN = re.compile("[^\\x00-ÿ]")


def splitter(pattern: str):  # noqa: ANN201
    """A function that cuts a text into the matches of ``pattern``.

    Texts of code points below U+0250 take Python's ``re`` with its classes spelt out, which is twice as fast.
    """
    full = regex.compile(pattern)
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_S}{_L}{_N}]").replace(r"\p{L}", f"[{_L}]").replace(r"\p{N}", f"[{_N}]").replace(r"\s", f"[{_S}]").replace(r"\S", f"[^{_S}]")
    fast = re.compile(plain) if not re.search(r"\\[pP]", plain) else full
    return lambda text: (full if _BEYOND.search(text) else fast).findall(text)


#: The pattern whose matches :func:`latin_starts` finds.
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KINDS = latin_kinds("\t\n\x0b\x0c\r \x85\xa0")


def latin_starts(raw: bytes, edge: np.ndarray) -> np.ndarray:
    """Where the matches of ``LATIN_PATTERN`` begin in texts of Latin-1, as :func:`.bytewords.latin_bytes` has them."""
    n = len(raw) - 2
    data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KINDS), np.uint8, n)
    new = edge[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = new.copy()
    # a run but of white space takes the blank before it; the white space before that, or up to another character, is a match of its own
    behind = np.flatnonzero(new[1:] & ~edge[1:n] & (kind[:-1] == 0)) + 1
    start[behind - 1] = True
    start[behind[data[behind - 1] == 32]] = False
    cut_contractions(data, edge, start)
    return np.flatnonzero(start)


class Coder:
    """Encodes whole texts for a task, remembering the pieces it has met."""

    def __init__(self, bpe: PrefixBpe, pattern: str):
        self.bpe, self.split, self.latin = bpe, splitter(pattern), pattern == LATIN_PATTERN
        self.encoded: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def _learn(self, piece: str) -> str:
        if len(self.encoded) >= REMEMBERED:  # what is still met comes back from the older half
            self.older, self.encoded = self.encoded, {}
            self.decoded = {}
        if (spelt := self.older.get(piece)) is not None:
            self.encoded[piece] = spelt
            return spelt
        raw = piece.encode()
        whole = self.bpe.ranks.get(raw)
        ids = self.bpe.encode(raw) if whole is None else [whole]
        spelt = " ".join(map(str, ids))
        if len(piece) <= 64:  # a longer one hardly comes again: neither table keeps it
            self.encoded[piece], self.decoded[spelt] = spelt, raw if whole is not None else self.bpe.decode(ids)
        return spelt

    def encode(self, text: str) -> list[str]:
        """The decimal ids of each piece of ``text``, joined by spaces."""
        known = self.encoded
        return [known.get(p) or self._learn(p) for p in self.split(text)]

    def decode(self, pieces: list[str]) -> bytes:
        known, tokens = self.decoded, self.bpe.tokens
        return b"".join([known[p] if p in known else b"".join(tokens[int(i)] for i in p.split()) for p in pieces])


    def encode_and_decode(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Of each text how many ids it has, these in decimal, joined by spaces, and the bytes that they decode to.

        Texts of Latin-1 are cut many at a time in numpy, and each of their distinct pieces is met once; others are cut by the pattern.
        """
        quick = [self.latin and (t.isascii() or _LATIN.search(t) is None) for t in texts]
        found = iter(self._latin([t for t, q in zip(texts, quick) if q]))
        return [next(found) if q else self._whole(t) for t, q in zip(texts, quick)]

    def _whole(self, text: str) -> tuple[int, bytes, bytes]:
        pieces = self.encode(text)
        spelt = " ".join(pieces)
        return spelt.count(" ") + 1 if spelt else 0, spelt.encode(), self.decode(pieces)

    def _latin(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        raw, offs, edge = latin_bytes(texts)
        starts = latin_starts(raw, edge)
        codes, pieces = distinct_pieces(np.frombuffer(raw, np.uint8), starts, int(offs[-1]))
        del raw, edge
        spelt = [self.encoded.get(p) or self._learn(p) for p in (p.decode("latin-1") for p in pieces)]
        firsts = np.searchsorted(starts, offs)
        n = np.append(0, np.cumsum(np.array([s.count(" ") + 1 for s in spelt], np.int64)[codes.to_numpy()]))[firsts]
        coded = spread([s.encode() + b" " for s in spelt], codes, firsts)
        back = spread([self.decode([s]) for s in spelt], codes, firsts)
        return [(k, bytes(c[:-1]), bytes(b)) for k, c, b in zip(np.diff(n).tolist(), coded, back)]


_CODERS: dict[int, Coder] = {}


def _coder(ranks: dict[bytes, int], pattern: str) -> Coder:
    """The coder of this Python worker, which keeps what it has learnt from one task to the next."""
    key = hash((pattern, len(ranks), sum(ranks.values()), b"".join(ranks)))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(PrefixBpe(ranks), pattern)
    return _CODERS[key]


def encode_texts(docs: DataFrame, bpe: PrefixBpe, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(id, n_tokens, ids, ids_sha256, decoded_sha256)`` of every whole text of ``docs``; ``ids`` only on demand.

    A null text is empty and has no ids; both hashes are then those of nothing. Rows stay as they are, also
    repeated ones and those with a null id; other columns are ignored. One pass without a shuffle.
    """
    shared = bounded_broadcast(docs.sparkSession, (bpe.ranks, pattern), sum(map(len, bpe.ranks)) + 64 * len(bpe.ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for batch in slices(batches, limit=_SLICE):
            n, ids, coded, back = [], [], [], []
            for count, spelt, decoded in coder.encode_and_decode([t or "" for t in batch.column("text").to_pylist()]):
                n.append(count)
                if with_ids:
                    ids.append([int(i) for i in spelt.split()])
                coded.append(hashlib.sha256(spelt).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
            columns = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64())} | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}) | {"ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, bpe: PrefixBpe, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its id lists; null lists give null."""
    shared = bounded_broadcast(encoded.sparkSession, bpe.tokens, sum(map(len, bpe.ranks)) + 64 * len(bpe.ranks))

    @F.pandas_udf("binary")
    def decode(lists):  # noqa: ANN001, ANN202
        tokens = shared.value
        return lists.map(lambda ids: None if ids is None else b"".join([tokens[i] for i in ids]))

    return encoded.withColumn(out_col, decode(F.col(ids_col)))
