"""Packing of texts into windows by non-negative least squares over a length histogram (operator 4).

After Krell et al., "Efficient Sequence Packing without Cross-contamination" (2021). Texts longer than the
window are cut into whole windows and a rest. The histogram of the rests, rounded up to ``unit`` ids, is a
few hundred numbers however large the corpus is; the driver solves for how often each combination of up
to ``depth`` lengths that fills a window should be used. Rests are dealt into blocks of a bounded number
of rows, each block takes its share of the repeat counts, rounded down, and packs what is left greedily.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import cut_contractions, distinct_pieces, latin_bytes, latin_kinds, slices, spread
from .scratch import Scratch, bounded_broadcast, kept, lean

#: Rows that one task packs at a time.
BLOCK_ROWS = 32_768
#: Words after which a task begins a new table of their ids; the one before is kept until then.
REMEMBERED = 200_000

# The texts that the quick path takes: printable Latin-1 without the no-break space, which NFC leaves as they are.
_PLAIN = re.compile("[^\t\n\r -~¡-ÿ]")
_KINDS = latin_kinds("\t\n\r ")
# The characters that byte-level tokenizers write for bytes: printable Latin-1 for itself, the others from 256.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELT = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(_OWN)))}
_LOWER = bytes(ord(chr(i).lower()) for i in range(256))


class WordIds:
    """Ids of whole texts by a tokenizer file that lower-cases, splits at words and has no ids across them.

    Texts of printable Latin-1 are split here, many at a time in numpy, and each distinct word is encoded once by the library;
    any other text, and one with a special token's string, is encoded whole by the library.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_buffer(data)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        tokens = self.tokenizer.get_vocab()
        self.merges = self.tokenizer.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(max(tokens.values()) + 1)]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: bytes) -> bytes:
        """Ids of a Latin-1 word, by the library's merges alone: it is in lower case, composed and cut already."""
        text = word.decode("latin-1")
        if len(text) > 64:  # an object for each id would be large
            return self._bytes([text])[0]
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(_SPELT)
        return b"".join([self.four[t.id] for t in self.merges(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four little-endian bytes each."""
        out = [self._bytes([t])[0] if _PLAIN.search(t) or any(s in t for s in self.special) else None for t in texts]
        quick = iter(self._plain([t for t, done in zip(texts, out) if done is None]))
        return [next(quick) if done is None else done for done in out]

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw, offs, edge = latin_bytes(texts)
        n = int(offs[-1])
        raw = raw.translate(_LOWER)
        data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KINDS), np.uint8, n)
        del raw
        start = edge[:n] | (kind == 2)  # numbers stand alone
        start[1:] |= kind[1:] != kind[:-1]
        cut_contractions(data, edge, start)
        starts = np.flatnonzero(start & (kind > 0))
        codes, pieces = distinct_pieces(data, starts, n)  # with the white space behind them
        words = [p.rstrip(b"\t\n\r ") for p in pieces]
        if len(self.known) >= REMEMBERED:  # what is still met comes back from the older half
            self.older, self.known = self.known, {}
        known = self.known
        missing = set(words).difference(known)
        known.update((w, self.older[w]) for w in missing.intersection(self.older))
        new = list(missing.difference(self.older))
        known.update((w, self._word(w)) for w in new)
        found = [bytes(x) for x in spread([known[w] for w in words], codes, np.searchsorted(starts, offs))]
        for w in new:
            if len(w) > 64:
                del known[w]
        return found


def _coder(data: bytes) -> WordIds:
    """The coder of this Python worker, which keeps what it has learnt from one task to the next, until another operator's starts."""
    return kept(("packing", hash(data)), lambda: WordIds(data))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|``, by the active-set method of Lawson and Hanson on the normal equations."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    ab, scale = a.T @ b, max(1e-300, np.abs(a.T @ b).max())
    for _ in range(3 * len(b)):
        w = ab - a.T @ (a @ x)
        w[active] = -np.inf
        if active.all() or w.max() <= tolerance * scale:
            break
        active[int(w.argmax())] = True
        while active.any():
            at = np.flatnonzero(active)
            some = a[:, at]
            s = np.linalg.solve(some.T @ some + 1e-12 * np.eye(len(at)), ab[at])
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = (x[at][low] / np.maximum(x[at][low] - s[low], 1e-300)).min()
            x[at] += step * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``depth`` numbers from 1 that add up to ``classes``."""
    out: list[tuple[int, ...]] = []

    def fill(left: int, most: int, parts: tuple[int, ...]) -> None:
        if 0 < left <= most:
            out.append((*parts, left))
        if len(parts) + 1 < depth:
            for p in range(min(most, left - 1), 0, -1):
                if p * (depth - len(parts)) < left:
                    break
                fill(left - p, p, (*parts, p))

    fill(classes, classes, ())
    return out


def repeat_shares(histogram: dict[int, int], classes: int, depth: int = 3) -> list[tuple[tuple[int, ...], float]]:
    """Combinations in use and how often each is repeated, per row of the histogram."""
    total = sum(histogram.values())
    if not total:
        return []
    b = np.array([histogram.get(c, 0) for c in range(1, classes + 1)], float) / total
    some = [c for c in combinations(classes, depth) if all(b[p - 1] > 0 for p in c)]
    if not some:
        return []
    a = np.zeros((classes, len(some)))
    for k, c in enumerate(some):
        for p in c:
            a[p - 1, k] += 1
    # Short lengths fill gaps well, so leaving or overdrawing some of them matters less.
    weight = np.where(np.arange(1, classes + 1) > classes // 32, 1.0, 0.1)
    x = nnls(a * weight[:, None], b * weight)
    return [(c, v) for c, v in zip(some, x.tolist()) if v > 0]


def pack_block(lengths: np.ndarray, window: int, unit: int, shares: list[tuple[tuple[int, ...], float]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length. No sequence is longer than ``window``."""
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    whole = np.flatnonzero(lengths >= window)
    sequence[whole] = np.arange(len(whole))
    made = len(whole)
    rests = np.flatnonzero(lengths < window)
    size = -(-lengths[rests] // unit)
    order = rests[np.argsort(size, kind="stable")]
    classes = window // unit
    cuts = np.searchsorted(np.sort(size), np.arange(classes + 2))
    left = {c: list(order[cuts[c] : cuts[c + 1]]) for c in range(1, classes + 1) if cuts[c + 1] > cuts[c]}

    def put(rows: list[int]) -> None:
        nonlocal made
        at = 0
        for r in rows:
            sequence[r], offset[r] = made, at
            at += int(lengths[r])
        made += 1

    for parts, share in shares:
        need = {p: parts.count(p) for p in set(parts)}
        times = min([int(share * len(rests)), *(len(left.get(p, [])) // k for p, k in need.items())])
        for _ in range(times):
            put([left[p].pop() for p in parts])
    sizes = np.array(sorted(left), np.int64)
    count = np.array([len(left[c]) for c in sizes], np.int64)
    while len(sizes := sizes[count > 0]):
        count = count[count > 0]
        rows, gap = [], window
        at = len(sizes) - 1
        while at >= 0:
            rows.append(left[int(sizes[at])].pop())
            count[at] -= 1
            gap -= int(lengths[rows[-1]])
            fits = np.flatnonzero((sizes * unit <= gap) & (count > 0))
            if len(fits):
                at = int(fits[-1])
            else:  # the next class up may still hold one that fits, for its length was rounded up
                up = np.flatnonzero((sizes == gap // unit + 1) & (count > 0))
                pick = [k for k, r in enumerate(left[int(sizes[up[0]])]) if lengths[r] <= gap][:1] if len(up) else []
                if pick:
                    rows.append(left[int(sizes[up[0]])].pop(pick[0]))
                    count[up[0]] -= 1
                at = -1
        put(rows)
    return sequence, offset


def cut_into_pieces(docs: DataFrame, tokenizer: bytes, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)`` of each piece, its ``ids`` on demand.

    A text is its ids and ``end_id``, cut every ``window`` ids, so none has no piece: a null or empty one has ``end_id`` alone.
    """
    shared = bounded_broadcast(docs.sparkSession, tokenizer, len(tokenizer))
    close = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            ids: list[bytes] = []
            for i, coded in enumerate(coder.encode([t or "" for t in batch.column("text").to_pylist()])):
                coded += close
                n = len(coded) // 4
                for start in range(0, n, window):
                    piece = coded[4 * start : 4 * (start + window)]
                    rows.append((i, start, len(piece) // 4, zlib.crc32(piece), n))
                    if with_ids:
                        ids.append(piece)
            at, *rest = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 5
            columns = {"doc_id": batch.column("id").take(pa.array(at))} | dict(zip(("start", "length", "ids_crc32", "doc_tokens"), map(pa.array, rest)))
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run, keep="packing"), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{', ids binary' * with_ids}")


def pack(docs: DataFrame, tokenizer: bytes, end_id: int = 1, window: int = 2048, unit: int = 8, depth: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on demand, ``ids`` (four little-endian bytes each).

    Every id of every text lies in one piece. A sequence is the pieces of one ``sequence_id``, without gaps
    from ``offset`` 0 and not longer than ``window``. A null text counts as an empty one, which is one piece of
    ``end_id``; rows with a null or repeated id are texts of their own; other columns are ignored. No rows give no pieces.

    Texts are encoded once and their pieces written to the shared folder. Two small shuffles follow: 256
    counts, and rows of seven numbers dealt evenly into blocks.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(cut_into_pieces(docs, tokenizer, end_id, window, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = pieces.groupBy(F.when(F.col("length") < window, F.ceil(F.col("length") / unit)).alias("size")).count().collect()  # at most window / unit + 1 rows
    shares = repeat_shares({r["size"]: r["count"] for r in counts if r["size"] is not None}, window // unit, depth)
    blocks = max(1, -(-sum(r["count"] for r in counts) // block_rows))
    columns = [f for f in pieces.schema.fields if f.name != "row"]

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        sequence, offset = pack_block(rows["length"].to_numpy(), window, unit, shares)
        return rows.drop(columns=["row", "block"]).assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in columns), "sequence_id long, offset long"])
    return pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("block").applyInPandas(place, schema)
