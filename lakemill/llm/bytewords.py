"""Words, hashes and shingles of whole Arrow batches of texts, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Nothing here loops over
words in Python: a batch's bytes are hashed with prefix sums of ``code[byte] * P**i`` modulo 2**64, from
which the hash of any span follows by one subtraction and one product with ``P**-start``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SOLID = np.ones(256, bool)
_SOLID[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _CODE[LOWER]  # hashing with these lower-cases A-Z on the way
_P = int(_rng.integers(1 << 62, 1 << 63)) * 2 % (1 << 64) | 5
_P_INVERSE = pow(_P, -1, 1 << 64)
_GAPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_POW, _INV = _powers(_P, 2 * _BLOCK), _powers(_P_INVERSE, 2 * _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of text that one numpy pass works on; a longer text is a pass of its own. The smaller one is for passes that hold many arrays at once.
SLICE_BYTES, SMALL_SLICE = 1 << 20, 1 << 18


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece hold about ``limit`` bytes, or one row."""
    for batch in batches:
        _, offs = text_bytes(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each two offsets, along the first axis; 0 where they are equal."""
    out = np.zeros((len(offs) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(offs[1:] > offs[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, offs[:-1][some], axis=0)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string or binary column end to end, and n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    if where is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n + 1 offsets of the texts' words."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offs[(offs > 0) & (offs < n)]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of ascending, disjoint spans; with ``fold`` A-Z count as a-z."""
    code = _FOLDED if fold else _CODE
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = starts[k]
        j = max(k + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        size = int(ends[j - 1] - base)
        power, inverse = (_POW, _INV) if size <= len(_POW) else (_powers(_P, size), _powers(_P_INVERSE, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(code[data[base : base + size]] * power[:size], out=sums[1:])
        s, e = starts[k:j] - base, ends[k:j] - base
        out[k:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _GAPS[63]
        k = j
    return mix(out)


def shingle_hashes(words: np.ndarray, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of ``size`` words; fewer words count as one run."""
    m = len(words) - size + 1
    runs = np.zeros(max(m, 0), np.uint64)
    if m > 0:
        for j in range(size):
            runs += words[j : j + m] * _GAPS[j]
        runs = mix(runs)
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = np.append(words[a:b] * _GAPS[: b - a], _GAPS[61 - (b - a)])
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def latin_kinds(spaces: str) -> bytes:
    """For ``bytes.translate``: of each Latin-1 character 0 for one of ``spaces``, else 1 for a letter, 2 for a number and 3 for any other."""
    each = [chr(i) for i in range(256)]
    return bytes(0 if c in spaces else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in each)


def latin_bytes(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Latin-1 bytes of the texts end to end with two zeros behind them, their n + 1 offsets, and where a text begins or all end; no texts beyond Latin-1."""
    raw = [t.encode("latin-1") for t in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offs[1:])
    edge = np.zeros(offs[-1] + 3, bool)
    edge[offs] = True
    return b"".join([*raw, b"\0\0"]), offs, edge


def cut_contractions(data: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
    """Where a piece starts with 's 't 'm 'd 're 've or 'll in ``data``, let it be just that."""
    at = np.flatnonzero(start & (data[: len(start)] == 39))
    first, second = np.where(edge[at + 1], 0, data[at + 1]), np.where(edge[at + 2], 0, data[at + 2])
    size = np.isin(first, list(b"stmd")) + 2 * (np.isin(first, list(b"rv")) & (second == 101) | (first == 108) & (second == 108))
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    behind = at + 1 + size
    start[behind[behind < len(start)]] = True


def distinct_pieces(data: np.ndarray, starts: np.ndarray, end: int) -> tuple[pa.Array, list[bytes]]:
    """Which of the distinct pieces, and these: a piece is from one start to the next, the last one up to ``end``."""
    places = pa.py_buffer(np.append(starts, end).astype(np.int32))
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, places, pa.py_buffer(data)]).dictionary_encode()
    return coded.indices, coded.dictionary.to_pylist()


def spread(values: list[bytes], codes: pa.Array, firsts: np.ndarray) -> list[memoryview]:
    """The values of all ``codes`` end to end, cut before the codes with these numbers."""
    raw, offs = text_bytes(pa.array(values, pa.binary()).take(codes))
    raw, cuts = memoryview(np.ascontiguousarray(raw)), offs[firsts].tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]
