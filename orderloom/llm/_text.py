"""Vectorised word handling over Arrow string columns (shared by the text operators).

Whole batches of texts are treated as one byte buffer: word boundaries, word hashes and
n-gram hashes are computed by numpy without a Python loop over words or documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 1 << 20
CHUNK = 4 << 20

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_STEP = _rng.integers(1, 1 << 62, 64, dtype=U) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(int(_P), -1, 1 << 64))

#: Bytes between words: white space, or every ASCII byte that is neither letter nor digit.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[:128] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    SYMBOL[_lo:_hi] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = max(n, BLOCK + 1)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, U)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["i"][:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches, text: str = "text", limit: int = CHUNK):
    """Batches again, split so that the texts of one hold about ``limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offs = buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            to = min(to, at + 60_000)
            yield batch.slice(at, to - at)
            at = to


def spans(data: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~gap[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold``, A-Z count as a-z."""
    table = _TABLE[FOLD] if fold else _TABLE
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        span = data[first : ends[to - 1]]
        p, inv = _powers(len(span) + 1)
        total = np.empty(len(span) + 1, U)
        total[0] = 0
        np.cumsum(table[span] * p[: len(span)], out=total[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = (total[e] - total[s]) * inv[s] + (e - s).astype(U)
        at = to
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words, whatever texts they belong to."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m] * _STEP[0]
    for j in range(1, n):
        out += h[j : j + m] * _STEP[j]
    return mix(out)


def whole(h: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hash of short word sequences [at, to), each as a gram of its own length."""
    out = np.zeros(len(at), U)
    for j in range(int((to - at).max(initial=0))):
        live = at + j < to
        out[live] += h[at[live] + j] * _STEP[j]
    return mix(out)


def planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte, so that equal high bytes compress."""
    raw = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def unplanes(blob, n: int, width: int, at: int = 0) -> tuple[np.ndarray, int]:
    """What planes() packed, and where its bytes end."""
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return raw.view("<u8").reshape(-1).astype(U), at + n * width


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; for whole chunks much faster than np.unique, which hashes."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+len."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return base + np.arange(total)


def runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true flags; a break at i parts i-1 from i."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | breaks[at[1:]]
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))
