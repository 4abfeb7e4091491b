"""Words and word shingles of whole Arrow columns of text by numpy, without a Python loop over words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, compared after A-Z is lower-cased. They
stand as 64-bit hashes: a polynomial over random byte values modulo 2**64, taken from running sums and
then mixed. Two different words or shingles share a hash with probability about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are scanned in chunks of about so many bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_STEP = _U(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else _U(pow(int(_BASE), -1, 2**64))
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null as empty), and each text's offsets in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive pieces of a column."""
    data, offsets = flat(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words; and where each text's words begin among them (n + 1 values)."""
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power("up", len(data) + 1), _power("down", len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, begins: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted: of `size` words, or of all words if it has fewer; none without words."""
    counts = np.diff(begins)
    rolled = np.zeros(0, np.uint64)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _STEP + words[k : len(words) - size + 1 + k]
        rolled = mix(rolled)
    out = []
    for i, n in enumerate(counts):
        b = begins[i]
        if n >= size:
            own = np.sort(rolled[b : b + n - size + 1])
            out.append(own[np.flatnonzero(np.r_[True, own[1:] != own[:-1]])])
        elif n:
            h = words[b : b + 1].copy()
            for k in range(1, n):
                h = h * _STEP + words[b + k : b + k + 1]
            out.append(mix(h + _U(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
