"""Canonical, length-limited Huffman coding of token ids with numpy.

Codes are at most MAX_BITS long (package-merge), so one table of 2**MAX_BITS entries decodes any code in a
single look-up. A block's bit stream has checkpoints: the bit offset of every LANE-th id. Decoding runs all
lanes of a block in step, one look-up an id and lane; it can also begin at any checkpoint.
"""

from __future__ import annotations

import numpy as np

MAX_BITS = 16
#: Ids between two checkpoints.
LANE = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to the limit for the ids with a count; 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"more than {1 << limit} ids")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # package-merge: of each level, remember which items of the merged list are packages
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at >= len(weights))
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for packaged in reversed(levels):
        chosen = packaged[:take]
        singles = int((~chosen).sum())
        depth[:singles] += 1
        take = 2 * int(chosen.sum())
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - before
            codes[i], before = code, n
            code += 1
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, and the bit offset of every LANE-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.uint64)
        bits, codes = self.lengths[ids], self.codes[ids]
        if not bits.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(bits)
        begins = ends - bits
        word, shift = begins >> 6, 64 - (begins & 63) - bits
        words = np.zeros(int(ends[-1] + 63) // 64 + 1, np.uint64)
        inside = np.where(shift >= 0, codes << np.maximum(shift, 0).astype(np.uint64), codes >> np.maximum(-shift, 0).astype(np.uint64))
        firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[firsts]] = np.bitwise_or.reduceat(inside, firsts)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= codes[over] << (64 + shift[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], begins[::LANE].astype(np.uint64)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every value of the next MAX_BITS bits."""
        if self._table is None:
            ids, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.int64)
            for i in np.flatnonzero(self.lengths):
                n = int(self.lengths[i])
                at = int(self.codes[i]) << (MAX_BITS - n)
                ids[at : at + (1 << (MAX_BITS - n))] = i
                sizes[at : at + (1 << (MAX_BITS - n))] = n
            self._table = ids, sizes
        return self._table

    def decode(self, stream: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        """The block's ids; `checkpoints` may also be those from some lane on, with the count from there."""
        ids, sizes = self.table()
        raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
        out = np.zeros((len(checkpoints), LANE), np.uint32)
        at = checkpoints.astype(np.int64)
        lanes = np.arange(len(checkpoints))
        rest = np.minimum(LANE, count - LANE * lanes)
        for k in range(min(LANE, count)):
            if k == rest[-1]:  # the last lane is the only short one
                lanes, at = lanes[:-1], at[:-1]
            peek = (window[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[lanes, k] = ids[peek]
            at = at + sizes[peek]
        return out.ravel()[:count]
