"""Totals of hashed keys over the whole corpus, brought back to the input partitions that hold the keys.

Vertical partitioning: the space of keys is cut into ranges (fragments), as many as there are shuffle
partitions. Every input partition sends each fragment its own distinct keys with their weights, already
summed, so a key of any frequency arrives once from a partition and no key is hot. A fragment sums them
and sends each input partition the totals of its own keys, which land in one file a partition in the
shared folder. A second scan of the same frame then opens the file of its partition. Nothing goes
through the driver or is broadcast, and all traffic is linear in the number of distinct keys a partition.

Both scans must see the same partitions. Each file holds a checksum of its partition's rows, and the
second scan fails loudly if its own differs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import storage, textscan

#: Keys that a scan gathers before it sums them and sends them off.
FLUSH_KEYS = 3_000_000
_SCHEMA = "frag int, part int, kind int, keys binary, sums binary"
_ARROW = pa.schema([("frag", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])
KEYS, CHECK, STATS = 0, 1, 2


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, or counts, in the narrowest type, compressed: all lowest bytes first, for the highest ones
    are nearly alike and shrink only where they stand together."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + zstandard.compress(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1 if len(values) else 1).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[data[0]]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begins], np.add.reduceat(weights, begins)


def _row(frag: int, part: int, kind: int, keys: bytes, sums: bytes) -> tuple:
    return frag, part, kind, keys, sums


def _batches(rows: Iterator[tuple], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of some MB each, so that no batch outgrows what Arrow and the worker can hold."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + len(row[4])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW, strict=True)], schema=_ARROW)


class Checksum:
    """Of the rows that a scan has seen, in order."""

    def __init__(self) -> None:
        self.value = 0

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                data, offsets = textscan.flat(column)
                self.value = zlib.crc32(offsets.tobytes(), zlib.crc32(data, self.value))
        return batch


@dataclass(frozen=True)
class Totals:
    """Files with the totals of each input partition's keys."""

    uri: str
    stats: list[bytes]

    def of_partition(self) -> tuple[np.ndarray, np.ndarray, int]:
        """In a task of the second scan: its partition's keys (sorted), their totals, and the checksum to expect."""
        data = storage.get_file(f"{self.uri}/{TaskContext.get().partitionId()}.totals")
        if data is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
        n, check = (int(x) for x in np.frombuffer(data[:16], np.uint64))  # n: bytes of the keys
        return unpack_sorted(data[16 : 16 + n]), unpack(data[16 + n :]), check

    def remove(self) -> None:
        storage.remove(self.uri)


def verify(check: Checksum, expected: int) -> None:
    if check.value != expected:
        raise RuntimeError("the second scan's partition has other rows than the first scan's; the input must be read in the same partitions each time")


def lookup(keys: np.ndarray, totals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Totals of the wanted keys, 0 for those without."""
    if not len(keys):
        return np.zeros(len(wanted), np.uint64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, totals[at], np.uint64(0))


def partition_totals(docs: DataFrame, extract: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], label: str, least: int = 1, bits: int = 64, stats: Callable[[np.ndarray, np.ndarray], bytes] | None = None, flush_keys: int = FLUSH_KEYS) -> Totals:
    """Totals of the keys that `extract` finds in the frame's batches: (keys below 2**bits, weights).

    A task holds `flush_keys` keys, or a batch's, before it sums them. Only totals of at least `least` come back. `stats` condenses a fragment's keys and totals to a few KB,
    which the driver gets from each fragment.
    """
    spark = docs.sparkSession
    frags = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = storage.new_dir(spark, label)
    edges = np.array([(i << bits) // frags for i in range(1, frags)], np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, check = TaskContext.get().partitionId(), Checksum()

        def flush(held: list) -> Iterator[tuple]:
            keys, sums = summed(np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held]))
            cuts = [0, *np.searchsorted(keys, edges), len(keys)]
            for f in range(frags):
                if cuts[f] < cuts[f + 1]:
                    yield _row(f, part, KEYS, pack_sorted(keys[cuts[f] : cuts[f + 1]]), pack(sums[cuts[f] : cuts[f + 1]]))

        def rows() -> Iterator[tuple]:
            held, size, seen = [], 0, False
            for batch in batches:
                seen = True
                for keys, weights in extract(check.add(batch)):
                    held.append((keys, weights.astype(np.uint64)))
                    size += len(keys)
                    if size >= flush_keys:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)
            if seen:
                yield _row(part % frags, part, CHECK, b"", np.uint64(check.value).tobytes())

        yield from _batches(rows())
        storage.release()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = []
            for batch in batches:
                for frag, part, kind, keys, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == CHECK:
                        yield _row(part % frags, part, CHECK, keys, sums)
                    else:
                        held.append((part, unpack_sorted(keys), unpack(sums)))
            if not held:
                return
            keys = np.concatenate([k for _, k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            sums = np.concatenate([s for _, _, s in held])[order]
            parts = np.repeat(np.array([p for p, _, _ in held], np.int64), [len(k) for _, k, _ in held])[order]
            held.clear()
            fresh = np.r_[True, keys[1:] != keys[:-1]]
            begins = np.flatnonzero(fresh)
            totals = np.add.reduceat(sums, begins)
            if stats:
                yield _row(0, 0, STATS, b"", stats(keys[begins], totals))
            totals = totals[np.cumsum(fresh) - 1]
            keep = totals >= least
            keys, totals, parts = keys[keep], totals[keep], parts[keep]
            order = np.argsort(parts, kind="stable")  # keys stay sorted in each part
            keys, totals, parts = keys[order], totals[order], parts[order]
            begins = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
            for b, e in zip(begins, [*begins[1:], len(parts)], strict=True):
                fresh = np.flatnonzero(np.r_[True, keys[b + 1 : e] != keys[b : e - 1]])  # a part may have sent a key twice
                yield _row(int(parts[b]) % frags, int(parts[b]), KEYS, pack_sorted(keys[b:e][fresh]), pack(totals[b:e][fresh]))

        yield from _batches(rows())
        storage.release()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[int, list] = {}
            checks: dict[int, bytes] = {}
            for batch in batches:
                for _, part, kind, keys, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == STATS:
                        yield _row(0, 0, STATS, b"", sums)
                    elif kind == CHECK:
                        checks[part] = sums
                    else:
                        held.setdefault(part, []).append((keys, sums))
            for part, check in checks.items():
                got = [(unpack_sorted(k), unpack(s)) for k, s in held.pop(part, [])]
                keys = np.concatenate([k for k, _ in got]) if got else np.zeros(0, np.uint64)
                sums = np.concatenate([s for _, s in got]) if got else np.zeros(0, np.uint64)
                order = np.argsort(keys, kind="stable")
                body = pack_sorted(keys[order])
                storage.put_file(f"{uri}/{part}.totals", np.uint64(len(body)).tobytes(), check, body, pack(sums[order]))

        yield from _batches(rows())
        storage.release()

    found = docs.mapInArrow(scan, _SCHEMA).repartitionById(frags, "frag").mapInArrow(total, _SCHEMA)
    found = found.repartitionById(frags, "frag").mapInArrow(store, _SCHEMA)
    totals = Totals(uri, [bytes(r.sums) for r in found.select("sums").collect()])
    del found
    storage.tidy(spark)  # the files hold all that is wanted of the shuffles
    return totals
