"""Document fingerprints by winnowing.

All k-grams of code points are hashed by a rolling polynomial; of every window of `window` successive hashes
the least is kept, the rightmost among equals, with its position. Any match of at least window + k - 1 code
points between two texts then shares a kept hash. A text with fewer k-grams than a window is one window; one
shorter than k is one gram; an empty or null text keeps nothing.

The likeness of two fingerprints is the Jaccard coefficient of their sets of hashes; 1 if both are empty.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage
from .textscan import mix

K = 16
#: A match of WINDOW + K - 1 = 23 code points is found, so a text of 36 or more shares a hash with its edited text.
WINDOW = 8
_BASE = 0x9E3779B97F4A7C15


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams, by doubling: a hash of 2m points is one of m times a power plus the next."""
    if not len(points):
        return np.zeros(0, np.uint64)
    k = min(k, len(points))
    have, size, out, done = points.astype(np.uint64), 1, None, 0
    while True:
        if k & size:  # the gram is made of pieces whose sizes are the bits of k
            piece = have[done:]
            out = piece if out is None else out[: len(piece)] * np.uint64(pow(_BASE, size, 2**64)) + piece[: len(out)]
            done += size
        if size * 2 > k:
            break
        have = have[: len(have) - size] * np.uint64(pow(_BASE, size, 2**64)) + have[size:]
        size *= 2
    return mix(out[: len(points) - k + 1]) >> np.uint64(32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept."""
    hashes = gram_hashes(points, k)
    n = len(hashes)
    if not n:
        return hashes, hashes.astype(np.int64)
    # hash first, then the later position: one minimum decides both
    least = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width, size = min(window, n), 1
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: n - width + 1], least[width - size :])
    kept = least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])]
    return kept >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(hashes: np.ndarray) -> str:
    """Kept hashes in order of position, 8 hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, hashes, positions) of every row (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [code_points(t or "") for t in some.column("text").to_pylist()]
                kept = [winnow(t, k, window) for t in texts]
                lists = [pa.array([x[j].tolist() for x in kept], pa.list_(pa.int64())) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), *lists], names=["doc_id", "n_chars", "hashes", "positions"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """The last third of a text (rounded down) replaced by as many first code points of the following one, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"
_KEY = "missing boolean, rev long, h long"


def compare_with_next(docs: DataFrame, edit: Callable[[str, str], str] = edited, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next row, in descending doc_id, after the last the first.

    positions are the code points at which the fingerprint's hashes begin, so that hashes met in another text can be
    placed. Null ids come last; rows with the same id are in order of a hash of the text, then of the text. A single row
    is its own next; extra columns are ignored.

    Rows are dealt once, to ranges of ids whose first keys a range partitioning of the ids alone has found (a key of
    24 bytes a range comes to the driver). The text of each range's first row lies in a file of the shared folder,
    where the range before it reads what follows its last row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.col("doc_id").isNull().alias("missing"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("rev"), F.xxhash64("text").alias("h"))
    key = F.struct("missing", "rev", "h")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select("missing", "rev", "h").repartitionByRange(parts, "missing", "rev", "h")
    found = sorted(tuple(r.first) for r in ranges.groupBy(F.spark_partition_id()).agg(F.min(key).alias("first")).select("first").collect())
    if not found:
        return spark.createDataFrame([], _COLUMNS)
    bounds = F.from_json(F.lit(json.dumps([dict(zip(("missing", "rev", "h"), b, strict=True)) for b in found])), "array<struct<missing:boolean,rev:bigint,h:bigint>>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(found).bit_length()))))
    part = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(key >= F.get(bounds, at + step), step).otherwise(0))  # binary search
    heads = storage.new_dir(spark, "heads")
    storage.until_exit(heads)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("part").to_pylist(), batch.column("text"), strict=True):
                storage.put_file(f"{heads}/{number}", text.as_py().encode())
            yield batch.select(["part"])

    firsts = spark.createDataFrame([(i, *b) for i, b in enumerate(found)], f"part int, {_KEY}")
    firsts = docs.join(F.broadcast(firsts), ["missing", "rev", "h"]).groupBy("part").agg(F.min("text").alias("text"))  # a row a range
    firsts.mapInArrow(store, "part int").agg(F.count("*")).collect()

    def result(rows: list[tuple]) -> pa.RecordBatch:
        *plain, kept = zip(*rows, strict=True)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        places = pa.ListArray.from_arrays(np.cumsum([0, *map(len, kept)]).astype(np.int32), np.concatenate(kept).astype(np.int32))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, kinds, strict=True)), places], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, size, part = None, [], 0, 0

        def compared(following: str, other: np.ndarray) -> tuple:
            doc_id, text, (own, places) = before
            new = edit(text, following)
            changed = own if new == text else winnow(code_points(new), k, window)[0]
            return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_string(own), as_string(changed), likeness(own, changed), likeness(own, other), places

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                kept = winnow(code_points(text), k, window)
                if before is not None:
                    out.append(compared(text, kept[0]))
                    size += len(text)
                    if size > 1 << 20:
                        yield result(out)
                        out, size = [], 0
                before = (doc_id, text, kept)
        if before is not None:
            following = storage.get_file(f"{heads}/{(part + 1) % len(found)}").decode()
            out.append(compared(following, winnow(code_points(following), k, window)[0]))
            yield result(out)

    placed = docs.withColumn("part", part).repartitionById(len(found), "part").sortWithinPartitions("missing", "rev", "h", "text")
    return placed.select("part", "doc_id", "text").mapInArrow(scan, _COLUMNS)
