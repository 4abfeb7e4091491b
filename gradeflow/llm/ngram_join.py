"""N-gram Jaccard self-join and its classes of near-duplicates, by vertical partitioning.

Two texts link when the Jaccard coefficient of their sets of 5-word shingles is at least 0.75. The global
order of shingles is by document frequency, then by hash, so that a shingle found in one text only comes
first. It serves twice:

* Prefix filter. A text of n shingles must share one of its first n - ceil(0.75 n) + 1 with any partner.
  Shingles of frequency 1 fill that prefix for nearly all texts, which then have no partner. The
  frequencies come from `vertical.partition_totals`: keys of 40 bits, so a rare collision makes a shingle
  look shared and costs a candidate, never a result.
* Vertical partitioning. The order is cut into fragments at fixed frequencies. A candidate pair's overlap
  is counted in each fragment separately and summed per pair.

Equal sets are one class from the start. Links are wanted for components, so pairs whose ends are already
connected need no check: first every class is compared with the first of its min-hash buckets; then, as long as
more than a tenth of all links so far are found each time, with the first, in an order that changes, of each prefix shingle that
several components still hold; and last every pair across components that shares a prefix shingle and passes the bounds of length,
position and bit map (a bit that only one map has stands for a shingle that only one set has) is compared. The last step leaves out no pair that could link two components, so the result is exact, while
a group of n near copies costs a few n comparisons, not n * n. Each step's components are found on the components of the one before.

Null or empty texts have no shingles and no links. Rows with the same text or the same doc_id are separate
rows of one class. A null doc_id takes part; it is reported as null and never names a component that has
another id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import storage, textscan, vertical
from .components import components
from .rows import text_hash

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
WORDS = 5
#: Document frequencies at which the global order is cut into fragments.
CUTS = (3, 5, 17)
FRAGMENTS = len(CUTS) + 1
#: Min-hash values a text in the first round.
SKETCH = 4
#: Bits of a text's map of its shared shingles, by which pairs that cannot link are told without their sets.
MAP_BITS = 1024
#: Shingles that a task holds before it sums them.
FLUSH_KEYS = 1_000_000
_KEY_SHIFT = np.uint64(24)
_SEEDS = np.random.default_rng(7).integers(1, 2**63, SKETCH, dtype=np.uint64)
_OUT = "rid long, doc_id long, text_hash long, n_shingles long, set_a long, set_b long, kept boolean, sketch array<long>, bits array<long>, prefix array<long>, " + ", ".join(f"part{k} array<long>" for k in range(FRAGMENTS))


def prefix_length(n: int, percent: int) -> int:
    """Of the first shingles in the order among which each partner shares at least one."""
    return n - math.ceil(percent * n / 100) + 1


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """MAP_BITS bits in 64-bit integers: each shingle sets one."""
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(textscan.mix(shingles ^ _SEEDS[0]) >> np.uint64(32)) % np.uint64(MAP_BITS)] = 1
    return np.packbits(bits).view(np.int64)


def _only(a: Column, b: Column) -> Column:
    """Bits of map a that b does not have: so many shingles of a's set, at least, are not in b's."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, k: n + k)  # fewer bytes of code than a sum of terms, which would not be compiled


def _sets(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    for _, _, data, offsets in textscan.chunks(column):
        starts, ends, begins = textscan.word_bounds(data, offsets)
        yield textscan.shingles(textscan.word_hashes(data, starts, ends), begins, size)


def _profiles(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, str]:
    """A row a document: the size and a fingerprint of its set and, where the prefix filter leaves it, the shared shingles by fragment."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))

    def extract(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for sets in _sets(batch.column("text"), size):
            keys = np.concatenate(sets) >> _KEY_SHIFT
            yield keys, np.ones(len(keys), np.uint64)

    totals = vertical.partition_totals(docs, extract, "ngrams", least=2, bits=40, flush_keys=FLUSH_KEYS)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, expected = totals.of_partition()
        check, rid = vertical.Checksum(), TaskContext.get().partitionId() << 33
        for batch in batches:
            row = 0
            ids, hashes = check.add(batch).column("doc_id"), batch.column("text_hash")
            for sets in _sets(batch.column("text"), size):
                out = []
                frequency = vertical.lookup(keys, sums, np.concatenate(sets) >> _KEY_SHIFT) if sets else []
                at = 0
                for own in sets:
                    n, df = len(own), frequency[at : at + len(own)]
                    at += n
                    shared = own[df >= 2]
                    prefix = prefix_length(n, percent) - (n - len(shared))  # of the shared ones
                    ids_of_set = (int(own.sum(dtype=np.uint64).view(np.int64)), int(textscan.mix(own).sum(dtype=np.uint64).view(np.int64))) if n else (0, 0)
                    line = [rid, None, None, n, *ids_of_set, bool(n and prefix > 0)]
                    if n and prefix > 0:
                        df = df[df >= 2]
                        order = np.lexsort((shared, df))
                        shared, df = shared[order], df[order]
                        sketch = [int(textscan.mix(shared ^ s).min().view(np.int64)) for s in _SEEDS]
                        signed, cuts = shared.view(np.int64), [0, *np.searchsorted(df, CUTS), len(df)]
                        line += [sketch, bit_map(shared).tolist(), signed[:prefix].tolist(), *(signed[cuts[k] : cuts[k + 1]].tolist() for k in range(FRAGMENTS))]
                    else:
                        line += [None] * (3 + FRAGMENTS)
                    out.append(line)
                    rid += 1
                fields = list(zip(*out, strict=True))
                fields[1], fields[2] = ids.slice(row, len(out)), hashes.slice(row, len(out))
                row += len(out)
                kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.list_(pa.int64())] * (3 + FRAGMENTS)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(fields, kinds, strict=True)], names=[c.split()[0] for c in _OUT.split(", ")])
        vertical.verify(check, expected)
        keys = sums = None
        storage.release()

    try:
        return storage.written(docs.mapInArrow(profile, _OUT), "profiles")
    finally:
        totals.remove()


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b, na, nb, ...), those that link: overlaps counted fragment by fragment, and summed per pair.

    Sets and pairs are sorted together whatever the number of pairs, so that what is shuffled follows the input.
    """
    parts = [f"part{k}" for k in range(FRAGMENTS)]
    side = lambda x: texts.select(F.col("rid").alias(x), *(F.col(p).alias(f"{p}_{x}") for p in parts))
    partial = [F.size(F.array_intersect(f"{p}_a", f"{p}_b")) for p in parts]
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select(*pairs.columns, reduce(lambda x, y: x + y, partial).alias("common"))
    return both.where(f"100 * common >= {percent} * (na + nb - common)").select(*pairs.columns)


def similarity_groups(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text; other columns are ignored).

    component_id is the least doc_id reachable by links, the row's own included.
    """
    with storage.no_shuffle_left(docs.sparkSession):
        return _groups(*_profiles(docs, percent, size), percent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, n, times) of the rows that stand for their groups, for `rows.take`: n rows have this key, one is kept.

    The row with the least doc_id (null last), then the least hash, stands for its group. Rows without words are
    groups by doc_id and text.
    """
    with storage.no_shuffle_left(docs.sparkSession):
        groups = _groups(*_profiles(docs, percent, size), percent)
        order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
        least = storage.checkpointed(groups.where("comp IS NOT NULL").groupBy("comp").agg(F.min(order).alias("head")).select("head.doc_id", "head.text_hash"))
        keys = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.bool_or(F.col("comp").isNull()).alias("alone"))
        heads = least.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
        keys = keys.join(heads, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
        return storage.checkpointed(keys.where("alone OR h IS NOT NULL").select("doc_id", "text_hash", "n", F.lit(1).alias("times")))


def _groups(profiles: DataFrame, uri: str, percent: int) -> DataFrame:
    """Of the profiles at uri, which are removed as soon as their shingles stand in a smaller table."""
    with storage.Scratch(profiles.sparkSession, "groups") as scratch:
        try:
            every, classes, texts = _representing(profiles, scratch)
        finally:
            storage.remove(uri)
        storage.tidy(profiles.sparkSession)
        return _grouped(every, classes, texts, percent, scratch)


_SAME = ["set_a", "set_b", "n_shingles"]


def _representing(profiles: DataFrame, scratch: storage.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows without shingles; the classes of equal sets; and a row with its shingles for each class."""
    same = _SAME
    every = scratch.keep(profiles.select("doc_id", "text_hash", *same, "kept"))
    classes = scratch.keep(profiles.where("kept").groupBy(*same).agg(F.min("rid").alias("class")))
    texts = profiles.where("kept").drop("doc_id", "text_hash", "set_a", "set_b", "kept").withColumnRenamed("n_shingles", "n")
    texts = texts.withColumn("shared", reduce(lambda a, b: a + b, (F.size(f"part{k}") for k in range(FRAGMENTS))))
    return every, classes, scratch.keep(texts.join(classes.select(F.col("class").alias("rid")), "rid", "left_semi"))


def _grouped(every: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, scratch: storage.Scratch) -> DataFrame:
    same, spark = _SAME, every.sparkSession
    alike = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"

    def relabelled(rows: DataFrame, moves: DataFrame) -> DataFrame:
        """Rows (..., comp) with the components that theirs have become part of."""
        others = [c for c in rows.columns if c != "comp"]
        return rows.join(moves.select(F.col("node").alias("comp"), "component"), "comp", "left").select(*others, F.coalesce("component", "comp").alias("comp"))

    def mixed(rows: DataFrame) -> DataFrame:
        """Of rows (w, ..., comp), those whose w is met in several components."""
        several = rows.groupBy("w").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("w")
        left = scratch.keep(rows.join(several, "w", "left_semi"))
        storage.tidy(spark)
        return left

    def star(rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of the rows (w, rid, n, comp) of a w with the first of them, but for those of its component; each turn and quarter of the w orders the rows anew."""
        rank = F.xxhash64("rid", F.lit(turn), F.pmod("w", F.lit(4))).alias("rank")
        first = rows.groupBy("w").agg(F.min(F.struct(rank, "rid", "n", "comp")).alias("f")).select("w", F.col("f.rid").alias("a"), F.col("f.n").alias("na"), F.col("f.comp").alias("ca"))
        met = rows.select("w", F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb")).join(first, "w")
        return met.where(f"ca <> cb AND {alike}").select("a", "b", "na", "nb", "ca", "cb").distinct()

    def across(rows: DataFrame) -> DataFrame:
        """All pairs of rows (w, rid, n, rest, comp) with one w that different components hold and that the bounds leave.

        Two sets have no more in common than what either holds from w on, nor than what either holds but for the bits that only its map has.
        """
        rows = rows.join(texts.select("rid", "shared", "bits"), "rid")
        a, b = (rows.select("w", *(F.col(c).alias(f"{c[0]}{x}") for c in ("n", "comp")), F.col("rid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("rest", "shared", "bits"))) for x in "ab")
        enough = lambda most: (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
        mapped = [F.col(f"shared_{x}") - _only(F.col(f"bits_{x}"), F.col(f"bits_{y}")) for x, y in ("ab", "ba")]
        met = a.join(b, "w").where(f"a < b AND ca <> cb AND {alike}").where(enough(F.least("rest_a", "rest_b"))).where(enough(F.least(*mapped)))
        return met.select("a", "b", "na", "nb", "ca", "cb").distinct()

    moves: list[DataFrame] = []

    def merge(pairs: DataFrame) -> int:
        """Adds the map of components that the links among the pairs make; how many links there are.

        The pairs are written first: one plan for all would have the driver hold both halves' stages at once.
        """
        pairs = scratch.keep(pairs)
        storage.tidy(spark)
        links = scratch.keep(_linked(pairs, texts, percent).select("ca", "cb"))
        del pairs
        storage.tidy(spark)
        moves.append(components(links, "ca", "cb", least=False))
        storage.tidy(spark)
        return links.count()

    prefix = texts.select("rid", "n", (F.col("n") - F.col("shared")).alias("alone"), F.posexplode("prefix").alias("i", "w"), F.col("rid").alias("comp"))
    prefix = prefix.select("w", "rid", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), "comp")  # rest: shingles from this one on
    sketch = texts.select(F.posexplode("sketch").alias("i", "h"), "rid", "n", F.col("rid").alias("comp")).select(F.xxhash64("i", "h").alias("w"), "rid", "n", "comp")
    links = merge(star(sketch, 0))
    rows = mixed(relabelled(prefix, moves[0]))
    while not rows.isEmpty():
        found = merge(star(rows, len(moves)))
        rows = mixed(relabelled(rows, moves[-1]))
        links += found
        if 10 * found <= links:
            break
    if not rows.isEmpty():
        merge(across(rows))
    named = classes.withColumn("comp", F.col("class"))
    for move in moves:
        named = relabelled(named, move)
    storage.tidy(spark)
    placed = scratch.keep(every.join(named.drop("class"), same, "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("kept"), F.col("comp")).alias("comp")))
    least = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return storage.checkpointed(placed.join(least, "comp", "left").select("doc_id", "text_hash", "n_shingles", "comp", F.coalesce("component_id", "doc_id").alias("component_id")))
