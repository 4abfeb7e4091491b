"""Mixing sources to target weights by fitting word budgets exactly (subset sum over length counts).

Each source gets a target of words: its share by weight of all words, at most REPEATS times its own size,
with what is cut off reshared by weight among the rest until no target is above that. A target of k whole
passes over the source and a remainder is met by taking every document k times and, for the remainder, a
subset of documents once more. Which lengths the subset holds is fitted on the count of documents by exact
length: first the same fraction of every length (so that the subset looks like the source), then whole
documents from the longest length down, and last a bounded-knapsack dynamic program over what is left of
each length for the words still missing; where that leaves words missing, one document more, one fewer or one
for another, of any length, as long as the sum gets nearer. Which documents of a length are taken is decided by a seeded hash
of their ids.

Only counts meet in one place: one row a source on the driver (at most MAX_SOURCES, else an error), and one
row a length of one source in a task. Ranks within a length are counted over hash buckets, so a length held
by very many documents is never sorted in one task.

Null text has size 0; documents of size 0 take 0 words. A null source is a source of its own, last in order.
Rows with the same id, size and source are equally likely, and are told apart by a hash of the text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import storage

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 20240229
#: Most sources, whose sizes the driver holds: about 100 bytes each.
MAX_SOURCES = 200_000
#: Hash buckets among which documents of one source and length are ranked.
BUCKETS = 4096
#: Words that the dynamic program fits at least: its table has a cell for each.
WINDOW = 4096
#: Sources of so many documents are fitted as a whole.
FEW = 64
#: Cells of the table at most; where there would be more, a cell stands for several words.
MOST_CELLS = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Each source's target, by water filling; they sum to all sizes."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] > repeats * sizes[i]}
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else per * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int | None = None) -> np.ndarray:
    """How many documents of each length to take (at most counts) so that their words come as near to budget as can be found.

    The dynamic program fits `window` words, by default WINDOW or four of the longest documents, whichever is more, so that it
    always has several documents of any length to choose from; of FEW documents or fewer it fits all, and no sum is nearer then.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    window = window or max(WINDOW, total if counts.sum() <= FEW else 4 * int(lengths[counts > 0].max()))
    # a source that the table holds as a whole is fitted as a whole
    take = np.array([int(c) * budget // total for c in counts], np.int64) if total > window else np.zeros(len(counts), np.int64)
    missing = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # leave the dynamic program some words to fit
        if lengths[i] and missing > window:
            more = min(int(counts[i] - take[i]), (missing - window // 2) // int(lengths[i]))
            take[i] += max(0, more)
            missing -= max(0, more) * int(lengths[i])
    _fill(lengths, counts, take, missing, window)
    return _nearer(lengths, counts, take, budget, window)


def _fill(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, missing: int, window: int) -> None:
    """Adds to take the documents left whose words come nearest to what is missing, up to the window.

    Documents of one length go in by lots of 1, 2, 4, ..., of which any number of them can be made; a sum remembers the lot that
    reached it first, and the sums before it the lots before.
    """
    unit = -(-(2 * min(missing, window) + 1) // MOST_CELLS)
    lengths = lengths if unit == 1 else np.rint(lengths / unit).astype(np.int64)
    fits = min(missing, window) // unit
    cells = 2 * fits + 1  # a sum above may be nearer than any below
    by = np.full(cells, -1, np.int32)
    reach = np.zeros(cells, bool)
    reach[0] = True
    lots: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):  # long ones first: short ones fill up
        step, room = int(lengths[i]), int(counts[i] - take[i])
        if not 0 < step < cells:
            continue
        room, size = min(room, (cells - 1) // step), 1
        while room and not reach[fits]:
            n = min(size, room)
            fresh = np.flatnonzero(reach[: cells - n * step]) + n * step
            fresh = fresh[~reach[fresh]]
            by[fresh] = len(lots)
            reach[fresh] = True
            lots.append((i, n))
            room, size = room - n, 2 * size
        if reach[fits]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - fits))])
    while at:
        i, n = lots[by[at]]
        take[i] += n
        at -= n * int(lengths[i])


def _nearer(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int, window: int) -> np.ndarray:
    """Moves single documents of any length, while one in, one out or one for another brings the sum nearer to budget."""
    while missing := budget - int((lengths * take).sum()):
        into, out = np.append(np.flatnonzero(counts > take), -1), np.append(np.flatnonzero(take > 0), -1)  # -1: none
        gain, loss = (np.where(i < 0, 0, lengths[i]) for i in (into, out))
        order = np.argsort(gain, kind="stable")
        near = np.searchsorted(gain[order], missing + loss)
        near = np.clip([near - 1, near], 0, len(order) - 1)
        off = np.abs(missing + loss - gain[order[near]])
        side, at = np.unravel_index(np.argmin(off), off.shape)
        if off[side, at] >= abs(missing):
            break
        for i, n in ((into[order[near[side, at]]], 1), (out[at], -1)):
            if i >= 0:
                take[i] += n
        missing = budget - int((lengths * take).sum())
        if missing > 0:
            _fill(lengths, counts, take, missing, window)
    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, times, taken, text_hash) of every row; `weights` go to sources in order, repeating.

    times is how often the mix takes the document, taken the words that this makes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = storage.checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie")))
    # a length that very many documents share is counted in each task first
    counts = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = storage.checkpointed(counts)
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = sorted(sizes, key=lambda r: (r.source is None, (r.source or "").encode()))
    aims = targets([r["size"] for r in sizes], [weights[i % len(weights)] for i in range(len(sizes))], repeats)
    plan = [(r.source, r["size"], aim, min(repeats, int(aim // r["size"])) if r["size"] else 0) for r, aim in zip(sizes, aims, strict=True)]
    plan = spark.createDataFrame([(*p, max(0, round(p[2]) - p[3] * p[1])) for p in plan], "source string, source_size long, target double, whole long, budget long")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]))
        return pdf[["source", "size"]].assign(more=take)

    # one group holds a row for each distinct length of one source
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    budgets = counts.join(F.broadcast(plan.select(F.col("source").alias("of"), "budget")), same("source", "of")).select("source", "size", "n", "budget")
    extra = storage.checkpointed(budgets.groupBy("source").applyInPandas(fitted, "source string, size long, more long").where("more > 0"))

    # the `more` first documents of a length by seeded hash: buckets wholly taken, and one that is ranked inside
    key = ["source", "size", "bucket"]
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "tie", F.lit(seed))).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    buckets = rows.groupBy(*key).agg(F.count("*").alias("n")).join(extra.withColumnsRenamed({"source": "s", "size": "z"}), same("source", "s") & (F.col("size") == F.col("z"))).drop("s", "z")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = storage.checkpointed(buckets.withColumn("left", F.col("more") - F.coalesce(before, F.lit(0))).where("left > 0").select(*key, "n", "left"))
    buckets = buckets.withColumnsRenamed({k: f"{k}_" for k in key})
    met = same("source", "source_") & (F.col("size") == F.col("size_")) & (F.col("bucket") == F.col("bucket_"))
    rows = rows.join(buckets, met, "left").drop("source_", "size_", "bucket_")
    edge = rows.where("left < n")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("hash", "doc_id", "tie"))
    edge = edge.withColumn("again", (rank <= F.col("left")).cast("long"))
    rest = rows.where("left IS NULL OR left >= n").withColumn("again", F.when(F.col("left").isNull(), 0).otherwise(1).cast("long"))
    out = rest.unionByName(edge).join(F.broadcast(plan.withColumnRenamed("source", "of")), same("source", "of"), "left")
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("again")).otherwise(0)
    return out.select("doc_id", "size", "source", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), F.col("tie").alias("text_hash"))
