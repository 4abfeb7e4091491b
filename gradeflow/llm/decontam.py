"""Benchmark decontamination: documents that hold a passage like a benchmark item.

A window is as many successive 5-word shingles of a document as an item has, or the whole document if it has
fewer. It holds the item when the
weighted Jaccard coefficient of the two multisets of shingles is at least 0.75. All in DataFrame operations:

1. Anchors. A window that holds an item shares at least 6/7 of the item's shingles (both have the same
   total weight m, and 0.75 of the union is 2 * 0.75 / 1.75 * m); a document of n < m shingles shares at least
   3/7 of n + m, so at least 3/4 of m. Positions whose shingle occurs in any item
   are found while the text is scanned; documents with fewer than the smallest item needs go no further. For
   each item, only windows with enough of its shingles inside are formed. Nothing is lost here.
2. SimHash. Every such window and every item gets a 64-bit fingerprint of its weighted shingles.
3. Multi-index Hamming blocks. The 64 bits are cut into RADIUS + 1 blocks; two fingerprints within RADIUS
   agree in at least one block, so joining on (item, block, value) finds all of them. A window meets the items that it was
   formed for and no others, for an item that it holds is among them. A pair is kept in its
   first common block only, and if it is within RADIUS. Where the window's or the item's shingles repeat, pairs of
   an item and a window formed for it are kept at any distance.
4. Verification by the exact weighted Jaccard coefficient.

SimHash is random: with distinct shingles, at a similarity of 0.75 the distance is about 11 with deviation 3, so a radius of 24 loses
about one pair in 100,000 at the very threshold and fewer above.

Words are maximal runs of characters other than 0x20 and 0x09-0x0D, in lower case. An item of fewer than
five words is one shingle of all its words, and is held where these words follow one another. Items and
documents that are null or without words hold nothing. Items with equal ids count each by itself, and so do
documents with equal or null ids: text_hash (that of `rows.text_hash`) tells which row was found. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import storage
from .rows import text_hash

WORDS = 5
PERCENT = 75
RADIUS = 24
#: Broadcast the benchmark's shingles up to so many rows (40 bytes each); join by shuffle above.
MAX_BROADCAST = 500_000
#: Test shingles against a set within the scan up to so many; count all anchors by a join above.
MAX_IN_PLAN = 200_000

def _words(text: str) -> Column:
    flat = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    for c in "\t\n\x0b\x0c\r":  # plain replacements and a split at one character are several times faster than patterns
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _shingles(words: str, size: int) -> Column:
    """Hashes of all runs of `size` words, in order."""
    count = F.size(words) - (size - 1)
    runs = F.transform(F.slice(words, F.lit(1), F.greatest(count, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size))))
    return F.when(count > 0, runs).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """Bit b is set if most shingles, counted as often as they occur, have bit b set."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")))
    return F.aggregate(F.transform(bits, lambda n, b: F.when(2 * n > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _block_edges(radius: int) -> list[int]:
    return [64 * k // (radius + 1) for k in range(radius + 2)]


def _blocks(fingerprint: str, radius: int) -> Column:
    edges = _block_edges(radius)
    return F.array(*(F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(edges, edges[1:])))


def _needed(m: Column, percent: int) -> Column:
    """Least number of an item's m shingles in a window of m that may hold it."""
    return _needed_of(2 * m, percent)


def _needed_of(both: Column, percent: int) -> Column:
    """The same by the number of shingles that the window and the item have together."""
    return F.ceil(percent * both / (100 + percent) - 1e-9).cast("int")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, size, m, shingles) of every item with words; `size` words make a shingle."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words("text").alias("words"))
    items = items.withColumn("size", F.least(F.size("words"), F.lit(WORDS))).where("size > 0")
    shingles = F.coalesce(*(F.when(F.col("size") == n, _shingles("words", n)) for n in range(1, WORDS + 1)))
    return items.select("item_id", F.monotonically_increasing_id().alias("item"), "size", shingles.alias("shingles")).withColumn("m", F.size("shingles"))


def find(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, n_words, similarity, distance): of each row and item it holds, the likest window, the first among equals."""
    schema = "doc_id long, text_hash long, item_id long, start_word long, n_words long, similarity double, distance int"
    items = storage.checkpointed(items_of(benchmark).withColumn("need", _needed(F.col("m"), percent)).withColumn("print", simhash(F.col("shingles"))))
    sizes = items.groupBy("size").agg(F.min("need").alias("need"), F.sum("m").alias("rows"), F.min("m").alias("least"), F.max("m").alias("most")).collect()  # at most WORDS rows
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema)
    small = sum(r["rows"] for r in sizes) <= MAX_BROADCAST
    hint = F.broadcast if small else (lambda df: df)
    grams = items.select("item", "size", "m", "need", F.explode("shingles").alias("h")).distinct()

    # Spark copies what a filter tests into the filter itself, here a text's words into each of its shingles,
    # unless a projection has a column that must not be computed twice
    apart = F.monotonically_increasing_id
    rows = docs.select(apart().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), _words("text").alias("words"))
    found, kept = None, []
    for r in sizes:
        own = rows.select("rid", "doc_id", "text_hash", F.lit(r["size"]).alias("size"), _shingles("words", r["size"]).alias("hashes"), apart().alias("mark"))
        wanted = [x.h for x in grams.where(F.col("size") == r["size"]).select("h").distinct().limit(MAX_IN_PLAN + 1).collect()]  # bounded
        inside = f"h IN ({', '.join(f'{h}L' for h in wanted)})" if len(wanted) <= MAX_IN_PLAN else "true"
        at = F.expr(f"filter(transform(hashes, (h, i) -> if({inside}, i, null)), i -> i IS NOT NULL)")
        # a document shorter than an item needs fewer
        need = F.when(F.size("hashes") < r["most"], math.ceil(percent * r["least"] / 100 - 1e-9)).otherwise(r["need"])
        own = own.withColumns({"at": at, "mark": apart()}).where(F.size("at") >= need)
        found = own if found is None else found.unionByName(own)
    found, uri = storage.written(found, "anchors")
    kept.append(uri)
    storage.tidy(docs.sparkSession)
    hits = found.select("rid", "size", F.explode("at").alias("pos"), "hashes").select("rid", "size", "pos", F.size("hashes").alias("n"), F.get("hashes", F.col("pos")).alias("h")).join(hint(grams), ["size", "h"])
    near = hits.groupBy("rid", "size", "n", "item", "m", "need").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    near = near.where(F.size("at") >= F.when(F.col("n") < F.col("m"), _needed_of(F.col("n") + F.col("m"), percent)).otherwise(F.col("need")))
    # from the first of `need` successive hits that lie within m positions to the last: all windows that hold them
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("at") - F.col("need"))), lambda i: F.struct(F.get("at", i).alias("first"), F.get("at", i + F.col("need") - 1).alias("last")))
    starts = F.filter(starts, lambda s: s["last"] - s["first"] < F.col("m"))
    starts = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(F.greatest(F.lit(0), s["last"] - F.col("m") + 1), s["first"]))))
    starts = F.when(F.col("n") < F.col("m"), F.array(F.lit(0))).otherwise(starts)
    anchored = storage.checkpointed(near.select("rid", "size", "m", "item", F.explode(starts).alias("start")))
    storage.tidy(docs.sparkSession)
    windows = anchored.select("rid", "size", "m", "start").distinct()
    met = windows.join(found.select("rid", "size", "doc_id", "text_hash", "hashes"), ["rid", "size"]).where("start + least(m, size(hashes)) <= size(hashes)")
    met = met.select("rid", "doc_id", "text_hash", "size", "m", "start", F.expr("slice(hashes, start + 1, m)").alias("window"))
    met, uri = storage.written(met.withColumn("print", simhash(F.col("window"))), "windows")  # so that no fingerprint is computed twice
    kept.append(uri)
    storage.tidy(docs.sparkSession)
    formed = met
    # multi-index blocks
    count = F.expr("transform(array_distinct(shingles), h -> named_struct('h', h, 'n', size(filter(shingles, x -> x = h))))")
    index = items.select("item_id", "item", F.col("print").alias("item_print"), count.alias("counted"), F.posexplode(_blocks("print", radius)).alias("block", "value"))
    met = formed.join(anchored, ["rid", "size", "m", "start"]).select("*", F.posexplode(_blocks("print", radius)).alias("block", "value")).join(hint(index), ["item", "block", "value"])
    first = F.array_position(F.zip_with(_blocks("print", radius), _blocks("item_print", radius), lambda a, b: a == b), True) - 1
    met = met.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).where((first == F.col("block")) & (F.col("distance") <= radius))
    # the distance says little where shingles repeat: there anchored pairs beyond the radius are verified too
    repeats = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    whole = items.select("item_id", "item", F.col("print").alias("item_print"), count.alias("counted"), repeats("shingles").alias("repeats"))
    loose = formed.join(anchored, ["rid", "size", "m", "start"]).join(hint(whole), "item").where(F.col("repeats") | repeats("window"))
    loose = loose.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).where(F.col("distance") > radius)
    met = met.drop("block", "value", "item_print").unionByName(loose.drop("repeats", "item_print"))
    met, uri = storage.written(met, "pairs")  # so that no pair beyond the radius is verified
    kept.append(uri)
    storage.tidy(docs.sparkSession)
    common = F.expr("aggregate(counted, 0, (a, c) -> a + least(c.n, size(filter(window, x -> x = c.h))))")
    met = met.withColumn("common", common).where(f"100 * common >= {percent} * (m + size(window) - common)")
    best = met.groupBy("rid", "item").agg(F.max(F.struct("common", (-F.col("start")).alias("back"), "doc_id", "text_hash", "item_id", "m", F.size("window").alias("n"), "size", "distance")).alias("b"))
    out = best.select("b.doc_id", "b.text_hash", "b.item_id", (-F.col("b.back")).cast("long").alias("start_word"), (F.col("b.n") + F.col("b.size") - 1).cast("long").alias("n_words"), F.expr("b.common / cast(b.m + b.n - b.common AS double)").alias("similarity"), "b.distance")
    out = storage.checkpointed(out)
    for uri in kept:
        storage.remove(uri)
    return out


def needed(m: int, percent: int = PERCENT) -> int:
    return math.ceil(2 * percent * m / (100 + percent) - 1e-9)
