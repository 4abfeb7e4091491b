"""Blocks of pages in relational form: copies, grids, loops, neighbours, regions, votes and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.layout import TEXT_CATEGORIES
from ..functions.metrics import char_edits
from . import spatial


def copied_cells(blocks: DataFrame, least: int = 3) -> DataFrame:
    """(page, i) of text blocks whose text, or a word of theirs with a digit and at least five characters, is in `least` blocks of the page."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = blocks.where(F.col("category").isin(*TEXT_CATEGORIES)).select("page", "i", text.alias("t")).where("t <> ''")
    words = F.filter(F.array_distinct(F.split("t", " ")), lambda w: (F.length(w) >= 5) & w.rlike("[0-9]"))
    signs = rows.select("page", "i", F.explode(F.array_union(F.array(F.concat(F.lit("="), F.col("t"))), F.transform(words, lambda w: F.concat(F.lit("~"), w)))).alias("sign"))
    often = signs.groupBy("page", "sign").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return signs.join(often, ["page", "sign"]).select("page", "i").distinct()


def grid_runs(blocks: DataFrame, least: int = 6, tolerance: int = 4) -> DataFrame:
    """(page, first, last, n): successive text blocks in one column, equally high, one height apart."""
    order = Window.partitionBy("page").orderBy("i")
    before = {c: F.lag(c).over(order) for c in ("x1", "y1", "x2", "y2", "category")}
    height = before["y2"] - before["y1"]
    near = lambda a, b: F.abs(a - b) <= tolerance
    joined = (
        F.col("category").isin(*TEXT_CATEGORIES) & before["category"].isin(*TEXT_CATEGORIES) & near(F.col("x1"), before["x1"]) & near(F.col("x2"), before["x2"])
        & near(F.col("y2") - F.col("y1"), height) & near(F.col("y1") - before["y1"], height)
    )
    marked = blocks.withColumn("_joined", F.coalesce(joined, F.lit(False)))
    run = F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_run", run).groupBy("page", "_run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def tail_runs(blocks: DataFrame, least: int = 25, characters: int = 6) -> DataFrame:
    """(page, n, looping): how often the page's last (category, text) stands at its end."""
    order = Window.partitionBy("page").orderBy(F.desc("i"))
    same = F.col("category").eqNullSafe(F.first("category").over(order)) & F.col("text").eqNullSafe(F.first("text").over(order))
    marked = blocks.withColumn("_breaks", F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_breaks = 0")
    runs = marked.groupBy("page").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("_len"))
    return runs.select("page", "n", ((F.col("n") >= least) & (F.col("_len") >= characters)).alias("looping"))


def adjacent_groups(boxes: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Boxes (page, i, y1, y2) with a group: a box joins its predecessor's group if they share half of the smaller height."""
    order = Window.partitionBy("page").orderBy("i")
    y1, y2 = F.lag("y1").over(order), F.lag("y2").over(order)
    shared = F.least(F.col("y2"), y2) - F.greatest(F.col("y1"), y1)
    apart = y1.isNull() | (shared < overlap * F.least(F.col("y2") - F.col("y1"), y2 - y1))
    return boxes.withColumn("_apart", apart).withColumn("group", F.sum(F.col("_apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_apart")


def text_blocks(words: DataFrame, by_line: bool = False) -> DataFrame:
    """Words (page, block, par, line, ord, word, x1, y1, x2, y2) as paragraphs, or lines: the box around them and the words in order."""
    keys = ["page", "block", "par", *["line"] * by_line]
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ")
    return words.where(F.trim("word") != "").groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), said.alias("text"))


def outside_regions(blocks: DataFrame, regions: DataFrame, part: float = 0.5) -> DataFrame:
    """Blocks (page, i, x1, y1, x2, y2) of which no region of their page covers more than `part`."""
    return spatial.outside(blocks, regions, part)


def clamped(blocks: DataFrame) -> DataFrame:
    """Blocks (..., x1, y1, x2, y2, width, height) with the ends of boxes in order, inside the page, and one pixel apart at least."""
    inside = {c: F.greatest(F.lit(0), F.least(F.col(c), F.col(side))) for c, side in (("x1", "width"), ("x2", "width"), ("y1", "height"), ("y2", "height"))}
    out = blocks.withColumns(inside)
    ends = {}
    for a, b, side in (("x1", "x2", "width"), ("y1", "y2", "height")):
        flat, edge = F.col(a) == F.col(b), F.greatest(a, b) >= F.col(side)
        ends |= {a: F.least(a, b) - (flat & edge).cast("int"), b: F.greatest(a, b) + (flat & ~edge).cast("int")}
    return out.withColumns(ends)


def region_around(blocks: DataFrame, pad: float = 0.5) -> DataFrame:
    """(page, x1, y1, x2, y2) around a page's blocks (page, x1, y1, x2, y2, width, height), wider by `pad` of their upper median height, inside the page."""
    tall = F.array_sort(F.collect_list(F.col("y2") - F.col("y1")))  # a page's few blocks
    hull = blocks.groupBy("page").agg(*(F.min(c).alias(c) for c in ("x1", "y1")), *(F.max(c).alias(c) for c in ("x2", "y2", "width", "height")), tall.alias("tall"))
    more = F.floor(F.get("tall", F.floor(F.size("tall") / 2).cast("int")) * pad).cast("int")
    low, high = {c: F.greatest(F.lit(0), F.col(c) - more) for c in ("x1", "y1")}, {c: F.least(F.col(s), F.col(c) + more) for c, s in (("x2", "width"), ("y2", "height"))}
    return hull.select("page", *(v.alias(k) for k, v in (low | high).items()))


def spliced(blocks: DataFrame, runs: DataFrame, new: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Blocks (page, i, x1, y1, x2, y2, ...) with the run (page, first, last) of each page replaced, in place, by those of the
    new ones (page, k, x1, ...) that no remaining block of the page covers by `overlap`; i is the new order."""
    met = blocks.join(runs, "page", "left")
    kept = met.where(F.col("first").isNull() | ~F.col("i").between(F.col("first"), F.col("last"))).drop("first", "last")
    fresh = spatial.outside(new, kept, overlap, inclusive=True).join(runs.select("page", "first"), "page")
    both = kept.withColumns({"_at": F.col("i"), "_k": F.lit(-1)}).unionByName(fresh.withColumns({"_at": F.col("first"), "_k": F.col("k"), "i": F.col("first")}).drop("first", "k"))
    order = Window.partitionBy("page").orderBy("_at", "_k")
    return both.withColumn("i", F.row_number().over(order) - 1).drop("_at", "_k")


def with_pictures(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks without those that lie mostly in a region of their page, and the regions (page, category, x1, ...) among them,
    each before the first block that begins lower; i is the new order. Regions at the same place stand by height."""
    kept = outside_regions(blocks, regions)
    below = kept.alias("b").join(regions.alias("r"), "page", "right").groupBy("r.page", "r.category", "r.x1", "r.y1", "r.x2", "r.y2").agg(F.min(F.when(F.col("b.y1") > F.col("r.y1"), F.col("b.i"))).alias("_at"))
    placed = below.select("page", "category", "x1", "y1", "x2", "y2", F.lit("").alias("text"), F.coalesce(F.col("_at").cast("double") - 0.5, F.lit(float("inf"))).alias("_at"))
    both = kept.select("page", "category", "x1", "y1", "x2", "y2", "text", F.col("i").cast("double").alias("_at")).unionByName(placed)
    return both.withColumn("i", F.row_number().over(Window.partitionBy("page").orderBy("_at", "y1", "x1", "category", "text")) - 1).drop("_at")


def votes(readings: DataFrame, least: int = 2) -> DataFrame:
    """(cell, value, n) applied: of readings (cell, pass, candidate), passes with one candidate vote; one value, and enough votes for it."""
    single = readings.groupBy("cell", "pass").agg(F.count_distinct("candidate").alias("n"), F.min("candidate").alias("value")).where("n = 1")
    return single.groupBy("cell").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value"), F.count("*").alias("n")).where((F.col("values") == 1) & (F.col("n") >= least)).drop("values")


def label_prefixes(lines: DataFrame) -> DataFrame:
    """Lines (..., line), each with every label that it is (stage 0) or begins with before a blank (stage 1)."""
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.length("line")), lambda i: F.substring(F.col("line"), i, F.lit(1)) == " "), lambda i: F.substring(F.col("line"), F.lit(1), i - 1))
    every = F.when(F.col("line").contains(" "), F.array_union(F.array("line"), ends)).otherwise(F.array("line"))
    return lines.withColumn("label", F.explode(every)).withColumn("stage", F.when(F.col("line") == F.col("label"), 0).otherwise(1))


def row_of_label(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each label the first line that is it, else the first that begins with it and a blank: two joins, not a comparison of all pairs.

    labels (doc, label), lines (doc, ord, line).
    """
    return labels.join(label_prefixes(lines), ["doc", "label"]).groupBy("doc", "label").agg(F.min_by("line", F.struct("stage", "ord")).alias("line"))


def agreement(texts: DataFrame) -> DataFrame:
    """(a, b, agreement): mean over pages of max(0, 1 - edits / length of a), of every two systems on texts (page, system, text)."""
    a, b = (texts.select("page", F.col("system").alias(n), F.col("text").alias(f"text_{n}")) for n in "ab")
    share = F.greatest(F.lit(0.0), 1 - char_edits(F.col("text_a"), F.col("text_b")) / F.greatest(F.lit(1), F.length("text_a")))
    return a.join(b, "page").where("a <> b").groupBy("a", "b").agg(F.avg(F.round(share, 3)).alias("agreement"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """(file, job) the newest job that holds each file; jobs (id, files array<struct<name>>)."""
    return jobs.select("id", F.explode("files.name").alias("file")).groupBy("file").agg(F.max("id").alias("job"))
