"""Marks before numbers, voted by further readings of the same table, as joins and aggregates.

A base reading keeps its structure and numbers; further readings only vote on the mark that stands before a cell's value
in the row of the same label. Frames: readings (doc, pass, text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.markup import detail_lines, marker_of, split_rows
from .blocks import label_prefixes


def marks(texts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, label, value, mark), once each, of the marks before numbers in the tables of (key, text)."""
    rows = split_rows(texts, key).select(key, "label", F.explode(F.flatten("cells")).alias("word"))
    value = F.regexp_extract("word", r"^.*?(\d[\d.,]*)$", 1)
    return rows.select(key, "label", value.alias("value"), marker_of(F.col("word"), value).alias("mark")).where("value <> '' AND mark IS NOT NULL").distinct()


def base_cells(base: DataFrame) -> DataFrame:
    """(doc, row, col, label, value) of cells that are one value with a digit, in rows of a label and more."""
    rows = split_rows(base, "doc").select("doc", "row", "label", F.posexplode("cells").alias("col", "words"))
    return rows.where("size(words) = 1 AND label <> '' AND words[0] RLIKE '[0-9]'").select("doc", "row", "col", "label", F.get("words", F.lit(0)).alias("value"))


def ballots(base: DataFrame, readings: DataFrame) -> DataFrame:
    """(doc, row, col, label, value, pass, mark): of each further reading the one mark that it gives a cell; readings that give several do not vote."""
    cells = base_cells(base)
    # a label's line is one that is it, else the first that begins with it and a blank; a line of plain text loses its label
    lines = label_prefixes(detail_lines(readings, "doc", "pass"))
    met = cells.join(lines, ["doc", "label"]).groupBy("doc", "row", "col", "label", "value", "pass").agg(F.min_by("words", F.struct("stage", "ord")).alias("words"))
    said = F.array_distinct(F.array_compact(F.transform("words", lambda w: marker_of(w, F.col("value")))))
    return met.withColumn("said", said).where("size(said) = 1").select("doc", "row", "col", "label", "value", "pass", F.get("said", F.lit(0)).alias("mark"))


def applied(votes: DataFrame, least: int = 1) -> DataFrame:
    """(doc, row, col, label, value, mark, votes) of cells where all votes agree and there are enough."""
    counted = votes.groupBy("doc", "row", "col", "label", "value").agg(F.count_distinct("mark").alias("n"), F.min("mark").alias("mark"), F.count("*").alias("votes"))
    return counted.where((F.col("n") == 1) & (F.col("votes") >= least)).drop("n")


def totals(truth: DataFrame, base: DataFrame, fused: DataFrame) -> DataFrame:
    """(doc, in_truth, kept, right, wrong): marks (doc, label, value, mark) of the truth, how many the base and the fused
    reading have of them, and how many the fusion added that are not there. Each side is read once."""
    sides = {"t": truth, "b": base, "f": fused}
    one = lambda name, frame: frame.select("doc", "label", "value", "mark", *(F.lit(int(n == name)).alias(n) for n in sides))
    rows = reduce(DataFrame.unionAll, (one(n, frame) for n, frame in sides.items()))
    marks = rows.groupBy("doc", "label", "value", "mark").agg(*(F.sum(n).alias(n) for n in sides))
    has = lambda condition: F.count_if(F.expr(condition))
    counted = marks.groupBy("doc").agg(F.sum("t").alias("in_truth"), has("t > 0 AND b > 0").alias("kept"), has("t > 0 AND f > 0").alias("right"), has("t = 0 AND f > if(b > 0, 1, 0)").alias("wrong"))
    return counted.where("in_truth + wrong > 0")


def by_pass(votes: DataFrame, truth: DataFrame, base: DataFrame) -> DataFrame:
    """(pass, right, wrong): what each further reading alone would add to the base."""
    added = applied(votes.withColumn("doc", F.struct("doc", "pass"))).select(F.col("doc.doc").alias("doc"), F.col("doc.pass").alias("pass"), "label", "value", "mark")
    new = added.distinct().join(base, ["doc", "label", "value", "mark"], "left_anti")
    known = new.join(truth.withColumn("ok", F.lit(True)), ["doc", "label", "value", "mark"], "left")
    return known.groupBy("pass").agg(F.count_if("ok").alias("right"), F.count_if(F.col("ok").isNull()).alias("wrong"))
