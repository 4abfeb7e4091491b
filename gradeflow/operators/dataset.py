"""The labelled set: validation, selection, fixed samples, summary and fingerprint.

Items are (ordinal, id, images, category, gt, gt_type, doc_id, split, ...). Global checks (duplicate ids,
documents in two splits) are frames of their own over the unfiltered set: as columns of a selection, column
pruning would drop them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import sample_key


def duplicate_ids(items: DataFrame) -> DataFrame:
    return items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def leaked_groups(items: DataFrame) -> DataFrame:
    """Groups of pages with more than one split."""
    found = items.where("split IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n_items"))
    return found.where("n_splits > 1")


def problems(items: DataFrame, least: int = 30) -> DataFrame:
    """(problem, what, n): blank truths, and dev categories of fewer than `least` items."""
    blank = items.where(F.trim(F.coalesce("gt", F.lit(""))) == "").groupBy("category").agg(F.count("*").alias("n")).select(F.lit("blank truth").alias("problem"), F.col("category").alias("what"), "n")
    few = items.where("split = 'dev'").groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit("few items").alias("problem"), F.col("category").alias("what"), "n")
    return blank.unionByName(few)


def select(items: DataFrame, split: str | None = None, excluded: DataFrame | None = None, categories: list[str] | None = None, per_category: int = 0, seed: int = 0, limit: int = 0) -> DataFrame:
    """Split, exclusions (of the holdout split only), categories, a fixed sample of each category and the first items, in this order."""
    if split:
        items = items.where(F.col("split") == split)
        if split == "holdout" and excluded is not None:
            items = items.join(excluded.select("id"), "id", "left_anti")
    if categories:
        items = items.where(F.col("category").isin(*categories))
    if per_category:
        items = fixed_sample(items, per_category, seed)
    return items.orderBy("ordinal").limit(limit) if limit else items


def fixed_sample(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n items of each category with the least hash of seed and id: the same whatever else the set holds."""
    window = Window.partitionBy("category").orderBy(sample_key(F.col("id"), seed))
    # row_number <= n is kept within each task before the rows of a category meet (window group limit)
    return items.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def summary(items: DataFrame) -> DataFrame:
    """(category, dev, holdout, total, docs) of each category and, with null, of all; documents of all are counted anew."""
    count = lambda s: F.count_if(F.col("split") == s).alias(s)
    return items.rollup("category").agg(count("dev"), count("holdout"), F.count("*").alias("total"), F.count_distinct("doc_id").alias("docs"))


def item_line() -> Column:
    names = F.array_join(F.transform("images", lambda p: F.element_at(F.split(p, "/"), -1)), ",")
    return F.concat_ws("\t", "id", "category", F.coalesce("split", F.lit("")), "gt_type", F.sha2("gt", 256), names)


def fingerprint(items: DataFrame) -> DataFrame:
    """(fingerprint): SHA-256 of the items' lines sorted by id, 16 hex digits.

    The hash is of one ordered text, as the rule demands. Only lines (about 100 bytes each, whatever the truths' size) are moved;
    one task sorts them, on disk where they are many, and hashes them as they come.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = hashlib.sha256()
        for batch in batches:
            for line in batch.column("line").to_pylist():
                whole.update(f"{line}\n".encode())
        yield pa.RecordBatch.from_pydict({"fingerprint": [whole.hexdigest()[:16]]})

    lines = items.select("id", item_line().alias("line")).repartition(1).sortWithinPartitions("id", "line")
    return lines.select("line").mapInArrow(digest, "fingerprint string")
