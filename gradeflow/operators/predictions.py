"""Predictions: test models, the latest record of a log, what is left to do, runs of errors, and pages of one item."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import shard_of

LOOP = " lorem ipsum" * 40


def noisy_text(text: str, key: str, noise: float = 0.05, seed: int = 0) -> str:
    """Characters dropped or replaced at random, seeded by the item."""
    draw = random.Random(f"{seed}:{key}")
    chances = ((c, draw.random()) for c in text)
    return "".join("x" if r < noise else c for c, r in chances if r >= noise / 2)


def noisy(text: Column, key: Column, noise: float = 0.05, seed: int = 0) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([noisy_text(t or "", k, noise, seed) for t, k in zip(texts, keys, strict=True)])

    return run(text, key)


def test_answer(mode: str, text: Column, key: Column) -> tuple[Column, Column]:
    """(answer, error) of a test model: oracle, empty, loop, fail, truncated (the first half), swapped (a fixed rewriting) or noisy."""
    answers = {
        "oracle": lambda: text, "empty": lambda: F.lit(""), "fail": lambda: F.lit(None).cast("string"), "loop": lambda: F.concat(text, F.lit(LOOP)),
        "truncated": lambda: F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")), "swapped": lambda: F.translate(text, "eot", "3x"), "noisy": lambda: noisy(text, key),
    }
    if mode not in answers:
        raise ValueError(f"no such test mode: {mode}")
    return answers[mode](), (F.lit("test failure") if mode == "fail" else F.lit(None).cast("string"))


def run_models(items: DataFrame, models: list[str]) -> DataFrame:
    """(model, id, text, error, seq) of every item by every test model."""
    made = None
    for i, mode in enumerate(models):
        text, error = test_answer(mode, F.col("gt"), F.col("id"))
        one = items.select(F.lit(mode).alias("model"), F.lit(i).alias("model_ordinal"), "id", text.alias("text"), error.alias("error"), F.col("ordinal").alias("seq"))
        made = one if made is None else made.unionByName(one)
    return made


ANSWERS = "id string, text string, confidence double, latency_s double, error string"


def apply_adapter(items: DataFrame, adapter, schema: str = ANSWERS, batch: int = 0) -> DataFrame:
    """Answers by an object with load(), predict_batch(frame) -> frame and close(): loaded once a task, `batch` items at a time (0: as they come).

    A batch that fails is tried again item by item; an item that fails is a row with its error. Works on streams, too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter.load()
        names = [c.split()[0] for c in schema.split(", ")]

        def whole(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.reindex(columns=names).astype(object)
            return frame.where(frame.notna(), None)

        try:
            for some in (frame.iloc[at : at + (batch or len(frame))] for frame in batches for at in range(0, len(frame), batch or len(frame))):
                try:
                    yield whole(adapter.predict_batch(some))
                except Exception:  # noqa: BLE001 - any model error is data here
                    for i in range(len(some)):
                        one = some.iloc[i : i + 1]
                        try:
                            yield whole(adapter.predict_batch(one))
                        except Exception as why:  # noqa: BLE001
                            yield whole(pd.DataFrame({"id": one["id"], "error": f"{type(why).__name__}: {why}"}))
        finally:
            adapter.close()

    return items.mapInPandas(run, schema)


def latest(log: DataFrame, *key: str) -> DataFrame:
    """The last record of each key by seq. One aggregation, combined in each task before the shuffle: no key is hot."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(*key, "_last.*")


def todo(items: DataFrame, done: DataFrame, retry_errors: bool = False, shards: int = 0, shard: int = 0) -> DataFrame:
    """Items without a record (or, on retry, whose last record is an error), of one shard."""
    if retry_errors:
        done = done.where(F.coalesce("error", F.lit("")) == "")
    left = items.join(done.select("id"), "id", "left_anti")
    return left.where(shard_of(F.col("id"), shards) == shard) if shards else left


def reuse(left: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records copied from a base model where preprocessing changed nothing and there was no error, items that still must run)."""
    usable = base.where("unchanged AND coalesce(error, '') = ''")
    return usable.join(left.select("id"), "id", "left_semi"), left.join(usable.select("id"), "id", "left_anti")


def error_streaks(log: DataFrame, key: str) -> DataFrame:
    """(key, streak, tripped at 10): the longest run of successive errors of each key in order of seq."""
    ordered = Window.partitionBy(key).orderBy("seq")
    marked = log.withColumn("_island", F.sum(F.when(F.col("is_error"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = marked.where("is_error").groupBy(key, "_island").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("streak")).withColumn("tripped", F.col("streak") >= 10)


def merge_pages(pages: DataFrame) -> DataFrame:
    """(id, text, confidence, stopped, new_tokens, n_pages): an item's pages in order, texts joined by a blank line."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.groupBy("id").agg(F.array_join(texts, "\n\n").alias("text"), F.avg("confidence").alias("confidence"), F.bool_or("stopped").alias("stopped"), F.sum("new_tokens").alias("new_tokens"), F.count("*").alias("n_pages"))


def merged_logs(*logs: DataFrame, key: tuple[str, ...] = ("id", "seq")) -> DataFrame:
    """One log of several copies of it (id, seq, ..., error), whatever their order: each record that any has, once.

    No copy's records are lost, so none replaces a longer one. Where copies differ in a record, one without an error wins, then
    the greater in its columns, so that all machines come to the same log. A full outer join on the key, as one aggregation that is
    combined before its shuffle.
    """
    first, *more = logs
    both = first
    for log in more:
        both = both.unionByName(log, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    sound = (F.coalesce("error", F.lit("")) == "").alias("_sound") if "error" in rest else F.lit(True).alias("_sound")
    return both.groupBy(*key).agg(F.max(F.struct(sound, *rest)).alias("_best")).select(*key, *(f"_best.{c}" for c in rest))


def lost_records(merged: DataFrame, log: DataFrame, key: tuple[str, ...] = ("id", "seq")) -> DataFrame:
    """Keys of a log that a merged one has not; none, if it was among its copies."""
    return log.select(*key).join(merged.select(*key), list(key), "left_anti")
