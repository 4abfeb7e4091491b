"""Incremental forms: latest records, error breakers, progress, token loops. Batch and stream share their rules.

State is kept by key in the state store; its size is one small row a key. Sources are file streams, so a
restart goes on from the checkpoint, and a record read twice changes nothing (records carry their seq).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.layout import CATEGORY_AND_TEXT
from ..sources import scratch

BREAK_AT = 10
LOOP_BLOCKS, LOOP_CHARACTERS = 25, 6


def latest_stream(log: DataFrame, key: str) -> DataFrame:
    """The last record of each key so far, by seq (update mode)."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("_last")).select(key, "_last.*")


def progress_stream(log: DataFrame) -> DataFrame:
    """Counts, errors and mean latency by model so far (complete or update mode)."""
    return log.groupBy("model").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.avg("latency_s").alias("latency_mean_s"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """(start, stop, by, n): records of each key in tumbling, or with a slide in overlapping, windows of event time.

    Records later than the watermark are not counted; a window's row comes once it is closed (append mode)."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """(by, start, stop, n, errors): records of a key less than a gap apart, under a watermark; stop is a gap after the last (append mode)."""
    counts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))
    return counts.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "errors")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a stream's stateful operators have left out as later than the watermark, over the batches whose progress Spark still holds."""
    return sum(int(op.numRowsDroppedByWatermark) for batch in query.recentProgress for op in batch.stateOperators)


def breaker_stream(log: DataFrame, key: str, at: int = BREAK_AT) -> DataFrame:
    """(key, streak, longest, tripped) after every batch: successive errors of a shard in order of seq, reset by success."""

    def advance(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, longest, seen = state.get if state.exists else (0, 0, -1)
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, bad in zip(rows["seq"], rows["is_error"], strict=True):
            if seq > seen:
                streak = streak + 1 if bad else 0
                longest, seen = max(longest, streak), int(seq)
        state.update((streak, longest, seen))
        yield pd.DataFrame({key: [keys[0]], "streak": [streak], "longest": [longest], "tripped": [longest >= at]})

    kind = log.schema[key].dataType.simpleString()
    return log.select(key, "seq", "is_error").groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, streak long, longest long, tripped boolean", "streak long, longest long, seen long", "update", GroupStateTimeout.NoTimeout)


def token_loop_stream(tokens: DataFrame, key: str, stops: Callable[[list[int]], bool], tail: int) -> DataFrame:
    """(key, n, stopped): token batches (key, seq, tokens) against a rule on the last `tail` tokens, which are as many as the rule looks at."""

    def advance(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, stopped = state.get if state.exists else ([], 0, False)
        held = list(held)
        for part in pd.concat(list(frames)).sort_values("seq")["tokens"]:
            if not stopped:
                held, n = (held + [int(t) for t in part])[-tail:], n + len(part)
                stopped = stops(held)
        state.update((held, n, stopped))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "stopped": [stopped]})

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, n long, stopped boolean", "held array<long>, n long, stopped boolean", "update", GroupStateTimeout.NoTimeout)


def text_loop_stream(texts: DataFrame, key: str) -> DataFrame:
    """(key, n, stopped): pieces of layout JSON (key, seq, text) so far, and whether its last block has come too often in a row.

    The state is the last block and how often it came, and of the text after the last whole one what may begin a block. A piece without
    a quotation mark ends no block, so it is only kept; others are searched from the place where a block may begin.
    """
    pattern, opening = re.compile(CATEGORY_AND_TEXT), '"category"'

    def advance(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, rest, n = state.get if state.exists else ("", 0, "", 0)
        for piece in pd.concat(list(frames)).sort_values("seq")["text"]:
            rest, n, end = rest + piece, n + len(piece), 0
            for found in pattern.finditer(rest) if '"' in piece else ():
                times = times + 1 if found[0] == last else 1
                last, end = found[0], found.end()
            begin = rest.find(opening, end)
            rest = rest[begin:] if begin >= 0 else rest[max(end, len(rest) - len(opening) + 1) :]
        said = pattern.fullmatch(last)
        state.update((last, times, rest, n))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "stopped": [bool(said) and times >= LOOP_BLOCKS and len(said[2]) >= LOOP_CHARACTERS]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.groupBy(key).applyInPandasWithState(advance, f"{key} {kind}, n long, stopped boolean", "last string, times long, rest string, n long", "update", GroupStateTimeout.NoTimeout)


def peak_stream(samples: DataFrame, key: str, value: str) -> DataFrame:
    """The greatest sample of each key so far (update mode)."""
    return samples.groupBy(key).agg(F.max(value).alias("peak"), F.count("*").alias("samples"))


def append_new(batch: DataFrame, path: str, number: int) -> None:
    """For foreachBatch: writes a batch's records to the batch's own folder, so that a batch that is played again replaces itself and the log is never read."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def drained(stream: DataFrame, mode: str, keys: list[str], path: str | None = None) -> DataFrame:
    """Runs a stream over what its source holds now and returns the last row of each key as a table. Rows go through files, not the driver."""
    spark = stream.sparkSession
    place = path or scratch.new_dir(spark, "drained")

    def keep(batch: DataFrame, number: int) -> None:
        append_new(batch, f"{place}/rows", number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).option("basePath", f"{place}/rows").parquet(f"{place}/rows")
    rows = rows.withColumn("_batch", F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).cast("long"))
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*")
