"""Keyed state that is changed in place: latest records, error breakers and token loops by transformWithState.

A key's state is a few small variables in RocksDB. A batch reads and writes those of its own keys only; a list is appended to
without being read, and cut when it has grown to several times what its rule looks at. With a time to live, the state of a key
that is not seen any more is dropped. Records carry a seq, so that one that is read twice changes nothing.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .progress import BREAK_AT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A list of tokens is cut when it holds so many times what its rule looks at.
SLACK = 4


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that begin in this block keep their state in RocksDB, which transformWithState needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Keyed(StatefulProcessor):
    #: (name, schema) of single values.
    values: tuple[tuple[str, str], ...] = ()

    def __init__(self, key: str, ttl: int | None) -> None:
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        for name, schema in self.values:
            setattr(self, name, handle.getValueState(name, schema, self.ttl))

    def close(self) -> None:
        pass


class _Latest(_Keyed):
    def __init__(self, key: str, ttl: int | None, columns: list[str], schema: str) -> None:
        super().__init__(key, ttl)
        self.columns, self.values = columns, (("last", schema),)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        best, changed = self.last.get() if self.last.exists() else None, False
        at = self.columns.index("seq")
        for frame in rows:
            for row in frame[self.columns].itertuples(index=False, name=None):
                if best is None or row[at] > best[at]:
                    best, changed = tuple(None if v is pd.NaT or v != v else v for v in row), True
        if changed:
            self.last.update(best)
            yield pd.DataFrame([(key[0], *best)], columns=[self.key, *self.columns])


class _Breaker(_Keyed):
    values = (("run", "streak long, longest long, seen long"),)

    def __init__(self, key: str, ttl: int | None, at: int) -> None:
        super().__init__(key, ttl)
        self.at = at

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        streak, longest, seen = self.run.get() if self.run.exists() else (0, 0, -1)
        frame = pd.concat(list(rows)).sort_values("seq")  # a key's records of one batch
        for seq, bad in zip(frame["seq"].tolist(), frame["is_error"].tolist(), strict=True):
            if seq > seen:
                streak, seen = streak + 1 if bad else 0, seq
                longest = max(longest, streak)
        self.run.update((streak, longest, seen))
        yield pd.DataFrame({self.key: [key[0]], "streak": [streak], "longest": [longest], "tripped": [longest >= self.at]})


class _TokenLoop(_Keyed):
    values = (("said", "n long, held long, seen long, stopped boolean"),)

    def __init__(self, key: str, ttl: int | None, stops: Callable[[list[int]], bool], tail: int) -> None:
        super().__init__(key, ttl)
        self.stops, self.tail = stops, tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getListState("parts", "tokens array<long>", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        n, held, seen, stopped = self.said.get() if self.said.exists() else (0, 0, -1, False)
        frame = pd.concat(list(rows)).sort_values("seq")
        fresh = [(int(s), [int(t) for t in tokens]) for s, tokens in zip(frame["seq"], frame["tokens"], strict=True) if s > seen]
        if fresh and not stopped:
            tail = [t for (part,) in self.parts.get() for t in part][-self.tail :] if held else []
            for seq, tokens in fresh:
                if not stopped:
                    tail, n, seen = (tail + tokens)[-self.tail :], n + len(tokens), seq
                    stopped = self.stops(tail)
            if held > SLACK * self.tail:
                self.parts.put([(tail,)])
                held = len(tail)
            else:
                added = [t for _, tokens in fresh for t in tokens][-self.tail :]
                self.parts.appendValue((added,))
                held += len(added)
        self.said.update((n, held, max(seen, max((s for s, _ in fresh), default=seen)), stopped))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "stopped": [stopped]})


def _kind(frame: DataFrame, name: str) -> str:
    return f"`{name}` {frame.schema[name].dataType.simpleString()}"


def latest(log: DataFrame, key: str, ttl: int | None = None) -> DataFrame:
    """The last record of each key by seq (a number or a time), whenever it changes (update mode). ttl: milliseconds."""
    rest = [c for c in log.columns if c != key]
    schema = ", ".join(_kind(log, c) for c in rest)
    return log.groupBy(key).transformWithStateInPandas(_Latest(key, ttl, rest, schema), f"{_kind(log, key)}, {schema}", "update", "ProcessingTime" if ttl else "None")


def breaker(log: DataFrame, key: str, at: int = BREAK_AT, ttl: int | None = None) -> DataFrame:
    """(key, streak, longest, tripped) after every batch: successive errors of a key in order of seq, reset by success."""
    rows = log.select(key, "seq", "is_error")
    return rows.groupBy(key).transformWithStateInPandas(_Breaker(key, ttl, at), f"{_kind(log, key)}, streak long, longest long, tripped boolean", "update", "ProcessingTime" if ttl else "None")


def token_loops(tokens: DataFrame, key: str, stops: Callable[[list[int]], bool], tail: int, ttl: int | None = None) -> DataFrame:
    """(key, n, stopped): token batches (key, seq, tokens) against a rule on the last `tail` tokens. Tokens after a stop are not counted."""
    rows = tokens.select(key, "seq", "tokens")
    return rows.groupBy(key).transformWithStateInPandas(_TokenLoop(key, ttl, stops, tail), f"{_kind(tokens, key)}, n long, stopped boolean", "update", "ProcessingTime" if ttl else "None")
