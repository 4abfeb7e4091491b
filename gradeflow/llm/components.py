"""Connected components of a distributed edge list by contraction.

First each task replaces its links by a forest: every node linked with the least node that it reaches within the task's
links, so that no more links than nodes are left and chains are short. Then, in each
round, every node moves to the least of itself and its neighbours, by number in even rounds and by a
hash that differs in each odd round; links whose ends meet disappear, the others link what they moved to.
The moves are a map of the graph onto a smaller one with the same components, and by random order at least half of
the nodes that still have links are expected to move, so the rounds end after about log2 of the longest chain. The
rounds' maps are then followed one after the other.

The links never leave the executors. A round is two queries, whose results are written to the shared folder:
an aggregation that is combined before its shuffle, and two joins whose other side has one row a key, so a
node with very many links is only ever a key that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import Scratch, checkpointed, tidy

#: Links that a task holds when it replaces them by a forest; more go on as several forests.
HELD = 1_000_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) of every other node of these links."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        for end in (least[a], least[b], a, b):
            np.minimum.at(least, end, low)
        least = least[least]
        if (least == before).all():
            break
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[other]], nodes[other]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def forest() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["u", "v"])

    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        n += batch.num_rows
        if n >= HELD:
            yield forest()
            held, n = [], 0
    if n:
        yield forest()


def components(links: DataFrame, a: str, b: str, least: bool = True) -> DataFrame:
    """(node, component) for every node with a link; the component is one of its nodes, its least one if `least`.

    Null ends and links of a node with itself are ignored; no links give no rows.
    """
    with Scratch(links.sparkSession, "components") as scratch:
        own = links.where(f"{a} <> {b}").select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
        edges = scratch.keep(own.mapInArrow(_contracted, "u long, v long").distinct())
        moves: list[DataFrame] = []
        while not edges.isEmpty():
            turn = len(moves)

            def rank(node: str, turn: int = turn):
                return F.struct((F.xxhash64(node, F.lit(turn)) if turn % 2 else F.col(node)).alias("rank"), F.col(node).alias("id"))

            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            near = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), "m").getField("id").alias("to"))
            move = scratch.keep(near)
            moves.append(move)
            ends = edges.join(move, "u").select(F.col("to").alias("a"), F.col("v").alias("u")).join(move, "u").where("a <> to")
            edges = scratch.keep(ends.select(F.least("a", "to").alias("u"), F.greatest("a", "to").alias("v")).distinct())
            del both, near, ends
            tidy(links.sparkSession)
        if not moves:
            return links.sparkSession.createDataFrame([], "node long, component long")
        found = moves[0].select(F.col("u").alias("node"), F.col("to").alias("component"))
        for move in moves[1:]:
            found = found.join(move.select(F.col("u").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        if least:
            found = scratch.keep(found)
            names = found.groupBy("component").agg(F.min("node").alias("least"))
            found = found.join(names, "component").select("node", F.col("least").alias("component"))
        return checkpointed(found)
