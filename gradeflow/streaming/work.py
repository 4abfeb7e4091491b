"""A bounded window of work: items are taken from a folder a few at a time, answered by a model, and kept in a log with commits."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.predictions import ANSWERS, apply_adapter
from ..sources import records

#: Items that each model at work may have waiting, in batches.
WAITING = 2


def worked(spark: SparkSession, folder: str, schema: str, adapter, log: str, checkpoint: str, adapters: int = 1, batch: int = 4, answers: str = ANSWERS) -> StreamingQuery:
    """Answers the items of a folder (Parquet, one item a file, with an id) that are there or still come, until none is left.

    A micro-batch takes no more than adapters * batch * WAITING files, so no more items are ever under way, and deals them to
    `adapters` tasks with a model each. A batch of items that fails is tried again one by one; an item that fails is a row with its
    error. Answers are visible in the log a micro-batch at a time, once; what was under way when all stopped is taken again.
    """
    spark.dataSource.register(records.Records)
    window = adapters * batch * WAITING
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", window).parquet(folder)
    rows = apply_adapter(items.repartition(adapters), adapter, answers, batch)
    return rows.writeStream.format("records").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
