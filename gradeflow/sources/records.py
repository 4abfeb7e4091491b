"""An append-only log of records whose writes are visible whole or not at all, once.

    spark.dataSource.register(records.Records)
    frame.write.format("records").mode("append").save(uri)
    stream.writeStream.format("records").option("path", uri).option("checkpointLocation", place).start()
    records.read(spark, uri, frame.schema)

A log is a folder: `data` holds Parquet files, one a task, and `commits` a small file for each write, which names the data files
that belong to the log. Tasks write under names that never come twice; the driver writes the commit, under its
final name only when it is whole, after all tasks have ended well. So files of tasks that failed, ran twice or belong to a write that was
given up are in the folder but not in the log (`orphans` finds them). A stream's commit is named by its batch: a batch that is played again
after a crash finds its commit and adds nothing. Overwriting is a commit that hides those before it.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Records of a data file's row group.
GROUP = 1 << 17


@dataclass
class Part(WriterCommitMessage):
    """What a task has written; no name if it had no records."""

    name: str | None
    records: int


class _Log:
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """Of one task: its records in a file of their own, as they come."""
        fs, root = self._open()
        name, writer, records = f"{uuid.uuid4().hex}.parquet", None, 0
        fs.create_dir(f"{root}/data", recursive=True)
        try:
            for batch in iterator:
                if batch.num_rows:
                    writer = writer or pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=fs, compression="zstd")
                    writer.write_batch(batch, row_group_size=GROUP)
                    records += batch.num_rows
        finally:
            if writer:
                writer.close()
        return Part(name if writer else None, records)

    def _commit(self, place: str, parts: list, overwrite: bool) -> None:
        fs, root = self._open()
        path, temp = f"{root}/commits/{place}.json", f"{root}/commits/{place}.{uuid.uuid4().hex}.tmp"
        known = [p for p in parts if p is not None and p.name]
        said = {"time": time.time_ns(), "overwrite": overwrite, "files": sorted(p.name for p in known), "records": sum(p.records for p in known)}
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(temp) as out:
            out.write(json.dumps(said).encode())
        fs.move(temp, path)

    def abort(self, messages: list, *_: object) -> None:
        """Files of a write that was given up are removed where their names are known."""
        fs, root = self._open()
        for part in messages:
            if part is not None and part.name:
                with contextlib.suppress(OSError):
                    fs.delete_file(f"{root}/data/{part.name}")


class BatchWriter(_Log, DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool) -> None:
        super().__init__(uri)
        self.overwrite = overwrite

    def commit(self, messages: list) -> None:
        self._commit(f"batch/{time.time_ns():020d}-{uuid.uuid4().hex}", messages, self.overwrite)


class StreamWriter(_Log, DataSourceStreamArrowWriter):
    def __init__(self, uri: str, writer: str) -> None:
        super().__init__(uri)
        self.writer = writer

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 - Spark's name
        fs, root = self._open()
        place = f"{self.writer}/{batchId:020d}"
        if fs.get_file_info(f"{root}/commits/{place}.json").type == pafs.FileType.NotFound:
            self._commit(place, messages, False)
        else:
            self.abort(messages)


class Records(DataSource):
    """Options: path, the log's folder; writer, a stream's name among those that write the same log."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802 - Spark's name
        return StreamWriter(self.options["path"], self.options.get("writer", "stream"))


def commits(uri: str) -> list[dict]:
    """The log's commits that count, the oldest first: those since the last that overwrote."""
    fs, root = pafs.FileSystem.from_uri(uri)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/commits", recursive=True, allow_not_found=True)):
        if info.type == pafs.FileType.File and info.path.endswith(".json"):
            with fs.open_input_stream(info.path) as source:
                found.append((json.loads(source.read()), info.path))
    found = [c for c, _ in sorted(found, key=lambda c: (c[0]["time"], c[1]))]
    last = max((i for i, c in enumerate(found) if c["overwrite"]), default=0)
    return found[last:]


def read(spark: SparkSession, uri: str, schema: StructType) -> DataFrame:
    """All records of a log, by Spark's own Parquet scan of its files."""
    files = [f"{uri}/data/{name}" for c in commits(uri) for name in c["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def orphans(uri: str, older: float = 24 * 3600) -> list[str]:
    """Data files that no commit names, older than so many seconds, for a write may still be going on; safe to remove."""
    fs, root = pafs.FileSystem.from_uri(uri)
    known = set()
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/commits", recursive=True, allow_not_found=True)):
        if info.path.endswith(".json"):
            with fs.open_input_stream(info.path) as source:
                known.update(json.loads(source.read())["files"])
    there = fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True))
    return sorted(i.path for i in there if i.base_name not in known and i.mtime.timestamp() <= time.time() - older)
