"""Folders that driver and executors share, for what one query leaves between its steps."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_dir(spark: SparkSession, label: str) -> str:
    """URI of a new folder below spark.checkpoint.dir, removed when the driver ends. Only a session of one machine may have none set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("a cluster needs a shared folder: set spark.checkpoint.dir")
    uri = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='gradeflow-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)

    def gone() -> None:
        with contextlib.suppress(OSError):
            fs.delete_dir(path)

    atexit.register(gone)
    return uri


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame's rows, computed once and read from a new folder."""
    uri = f"{new_dir(frame.sparkSession, label)}/rows"
    frame.write.parquet(uri)
    return frame.sparkSession.read.schema(frame.schema).parquet(uri)


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Queries made within it remove their shuffle files when they end, not when the driver happens to collect its garbage. The session's own
    setting comes back at the end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
