"""Scratch space and files in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where it is unset and all runs on one machine (as in
tests) a temporary folder of our own is made and set; a cluster without it is an error. Everything written here outlives the loss of
an executor: files get their final name by one rename after they are complete, and a task that runs
again writes the same name with the same content.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets Spark's checkpoint folder to it if there is none yet."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("a cluster needs a folder that all machines share: set spark.checkpoint.dir")
        found = "file://" + tempfile.mkdtemp(prefix="gradeflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """URI of a new, empty folder below the shared one."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return uri


def remove(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def written(df: DataFrame, label: str, parts: list[str] | None = None) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the shared folder, read again; and the table's URI, to remove it."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def until_exit(uri: str) -> None:
    """Has a folder that a result still to be computed reads removed when the driver ends."""

    def gone() -> None:
        with contextlib.suppress(OSError):
            remove(uri)

    atexit.register(gone)


class Scratch:
    """Parquet tables of the steps of one operator, in one folder below the shared one, removed together at the end."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.uri, self.number = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The frame, written and read again: later steps plan a scan, not what came before."""
        self.number += 1
        df.write.option("compression", "zstd").parquet(f"{self.uri}/{self.number}")
        return self.spark.read.schema(df.schema).parquet(f"{self.uri}/{self.number}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.uri)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; Spark removes its files once nothing refers to the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Queries made within it remove their shuffle files when they end, not when the driver happens to collect its garbage. A frame that is
    computed twice shuffles twice. The session's own setting comes back at the end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def tidy(spark: SparkSession) -> None:
    """Lets go of what earlier steps of a long operator left: Spark removes shuffle and checkpoint files once the driver has
    collected the frames they belong to, and the driver keeps less memory. Spark's listeners are given a moment to let go of the
    last query."""
    gc.collect()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A stream to a temporary name that becomes the file once it is complete."""
    fs, path = pafs.FileSystem.from_uri(uri)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        yield out
    fs.move(temp, path)


def put_file(uri: str, *chunks: bytes) -> None:
    with new_file(uri) as out:
        for chunk in chunks:
            out.write(chunk)


def release() -> None:
    """In a task that has let go of large arrays: gives the memory back, for Python workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def get_file(uri: str) -> bytes | None:
    """A file's bytes; None if there is no such file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as source:
        return source.read()


def list_files(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """(URI, size) of the files directly in a folder, by name."""
    fs, path = pafs.FileSystem.from_uri(uri)
    scheme = uri.split("://", 1)[0] + "://" if "://" in uri else ""
    host = "" if isinstance(fs, pafs.LocalFileSystem) else uri.split("://", 1)[1].split("/", 1)[0]
    infos = fs.get_file_info(pafs.FileSelector(path))
    return sorted((f"{scheme}{host}{i.path}", i.size) for i in infos if i.type == pafs.FileType.File and i.path.endswith(suffix))


def unique() -> str:
    return uuid.uuid4().hex
