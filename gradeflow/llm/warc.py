"""WARC archives: a writer by Spark's text sink, and a reader that is a Python data source.

Writing. A record's text ends in two line breaks, which is the sink's line separator, so part files are
WARC 1.1 files and appear only when their task commits. Of records with equal payloads of at least
MIN_REVISIT bytes, that with the largest page id is a response and the others are revisits of it without
payload; smaller ones are all responses. Payloads are compared by SHA-1 and length. Which payloads repeat is
counted in each task first, and only payloads that do repeat are joined.

Every record has an id of its own and the date of writing; page ids stand in headers X-Page-ID and X-Refers-To-Page,
since they may repeat. Where records begin, one every INDEX_BYTES, lies in a file beside each part file.

Reading. Files are cut into ranges of about SPLIT_BYTES; a range holds the records that begin in it. A reader
begins at the last indexed record before its range and steps from record to record by Content-Length. It parses the headers, tests the pushed-down predicates on
record type and headers, and reads and decodes the payload only if all hold and a column needs it.
Predicates are pushed down where spark.sql.python.filterPushdown.enabled is true; Spark checks them again.

Null html is an empty payload; a null url or page id leaves its header out. Rows with the same page id are
records of their own; among equal payloads with the same largest page id, one is the response.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import storage

MIN_REVISIT = 1000
#: Broadcast repeated payloads up to so many rows (80 bytes each).
MAX_BROADCAST = 100_000
SPLIT_BYTES = 32 << 20
INDEX_BYTES = 1 << 20
_INDEX = "_index"
_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_START = b"WARC/1.1\r\n"
_GAP = b"\r\n\r\n"
#: Shown by headers of the archive, without a payload.
HEADER_COLUMNS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
SCHEMA = HEADER_COLUMNS + ", payload binary"


def write(pages: DataFrame, uri: str, least: int = MIN_REVISIT, date: str | None = None) -> None:
    """Writes a record for every row (page_id, url, html); date: when the pages were fetched (ISO, UTC), now if not given."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    known = rows.where(F.col("bytes") >= least)
    repeated = known.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1")
    repeated = storage.checkpointed(repeated.select("digest", "bytes", "first"))
    # few repeated payloads go to the pages; many would be met by shuffling the pages
    small = repeated.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    met = rows.join(F.broadcast(repeated) if small else repeated, ["digest", "bytes"], "left")
    # the row of the largest id is the response; if several rows have it, the first of them
    tied = storage.checkpointed(known.join(repeated, ["digest", "bytes"]).where("page_id <=> first").groupBy("digest", "bytes").count().where("count > 1"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    if not tied.isEmpty():
        one = Window.partitionBy("digest", "bytes", "page_id").orderBy("url")
        same = met.join(tied.select("digest", "bytes", F.lit(True).alias("several")), ["digest", "bytes"], "left")
        again = same.where("several AND page_id <=> first").withColumn("again", F.row_number().over(one) > 1)
        met = same.where("NOT coalesce(several AND page_id <=> first, false)").withColumn("again", F.lit(False)).unionByName(again)
        revisit = revisit | F.col("again")
    kind = F.when(revisit, "revisit").otherwise("response")
    head = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))).otherwise("")
    # a url with a line break would end its header
    clean = F.regexp_replace("url", r"[\r\n]+", " ")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(_CRLF),
        F.lit("WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        head("WARC-Target-URI", clean), head("X-Page-ID", F.col("page_id").cast("string")), head("X-Refers-To-Page", F.when(revisit, F.col("first").cast("string"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        head("WARC-Payload-Digest", digest), head("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
        block,
    )
    met.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(uri)
    _write_index(pages.sparkSession, uri)


def _parts(uri: str) -> list[tuple[str, int]]:
    return [x for x in storage.list_files(uri) if not x[0].rsplit("/", 1)[1].startswith(("_", "."))]


def _index_of(name: str) -> str:
    folder, file = name.rsplit("/", 1)
    return f"{folder}/{_INDEX}/{file}"


def _write_index(spark: SparkSession, uri: str) -> None:
    """For each part file, the offsets of records, one every INDEX_BYTES: one walk over headers a file."""
    names = [name for name, size in _parts(uri) if size]
    if not names:
        return
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(f"{path}/{_INDEX}")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("uri").to_pylist():
                kept, due = [], 0
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as source:
                    for at in _starts(source, 0, source.size()):
                        if at >= due:
                            kept.append(at)
                            due = at + INDEX_BYTES
                storage.put_file(_index_of(name), np.array(kept, np.int64).tobytes())
            yield batch

    spark.createDataFrame(list(enumerate(names)), "number int, uri string").repartitionById(len(names), "number").mapInArrow(walk, "number int, uri string").agg(F.count("*")).collect()


def _header(source: pa.NativeFile, at: int, size: int) -> tuple[dict[str, str], int]:
    """The fields of the record that begins at an offset, and where its block begins."""
    head = b""
    while (n := head.find(_GAP)) < 0 and at + len(head) < size:
        head += source.read_at(min(1024 + len(head), size - at - len(head)), at + len(head))
    return dict(x.split(": ", 1) for x in head[:n].decode("utf-8", "replace").split(_CRLF)[1:] if ": " in x), at + n + len(_GAP)


def _starts(source: pa.NativeFile, at: int, size: int) -> Iterator[int]:
    while at < size:
        yield at
        fields, block = _header(source, at, size)
        at = block + int(fields["Content-Length"]) + len(_GAP)


class _Range(InputPartition):
    def __init__(self, uri: str, begin: int, end: int) -> None:
        super().__init__(uri)
        self.uri, self.begin, self.end = uri, begin, end


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _digest(text: str | None) -> str | None:
    """Bare lower-case hex of a header's SHA-1, in hex or base 32."""
    value = (text or "").removeprefix("sha1:")
    return (base64.b32decode(value).hex() if len(value) == 32 else value.lower()) or None


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self._columns = [f.name for f in schema.fields]
        self._schema = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema.fields])
        self._uri, self._split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self._tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name and name != "payload" and type(f) in (*_TESTS, IsNotNull):
                self._tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        cut = [_Range(name, at, min(size, at + self._split)) for name, size in _parts(self._uri) for at in range(0, size, self._split)]
        return cut or [_Range("", 0, 0)]

    def _passes(self, row: dict) -> bool:
        for name, kind, value in self._tests:
            own = row[name]
            if own is None or kind is not IsNotNull and not _TESTS[kind](own, value):
                return False
        return True

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self._records(partition):
            held.append(row)
            size += len(row.get("payload") or b"") + 200
            if size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=self._schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self._schema)

    def _records(self, part: _Range) -> Iterator[dict]:
        if not part.uri:
            return
        fs, path = pafs.FileSystem.from_uri(part.uri)
        with fs.open_input_file(path) as source:
            size = source.size()
            for at in _starts(source, self._indexed(part), size):
                if at >= part.end:
                    break
                if at < part.begin:
                    continue
                fields, body = _header(source, at, size)
                row = {
                    "page_id": _number(fields.get("X-Page-ID")), "url": fields.get("WARC-Target-URI"), "record_type": fields.get("WARC-Type"),
                    "payload_bytes": _number(fields.get("X-Payload-Length")), "payload_digest": _digest(fields.get("WARC-Payload-Digest")), "refers_to": _number(fields.get("X-Refers-To-Page")),
                }
                if self._passes(row):
                    if "payload" in self._columns and row["record_type"] == "response":
                        block = source.read_at(int(fields["Content-Length"]), body)
                        row["payload"] = block[block.index(_GAP) + len(_GAP) :]
                    yield {k: row.get(k) for k in self._columns}

    @staticmethod
    def _indexed(part: _Range) -> int:
        """The last indexed record not after the range's begin; the file's first without an index. Only a walk by lengths from a
        known record tells records from payloads that quote them."""
        known = storage.get_file(_index_of(part.uri)) if part.begin else None
        starts = np.frombuffer(known or b"", np.int64)
        return int(starts[np.searchsorted(starts, part.begin, "right") - 1]) if len(starts) else 0


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); give a schema without payload to leave payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, uri: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(SCHEMA if payload else HEADER_COLUMNS).load(uri)


def check_payloads(records: DataFrame) -> DataFrame:
    """Records with length and digest of responses taken from their payloads, which must agree with the headers."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                payload = row.pop("payload")
                if row["record_type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (row["payload_bytes"], row["payload_digest"]):
                    raise ValueError(f"the payload of page {row['page_id']} does not match its headers")
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in HEADER_COLUMNS.split(", "))]))

    return records.mapInArrow(checked, HEADER_COLUMNS)
