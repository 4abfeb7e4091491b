"""Token ids of documents in binary files, entropy-coded with one code for the whole corpus.

Format of a file (little-endian):
  magic "GFTB", version u32, vocabulary size u32, then a u8 code length for each id (canonical Huffman code,
  at most 16 bits; 0 for ids that do not occur), zlib-compressed with its size before it as u32;
  then blocks, each independent of the others: number of documents u32, number of ids u64, number of bytes
  u64, size u32 and zlib-compressed (document id i64, its null mark u8, number of ids u64) in columns,
  the bit offsets u64 of every 256th id, and the bit stream;
  then the footer: for each block its file offset u64, documents u64 and ids u64; and last the number of
  blocks u32 and magic "GFTE".
Files are named by their order: all documents of a file come before those of the next in ascending doc_id
order (null first; rows with the same id by text), and so do the documents of a file.

Writing sorts the texts by ranges of ids, tokenizes each range once and keeps the ids as a table in the
shared folder. Every id is counted on the way (a count an id and range; the vocabulary bounds them), the ranges' counts are
summed, and then each range is encoded into a file, block by block, and the table removed.

The tokenizer splits at blanks before anything else, so the ids of a text are those of its blank-separated
pieces. Each distinct piece of some MB of text is tokenized once: pieces of letters, less the sentence marks
after them, are joined to long texts for the tokenizer, whose word ends then tell them apart; others are
given to it one by one. Marks stay at words whose last letter the tokenizer joins with them, which it is asked once a letter.

Reading plans one task a file; its first document's position in the corpus follows from the footers.
"""

from __future__ import annotations

import os
import struct
import threading
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import storage
from .huffman import LANE, Coder, code_lengths

MAGIC, END_MAGIC, VERSION = b"GFTB", b"GFTE", 1
#: Ids in a block before it is closed (a document is never cut).
BLOCK_IDS = 1 << 19
#: Pieces whose ids a task keeps; then it starts afresh.
KEPT_PIECES = 600_000
#: Bytes of text whose distinct pieces are found at once.
SLICE_BYTES = 6 << 20
END_ID = 1
#: Sentence marks that are taken off a word's end.
MARKS = ".,!?"


class Pieces:
    """Ids of texts by a tokenizer that never looks across blanks, line feeds, tabs and carriage returns, and ends words in `</w>`."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size()
        self._kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self._is_end = np.zeros(self.size, bool)
        for token, i in self._tokenizer.get_vocab().items():
            self._is_end[i] = token.endswith("</w>")
        self._sticky: dict[str, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self._known, self._fresh = pa.array([""], pa.large_string()), []
        self._ids, self._begins, self._ends = [np.zeros(0, self._kind)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self._stored = 0

    def _keep(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self._fresh.append(pa.array(keys, pa.large_string()))
        ends = self._stored + np.cumsum(lengths)
        self._ids.append(ids)
        self._begins.append(ends - lengths)
        self._ends.append(ends)
        self._stored += len(ids)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self._kind) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str], alpha: list[bool]) -> None:
        letters, others = list(compress(keys, alpha)), list(compress(keys, map(not_, alpha)))
        for at in range(0, len(letters), 10_000):
            some = letters[at : at + 10_000]
            ids = np.concatenate(self._encode([" ".join(some[i : i + 500]) for i in range(0, len(some), 500)]))
            ends = np.flatnonzero(self._is_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._keep(some, ids, np.diff(ends, prepend=0))
            else:
                others += some
        for at in range(0, len(others), 2_000):
            some = others[at : at + 2_000]
            got = self._encode(some)
            self._keep(some, np.concatenate(got), np.array([len(g) for g in got]))

    def _sticks(self, last: str) -> bool:
        """Whether the tokenizer takes a word's last letter and a mark after it together, as where the letter's normal form ends in a combining mark."""
        if last not in self._sticky:
            alone, *others = (g.tolist() for g in self._encode([last, *MARKS, *(last + m for m in MARKS)]))
            marks, both = others[: len(MARKS)], others[len(MARKS) :]
            self._sticky[last] = any(b != alone + m for b, m in zip(both, marks, strict=True))
        return self._sticky[last]

    def _apart(self, pieces: pa.Array, word: pa.Array) -> pa.Array:
        """Of which pieces the marks after the word can be tokenized by themselves."""
        letters = pc.utf8_is_alpha(word)
        last = pc.if_else(pc.or_(pc.string_is_ascii(word), pc.equal(word, pieces)), "", pc.utf8_slice_codeunits(word, -1))
        sticky = [c for c in pc.unique(last.filter(letters)).to_pylist() if c and self._sticks(c)]
        return pc.and_not(letters, pc.is_in(last, pa.array(sticky, last.type))) if sticky else letters

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) one after another, and each text's number of them."""
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        if len(self._known) > KEPT_PIECES:
            self._forget()
        # a distinct piece is one key, or a key of letters (less capitals, where these are ASCII) and one of the marks after them
        pieces = coded.dictionary
        word = pc.utf8_rtrim(pieces, MARKS)
        letters = self._apart(pieces, word)
        word = pc.if_else(letters, pc.if_else(pc.string_is_ascii(word), pc.ascii_lower(word), word), pieces)
        marked = pc.and_(letters, pc.not_equal(pc.binary_length(word), pc.binary_length(pieces)))
        ends = pc.replace_substring_regex(pieces.filter(marked), r"(?s)^.*?([.,!?]*)$", r"\1")
        marks = pc.replace_with_mask(pa.repeat(pa.scalar("", pa.large_string()), len(pieces)), marked, ends)
        parts = []
        for keys in (word.dictionary_encode(), marks.dictionary_encode()):
            names = keys.dictionary
            at = pc.fill_null(pc.index_in(names, self._known), -1).to_numpy().astype(np.int64)
            fresh = np.flatnonzero(at < 0)
            if len(fresh):
                some = names.take(pa.array(fresh))
                self._learn(some.to_pylist(), pc.utf8_is_alpha(some).to_pylist())
                new, self._fresh = pa.concat_arrays(self._fresh), []
                at[fresh] = len(self._known) + pc.index_in(some, new).to_numpy()
                self._known = pa.concat_arrays([self._known, new])
            parts.append(at[keys.indices.to_numpy()])
        store, begins, ends = (np.concatenate(x) for x in (self._ids, self._begins, self._ends))
        self._ids, self._begins, self._ends = [store], [begins], [ends]
        # ids of the distinct pieces one after another, and then those of all pieces
        flat, lengths = _gathered(store, begins, ends - begins, np.stack(parts, 1).ravel())
        lengths = lengths.reshape(-1, 2).sum(1)
        out, lengths = _gathered(flat, np.cumsum(lengths) - lengths, lengths, coded.indices.to_numpy())
        at = np.asarray(split.offsets)
        return out, np.diff(np.r_[0, np.cumsum(lengths)][at - at[0]])


#: A worker's pieces by tokenizer: its next task goes on with what is known.
_OF_WORKER: dict[str, Pieces] = {}
_idle: list[threading.Timer] = []
#: Seconds without a task after which a worker lets go of its pieces, for other stages use the same workers.
IDLE_S = 2


def pieces_of_worker(path: str) -> Pieces:
    while _idle:
        _idle.pop().cancel()
    if path not in _OF_WORKER:
        _OF_WORKER[path] = Pieces(path)
    return _OF_WORKER[path]


def _let_go() -> None:
    _OF_WORKER.clear()
    storage.release()


def task_done() -> None:
    timer = threading.Timer(IDLE_S, _let_go)
    timer.daemon = True
    timer.start()
    _idle.append(timer)


def _gathered(store: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `store` numbered in `which`, one after another, and their lengths."""
    kind = np.int32 if len(store) < 2**31 else np.int64
    lengths, begins = lengths.astype(kind)[which], begins.astype(kind)[which]
    sums = np.cumsum(lengths)
    total = int(sums[-1]) if len(sums) else 0
    if total >= 2**31 and kind is np.int32:
        return _gathered(store, begins.astype(np.int64), lengths.astype(np.int64), np.arange(len(which)))
    at = np.repeat(begins - (sums - lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return store[at], lengths


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts (null as empty) of a batch, some MB at a time."""
    texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + SLICE_BYTES, "right")))
        yield batch.column("doc_id").slice(row, end - row).to_pylist(), texts.slice(row, end - row)
        row = end


def tokenized(docs: DataFrame, tokenizer: str, counted: str, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, ids, n) of documents in ascending order, ids as little-endian 16-bit (32-bit for a vocabulary beyond) integers with the end id.

    How often each id occurs in a range goes to a file of the folder `counted`.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part = pieces_of_worker(tokenizer), TaskContext.get().partitionId()
        kind = "<u2" if pieces.size <= 1 << 16 else "<u4"
        total = np.zeros(pieces.size, np.int64)
        for batch in batches:
            for names, texts in _texts(batch):
                ids, counts = pieces.ids(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
                total += np.bincount(ids, minlength=pieces.size)
                counts = counts + 1
                ends = np.cumsum(counts)
                blobs = [ids[b:e].tobytes() for b, e in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(blobs, pa.binary()), pa.array(counts, pa.int64())], names=["part", "doc_id", "ids", "n"])
        storage.put_file(f"{counted}/{part}.counts", zlib.compress(total.tobytes(), 1))
        storage.release()
        task_done()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows with the same id and text are equal; a range boundary between rows of one id would do no harm either
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(scan, "part int, doc_id long, ids binary, n long")


def _unpacked(ids: list[bytes], n: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), "<u2" if sum(map(len, ids)) == 2 * sum(n) else "<u4")


def count_ids(spark: SparkSession, counted: str, size: int) -> np.ndarray:
    """How often each id occurs, from the ranges' files: each task sums its share of them."""
    names = [name for name, _ in storage.list_files(counted, ".counts")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for name in batch.column("uri").to_pylist():
                counts += np.frombuffer(zlib.decompress(storage.get_file(name)), np.int64)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    if names:
        listed = spark.createDataFrame([(n,) for n in names], "uri string").repartition(min(len(names), 32))
        for row in listed.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many rows as the vocabulary has ids
            counts[row.id] = row.n
    return counts


class _Writer:
    """Blocks of documents, each written as soon as it is full."""

    def __init__(self, coder: Coder, out: pa.NativeFile) -> None:
        self._coder, self._out, self._size = coder, out, 0
        packed = zlib.compress(coder.lengths.astype(np.uint8).tobytes())
        self._write(MAGIC + struct.pack("<III", VERSION, len(coder.lengths), len(packed)) + packed)
        self._footer: list[tuple[int, int, int]] = []
        self._docs: list[tuple] = []
        self._ids: list[np.ndarray] = []
        self._count = 0

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self._size += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id, len(ids)))
        self._ids.append(ids)
        self._count += len(ids)
        if self._count >= BLOCK_IDS:
            self.close_block()

    def close_block(self) -> None:
        if not self._docs:
            return
        ids = np.concatenate(self._ids)
        stream, checkpoints = self._coder.encode(ids)
        names = np.array([d or 0 for d, _ in self._docs], np.int64).tobytes() + np.array([d is None for d, _ in self._docs], np.uint8).tobytes()
        table = zlib.compress(names + np.array([n for _, n in self._docs], np.uint64).tobytes())
        block = struct.pack("<IQQI", len(self._docs), len(ids), len(stream), len(table)) + table + checkpoints.tobytes() + stream
        self._footer.append((self._size, len(self._docs), len(ids)))
        self._write(block)
        self._docs, self._ids, self._count = [], [], 0

    def finish(self) -> None:
        self.close_block()
        self._write(np.array(self._footer, np.uint64).tobytes() + struct.pack("<I", len(self._footer)) + END_MAGIC)


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes all rows (doc_id, text; null text is empty) to files in a folder."""
    spark = docs.sparkSession
    counted = storage.new_dir(spark, "counts")
    _, kept = storage.written(tokenized(docs, tokenizer, counted, end_id), "ids")
    storage.tidy(spark)  # the sorted texts' shuffle files are not needed any more
    lengths = code_lengths(count_ids(spark, counted, Pieces(tokenizer).size))
    storage.remove(counted)

    # one task reads each file of the table, whole and in order: a range was written as one file
    names = [name for name, _ in storage.list_files(kept, ".parquet")]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        coder = Coder(lengths)
        for name in (n for batch in batches for n in batch.column("uri").to_pylist()):
            fs, path = pafs.FileSystem.from_uri(name)
            with fs.open_input_file(path) as source:
                table = pq.ParquetFile(source)
                part = next((b.column("part")[0].as_py() for b in table.iter_batches(1, columns=["part"])), None)
                if part is None:
                    continue
                with storage.new_file(f"{uri}/part-{part:06d}.tokens") as out:
                    writer = _Writer(coder, out)
                    for some in table.iter_batches(200, columns=["doc_id", "ids", "n"]):
                        counts = some.column("n").to_pylist()
                        ids = _unpacked(some.column("ids").to_pylist(), counts)
                        for doc_id, n, end in zip(some.column("doc_id").to_pylist(), counts, np.cumsum(counts), strict=True):
                            writer.add(doc_id, ids[end - n : end])
                    writer.finish()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])
        storage.release()

    if names:
        listed = spark.createDataFrame(list(enumerate(names)), "number int, uri string").repartitionById(len(names), "number")
        parts = [r.part for r in listed.mapInArrow(load, "part int").collect()]
        if len(parts) != len(set(parts)):
            raise RuntimeError("a range of documents was written as several files")
    storage.remove(kept)


def footer(uri: str) -> list[tuple[int, int, int]]:
    """(file offset, documents, ids) of a file's blocks, without reading the blocks."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        size = source.size()
        tail = source.read_at(8, size - 8)
        if tail[4:] != END_MAGIC:
            raise ValueError(f"{uri} is cut short")
        n = struct.unpack("<I", tail[:4])[0]
        return [tuple(int(x) for x in r) for r in np.frombuffer(source.read_at(24 * n, size - 8 - 24 * n), np.uint64).reshape(-1, 3)]


def blocks(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block of a file: document ids, null marks, numbers of ids, and all ids."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    index = footer(uri)
    with fs.open_input_file(path) as source:
        head = source.read_at(16, 0)
        version, vocabulary, packed = struct.unpack("<III", head[4:])
        if head[:4] != MAGIC or version != VERSION:
            raise ValueError(f"{uri} has another format")
        coder = Coder(np.frombuffer(zlib.decompress(source.read_at(packed, 16)), np.uint8))
        for at, n_docs, n_ids in index:
            _, _, n_bytes, n_table = struct.unpack("<IQQI", source.read_at(24, at))
            table = zlib.decompress(source.read_at(n_table, at + 24))
            at += 24 + n_table
            lanes = -(-n_ids // LANE)
            checkpoints = np.frombuffer(source.read_at(8 * lanes, at), np.uint64)
            ids = coder.decode(source.read_at(n_bytes, at + 8 * lanes), checkpoints, n_ids)
            yield np.frombuffer(table, np.int64, n_docs), np.frombuffer(table, np.uint8, n_docs, 8 * n_docs), np.frombuffer(table, np.uint64, n_docs, 9 * n_docs), ids


def read(spark: SparkSession, uri: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of a folder.

    start counts the ids of all documents before it; ids_crc32 is of its ids as little-endian 32-bit integers.
    """
    files = storage.list_files(uri, ".tokens")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("uri").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array([sum(b[2] for b in footer(n)) for n in names], pa.int64())], names=["uri", "ids"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(n,) for n, _ in files], "uri string").repartition(min(len(files), 64))
    sizes = dict(listed.mapInArrow(summary, "uri string, ids long").collect())  # one row a file
    start, plan = 0, []
    for name, _ in files:
        plan.append((len(plan), name, start))
        start += sizes[name]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for doc_ids, nulls, counts, ids in blocks(name):
                    ends = np.cumsum(counts.astype(np.int64))
                    begins = ends - counts.astype(np.int64)
                    crcs = [zlib.crc32(ids[b:e].astype("<u4").tobytes()) for b, e in zip(begins, ends, strict=True)]
                    columns = [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(at + begins), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
                    at += len(ids)

    return spark.createDataFrame(plan, "number int, uri string, start long").repartitionById(len(plan), "number").mapInArrow(load, schema)
