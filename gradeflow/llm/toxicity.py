"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability, logistic in the words it holds; a document is
toxic unless all its sentences are clean: 1 - product(1 - p), the noisy-or. Only documents have labels; the
weights are trained on those by gradient descent through the noisy-or, which gives the blame to the sentences
that best explain it. The same weights then score every sentence, and so locate the offending ones.

Words are maximal runs of ASCII letters (lower-cased) and bytes of other scripts; they and their first few
bytes (for inflected and compound forms) are hashed to 2**BITS weights. Sentences end at . ! ? or a line break. The model is fitted on at most MAX_LABELLED labelled
documents, those with the least hash of the id; with fewer, on all. One task holds their hashed words and trains;
the driver gets the weights only.

Null and empty texts have no sentence; they score the share of label 1 among such documents in training, or
the overall share where training had none. Rows without a usable label (null, or several labels for an id that
disagree) do not train. Rows with the same id or text are scored each by itself, and all rows of a labelled id train.
Columns of other names pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import storage, textscan

BITS = 20
#: Lengths in bytes of the beginnings of words that are features too.
STEMS = (4, 5)
MAX_LABELLED = 8_000
THRESHOLD = 0.3
#: Documents with at least this score are rejected by the pipeline: those that the operator calls toxic.
REJECT = THRESHOLD
PASSES = 120
RATE, DECAY = 0.05, 3e-4
_APART = np.ones(256, bool)
_APART[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def _sentences(column: pa.Array) -> Iterator[tuple]:
    """Of pieces of a column: first row, end row, bytes, offsets of texts, starts and ends of words, hashed features, the sentence of each feature and of each word, and the row of each sentence."""
    for row, end, data, offsets in textscan.chunks(column):
        starts, ends, begins = textscan.word_bounds(data, offsets, _APART)
        long = [np.flatnonzero(ends - starts > n) for n in STEMS]
        hashes = [textscan.word_hashes(data, starts, ends), *(textscan.word_hashes(data, starts[at], starts[at] + n) + np.uint64(n) for at, n in zip(long, STEMS, strict=True))]
        doc = np.repeat(np.arange(end - row), np.diff(begins))
        stops = np.cumsum(_STOP[data])[starts] if len(starts) else np.zeros(0, np.int64)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
        sentence = np.cumsum(fresh) - 1
        features = np.concatenate([textscan.mix(h) >> np.uint64(64 - BITS) for h in hashes]).astype(np.int64)
        yield row, end, data, offsets, starts, ends, features, np.concatenate([sentence, *(sentence[at] for at in long)]), sentence, doc[np.flatnonzero(fresh)]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    empty: float

    def sentence_scores(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(sentence, self.weights[words], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def document_scores(self, scores: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        clean = np.bincount(row, np.log1p(-np.minimum(scores, 1 - 1e-12)), n)
        return np.where(np.bincount(row, minlength=n) > 0, -np.expm1(clean), self.empty)


def fit(bags: list[list[np.ndarray]], labels: np.ndarray, passes: int = PASSES, rate: float = RATE, decay: float = DECAY) -> Model:
    """Trains on bags of sentences (arrays of hashed words) by Adam on whole passes. The list of bags is emptied."""
    share = float(labels.mean()) if len(labels) else 0.0
    has = np.array([len(b) > 0 for b in bags], bool)
    empty = float(labels[~has].mean()) if (~has).any() else share
    weights, bias = np.zeros(1 << BITS), -4.0
    if not has.any() or share in (0.0, 1.0):
        return Model(weights, float(np.log((share + 1e-3) / (1 - share + 1e-3))), empty)
    # only features of several documents can be told from chance
    documents = np.zeros(1 << BITS, np.int32)
    for bag in bags:
        if bag:
            documents[np.unique(np.concatenate(bag))] += 1
    often = documents >= 3
    sentences = [s[often[s]] for b in bags for s in b]
    words = np.concatenate(sentences).astype(np.int32)
    sentence = np.repeat(np.arange(len(sentences), dtype=np.int32), [len(s) for s in sentences])
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    n, m = len(bags), len(sentences)
    bags.clear()  # the driver holds each feature once
    del sentences
    cuts = np.searchsorted(sentence, np.linspace(0, m, 17).astype(np.int32))  # what a pass computes is for a piece at a time
    pieces = [(words[a:b], sentence[a:b]) for a, b in zip(cuts, cuts[1:])]
    first, second = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    y = labels.astype(float)
    for step in range(1, passes + 1):
        z = sum(np.bincount(s, weights[w], m) for w, s in pieces) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        pull = np.where(y == 1, (1 - toxic) / toxic, -1.0)[row] * p  # of the log likelihood by z
        grad = np.r_[sum(np.bincount(w, pull[s], 1 << BITS) for w, s in pieces), pull.sum()] / n
        grad[:-1] -= decay * weights
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        weights += move[:-1]
        bias += move[-1]
    return Model(weights, float(bias), empty)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, passes: int = PASSES) -> Model:
    """Fits a model on documents (doc_id, text) that labels (doc_id, toxic) mark; rows that should not train are left out by the caller."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high")
    # ids alone are sampled first, so that the texts of no more than the sample are moved
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "doc_id")
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # a documented bound
    if not chosen:
        return fit([], np.zeros(0))
    wanted = {r.doc_id: r.toxic for r in chosen}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, _, _, _, _, words, sentence, _, rows in _sentences(batch.column("text")):
                keys = np.unique(sentence << BITS | words)  # words of a sentence count once
                sentence, words = keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32)
                cuts = np.searchsorted(rows[sentence], np.arange(end - row + 1))
                out = [(words[a:b].tobytes(), (sentence[a:b] - sentence[a] if b > a else sentence[:0]).astype(np.int32).tobytes()) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array([w for w, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], names=["doc_id", "words", "sentences"])
        storage.release()

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((i, w, n) for batch in batches for i, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        bags, marks = [], np.array([wanted[i] for i, _, _ in held])
        for k, (_, w, n) in enumerate(held):
            words, sentence = np.frombuffer(w, np.int32), np.frombuffer(n, np.int32)
            bags.append(np.split(words, np.flatnonzero(np.diff(sentence)) + 1) if len(words) else [])
            held[k] = None
        if bags:
            model = fit(bags, marks, passes)
            storage.release()
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([model.bias]), pa.array([model.empty])], names=["weights", "bias", "empty"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in wanted], "doc_id long"))  # `most` rows; other texts never leave the JVM
    features = texts.join(sample, "doc_id", "left_semi").mapInArrow(hashed, "doc_id long, words binary, sentences binary")
    found = features.repartitionById(1, F.lit(0)).mapInArrow(trained, "weights binary, bias double, empty double").collect()  # at most one row
    if not found:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(found[0].weights, np.float32), found[0].bias, found[0].empty)


def _distinct_words(words: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(sentence << BITS | words)
    return keys & ((1 << BITS) - 1), keys >> BITS


def score(docs: DataFrame, model: Model, worst: bool = False, name: str = "score") -> DataFrame:
    """All columns of docs, and `name` (0 to 1); with `worst` also what locates the sentence most to blame, the first among equals.

    worst_sentence is its text, worst_score its score, worst_start and worst_end the bytes of the text's UTF-8 from its first
    word to its last (null without a sentence). Columns of docs with one of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights: 8 MB, however many documents
    extra = [f"`{name}` double", *["worst_sentence string", "worst_score double", "worst_start long", "worst_end long"] * worst]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for row, end, data, offsets, starts, ends, words, sentence, of_word, rows in _sentences(batch.column("text")):
                n = len(rows)
                words_once, sentence_once = _distinct_words(words, sentence)
                each = own.sentence_scores(words_once, sentence_once, n)
                out = [*batch.slice(row, end - row).columns, pa.array(own.document_scores(each, rows, end - row))]
                if worst:
                    order = np.lexsort((np.arange(n)[::-1], each, rows))  # last of a row: the highest score, the first among equals
                    last = order[np.flatnonzero(np.r_[rows[order][1:] != rows[order][:-1], n > 0])] if n else order
                    begin, stop = np.searchsorted(of_word, last), np.searchsorted(of_word, last, "right")
                    texts = [None] * (end - row)
                    scores, froms, tos = ([None] * (end - row) for _ in range(3))
                    for s, b, e in zip(last, begin, stop, strict=True):
                        texts[rows[s]] = data[starts[b] : ends[e - 1]].tobytes().decode("utf-8", "replace")
                        scores[rows[s]], froms[rows[s]], tos[rows[s]] = float(each[s]), starts[b] - offsets[rows[s]], ends[e - 1] - offsets[rows[s]]
                    out += [pa.array(texts, pa.string()), pa.array(scores, pa.float64()), pa.array(froms, pa.int64()), pa.array(tos, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=names)
        storage.release()  # the same workers serve the stages after this one

    kept = docs.drop(*(c.split()[0].strip("`") for c in extra))
    kept = kept.withColumn("text", F.col("text").cast("string"))
    names = [*kept.columns, *(c.split()[0].strip("`") for c in extra)]
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields), *extra])
    return kept.mapInArrow(scan, schema)


def crc_of_id(doc_id: str = "doc_id"):
    """crc32 of an id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
