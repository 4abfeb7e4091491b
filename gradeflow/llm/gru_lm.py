"""Scores of a gated recurrent language model, beside those of an add-one unigram model.

Tokens are the words of a text, A-Z lower-cased, and one end. Counts of all training tokens over the whole
corpus come from `vertical.partition_totals`, which brings each input partition the counts of its own words.

The recurrent model. A gated recurrent unit reads the tokens of a document in order; its state predicts the
next token in two factors. First the class: the FREQUENT most frequent words are cut into classes by
frequency, the others fall into classes by their last two bytes, and the end is a class of its own. Then the
word in its class: a softmax over the class's frequent words that depends on the state; for other words the
add-one share of their count among the class's. The probabilities of all words sum to 1, with one word that
was never seen in each class of rare words.

Training is truncated back-propagation in numpy, over windows of STEPS tokens with the state carried from
window to window. Documents stand one after the other in BATCH lanes of about equal length, the state 0 where one begins;
those of more than LONG tokens are cut into sequences. It is distributed: the training documents are dealt by hash to ROUNDS rounds, each document to one;
in each round every input partition trains from the same weights on its own documents of the round, and the
results are averaged by tokens trained, slice by slice, on the executors. Every training document is trained
once. Biases start from the corpus counts.

Scoring carries the state through the complete document, however long: many documents advance in step, the
longest last.

Null and empty texts are one end token. Rows with equal or null ids are counted, trained and scored each by itself; a null
`held_out` is held out; other columns are ignored. No rows give no rows. The sums are in double precision; weights are single.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import storage, textscan, vertical

HIDDEN = 16
FREQUENT = 2048
FREQUENT_CLASSES = 32
RARE_CLASSES = 48
STEPS = 32
ROUNDS = 2
#: Lanes of documents that a training step advances at once.
BATCH = 128
RATE = 0.01
#: Tokens that a task gathers before it runs their documents side by side.
POOL_TOKENS = 1_500_000
#: Documents of more tokens train as several sequences, each from state 0; in scoring they are gathered by themselves.
LONG = 2048
SLICES = 16
#: Tokens whose class probabilities are computed at once: what fits a core's cache.
BLOCK = 2048
#: Bound of the output weights. The state lies in -1..1, so logits stay within HIDDEN * LIMIT of their biases.
LIMIT = np.float32(4)
_U = np.uint64
_CLASS_MASK = _U(0xFF)
#: The end token's key: its class is beyond those of words.
END_KEY = _U((0x0123456789ABCDEF & ~0xFF) | RARE_CLASSES)
_LAST = np.random.default_rng(11).integers(0, 2**31, (2, 256), dtype=np.int64)
_LAST[:, ord("A") : ord("Z") + 1] = _LAST[:, ord("a") : ord("z") + 1]


def token_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """56 bits of a word's hash and, in the low 8, the class it has if it is rare."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    last = _LAST[0][data[ends - 1]]
    before = np.where(ends - starts > 1, _LAST[1][data[np.maximum(ends - 2, 0)]], 0)
    kind = ((last ^ before) % RARE_CLASSES).astype(np.uint64)
    return (textscan.word_hashes(data, starts, ends) & ~_CLASS_MASK) | kind


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, keys of words, where each row's begin) of pieces of a column."""
    for row, end, data, offsets in textscan.chunks(column):
        starts, ends, begins = textscan.word_bounds(data, offsets)
        yield row, end, token_keys(data, starts, ends), begins


@dataclass(frozen=True)
class Vocabulary:
    """Corpus counts, and the classes of tokens. Class numbers: frequent ones, then rare ones, then the end."""

    keys: np.ndarray  # of frequent words, sorted
    klass: np.ndarray  # of each frequent word
    place: np.ndarray  # of each in its class
    counts: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: np.ndarray  # by rare class, without frequent words
    rare_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return FREQUENT_CLASSES + RARE_CLASSES + 1

    @property
    def starts(self) -> np.ndarray:
        """Where each frequent class's words begin among the columns of the second factor."""
        return np.r_[0, np.cumsum(np.bincount(self.klass, minlength=FREQUENT_CLASSES))]

    def index(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens: input row, class, and place in a frequent class (-1 for others). Inputs: frequent words, rare classes, end."""
        n = len(self.keys)
        rare = (keys & _CLASS_MASK).astype(np.int32)
        if not n:
            return rare, rare + FREQUENT_CLASSES, np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), n - 1).astype(np.int32)
        known = self.keys[at] == keys
        return np.where(known, at, n + rare), np.where(known, self.klass[at], FREQUENT_CLASSES + rare).astype(np.int32), np.where(known, self.place[at], -1).astype(np.int32)


def _stats(keys: np.ndarray, totals: np.ndarray) -> bytes:
    """A fragment's sums, and its most frequent words: several times its share of the FREQUENT of the whole corpus."""
    seen = totals > 0
    keys, totals = keys[seen], totals[seen]
    kind = (keys & _CLASS_MASK).astype(np.int64)
    top = np.argsort(-totals.astype(np.int64), kind="stable")[:FREQUENT]
    out = io.BytesIO()
    np.savez(out, tokens=np.bincount(kind, totals.astype(np.float64), RARE_CLASSES + 1), distinct=np.bincount(kind, minlength=RARE_CLASSES + 1), keys=keys[top], counts=totals[top])
    return out.getvalue()


def vocabulary(stats: list[bytes]) -> Vocabulary:
    parts = [np.load(io.BytesIO(s)) for s in stats]
    zero = np.zeros(RARE_CLASSES + 1)
    tokens, distinct = (sum((p[n] for p in parts), zero).astype(np.int64) for n in ("tokens", "distinct"))
    keys = np.concatenate([p["keys"] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p["counts"] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    words = keys != END_KEY
    keys, counts = keys[words], counts[words]
    top = np.lexsort((keys, -counts))[:FREQUENT]
    top = top[counts[top] > 1]
    keys, counts = keys[top], counts[top]
    # classes by frequency: about equal sums of square roots
    mass = np.cumsum(np.sqrt(counts))
    klass = np.minimum((mass - np.sqrt(counts)) / max(mass[-1], 1e-9) * FREQUENT_CLASSES, FREQUENT_CLASSES - 1).astype(np.int32) if len(keys) else np.zeros(0, np.int32)
    place = (np.arange(len(keys)) - np.searchsorted(klass, klass)).astype(np.int32)
    kind = (keys & _CLASS_MASK).astype(np.int64)
    order = np.argsort(keys)
    rare_tokens = tokens[:RARE_CLASSES] - np.bincount(kind, counts, RARE_CLASSES + 1)[:RARE_CLASSES].astype(np.int64)
    rare_distinct = distinct[:RARE_CLASSES] - np.bincount(kind, minlength=RARE_CLASSES + 1)[:RARE_CLASSES]
    return Vocabulary(keys[order], klass[order], place[order], counts[order], int(tokens.sum()), int(distinct.sum()), rare_tokens, rare_distinct)


def initial(v: Vocabulary) -> dict[str, np.ndarray]:
    """Weights before training: the state does nothing, the biases are the corpus's shares."""
    rng = np.random.default_rng(5)
    ends = max(0, v.tokens - int(v.counts.sum()) - int(v.rare_tokens.sum()))
    sums = np.concatenate([np.bincount(v.klass, v.counts, FREQUENT_CLASSES), v.rare_tokens + v.rare_distinct, [ends]]) + 1.0
    inner = np.zeros(len(v.keys))
    inner[v.starts[v.klass] + v.place] = np.log(v.counts)
    h, rows = HIDDEN, len(v.keys) + RARE_CLASSES + 1
    out = {
        "x": rng.normal(0, 0.3, (3 * h, rows)), "u": rng.normal(0, 1 / np.sqrt(h), (3 * h, h)),
        "c": np.zeros((v.classes, h)), "cb": np.log(sums / sums.sum()),
        "w": np.zeros((len(v.keys), h)), "wb": inner,
    }
    return {k: a.astype(np.float32) for k, a in out.items()}


def _advance(p: dict, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(new state, gates z and r, candidate, recurrent part of the candidate); a column an item, x the tokens' inputs."""
    h = HIDDEN
    g = p["u"] @ state
    zr = x[: 2 * h] + g[: 2 * h]
    np.negative(zr, out=zr)
    with np.errstate(over="ignore"):  # a gate is 0 there
        np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    gn = g[2 * h :]
    n = zr[h:] * gn
    n += x[2 * h :]
    np.tanh(n, out=n)
    new = state - n
    new *= zr[:h]
    new += n
    return new, zr, n, gn


def _by_class(v: Vocabulary, klass: np.ndarray, place: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The output rows of each frequent class that is met, and where it is."""
    frequent = np.flatnonzero(place >= 0)
    order = frequent[np.argsort(klass[frequent].astype(np.uint8), kind="stable")]
    cuts, starts = np.searchsorted(klass[order], np.arange(FREQUENT_CLASSES + 1)), v.starts
    for c in range(FREQUENT_CLASSES):
        if cuts[c] < cuts[c + 1]:
            yield slice(starts[c], starts[c + 1]), order[cuts[c] : cuts[c + 1]]


def _exp_logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of the logits, a column an item; the logits wanted). LIMIT keeps the logits where exp is finite."""
    logits = weights @ states
    logits += bias[:, None]
    chosen = logits[wanted, np.arange(len(wanted))]
    return np.exp(logits, out=logits), chosen


def log_probs(p: dict, v: Vocabulary, states: np.ndarray, klass: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Natural log of P(class) and, of frequent words, P(word | class), given the states before them (a column each)."""
    out = np.empty(len(klass), states.dtype)
    for at in range(0, len(klass), BLOCK):
        part = slice(at, at + BLOCK)
        exps, chosen = _exp_logits(states[:, part], p["c"], p["cb"], klass[part])
        out[part] = chosen - np.log(exps.sum(0))
    for rows, at in _by_class(v, klass, place):
        exps, chosen = _exp_logits(states[:, at], p["w"][rows], p["wb"][rows], place[at])
        out[at] += chosen - np.log(exps.sum(0))
    return out


def _gradients(p: dict, v: Vocabulary, state: np.ndarray, rows: np.ndarray, klass: np.ndarray, place: np.ndarray, real: np.ndarray, fresh: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the mean log probability of a window (steps x lanes), through the window's steps; and the state after it.

    A lane holds documents one after the other; where one begins (fresh) the state is 0.
    """
    (steps, lanes), h = rows.shape, HIDDEN
    kept, before, whole = [], [], bool(real.all())
    inputs = np.take(p["x"], rows.ravel(), axis=1, mode="clip")
    old, begins_at = ~fresh, fresh.any(1)
    for t in range(steps):
        if begins_at[t]:
            state = state * old[t]
        before.append(state)
        new, zr, n, gn = _advance(p, state, inputs[:, t * lanes : (t + 1) * lanes])
        kept.append((zr, n, gn))
        state = new if whole else np.where(real[t], new, state)
    flat = np.concatenate(before, 1)
    k, pl, ok = klass.ravel(), place.ravel(), real.ravel()
    scale = state.dtype.type(1 / max(1, ok.sum()))
    dc, _ = _exp_logits(flat, p["c"], p["cb"], k)
    dc *= (np.where(ok, -scale, 0) / dc.sum(0)).astype(state.dtype)
    dc[k, np.arange(len(k))] += np.where(ok, scale, 0)
    g = {"c": dc @ flat.T, "cb": dc.sum(1), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
    back = p["c"].T @ dc
    for out, at in _by_class(v, k, np.where(ok, pl, -1)):
        some = flat[:, at]
        d, _ = _exp_logits(some, p["w"][out], p["wb"][out], pl[at])
        d *= -scale / d.sum(0)
        d[pl[at], np.arange(len(at))] += scale
        g["w"][out], g["wb"][out] = d @ some.T, d.sum(1)
        back[:, at] += p["w"][out].T @ d
    dstate = np.zeros((h, lanes), state.dtype)
    dx, du, back_through = np.empty((3 * h, len(k)), state.dtype), np.zeros_like(p["u"]), np.ascontiguousarray(p["u"].T)
    for t in range(steps - 1, -1, -1):
        (zr, n, gn), prior = kept[t], before[t]
        z, r = zr[:h], zr[h:]
        d = dstate if whole else np.where(real[t], dstate, 0)
        dz = d * z
        dn = d - dz
        dn *= 1 - n * n
        dg = np.empty((3 * h, lanes), state.dtype)
        np.multiply(dn, r, out=dg[2 * h :])
        np.multiply(dg[2 * h :], gn, out=dg[h : 2 * h])
        dg[h : 2 * h] *= 1 - r
        np.subtract(prior, n, out=dg[:h])
        dg[:h] *= dz
        dg[:h] *= 1 - z
        own = slice(t * lanes, (t + 1) * lanes)
        dx[: 2 * h, own], dx[2 * h :, own] = dg[: 2 * h], dn
        du += dg @ prior.T
        through = back_through @ dg
        through += dz
        dstate = (through if whole else np.where(real[t], through, dstate)) + back[:, own]
        if begins_at[t]:
            dstate *= old[t]
    g["u"] = du
    order = np.argsort(rows.ravel().astype(np.uint16), kind="stable")  # a radix sort
    sorted_rows = rows.ravel()[order]
    begins = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
    g["x"] = np.zeros_like(p["x"])
    g["x"][:, sorted_rows[begins]] = np.add.reduceat(np.take(dx, order, axis=1, mode="clip"), begins, axis=1)
    return g, state


def _in_lanes(lengths: np.ndarray, lanes: int, seed: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, the longest lane first; in a lane they stand in random order."""
    loads, held = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        load, lane = loads[0]
        held[lane].append(int(i))
        heapq.heapreplace(loads, (load + int(lengths[i]), lane))
    rng = np.random.default_rng(seed)
    return [rng.permutation(held[lane]).tolist() for _, lane in sorted(loads, key=lambda x: -x[0])]


def _windows(v: Vocabulary, docs: list[np.ndarray], seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, class, place, real, fresh), steps x lanes, of successive windows over whole documents in lanes."""
    lengths = np.array([len(d) for d in docs])
    begins = np.r_[0, np.cumsum(lengths)]
    lanes = _in_lanes(lengths, min(BATCH, len(docs)), seed)
    loads = np.array([lengths[lane].sum() for lane in lanes])
    at, fresh = np.full((loads[0], len(lanes)), begins[-1]), np.zeros((loads[0], len(lanes)), bool)
    for i, lane in enumerate(lanes):
        at[: loads[i], i] = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in lane])
        fresh[np.r_[0, np.cumsum(lengths[lane])[:-1]], i] = True
    index = [np.append(a, 0) for a in v.index(np.concatenate(docs))]
    for t in range(0, int(loads[0]), STEPS):
        n = int(np.searchsorted(-loads, -t))  # lanes that go on
        window = at[t : t + STEPS, :n]
        yield *(a[window] for a in index), window < begins[-1], fresh[t : t + STEPS, :n]


def _pools(docs: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents, the longer ones cut into sequences of at most LONG tokens, in lists of about POOL_TOKENS."""
    pool, size = [], 0
    for doc in docs:
        pool += np.split(doc, range(LONG, len(doc), LONG))
        size += len(doc)
        if size >= POOL_TOKENS:
            yield pool
            pool, size = [], 0
    if pool:
        yield pool


def train_documents(p: dict, v: Vocabulary, docs: Iterator[np.ndarray], rate: float = RATE) -> tuple[dict, int]:
    """Adam over windows of STEPS tokens of BATCH lanes of whole documents; (weights, tokens trained)."""
    p = {k: a.copy() for k, a in p.items()}
    first, second = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    tokens, step = 0, 0
    for number, pool in enumerate(_pools(docs)):
        state = np.zeros((HIDDEN, BATCH), np.float32)
        for window in _windows(v, pool, number):
            grads, state = _gradients(p, v, state[:, : window[0].shape[1]], *window)
            step += 1
            norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
            for k, g in grads.items():
                g *= np.float32(min(1, 1 / (norm + 1e-9)))
                first[k] *= np.float32(0.9)
                first[k] += np.float32(0.1) * g
                second[k] *= np.float32(0.99)
                g *= g
                g *= np.float32(0.01)
                second[k] += g
                np.multiply(second[k], np.float32(1 / (1 - 0.99**step)), out=g)
                np.sqrt(g, out=g)
                g += np.float32(1e-6)
                np.divide(first[k], g, out=g)
                g *= np.float32(rate / (1 - 0.9**step))
                p[k] += g
            for k in ("c", "w"):
                np.clip(p[k], -LIMIT, LIMIT, out=p[k])
            tokens += int(window[3].sum())
    return p, tokens


def _pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpack(values: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def in_round(turn: int, rounds: int = ROUNDS) -> Column:
    """Whether a row is trained in a round; each row is in exactly one."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights from all documents (doc_id, text, held_out) that are not held out."""
    spark = docs.sparkSession
    p = initial(v)
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((p, v))  # bounded by FREQUENT and HIDDEN: under 1 MB

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, words = held.value

            def each() -> Iterator[np.ndarray]:
                for batch in batches:
                    for row, end, keys, begins in _tokens(batch.column("text")):
                        for i in range(end - row):
                            yield np.append(keys[begins[i] : begins[i + 1]], END_KEY)

            trained, tokens = train_documents(weights, words, each())
            if tokens:
                parts = np.array_split(_pack(trained).astype(np.float64) * tokens, SLICES)
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([tokens] * SLICES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "tokens", "sums"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            tokens: dict[int, int] = {}
            for batch in batches:
                for i, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sums[i] = sums.get(i, 0) + np.frombuffer(x)
                    tokens[i] = tokens.get(i, 0) + n
            for i in sums:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([tokens[i]], pa.int64()), pa.array([sums[i].tobytes()], pa.binary())], names=["slice", "tokens", "sums"])

        schema = "slice int, tokens long, sums binary"
        some = docs.where(~F.col("held_out") & in_round(turn, rounds)).select("text")
        got = some.mapInArrow(fit, schema).repartitionById(SLICES, "slice").mapInArrow(average, schema).collect()  # SLICES rows
        if got:
            p = _unpack(np.concatenate([np.frombuffer(r.sums) / r.tokens for r in sorted(got, key=lambda r: r.slice)]), p)
        held.destroy()
    return p


def score_pool(p: dict, v: Vocabulary, keys: np.ndarray, begins: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """log10 probabilities of whole documents, run in step. rare: natural log of each rare word's share of its class."""
    starts, lengths = begins, np.diff(begins)
    order = np.argsort(-lengths, kind="stable")
    lengths, begins = lengths[order], begins[:-1][order]
    rows, klass, place = v.index(keys)
    out = np.bincount(np.repeat(np.arange(len(order)), np.diff(starts)), rare, len(order))[order]
    state = np.zeros((HIDDEN, len(order)), np.float32)
    going = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")  # documents that have a token t
    for at in range(0, len(going), STEPS):
        active = int(going[at])
        state = state[:, :active]
        states, tokens = [], []
        for n in going[at : at + STEPS].tolist():
            token = begins[:n] + at + len(tokens)
            prior = state[:, :n]
            states.append(prior)
            tokens.append(token)
            new = _advance(p, prior, np.take(p["x"], rows[token], axis=1, mode="clip"))[0]
            state = new if n == state.shape[1] else np.concatenate([new, state[:, n:]], 1)
        token = np.concatenate(tokens)
        logs = log_probs(p, v, np.concatenate(states, 1), klass[token], place[token])
        out[:active] += np.bincount(np.concatenate([np.arange(len(x)) for x in tokens]), logs, active)
    result = np.zeros(len(order))
    result[order] = out / np.log(10)
    return result


def score(docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row (doc_id, text).

    held_out is a boolean column expression; rows where it is true (or null) are not learnt from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))

    def extract(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        learn = ~np.asarray(batch.column("held_out"))
        yield np.array([END_KEY]), np.array([learn.sum()], np.uint64)
        for row, end, keys, begins in _tokens(batch.column("text")):
            yield vertical.summed(keys, np.repeat(learn[row:end].astype(np.uint64), np.diff(begins)))

    totals = vertical.partition_totals(docs, extract, "words", stats=_stats)
    v = vocabulary(totals.stats)
    held = docs.sparkSession.sparkContext.broadcast((train(docs, v), v))
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, words = held.value
        known, sums, expected = totals.of_partition()
        check = vertical.Checksum()
        room = np.log(words.rare_tokens + words.rare_distinct + 1.0)
        whole = np.log10(words.tokens + words.distinct + 1.0)
        pools: dict[bool, list[tuple]] = {False: [], True: []}  # long documents wait for others to advance with
        sizes = {False: 0, True: 0}

        def flush(pool: list[tuple]) -> pa.RecordBatch:
            ids = pa.concat_arrays([x for x, *_ in pool])
            out = np.concatenate([x for _, x, *_ in pool])
            keys = np.concatenate([x for _, _, x, _ in pool])
            lengths = np.concatenate([x for *_, x in pool])
            begins = np.r_[0, np.cumsum(lengths)]
            count = vertical.lookup(known, sums, keys).astype(np.float64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            base = np.bincount(row, np.log10(count + 1) - whole, len(lengths))
            n_known = np.bincount(row, count > 0, len(lengths)).astype(np.int64)
            _, klass, place = words.index(keys)
            rare = (place < 0) & (klass < FREQUENT_CLASSES + RARE_CLASSES)
            inner = np.where(rare, np.log(count + 1) - room[np.where(rare, klass - FREQUENT_CLASSES, 0)], 0.0)
            scores = score_pool(p, words, keys, begins, inner)
            n = len(lengths)
            return pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(lengths.astype(np.int64)), pa.array(n_known), pa.array(np.full(n, words.tokens)), pa.array(base), pa.array(scores)], names=[c.split()[0] for c in fields.split(", ")])

        for batch in batches:
            check.add(batch)
            out = np.asarray(batch.column("held_out"))
            for row, end, keys, begins in _tokens(batch.column("text")):
                lengths = np.diff(begins) + 1
                keys = np.insert(keys, begins[1:], END_KEY)
                for long, kind in ((x, lengths > LONG if x else lengths <= LONG) for x in (False, True)):
                    if kind.any():
                        pools[long].append((batch.column("doc_id").slice(row, end - row).filter(pa.array(kind)), out[row:end][kind], keys[np.repeat(kind, lengths)], lengths[kind]))
                        sizes[long] += int(lengths[kind].sum())
                    if sizes[long] >= POOL_TOKENS:
                        yield flush(pools[long])
                        pools[long], sizes[long] = [], 0
        for pool in pools.values():
            if pool:
                yield flush(pool)
        vertical.verify(check, expected)

    out = storage.checkpointed(docs.mapInArrow(run, fields))  # a few numbers a document
    totals.remove()
    return out
