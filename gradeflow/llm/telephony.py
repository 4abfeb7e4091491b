"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded in numpy and stored as resampled PCM.

A media value is a RIFF/WAVE file with one channel: format 7 (mu-law) or 6 (A-law) of 8-bit samples, or 17 (IMA ADPCM)
in blocks of BLOCK bytes: the first sample as 16 bits, the step's number, a zero, and then two samples a byte, low half first.

* mu-law and A-law bytes are expanded by a table of 256 values.
* ADPCM blocks do not depend on each other. Samples within a block do, so the decoder goes through the places in a block
  and at each place advances all blocks of all files at hand at once.
* Decoded samples are brought to another rate by a windowed-sinc polyphase filter in integers, so that a file's samples do
  not depend on what stands beside it. All files at hand lie in one array with silence between them.

`stored` keeps bytes as media: a text's UTF-8, with bytes of 0 up to a positive multiple of BLOCK, is taken as the samples (or
blocks) of a file, losslessly, in a code that follows from its content; `decoded` reads media back. Null and empty texts are
one block of zeros. Equal texts give equal media, whatever their ids; rows with null or repeated ids are stored each by itself.
Extra columns are ignored, and an empty table gives an empty one. Media that is null, damaged or in another code gives
null samples and its reason in `problem`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import storage

RATE, TARGET = 8000, 1000
#: Bytes of an ADPCM block: 4 of its head and two samples a byte.
BLOCK, HEAD = 64, 4
SAMPLES = 1 + 2 * (BLOCK - HEAD)
#: Files of about so many bytes are decoded at once (a longer one is decoded by itself).
HELD = 2 << 20
#: Blocks and outputs of the filter computed at once.
_BLOCKS, _OUTPUTS = 1 << 13, 1 << 16
#: Zero crossings of the filter on either side, and the bits of its weights.
WIDTH, BITS = 6, 14
#: Equal parts of a file whose loudness is a feature.
PARTS = 8

# Format numbers of WAVE files.
MULAW, ALAW, ADPCM = 7, 6, 17
CODES = {MULAW: "mu-law", ALAW: "A-law", ADPCM: "IMA ADPCM"}

# Step sizes of IMA ADPCM and how far a code moves in them.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """Samples of all mu-law bytes: sign, a 3-bit exponent and 4 bits, all inverted, about a bias of 132."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Samples of all A-law bytes: sign, a 3-bit exponent and 4 bits, every other bit inverted."""
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(power == 0, low + 8, (low + 264) << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_LAWS = {MULAW: mulaw_table(), ALAW: alaw_table()}


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * number of the step + code: what is added to the sample, and 16 times the next step's number."""
    step, code = np.array(STEPS)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (16 * after).astype(np.int32).ravel()


_ADDED, _NEXT = _steps()


def adpcm_samples(data: np.ndarray) -> np.ndarray:
    """All samples of whole blocks of bytes, one row a block; a step's number beyond the last is the last."""
    blocks = data.reshape(-1, BLOCK)
    out = np.empty((len(blocks), SAMPLES), np.int16)
    for at in range(0, len(blocks), _BLOCKS):
        some = blocks[at : at + _BLOCKS]
        sample = np.ascontiguousarray(some[:, :2]).view("<i2")[:, 0].astype(np.int32)
        state = 16 * np.minimum(some[:, 2], len(STEPS) - 1).astype(np.int32)
        codes = np.ascontiguousarray(some[:, HEAD:].T)
        found = np.empty((SAMPLES, len(some)), np.int16)
        found[0] = sample
        for k in range(SAMPLES - 1):
            key = state + (codes[k // 2] >> 4 if k % 2 else codes[k // 2] & 15)
            sample = np.clip(sample + _ADDED[key], -32768, 32767)
            state = _NEXT[key]
            found[k + 1] = sample
        out[at : at + len(some)] = found.T
    return out


def filters(up: int, down: int) -> list[tuple[int, np.ndarray]]:
    """Of each of `up` phases of the outputs, the first input and the weights of this one and those after it.

    Output up * q + r is the sum of weights over inputs from down * q + first on; each phase's weights sum to 2**BITS.
    """
    wide, cut = WIDTH * max(up, down), 1 / max(up, down)
    out = []
    for r in range(up):
        first, last = -((wide - r * down) // up), (r * down + wide) // up
        t = r * down - np.arange(first, last + 1) * up
        weight = np.sinc(t * cut) * np.cos(np.pi * t / (2 * wide + 2)) ** 2
        weight = np.rint(weight / weight.sum() * 2**BITS).astype(np.int32)
        weight[np.argmax(weight)] += 2**BITS - int(weight.sum())
        out.append((first, weight))
    return out


def resampled(signals: list[np.ndarray], rate: int, target: int) -> list[np.ndarray]:
    """Each signal at another rate; a signal of n samples has ceil(n * target / rate) then."""
    if rate == target or not signals:
        return signals
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    phases = filters(up, down)
    before = max(0, *(-f for f, _ in phases))
    gap = max(0, *(f + len(w) for f, w in phases)) + before
    lengths = [down * -(-(len(s) + gap) // down) for s in signals]  # each begins at a multiple of down
    begins = np.cumsum([0, *lengths])
    x = np.zeros(before + int(begins[-1]) + gap + down * 2, np.int16)
    for begin, s in zip(begins, signals):
        x[before + begin : before + begin + len(s)] = s
    n = int(begins[-1]) // down
    out = np.empty(n * up, np.int16)
    for q in range(0, n, _OUTPUTS):
        size = min(_OUTPUTS, n - q)
        for r, (first, weights) in enumerate(phases):
            total = np.full(size, 1 << BITS - 1, np.int32)
            for k, w in enumerate(weights.tolist()):
                at = before + q * down + first + k
                if w:
                    total += x[at : at + size * down : down] * np.int32(w)
            out[q * up + r : (q + size) * up : up] = np.clip(total >> BITS, -32768, 32767)
    return [out[b * up // down : b * up // down - (-len(s) * up // down)] for b, s in zip(begins.tolist(), signals)]


def features(pcm: np.ndarray) -> str:
    """Samples, peak, changes of sign, and the root mean square of each of PARTS equal parts, all whole numbers."""
    wide = pcm.astype(np.int64)
    loud = [int(np.sqrt(float((p * p).sum()) / len(p))) if len(p) else 0 for p in (wide[len(wide) * k // PARTS : len(wide) * (k + 1) // PARTS] for k in range(PARTS))]
    return f"{len(wide)};{int(np.abs(wide).max(initial=0))};{int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))};{','.join(map(str, loud))}"


def wave(code: int, payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of one channel; the payload is its samples' bytes, or its blocks."""
    if code == ADPCM:
        samples = len(payload) // BLOCK * SAMPLES
        form = struct.pack("<HHIIHHHH", code, 1, rate, rate * BLOCK // SAMPLES, BLOCK, 4, 2, SAMPLES)
    else:
        samples, form = len(payload), struct.pack("<HHIIHHH", code, 1, rate, rate, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + len(payload) + len(payload) % 2) + b"WAVE" + chunks + payload + b"\0" * (len(payload) % 2)


def parsed(media: bytes) -> tuple[int, int, memoryview]:
    """(format, rate, payload) of a WAVE file."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if at + 8 + size > len(view):
            raise ValueError("cut short")
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            if form is None or form[0] not in CODES or form[1] != 1 or form[4] != (BLOCK if form[0] == ADPCM else 1) or size % form[4]:
                raise ValueError("another code")
            return form[0], form[2], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def code_of(payload: bytes) -> int:
    """One of the codes, by the content."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def padded(text: bytes) -> bytes:
    return text + b"\0" * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Rows of about HELD bytes."""
    sums, row = np.cumsum(sizes), 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(sums, (sums[row - 1] if row else 0) + HELD, "right")))
        yield slice(row, end)
        row = end


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text (doc_id, text) as a WAVE file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for some in _slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                held = [t or b"" for t in texts[some].to_pylist()]
                payloads = [padded(t) for t in held]
                media = [wave(code_of(p), p) for p in payloads]
                yield pa.RecordBatch.from_arrays([ids[some], pa.array(list(map(len, held)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return known.mapInArrow(scan, "doc_id long, n_bytes long, media binary")


def samples(files: list[tuple[int, memoryview]]) -> list[np.ndarray]:
    """All samples of files (format, payload); ADPCM blocks of all files are decoded together."""
    blocks = [np.frombuffer(p, np.uint8) for f, p in files if f == ADPCM]
    decoded = adpcm_samples(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for form, payload in files:
        if form == ADPCM:
            n = len(payload) // BLOCK
            out.append(decoded[at : at + n].ravel())
            at += n
        else:
            out.append(_LAWS[form][np.frombuffer(payload, np.uint8)])
    return out


_DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, code string, rate int, pcm binary, problem string"


def decoded(media: DataFrame, target: int = TARGET) -> DataFrame:
    """The rows' other columns, and of each file (column media): lengths and hashes of its payload and of itself, features, the code, and its
    samples at the target rate as little-endian 16-bit integers."""
    others = [c for c in media.columns if c != "media"]
    schema = ", ".join([f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others] + [_DECODED])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _DECODED.split(", ")
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
        for batch in batches:
            column = batch.column("media")
            for some in _slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)):
                rows, files, places = [], [], []
                for i, held in enumerate(column[some].to_pylist()):
                    row = dict.fromkeys(f.split()[0] for f in fields)
                    rows.append(row)
                    try:
                        form, rate, payload = parsed(held or b"")
                    except ValueError as problem:
                        row["problem"] = str(problem)
                        continue
                    row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(held), "media_sha256": hashlib.sha256(held).hexdigest(), "code": CODES[form], "rate": target}
                    files.append((form, payload))
                    places.append((rate, i))
                signals = samples(files)
                for rate in sorted({r for r, _ in places}):
                    which = [k for k, (r, _) in enumerate(places) if r == rate]
                    for k, pcm in zip(which, resampled([signals[k] for k in which], rate, target), strict=True):
                        rows[places[k][1]] |= {"feature": features(pcm), "pcm": pcm.astype("<i2").tobytes()}
                made = [pa.array([r[f.split()[0]] for r in rows], kinds[f.split()[1]]) for f in fields]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[some] for c in others), *made], names=[*others, *(f.split()[0] for f in fields)])
        storage.release()

    return media.mapInArrow(scan, schema)


def round_trip(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """Every text stored as media, read back and decoded; (doc_id, n_bytes) and the columns of `decoded` but pcm, which stays in the shared folder's table."""
    spark = docs.sparkSession
    media, uri = storage.written(stored(docs), "media")
    storage.until_exit(uri)
    sound, sound_uri = storage.written(decoded(media, target), "pcm")
    storage.until_exit(sound_uri)
    return sound.drop("pcm", "problem")
