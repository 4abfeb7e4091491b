"""Fill-in-middle, telephony audio and centroid clustering against brute force."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("gradeflow.llm")
from gradeflow.llm import centroids, fim, queries, telephony  # noqa: E402
from oracle import connect, difference  # noqa: E402

TEXTS = [
    (1, "a plain text of some words"), (1, "a plain text of some words"), (2, None), (3, ""), (4, "holds <S> inside"), (5, "x"), (6, "\U0001f600é́\r\n  ü\U0001f600"), (None, "no id here, and more"),
    (7, "line one\nline two\n\nlast. Really? Yes! 12 3a"), (8, "<P"), (9, "ends in <"), (10, "ab\U0001f600" * 50_000), (11, "y" * fim.BLOCK), (12, "z" * (2 * fim.BLOCK + 1)), (13, "q" * 64), (14, "r" * 65),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n": F.lit("clash"), "form": F.lit(1), "media": F.lit(0), "first": F.lit(None).cast("string")})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def brute_fim(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'null' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b, c = text[:low], text[low:high], text[high:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, low, high - low, sha(f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"), sha(text)


def test_fill_in_middle(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for table, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (texts, TEXTS)):
        got = sorted(map(tuple, fim.digests(table).collect()), key=repr)
        assert got == sorted((brute_fim(*r) for r in rows), key=repr)
    assert {r.form for r in fim.digests(docs).collect()} == {"plain", "psm", "spm"}
    assert fim.digests(texts.limit(0)).collect() == []
    assert difference(queries.op12_fill_in_middle(spark, sf_dir), queries.oracle_sql()["op12_fill_in_middle"], connect(sf_dir)) is None


def kind(c):
    return "blank" if c.isspace() else "letter" if c.isalpha() or "̀" <= c <= "ͯ" else "digit" if c.isdecimal() else c


CUTS = {
    "character": lambda a, b: True,
    "word": lambda a, b: a.isspace() and not b.isspace(),
    "token": lambda a, b: kind(a) != kind(b) or len(kind(a)) == 1,
    "line": lambda a, b: a == "\n",
    "sentence": lambda a, b: a in ".!?" and b.isspace() or a == "\n" and not b.isspace(),
}


@pytest.mark.parametrize("grammar", fim.GRAMMARS)
def test_units_of_grammars(spark, grammar):
    rows = ["a plain  text, of 12 words", "one\ntwo. Three?\n\nfour!! 3a4", "\U0001f600\U0001f600 é", "x", "..", "no end"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for r in fim.transformed(table, grammar, plain=0).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        places = [i for i in range(1, len(r.text)) if CUTS[grammar](r.text[i - 1], r.text[i])]
        assert r.n == len(places) + 1 and r.back == r.text == r.prefix + r.middle + r.suffix
        assert {len(r.prefix), len(r.prefix + r.middle)} <= {0, len(r.text), *places}


def test_other_sentinels_and_shares(spark):
    marks = fim.Sentinels("|pre|", "(suf)", "[mid]")
    table = spark.createDataFrame([(i, f"text number {i} <P>") for i in range(50)] + [(99, "holds (suf)")], "doc_id long, text string")
    rows = fim.transformed(table, plain=0, spm=100, sentinels=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text and r.form == ("plain" if r.doc_id == 99 else "spm") and (r.form == "plain" or r.output.startswith("(suf)")) for r in rows)


def scalar_law(code, form):
    if form == telephony.MULAW:
        code = ~code & 255
        size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) * 4 - 132
        return -size if code & 128 else size
    code ^= 0x55
    power = code >> 4 & 7
    size = 16 * (code & 15) + 8 if not power else (16 * (code & 15) + 264) * 2 ** (power - 1)
    return size if code & 128 else -size


def scalar_adpcm(block):
    value, at = struct.unpack("<hB", block[:3])
    at, out = min(at, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = telephony.STEPS[at]
            size = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                size += part if code & bit else 0
            value = max(-32768, min(32767, value + (-size if code & 8 else size)))
            at = max(0, min(88, at + telephony.MOVES[code & 7]))
            out.append(value)
    return out


def test_tables_of_the_laws():
    for form, table in ((telephony.MULAW, telephony.mulaw_table()), (telephony.ALAW, telephony.alaw_table())):
        assert table.tolist() == [scalar_law(c, form) for c in range(256)]
        assert sorted(-table.astype(int)) == sorted(table.astype(int))
    assert telephony.mulaw_table()[[0, 0x80, 0xFF]].tolist() == [-32124, 32124, 0] and telephony.alaw_table()[[0x55, 0xD5, 0xAA]].tolist() == [-8, 8, 32256]
    assert telephony.STEPS == sorted(telephony.STEPS) and len(telephony.STEPS) == 89


def test_blocks_of_adpcm():
    data = np.random.default_rng(4).integers(0, 256, 64 * 300, dtype=np.uint8)
    assert telephony.adpcm_samples(data).tolist() == [scalar_adpcm(data[i : i + 64].tobytes()) for i in range(0, len(data), 64)]


def test_adpcm_follows_a_tone():
    """Codes chosen sample by sample bring a tone back nearly as it was."""
    tone = [int(8000 * math.sin(i / 9)) for i in range(telephony.SAMPLES)]
    value, at, codes = tone[0], 40, []
    for want in tone[1:]:
        moved = [max(-32768, min(32767, value + int(telephony._ADDED[16 * at + c]))) for c in range(16)]
        codes.append(min(range(16), key=lambda c: abs(moved[c] - want)))
        value, at = moved[codes[-1]], int(telephony._NEXT[16 * at + codes[-1]]) // 16
    block = struct.pack("<hBB", tone[0], 40, 0) + bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2]))
    assert max(abs(a - b) for a, b in zip(telephony.adpcm_samples(np.frombuffer(block, np.uint8))[0].tolist()[8:], tone[8:])) < 600


@pytest.mark.parametrize("rates", [(8000, 1000), (8000, 16000), (8000, 6000), (8000, 8000), (11025, 8000)])
def test_resampling(rates):
    rate, target = rates
    up, down = target // math.gcd(*rates), rate // math.gcd(*rates)
    rng = np.random.default_rng(5)
    signals = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (1, 0, 700, 2, 64)]
    got = telephony.resampled(signals, rate, target)
    for s, g in zip(signals, got):
        assert len(g) == -(-len(s) * up // down)
        if rate != target:
            for k in range(len(g)):
                first, weights = telephony.filters(up, down)[k % up]
                total = sum(int(w) * int(s[j]) for j, w in enumerate(weights, k // up * down + first) if 0 <= j < len(s))
                assert g[k] == max(-32768, min(32767, (total + 2**13) >> 14))
        assert (telephony.resampled([s], rate, target)[0] == g).all()  # alone or beside others
    tone = (10_000 * np.sin(np.arange(4000) * 2 * np.pi * 200 / rate)).astype(np.int16)
    back = telephony.resampled([tone], rate, target)[0]
    assert np.abs(back - 10_000 * np.sin(np.arange(len(back)) * 2 * np.pi * 200 / target))[60:-60].max() < 60


def test_files_that_are_none():
    for media in (b"", b"RIFF", telephony.wave(telephony.MULAW, b"abcd")[:-1], telephony.wave(telephony.ADPCM, b"x" * 63), telephony.wave(telephony.MULAW, b"ab").replace(b"\x07\0\x01\0", b"\x01\0\x01\0")):
        with pytest.raises(ValueError):
            telephony.parsed(media)
    odd = telephony.wave(telephony.ALAW, b"abc", 11025)
    assert len(odd) % 2 == 0 and (telephony.parsed(odd)[:2], bytes(telephony.parsed(odd)[2])) == ((telephony.ALAW, 11025), b"abc")
    listed = odd[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + odd[12:]
    assert bytes(telephony.parsed(listed)[2]) == b"abc"


def brute_sound(text, target=telephony.TARGET):
    data = (text or "").encode()
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    code = telephony.code_of(payload)
    wave = [x for i in range(0, len(payload), 64) for x in scalar_adpcm(payload[i : i + 64])] if code == telephony.ADPCM else [scalar_law(c, code) for c in payload]
    media = telephony.wave(code, payload)
    pcm = telephony.resampled([np.array(wave, np.int16)], 8000, target)[0]
    return len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), telephony.features(pcm)


def test_telephony(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    few = texts.where("doc_id IS NULL OR doc_id NOT IN (10, 11, 12)")
    for table in (docs, few):
        got = sorted(((r.doc_id, *r[1:8]) for r in telephony.round_trip(table).collect()), key=repr)
        assert got == sorted(((r.doc_id, *brute_sound(r.text)) for r in table.collect()), key=repr)
    assert telephony.round_trip(texts.limit(0)).collect() == []
    assert {r.code for r in telephony.round_trip(docs).collect()} == set(telephony.CODES.values())


def test_telephony_of_long_texts(spark):
    text = "many words in a very long text " * 200_000
    got = telephony.round_trip(spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string")).collect()
    payload = telephony.padded(text.encode())
    assert {(r.payload_sha256, r.media_sha256, r.feature) for r in got if r.doc_id != 2} == {(sha(payload), sha(telephony.wave(telephony.code_of(payload), payload)), next(r.feature for r in got if r.doc_id == 1))}


def test_samples_of_any_media(spark):
    rows = [(1, bytearray(telephony.wave(telephony.ALAW, bytes(range(256)) * 2, 16_000))), (2, None), (3, bytearray(b"none")), (4, bytearray(telephony.wave(telephony.ADPCM, bytes(64))))]
    got = {r.id: r for r in telephony.decoded(spark.createDataFrame(rows, "id int, media binary"), 8000).collect()}
    expected = telephony.resampled([np.array([scalar_law(c, telephony.ALAW) for c in [*range(256)] * 2], np.int16)], 16_000, 8000)[0]
    assert np.frombuffer(got[1].pcm, "<i2").tolist() == expected.tolist() and got[1].problem is None
    assert got[2].pcm is None and got[3].problem == "not a WAVE file" and len(got[4].pcm) == 2 * telephony.SAMPLES


def brute_clusters(rows, clusters=40, rounds=5, dimensions=64):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    means = [v for _, v in sorted(rows, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        held = [[] for _ in means]
        for _, v in rows:
            held[near(v)[1]].append(v)
        means = [[sum(x) // len(h) for x in zip(*h)] if h else m for h, m in zip(held, means)]
    found = [(i, *near(v)) for i, v in rows]
    total, by, most = sum(d for _, d, _ in found), {}, 2**63 - 1
    for _, d, c in found:
        by[c] = by.get(c, 0) + d
    return sorted(((i, c, min(d, most), min(by[c], most), min(total, most), sha(",".join(map(str, means[c])))) for i, d, c in found), key=repr)


def clustered(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>" if not how.pop("double", False) else "vec_id long, embedding array<double>")
    table = table.withColumns({"cluster": F.lit("clash"), "x": F.lit(1), "label": F.lit(None).cast("int")}).repartition(3)
    return sorted(map(tuple, centroids.cluster(table, **how).collect()), key=repr)


def test_clusters(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_centroids(spark, sf_dir).collect()), key=repr) == brute_clusters(rows)
    assert difference(queries.op13_centroids(spark, sf_dir), queries.oracle_sql()["op13_centroids"], connect(sf_dir)) is None


def test_clusters_of_ties_repeats_and_gaps(spark):
    rng = np.random.default_rng(9)
    whole = [(i % 50, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    odd = [(1, None), (2, [1.0, 2.0]), (3, [1.0, None, 0.0, 0.0]), (4, [1.0, float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, -0.001, 0.0, 1.0]), (None, [0.5, -0.001, 0.0, 1.0])]
    how = {"clusters": 12, "rounds": 4, "dimensions": 4}
    assert clustered(spark, whole + odd, **how) == brute_clusters(whole + odd, **how)
    few = whole[:5] + whole[:5]
    assert clustered(spark, few, **how) == brute_clusters(few, **how)
    assert clustered(spark, odd[:5], **how) == [] and clustered(spark, [], **how) == []


def test_clusters_of_huge_components(spark):
    rng = np.random.default_rng(10)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 20)).tolist()) for i in range(60)]
    how = {"clusters": 7, "rounds": 3, "dimensions": 4}
    assert clustered(spark, rows, double=True, **how) == brute_clusters(rows, **how)


def test_rounds_compare_what_changed_only(monkeypatch):
    """Unmoved owners meet changed centroids alone, and the answer is that of a comparison with all."""
    rng = np.random.default_rng(11)
    x, table = rng.integers(-50, 50, (500, 8)).astype(float), rng.integers(-50, 50, (9, 8)).tolist()
    every = np.arange(9, dtype=np.int32)
    owners, distances = centroids._compared(x, np.full(500, -1, np.int32), np.zeros(500), table, every)
    table[3], table[7] = [v + 5 for v in table[3]], [0] * 8
    seen, plain = [], centroids._distances
    monkeypatch.setattr(centroids, "_distances", lambda a, b: seen.append((len(a), len(b))) or plain(a, b))
    got = centroids._compared(x, owners, distances, table, np.array([3, 7], np.int32))
    moved = int(np.isin(owners, [3, 7]).sum())
    assert seen == [(moved, 9), (500 - moved, 2)]
    want = centroids._compared(x, np.full(500, -1, np.int32), np.zeros(500), table, every)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
