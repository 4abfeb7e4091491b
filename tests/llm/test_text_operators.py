"""Operators on documents against brute force, on a small table of awkward rows and on the smallest test table."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("gradeflow.llm")
from gradeflow.llm import components, decontam, gru_lm, huffman, licenses, mixing, ngram_join, queries, rows, storage, textscan, tokenbin, toxicity, vertical, winnow  # noqa: E402

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    (1, WORDS, "a", 1), (2, WORDS, "a", 1), (2, WORDS, "a", 1), (3, WORDS.upper() + " extra", "b", 1), (4, None, None, 0), (5, "", "b", 0),
    (6, " \n\t ", "a", 0), (7, "one two", None, 0), (8, "ONE\ttwo", "c", 0), (None, "null id text here", "c", 0), (9, "é " * 3000 + "x", "a", 2),
    (10, WORDS.replace("word30", "other"), "c", 3), (11, "\u2003\U0001f600 astral", "b", 0), (12, "Released under the MIT License.\nAll rights reserved.", "b", 0),
]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, source string, score int").withColumns({"n": F.lit("clash"), "size": F.lit(7), "rid": F.lit(0)})


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(table):
    sets = [shingle_set(t) for _, t in table]
    held, parent = defaultdict(list), list(range(len(table)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(table):
        least[root(i)] = min((x for x in (d, least.get(root(i))) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(table)), key=repr)


def test_ngram_groups(documents, awkward, empty):
    table = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, ngram_join.similarity_groups(documents).collect()), key=repr) == brute_groups(table)
    assert sorted(map(tuple, ngram_join.similarity_groups(awkward).collect()), key=repr) == brute_groups([(r[0], r[1]) for r in AWKWARD])
    assert ngram_join.similarity_groups(empty).collect() == []


def test_representatives_stand_for_each_group_once(awkward):
    kept = rows.take(awkward, ngram_join.representatives(awkward))
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 7, 9, 11, 12, None], key=str)


def test_near_copies_form_one_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    table = []
    for i in range(300):
        copy = list(base)
        for at in rng.integers(0, 200, 2):
            copy[at] = f"e{rng.integers(10**6)}"
        table.append((i, " ".join(copy)))
    got = ngram_join.similarity_groups(spark.createDataFrame(table, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(table)


def test_queries_of_groups_remove_their_shuffle_files(spark, documents, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, during, linked = spark.conf.get(name, None), [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda *a: during.append(spark.conf.get(name, None)) or linked(*a))
    ngram_join.similarity_groups(documents)
    assert during and set(during) == {"true"}
    assert spark.conf.get(name, None) == before


def test_no_shuffle_left(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    with storage.no_shuffle_left(spark):
        spark.range(10_000).groupBy(F.col("id") % 1000).count().write.parquet(f"{tmp_path}/written")
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - before


def test_sets_of_few_pairs_are_not_dealt_with_otherwise_than_those_of_many(spark):
    parts = {f"part{k}": F.array(F.lit(1)) for k in range(ngram_join.FRAGMENTS)}
    texts = spark.range(4).withColumnRenamed("id", "rid").withColumns({k: v.cast("array<long>") for k, v in parts.items()})
    pairs = spark.createDataFrame([(0, 1, 4, 4)], "a long, b long, na long, nb long")
    linked = ngram_join._linked(pairs, texts, 75)
    assert linked.collect() == [(0, 1, 4, 4)]
    assert "BroadcastHashJoin" not in linked._jdf.queryExecution().toString()


def test_bit_maps_bound_the_overlap(spark):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 400, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 30, 200, 350, 350)]
    frame = spark.createDataFrame([(i, j, ngram_join.bit_map(a).tolist(), ngram_join.bit_map(b).tolist()) for i, a in enumerate(sets) for j, b in enumerate(sets)], "i int, j int, a array<long>, b array<long>")
    for r in frame.select("i", "j", ngram_join._only(F.col("a"), F.col("b")).alias("only")).collect():
        alone = len(np.setdiff1d(sets[r.i], sets[r.j]))
        assert r.only <= alone and (r.i != r.j or r.only == 0) and (alone < 100 or r.only > alone // 3)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (None, 1), (3, 30), (30, 31)], "a long, b long")
    assert {r.node: r.component for r in components.components(links, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 30: 1, 31: 1, 7: 7, 8: 7, 9: 7}


def check_mix(docs, table):
    got = mixing.mix(docs).collect()
    assert len(got) == len(table)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    sizes = defaultdict(int)
    for _, t, s in table:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    aims = mixing.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])
    assert math.isclose(sum(aims), sum(sizes.values())) and all(a <= 3 * sizes[s] + 1e-6 for s, a in zip(order, aims))
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r.times * r.size <= 3 * r.size and r.source_size == sizes[r.source] and math.isclose(r.target, aims[order.index(r.source)])
        taken[r.source] += r.taken
    return {s: (taken[s], a) for s, a in zip(order, aims)}


def test_mix(documents, awkward, empty):
    table = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    assert all(abs(t - a) <= max(40, 0.01 * a) for t, a in check_mix(documents, table).values())
    check_mix(awkward, [(r[0], r[1], r[2]) for r in AWKWARD])
    assert mixing.mix(empty).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_fit_meets_budgets(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 900, 60))
    counts = rng.integers(1, 9, len(lengths))
    for share in (0, 0.1, 0.5, 0.99, 1):
        budget = int((lengths * counts).sum() * share)
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs((lengths * take).sum() - budget) <= 5


def test_targets_reshare_what_is_cut_off():
    assert mixing.targets([100, 1000], [3, 1]) == [300.0, 800.0]
    assert mixing.targets([0, 10], [1, 2]) == [0.0, 10.0]


def test_fit_of_few_and_of_long_documents():
    one = lambda n, budget: int(mixing.fit(np.array([n]), np.array([1]), budget)[0])
    assert (one(3000, 2400), one(3000, 1400), one(10_000, 9900), one(10_000, 100)) == (1, 0, 1, 0)
    assert mixing.fit(np.array([20_000]), np.array([10]), 119_000).tolist() == [6]
    assert mixing.fit(np.array([5500, 6000, 7000]), np.ones(3, int), 11_500).tolist() == [1, 1, 0]
    rng = np.random.default_rng(2)
    for _ in range(100):
        lengths = np.sort(rng.choice(np.arange(1, 20_000), rng.integers(1, 7), replace=False))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        missing = budget - int((lengths * take).sum())
        more, less = lengths[take < counts], lengths[take > 0]
        assert all(abs(missing) <= abs(missing - a + b) for a in [0, *more] for b in [0, *less])


def test_fit_of_long_documents_and_of_few_is_exact():
    rng = np.random.default_rng(12)
    for _ in range(12):
        lengths = np.unique(rng.integers(5000, 60_000, 120))
        counts = rng.integers(1, 3, len(lengths))
        for share in (0.1, 0.3, 0.7):
            budget = int((lengths * counts).sum() * share)
            assert abs(int((lengths * mixing.fit(lengths, counts, budget)).sum()) - budget) <= 3
    for _ in range(100):
        lengths = np.unique(rng.integers(1, 9000, rng.integers(1, 7)))
        counts = rng.integers(1, 3, len(lengths))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, max(sums) + 1))
        got = int((lengths * mixing.fit(lengths, counts, budget)).sum())
        assert abs(got - budget) == min(abs(s - budget) for s in sums)


def test_fit_of_few_documents_of_any_length_is_exact():
    rng = np.random.default_rng(13)
    cases = [(np.array([2313, 3116, 11482, 12990, 15861, 16030, 19855]), np.array([1, 2, 2, 1, 2, 1, 1]), 103_121)]
    for _ in range(150):
        lengths = np.unique(rng.integers(1, 20_000, rng.integers(1, 10)))
        counts = rng.integers(1, 4, len(lengths))
        cases.append((lengths, counts, int(rng.integers(0, (lengths * counts).sum() + 1))))
    for lengths, counts, budget in cases:
        sums = np.zeros(int((lengths * counts).sum()) + 1, bool)
        sums[0] = True
        for n in np.repeat(lengths, counts).tolist():
            sums[n:] |= sums[:-n].copy()
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((lengths * take).sum()) - budget) == np.abs(np.flatnonzero(sums) - budget).min()


def test_fit_of_huge_documents_is_bounded(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_CELLS", 1 << 12)
    rng = np.random.default_rng(14)
    lengths = np.unique(rng.integers(1, 3_000_000, 40))
    counts = rng.integers(1, 4, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    take = mixing.fit(lengths, counts, budget)
    assert (take <= counts).all() and abs(int((lengths * take).sum()) - budget) < 20_000


def brute_winnow(text, k=winnow.K, window=winnow.WINDOW):
    hashes = [int(x) for x in winnow.gram_hashes(winnow.code_points(text), k)]
    width = min(window, len(hashes))
    kept = []
    for i in range(len(hashes) - width + 1 if hashes else 0):
        least = min(hashes[i : i + width])
        at = max(j for j in range(i, i + width) if hashes[j] == least)
        if not kept or kept[-1] != (least, at):
            kept.append((least, at))
    return kept


def test_winnow_against_definition():
    for text in ["", "a", "a" * 300, WORDS, "é\U0001f600" * 70, "abc" * 5]:
        got = winnow.winnow(winnow.code_points(text))
        assert list(zip(got[0].tolist(), got[1].tolist())) == brute_winnow(text)
    points = winnow.code_points(WORDS)
    grams = {WORDS[i : i + 16] for i in range(len(WORDS) - 15)}
    assert len(set(winnow.gram_hashes(points).tolist())) == len(grams)


def test_winnow_guarantee():
    shared = "the passage that both texts hold, longer than a window and a gram together, is found in every case, wherever it stands"[: winnow.WINDOW + winnow.K - 1]
    a, b = (winnow.winnow(winnow.code_points(x + shared + y))[0] for x, y in (("left " * 9, " right" * 9), ("other", "end")))
    assert set(a.tolist()) & set(b.tolist())


def brute_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_compare_with_next(table, request):
    docs = request.getfixturevalue(table)
    source = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = winnow.compare_with_next(docs.repartition(5)).collect()
    assert len(got) == len(source)
    if table == "awkward":  # the rows that repeat an id are equal, so any order of theirs is the same
        assert {r.doc_id for r in got} == {d for d, _ in source}
    order = sorted(source, key=lambda x: (x[0] is None, -(x[0] or 0)))
    expected = {}
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]]):
        new = winnow.edited(t, following)
        kept, changed, after = brute_winnow(t), brute_winnow(new), brute_winnow(following)
        prints = ["".join(f"{h:08x}" for h, _ in x) for x in (kept, changed)]
        expected.setdefault(d, set()).add((len(t), hashlib.sha256(new.encode()).hexdigest(), *prints, brute_likeness(kept, changed), brute_likeness(kept, after), tuple(at for _, at in kept)))
    assert all((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, tuple(r.positions)) in expected[r.doc_id] for r in got)


def test_short_texts_share_a_hash_with_their_edited_text(documents):
    got = [r for r in winnow.compare_with_next(documents).collect() if 36 <= r.n_chars < 150]
    assert got and all(r.near_edited > 0 for r in got)


def test_winnow_of_nothing(empty, spark):
    assert winnow.compare_with_next(empty).collect() == []
    assert winnow.compare_with_next(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).first().near_next == 1.0


def test_licenses_wrapped_near_tied_and_long(spark):
    mit = licenses.TEMPLATES["MIT permission"].split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    docs = [(1, " ".join(f"before{i}" for i in range(99)) + f"\n\n{wrapped}\n \t\nand after it\nmore"), (2, licenses.TEMPLATES["MPL-2.0"].replace("Public", "Other")), (3, "all RIGHTS reserved"), (3, "all rights reserved"), (4, " ".join(f"w{i}" for i in range(50_000))), (5, None), (6, "All rights reserved. " * 30)]
    got = {(r.doc_id, r.line): (r.license, round(r.dice, 3)) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    grams = [set(licenses.template_bigrams(t)) for t in (docs[1][1], licenses.TEMPLATES["MPL-2.0"])]
    near = 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1]))
    assert got == {(1, -2): ("MIT permission", 1.0), (2, 1): ("MPL-2.0", round(near, 3)), (3, 1): ("reserved", 1.0), (6, 1): ("reserved", 0.8)}


def test_licenses(awkward, empty):
    assert {(r.doc_id, r.line): (r.license, r.dice) for r in licenses.scan(awkward).collect()} == {(12, 1): ("MIT", 1.0), (12, 2): ("reserved", 1.0)}
    assert licenses.scan(empty).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_huffman_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.2, 5000), 3000).astype(np.int64) if seed else np.zeros(700, np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3001))
    assert lengths.max() <= huffman.MAX_BITS and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    coder = huffman.Coder(lengths)
    stream, checkpoints = coder.encode(ids)
    assert (coder.decode(stream, checkpoints, len(ids)) == ids).all()
    if len(checkpoints) > 2:  # from a checkpoint on
        assert (coder.decode(stream, checkpoints[2:], len(ids) - 2 * huffman.LANE) == ids[2 * huffman.LANE :]).all()


def test_huffman_is_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost
    steep = huffman.code_lengths(2 ** np.arange(30, dtype=np.int64))
    assert steep.max() == huffman.MAX_BITS and math.isclose(sum(2.0 ** -int(n) for n in steep), 1)


@pytest.mark.parametrize("table", ["documents", "awkward"])
def test_token_files(table, request, spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs, tokenizer = request.getfixturevalue(table), Tokenizer.from_file(queries.tokenizer_path())
    uri = storage.new_dir(spark, "test-tokens")
    tokenbin.write(docs, uri, queries.tokenizer_path())
    got = tokenbin.read(spark, uri).orderBy("start").collect()
    source = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in source]
    texts = defaultdict(list)
    for d, t in source:
        texts[d].append([*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    start = 0
    for r in got:
        assert r.ids in texts[r.doc_id] and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_pieces_are_the_tokenizers_own():
    """Capitals whose lower case is longer, letters that come apart in their normal form, marks and joints of all kinds."""
    import sys
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(queries.tokenizer_path()), tokenbin.Pieces(queries.tokenizer_path())
    letters = [c for c in map(chr, range(128, sys.maxunicode)) if c.isalpha()]
    odd = [c for c in letters if len(c.lower()) > 1 or len(unicodedata.normalize("NFC", c)) > 1]
    assert "\u0130" in odd and len(odd) > 30
    rng = np.random.default_rng(6)
    texts = ["B\u0130LG\u0130. \u0130K\u0130, TAT\u0130L\u0130!? \u0130 \u0130.", "cafe\u0301. na\u0308ive, \u0301.", "\u039f\u0394\u039f\u03a3. \u03a3, it's. <|endoftext|>. a.b. ...", *(f"x{c}. {c}, {c}! {c}? {c}... {c}a. {c}" for c in odd)]
    texts += [" ".join(f"ab{c}{m}" for c, m in zip(rng.choice(letters, 40), rng.choice(list(".,!?"), 40))) for _ in range(200)]
    ids, counts = pieces.ids(pa.array(texts, pa.large_string()))
    ends = np.cumsum(counts)
    for t, b, e in zip(texts, ends - counts, ends):
        assert ids[b:e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files_of_nothing(empty, spark):
    uri = storage.new_dir(spark, "test-tokens")
    tokenbin.write(empty, uri, queries.tokenizer_path())
    assert tokenbin.read(spark, uri).collect() == []


def brute_windows(doc, item, percent=75):
    w, v = ([x.lower() for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for t in (doc, item))
    size = min(5, len(v))
    grams = lambda x: [tuple(x[i : i + size]) for i in range(len(x) - size + 1)]
    a, b = grams(w), Counter(grams(v))
    m = sum(b.values())
    best = None
    for s in range(len(a) - m + 1):
        common = sum((Counter(a[s : s + m]) & b).values())
        if 100 * common >= percent * (2 * m - common) and (best is None or common > best[0]):
            best = (common, s, common / (2 * m - common))
    return best


def test_decontamination(spark, documents, empty):
    rng = np.random.default_rng(3)
    item = [f"i{x}" for x in rng.integers(0, 10**5, 40)]
    insert = lambda *x: " ".join(["lead"] * 7 + list(x) + ["tail"] * 30)
    docs = [(1, insert(*item)), (2, insert(*item[:20], "new", *item[21:])), (3, insert(*item[:20], "in", "serted", *item[20:])), (4, insert(*item[:25])), (5, None), (6, ""), (7, insert("Short", "one")), (8, insert(*item, *item)), (8, insert(*item)), (None, insert(*item[1:]))]
    items = [(100, " ".join(item).upper()), (101, "short ONE"), (102, None), (103, ""), (104, " ".join(["lead"] * 7))]
    got = decontam.find(spark.createDataFrame(docs, "doc_id long, text string").withColumn("rid", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = [(d, i, b[1], round(b[2], 9)) for d, t in docs for i, u in items if u and (b := brute_windows(t, u))]
    assert sorted(((r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in got), key=repr) == sorted(expected, key=repr)
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.find(documents, benchmark).collect()}
    texts, held = [(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()]
    sets = {i: shingle_set(t) for i, t in held}
    assert found == {(d, i) for d, t in texts for i, u in held if shingle_set(t) & sets[i] and brute_windows(t, u)}
    assert decontam.find(empty, benchmark).collect() == [] and decontam.find(documents, benchmark.limit(0)).collect() == []


def test_decontamination_of_documents_shorter_than_an_item(spark):
    item = [f"t{i}" for i in range(59)]
    texts = [item[:-4], item[3:-4], item[:-20], item[:44], item, ["x", *item[5:], "y"], item[:48] + ["z"]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    expected = []
    for d, t in docs:
        a, b = shingle_set(t), shingle_set(" ".join(item))
        like = len(a & b) / len(a | b)
        if like >= 0.75:
            expected.append((d, 7, 0, len(words(t)), round(like, 9)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"u{i}" for i in range(30)))], "item_id long, text string")
    got = decontam.find(*frames).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in got) == expected
    assert {0, 1, 4, 6} <= {e[0] for e in expected} and len(expected) < len(docs)


def test_decontamination_of_repeated_shingles(spark):
    docs, items = [], []
    for i in range(20):
        shared = [f"s{i}x{k}" for k in range(124)]
        docs.append((i, " ".join([f"a{i}"] * 20 + shared)))
        items.append((i, " ".join([f"b{i}"] * 20 + shared)))
    got = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = [(d, d, b[1], round(b[2], 9)) for (d, t), (_, u) in zip(docs, items) if (b := brute_windows(t, u))]
    assert sorted((r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in got) == expected and len(expected) == 20


def test_toxicity_finds_documents_and_sentences(spark):
    rng = np.random.default_rng(2)
    table, labels = [], []
    for i in range(600):
        sentences = [" ".join(f"w{x}" for x in rng.integers(0, 300, 6)) for _ in range(rng.integers(1, 12))]
        if i % 5 == 0:
            sentences.insert(int(rng.integers(len(sentences) + 1)), f"you vile{rng.integers(50)} fool {rng.integers(9)}")
        table.append((i, ". ".join(sentences)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*table, (1000, None), (1001, ""), (None, "w1 w2")], "doc_id long, text string").withColumn("score", F.lit("old"))
    marks = spark.createDataFrame([x for x in labels if x[0] < 400] + [(1, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, marks), worst=True).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held)
    assert all("vile" in r.worst_sentence for r in held if r.doc_id % 5 == 0)
    texts = dict(table)
    assert all(texts[r.doc_id][r.worst_start : r.worst_end] == r.worst_sentence for r in held)
    none = toxicity.train(docs, marks.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_toxicity_of_awkward_rows(spark):
    docs = [(1, "vile fool"), (1, "kind words"), (2, "vile fool " * 20_000), (3, "calm day"), (None, "vile fool"), (4, None), (5, "!!! ... 123")] + [(10 + i, "vile fool" if i % 2 else "calm day") for i in range(60)]
    marks = [(10 + i, i % 2) for i in range(60)] + [(3, 0), (3, 1), (2, None), (None, 1), (99, 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"worst_sentence": F.lit("old"), "offsets": F.lit(1)})
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = toxicity.score(docs, model, worst=True).collect()
    assert len(got) == 67 and all(0 <= r.score <= 1 and r.offsets == 1 and r.worst_sentence != "old" for r in got)
    assert all((r.score >= 0.5) == ("vile" in (r.text or "")) for r in got if r.text and r.text[0].isalpha() and r.text != "kind words")
    assert {r.worst_start for r in got if r.doc_id in (4, 5)} == {None}


def test_noisy_or_against_definition(spark):
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(0, 2, 1 << toxicity.BITS).astype(np.float32), -1.5, 0.25)
    texts = ["One two. Two two three!\nfour? ...", "abcdefgh abcdefxy", "", None, "é ü words 12 mixed3in", "a " * 5000 + ". b"]
    feature = lambda data, plus=0: int(textscan.mix(textscan.word_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)])) + np.uint64(plus))[0] >> np.uint64(64 - toxicity.BITS))

    def brute(text):
        clean, worst = 1.0, None
        for sentence in re.split(rb"[.!?\n]", (text or "").encode().translate(LOWER)):
            found = re.findall(rb"[a-z\x80-\xff]+", sentence)
            if found:
                features = {feature(w) for w in found} | {feature(w[:n], n) for w in found for n in toxicity.STEMS if len(w) > n}
                p = 1 / (1 + math.exp(-max(-30, min(30, sum(float(model.weights[f]) for f in features) + model.bias))))
                clean *= 1 - min(p, 1 - 1e-12)
                worst = p if worst is None else max(worst, p)
        return (model.empty if worst is None else 1 - clean), worst

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in toxicity.score(docs, model, worst=True).collect():
        score, worst = brute(texts[r.doc_id])
        assert math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-9) and (r.worst_score is None) == (worst is None)
        assert worst is None or math.isclose(r.worst_score, worst, rel_tol=1e-6)


def test_language_model(spark, documents, awkward, empty):
    held = F.pmod(toxicity.crc_of_id(), F.lit(7)) == 2
    for docs in (documents, awkward):
        table = [(r.doc_id, r.text) for r in docs.collect()]
        out = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
        counts = Counter(t for d, x in table if not out(d) for t in [*words(x), None])
        n, v = sum(counts.values()), len(counts)
        got = sorted(map(tuple, gru_lm.score(docs, held).collect()), key=repr)
        base = {(d, x): (out(d), len(words(x)) + 1, sum(counts[t] > 0 for t in [*words(x), None]), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in [*words(x), None])) for d, x in table}
        assert len(got) == len(table)
        assert sorted(((d, o, k, known, n, round(b, 6)) for d, o, k, known, _, b, _ in got), key=repr) == sorted(((d, o, k, known, n, round(b, 6)) for d, x in table for o, k, known, b in [base[d, x]]), key=repr)
        assert all(g[4] == n and g[6] < 0 for g in got)
    assert gru_lm.score(empty, held).collect() == []


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(4)
    keys = (rng.integers(1, 2**62, 500, dtype=np.uint64) & ~gru_lm._CLASS_MASK) | rng.integers(0, gru_lm.RARE_CLASSES, 500).astype(np.uint64)
    totals = rng.integers(1, 50, 500).astype(np.uint64)
    v = gru_lm.vocabulary([gru_lm._stats(np.append(keys, gru_lm.END_KEY), np.append(totals, np.uint64(9)))])
    p = gru_lm.initial(v)
    p["c"] = rng.normal(0, 1, p["c"].shape).astype(np.float32)
    every = np.append(keys, gru_lm.END_KEY)
    _, klass, place = v.index(every)
    states = np.repeat(rng.normal(0, 1, (gru_lm.HIDDEN, 1)).astype(np.float32), len(every), 1)
    logs = gru_lm.log_probs(p, v, states, klass, place).astype(float)
    rare = (place < 0) & (klass < v.classes - 1)
    at = np.where(rare, klass - gru_lm.FREQUENT_CLASSES, 0)
    room = v.rare_tokens + v.rare_distinct + 1.0
    counts = np.append(totals, 9).astype(float)
    logs += np.where(rare, np.log((counts + 1) / room[at]), 0)
    unseen = np.exp(gru_lm.log_probs(p, v, states[:, : gru_lm.RARE_CLASSES], np.arange(gru_lm.RARE_CLASSES) + gru_lm.FREQUENT_CLASSES, np.full(gru_lm.RARE_CLASSES, -1)).astype(float)) / room
    empty_classes = np.exp(gru_lm.log_probs(p, v, states[:, : gru_lm.FREQUENT_CLASSES], np.arange(gru_lm.FREQUENT_CLASSES), np.full(gru_lm.FREQUENT_CLASSES, -1)).astype(float))
    empty_classes[np.unique(v.klass)] = 0
    assert math.isclose(np.exp(logs).sum() + unseen.sum() + empty_classes.sum(), 1, rel_tol=1e-4)


def test_language_model_gradients():
    rng = np.random.default_rng(6)
    keys = (rng.integers(1, 2**62, 40, dtype=np.uint64) & ~gru_lm._CLASS_MASK) | rng.integers(0, gru_lm.RARE_CLASSES, 40).astype(np.uint64)
    v = gru_lm.vocabulary([gru_lm._stats(keys, rng.integers(1, 50, 40).astype(np.uint64))])
    p = {k: a.astype(np.float64) for k, a in gru_lm.initial(v).items()}
    p["c"] = rng.normal(0, 0.5, p["c"].shape)
    tokens = keys[rng.integers(0, 40, (6, 3))]
    rows_, klass, place = (a.reshape(6, 3) for a in v.index(tokens.ravel()))
    real = np.ones((6, 3), bool)
    real[4:, 1] = False
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 0], fresh[5, 2] = True, True, True
    state = np.zeros((gru_lm.HIDDEN, 3))

    def loss():
        s, total = state, 0.0
        for t in range(6):
            s = np.where(fresh[t], 0, s)
            total += gru_lm.log_probs(p, v, s, klass[t], place[t])[real[t]].sum()
            s = np.where(real[t], gru_lm._advance(p, s, p["x"][:, rows_[t]])[0], s)
        return total / real.sum()

    grads, _ = gru_lm._gradients(p, v, state, rows_, klass, place, real, fresh)
    for name in p:
        flat = np.argsort(-np.abs(grads[name]).ravel())[:4]
        for i in flat:
            at = np.unravel_index(i, p[name].shape)
            kept = p[name][at]
            p[name][at] = kept + 1e-5
            up = loss()
            p[name][at] = kept - 1e-5
            down = loss()
            p[name][at] = kept
            assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=2e-3, abs_tol=1e-6), name


def test_language_model_trains_every_document(spark):
    own = [f"own{i}" for i in range(60)]
    table = [(None if i % 10 == 0 else i, f"{w} " * 100, i == 59) for i, w in enumerate(own)]
    docs = spark.createDataFrame(table, "doc_id long, text string, held_out boolean")
    keys = np.array([gru_lm.token_keys(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in own])
    order = np.argsort(keys)
    v = gru_lm.vocabulary([gru_lm._stats(keys[order], np.full(60, 100, np.uint64))])
    moved = (gru_lm.train(docs, v)["x"] != gru_lm.initial(v)["x"]).any(0)
    assert [w for w, row in zip(own, v.index(keys)[0]) if not moved[row]] == ["own59"]


def test_language_model_scores_token_by_token():
    """The batched scores of whole documents against one document and one token at a time, in double precision."""
    rng = np.random.default_rng(9)
    keys = np.sort((rng.integers(1, 2**62, 900, dtype=np.uint64) & ~gru_lm._CLASS_MASK) | rng.integers(0, gru_lm.RARE_CLASSES, 900).astype(np.uint64))
    v = gru_lm.vocabulary([gru_lm._stats(keys, rng.integers(1, 50, 900).astype(np.uint64))])
    docs = [np.append(keys[rng.zipf(1.3, n) % 900], gru_lm.END_KEY) for n in (0, 1, 5000, 40, 33, 32, 31, 700)]
    p, tokens = gru_lm.train_documents(gru_lm.initial(v), v, iter(docs * 2))
    assert tokens == 2 * sum(map(len, docs))
    h, exact = gru_lm.HIDDEN, {k: a.astype(float) for k, a in p.items()}
    sigmoid = lambda a: 1 / (1 + np.exp(-a))

    def brute(doc):
        state, total = np.zeros(h), 0.0
        for row, klass, place in zip(*(a.tolist() for a in v.index(doc)), strict=True):
            logits = exact["c"] @ state + exact["cb"]
            total += logits[klass] - np.log(np.exp(logits).sum())
            if place >= 0:
                own = slice(v.starts[klass], v.starts[klass + 1])
                inner = exact["w"][own] @ state + exact["wb"][own]
                total += inner[place] - np.log(np.exp(inner).sum())
            x, g = exact["x"][:, row], exact["u"] @ state
            z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
            n = np.tanh(x[2 * h :] + r * g[2 * h :])
            state = (1 - z) * n + z * state
        return total / np.log(10)

    got = gru_lm.score_pool(p, v, np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])], np.zeros(sum(map(len, docs))))
    assert np.allclose(got, [brute(d) for d in docs], rtol=1e-4)


def test_decontamination_of_long_texts_and_repeated_items(spark):
    rng = np.random.default_rng(15)
    item = [f"i{x}" for x in rng.integers(0, 10**5, 30)]
    long = [f"w{x}" for x in rng.integers(0, 10**5, 60_000)]
    at = [50, 30_000, 59_900]
    for a in at:
        long[a : a + 30] = item
    docs = [(1, " ".join(long)), (2, "clean text " * 50), (3, " ".join(["lead"] * 9 + item[:28]))]
    items = [(7, " ".join(item)), (7, " ".join(item)), (7, "another passage of five words and more"), (None, " ".join(item))]
    got = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    # items with equal ids count each by itself; of the passages in a long text the first is reported
    assert sorted(((r.doc_id, r.item_id, r.start_word) for r in got), key=str) == sorted([(d, i, w) for d, w in ((1, 50), (3, 7)) for i in (7, 7, None)], key=str)


def test_sorted_keys_are_packed_near_their_entropy():
    keys = np.unique(np.random.default_rng(4).integers(0, 2**34, 20_000, dtype=np.uint64))  # gaps of 20 bits, 21.1 bits of entropy
    packed = vertical.pack_sorted(keys)
    assert (vertical.unpack_sorted(packed) == keys).all() and len(packed) < 3.0 * len(keys)
    for some in ([], [0], [255], [256, 1], [2**63, 5]):
        assert vertical.unpack(vertical.pack(np.array(some, np.uint64))).tolist() == some


def test_pairs_are_written_before_their_sets_are_joined(spark, documents, monkeypatch):
    plans, linked = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or linked(pairs, *a))
    ngram_join.similarity_groups(documents)
    assert plans and not any("Join" in p or "Aggregate" in p for p in plans)
