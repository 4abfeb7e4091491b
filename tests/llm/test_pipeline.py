"""The pipeline's stages, each against brute force on what the stage before it kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("gradeflow.llm")
import corpus_pipeline  # noqa: E402
from gradeflow.llm import decontam, mixing, queries, storage, toxicity  # noqa: E402
from test_text_operators import brute_groups, brute_windows, shingle_set, words  # noqa: E402


def rows_of(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in frame.collect()), key=repr)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = rows_of(docs)
    benchmark = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_binary"]
    for name, stage in corpus_pipeline.STAGES:
        out, uri = storage.written(stage(spark, docs, sf_dir), "test-stage")
        if name == "token_binary":
            got = out.orderBy("start").collect()
            assert [r.doc_id for r in got] == sorted(k[0] for k in kept)
            assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(queries.tokenizer_path())
            crcs = {d: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t, *_ in kept}
            assert all(r.ids_crc32 == crcs[r.doc_id] for r in got)
            break
        assert out.columns == docs.columns
        new = rows_of(out)
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(docs, queries.toxicity_model(spark, sf_dir, docs)).select("doc_id", "score").collect()}
            assert new == [k for k in kept if scores[k[0]] < toxicity.REJECT]
        elif name == "ngram_jaccard":
            groups = brute_groups([(k[0], k[1]) for k in kept])
            assert [k[0] for k in new] == sorted({g[2] for g in groups}, key=lambda d: repr((d,))) or {k[0] for k in new} == {g[2] for g in groups}
        elif name == "decontamination":
            held = {k[0] for k in kept for b in benchmark if shingle_set(k[1]) & shingle_set(b) and brute_windows(k[1], b)}
            assert new == [k for k in kept if k[0] not in held]
        elif name == "mixing":
            times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
            assert Counter(new) == Counter(k for k in kept for _ in range(times[k[0]])) and max(times.values()) <= 3
            assert sum(len(words(k[1])) for k in new) == sum(r.taken for r in mixing.mix(docs).collect())
        kept, docs = new, out


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(docs):
    """With columns that have the names that operators use."""
    return docs.withColumns({c: F.lit(f"own {c}") for c in ("score", "toxicity", "_key_doc_id", "_n", "_times", "_row", "times", "text_hash", "rid", "size", "target")})


def test_stages_take_awkward_rows(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = [(None, text, "en", "a", 1), (5, text, "en", "a", 1), (5, text, "en", "a", 1), (6, None, None, None, None), (7, "", "en", "b", 0), (8, text + " more", "en", "b", 1), (9, long, "en", "c", 1)]
    docs = clashing(spark.createDataFrame(docs, COLUMNS))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_dir)
        out = result.collect()
        if name == "toxicity":
            assert len(out) == 7
        if name == "ngram_jaccard":
            assert sorted((r.doc_id for r in out), key=repr) == [5, 6, 7, 9]
        if name == "decontamination":
            assert len(out) == 7
        if name != "token_binary":
            assert result.columns == docs.columns and {r.score for r in out} == {"own score"} and {r["_row"] for r in out} == {"own _row"}
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert decontam.WORDS == 5


def test_decontamination_stage_goes_by_row(spark, sf_dir):
    bad = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.createDataFrame([(None, bad), (1, bad), (1, "clean words only"), (2, "other clean words"), (None, "clean without an id")], "doc_id long, text string")
    out = corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, "clean words only"), (2, "other clean words"), (None, "clean without an id")], key=repr)


def test_mixing_stage_takes_each_source_its_own(spark, sf_dir):
    docs = spark.createDataFrame([(i % 7, "same words in all", "en", s, 1) for i in range(70) for s in ("a", "b", None)], COLUMNS)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.source] += r.times
    assert Counter(r.source for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()) == plan


def test_toxicity_stage_rejects_what_the_operator_calls_toxic(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    called = {r.doc_id for r in queries.op9_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).select("doc_id").collect()}
    assert called and kept == {r.doc_id for r in docs.select("doc_id").collect()} - called


def test_the_driver_lets_go_of_decontamination_step_by_step(spark, monkeypatch):
    """After each table that is written, for the driver's memory has a limit and a step's plans need much of it."""
    from gradeflow.llm import decontam, storage

    seen = []
    for name in ("written", "checkpointed", "tidy"):
        monkeypatch.setattr(storage, name, lambda *a, f=getattr(storage, name), name=name: seen.append(name) or f(*a))
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "nothing of it in here at all")], "doc_id long, text string")
    found = decontam.find(docs, spark.createDataFrame([(7, text)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 7)]
    after = [b for a, b in zip(seen, seen[1:]) if a == "written"]
    assert after == ["tidy"] * 3 and seen.count("tidy") == 4


def test_driver_lets_go_of_each_round_of_components(spark, monkeypatch):
    from gradeflow.llm import components

    calls = []
    monkeypatch.setattr(components, "tidy", calls.append)
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "a long, b long")
    assert {r.node: r.component for r in components.components(links, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert calls
