"""Operators, sources and streams on small cases with known outcomes."""

import json

import pandas as pd
import pytest
from gradeflow.operators import blocks, dataset, decide, leaderboard, predictions, score
from gradeflow.sources import files
from gradeflow.streaming import progress
from pyspark.sql import functions as F


def test_manifest_round(spark, tmp_path):
    rows = [
        {"id": "a", "image": "x/a.png", "category": "en", "gt": "one", "split": "dev"}, {"id": "b", "image": ["b1.png", "b2.png"], "category": "en", "gt_file": "t/b.html", "split": "holdout", "doc_id": "a"},
        {"id": "a", "image": "c.png", "category": "ar", "gt": "", "split": "dev", "page": 3}, {"image": "d.png", "category": "ar", "gt": "x"}, {"id": "e", "image": [], "category": "ar", "gt": "x", "split": "test"},
    ]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/b.html").write_text("<table></table>")
    (tmp_path / "m.jsonl").write_text("# comment\n\n" + "\n".join(map(json.dumps, rows)) + '\n{"id": "torn')
    items = files.manifest(spark, str(tmp_path / "m.jsonl"))
    got = {r.ordinal: r for r in items.collect()}
    assert got[2].images == ["x/a.png"] and got[3].images == ["b1.png", "b2.png"] and got[3].gt_type == "table_html" and got[2].doc_id == "a" and got[5].id is None
    assert sorted(r.problem for r in files.manifest_errors(items).collect()) == ["bad JSON", "duplicate id", "no id", "no image"]
    assert [r.doc_id for r in dataset.leaked_groups(items).collect()] == ["a"]
    (tmp_path / "other").mkdir()
    (tmp_path / "other/b.html").write_text("another file of that name")
    assert {r.id: r.gt for r in files.with_truth_files(items, str(tmp_path)).collect() if r.id == "b"} == {"b": "<table></table>"}
    (tmp_path / "b1.png").write_text("x")
    assert {(r.id, r.path.rsplit("/", 1)[1]) for r in files.missing_files(items.where("id = 'b'"), str(tmp_path)).collect()} == {("b", "b2.png")}


def test_lines_of_several_files_and_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": f"{name}{i}", "text": str(i) * 20}) for i in range(500)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        got = files.numbered(spark, str(tmp_path)).collect()
        assert sorted((r.ordinal, json.loads(r.line)["id"]) for r in got) == list(enumerate([f"{n}{i}" for n in "ab" for i in range(500)]))
        log = files.prediction_log(spark, str(tmp_path)).collect()
        assert [r.id for r in sorted((r for r in log if r.id[0] == "b"), key=lambda r: r.seq)] == [f"b{i}" for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_paired_files_and_locks(spark, tmp_path):
    for name in ("en/d1__p1.png", "en/d1__p1.txt", "en/d1__p1.html", "en/d2.png", "ar/d3.jpg", "ar/d3.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.stem: (r.category, r.doc_id, r.truth.rsplit(".", 1)[1]) for r in files.paired_files(spark, str(tmp_path)).collect()}
    assert got == {"d1__p1": ("en", "d1", "html"), "d3": ("ar", "d3", "md")}
    digests = files.digests(spark, str(tmp_path / "en"))
    (tmp_path / "lock").write_text("".join(f"{r.digest}  {r.name}\n" for r in digests.collect()) + "0000  gone.txt\n")
    assert [r.name for r in leaderboard.changed_files(files.lock(spark, str(tmp_path / "lock")), digests).collect()] == ["gone.txt"]


def test_log_resume_and_retry(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    lines = [{"id": "a", "text": "old"}, {"id": "b", "error": "boom"}, {"id": "a", "text": "new", "confidence": 0.5}]
    (tmp_path / "m1/log.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"id": "c", "te')
    last = predictions.latest(files.prediction_log(spark, str(tmp_path / "*/log.jsonl")), "model", "id")
    assert {(r.model, r.id): (r.text, r.error) for r in last.collect()} == {("m1", "a"): ("new", None), ("m1", "b"): (None, "boom")}
    items = spark.createDataFrame([(x,) for x in "abc"], "id string")
    assert {r.id for r in predictions.todo(items, last).collect()} == {"c"} and {r.id for r in predictions.todo(items, last, True).collect()} == {"b", "c"}
    shards = [{r.id for r in predictions.todo(items, last.limit(0), shards=2, shard=k).collect()} for k in (0, 1)]
    assert shards[0] | shards[1] == set("abc") and not shards[0] & shards[1]


def test_errors_are_scored_and_missing_is_not(spark):
    items = spark.createDataFrame([(i, f"i{i}", "en", "a truth of more than twenty characters") for i in range(4)], "ordinal int, id string, category string, gt string")
    models = spark.createDataFrame([("m", 0)], "model string, model_ordinal int")
    answers = spark.createDataFrame([("m", "i0", "a truth of more than twenty characters", None), ("m", "i1", None, "boom"), ("m", "i2", "lorem ipsum " * 40, None), ("m", "zz", "x", None)], "model string, id string, text string, error string")
    rows = score.score(score.pair(items, models, answers))
    got = {r.id: r for r in rows.collect()}
    assert got["i3"].missing and got["i3"].cer is None and got["i1"].cer == 1.0 and got["i1"].flags == ["error"] and got["i2"].flags == ["repetition", "too_long"] and got["i0"].cer == 0.0
    total = score.aggregate(rows).where("category IS NULL").first()
    assert (total.n, total.n_scored, total.complete, total.n_fail, total.n_hallucination) == (4, 3, False, 1, 1)


def test_test_models_and_adapters(spark):
    assert predictions.noisy_text("hello " * 50, "k") == predictions.noisy_text("hello " * 50, "k") != "hello " * 50
    with pytest.raises(ValueError, match="nothing"):
        predictions.test_answer("nothing", F.lit(""), F.lit(""))

    class Upper:
        def load(self):
            self.ready = True

        def predict_batch(self, frame):
            if not self.ready or (frame["gt"] == "bad").any():
                raise RuntimeError("cannot read")
            return pd.DataFrame({"id": frame["id"], "text": frame["gt"].str.upper()})

        def close(self):
            self.ready = False

    items = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c")], "id string, gt string")
    got = {r.id: (r.text, r.error) for r in predictions.apply_adapter(items, Upper()).collect()}
    assert got == {"1": ("A", None), "2": (None, "RuntimeError: cannot read"), "3": ("C", None)}


AGG = "category string, model string, model_ordinal int, adapter string, is_table boolean, complete boolean, n int, cer_mean double, cer_ci95 double, cell_exact_mean double, cell_exact_ci95 double, n_fail int, n_hallucination int, latency_mean_s double, vram int, n_hit_max_tokens int"


@pytest.fixture(scope="module")
def aggregates(spark):
    row = lambda m, i, cer, ci=0.01, adapter="vlm", n_fail=0, hall=0, lat=1.0, complete=True, cut=0: ("en", m, i, adapter, False, complete, 100, cer, ci, None, None, n_fail, hall, lat, 4, cut)
    rows = [row("best", 0, 0.05, 0.03, lat=3.0), row("near", 1, 0.07, 0.03, lat=None), row("far", 2, 0.5), row("loops", 3, 0.01, hall=20), row("part", 4, 0.0, complete=False), row("old", 5, 0.4, adapter="tesseract", cut=2)]
    return spark.createDataFrame(rows, AGG)


def test_screening_and_final(aggregates):
    got = {r.model: (r.status, r.reason, r.finalist) for r in decide.screening(aggregates, finalists=1).collect()}
    assert got == {
        "best": ("kept", "", True), "near": ("outside top", "outside top", False), "far": ("eliminated", "certainly worse", False), "loops": ("eliminated", "unstable", False),
        "part": ("skipped", "incomplete", False), "old": ("kept", "best traditional model; 2 answers cut", True),
    }
    last = {r.model: (r.tied, r.winner) for r in decide.final(aggregates).collect()}
    assert last == {"best": (False, False), "near": (True, True)}  # no latency counts as 0 and wins the tie


def test_tables_are_ranked_by_exact_cells(spark):
    rows = [("t", m, i, "vlm", True, True, 10, None, None, v, 0.01, 0, 0, 1.0, 1, 0) for i, (m, v) in enumerate([("a", 0.5), ("b", 0.9)])]
    assert {r.model: r.status for r in decide.eliminate(spark.createDataFrame(rows, AGG)).collect()} == {"a": "eliminated", "b": "kept"}


def test_variants_and_skips(spark):
    queue = spark.createDataFrame([("m",), ("m2",)], "name string")
    covered = spark.createDataFrame([("m", 0, 5, 10, 0), ("m__8bit", 1, 9, 10, 2), ("m__4bit", 2, 9, 10, 1), ("m__long", 3, 10, 10, 0), ("m2x", 4, 10, 10, 0)], "variant string, variant_ordinal int, done int, total int, errors int")
    assert [(r.name, r.variant) for r in leaderboard.best_variant(queue, covered).collect()] == [("m", "m__4bit")]
    assert [(r.name, r.variant) for r in leaderboard.best_variant(queue, covered, long=True).collect()] == [("m", "m__long")]
    skips = spark.createDataFrame([("gated", "x", False), ("broken", "x", False), ("broken", " ", True), ("odd", "x", True), ("broken", "x", True)], "c string, d string, e boolean")
    assert [r[0] for r in skips.select(leaderboard.skip_problem(F.col("c"), F.col("d"), F.col("e"))).collect()] == [None, "no evidence", "no detail", "unknown reason", None]


@pytest.mark.parametrize(("params", "free", "level"), [(2.2, [15.0, 15.0], "A"), (8.29, [15.0, 15.0], "B"), (8.29, [15.0], "D"), (70.0, [15.0, 15.0], "H"), (2.2, [], None)])
def test_memory_plans(spark, params, free, level):
    got = leaderboard.recommended(leaderboard.memory_plans(spark.createDataFrame([("m", params)], "model string, params_b double"), free)).collect()
    assert [r.level for r in got] == ([level] if level else [])


def test_labels_regions_and_groups(spark):
    labels = spark.createDataFrame([(1, "Total"), (1, "Net"), (1, "Gross")], "doc int, label string")
    lines = spark.createDataFrame([(1, 0, "Total due 5"), (1, 1, "Total"), (1, 2, "Net 3"), (1, 3, "Netto")], "doc int, ord int, line string")
    assert {r.label: r.line for r in blocks.row_of_label(labels, lines).collect()} == {"Total": "Total", "Net": "Net 3"}
    boxes = "page int, i int, x1 int, y1 int, x2 int, y2 int"
    kept = blocks.outside_regions(spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 20, 0, 30, 10), (2, 0, 0, 0, 10, 10)], boxes), spark.createDataFrame([(1, 0, 0, 0, 8, 8)], boxes))
    assert {(r.page, r.i) for r in kept.collect()} == {(1, 1), (2, 0)}
    pages = spark.createDataFrame([(1, 30, 20, 10, 5), (2, 0, 0, 0, 0), (3, 90, 0, 200, 10), (4, 100, 5, 120, 5)], "page int, x1 int, y1 int, x2 int, y2 int").withColumns({"width": F.lit(100), "height": F.lit(50)})
    assert [tuple(r)[1:5] for r in blocks.clamped(pages).orderBy("page").collect()] == [(10, 5, 30, 20), (0, 0, 1, 1), (90, 0, 100, 10), (99, 5, 100, 6)]
    around = blocks.region_around(spark.createDataFrame([(1, 10, 10, 20, 20), (1, 12, 30, 40, 50), (1, 9, 60, 20, 64)], boxes.replace("i int, ", "")).withColumns({"width": F.lit(100), "height": F.lit(66)}))
    assert tuple(around.first()) == (1, 4, 5, 45, 66)
    old = spark.createDataFrame([(1, i, 0, 10 * i, 10, 10 * i + 10) for i in range(5)], boxes)
    new = spark.createDataFrame([(1, 0, 0, 12, 10, 18), (1, 1, 0, 20, 10, 30), (1, 2, 0, 5, 10, 12)], boxes.replace("i int", "k int"))
    replaced = blocks.spliced(old, spark.createDataFrame([(1, 1, 2)], "page int, first int, last int"), new).orderBy("i").collect()
    assert [(r.i, r.y1) for r in replaced] == [(0, 0), (1, 12), (2, 20), (3, 30), (4, 40)]
    groups = blocks.adjacent_groups(spark.createDataFrame([(1, 0, 0, 10), (1, 1, 4, 12), (1, 2, 11, 20)], "page int, i int, y1 int, y2 int")).orderBy("i").collect()
    assert [r.group for r in groups] == [1, 1, 2]
    jobs = spark.sql("SELECT '2026-01-01' AS id, array(named_struct('name', 'f')) AS files UNION ALL SELECT '2026-02-01', array(named_struct('name', 'f'), named_struct('name', 'g'))")
    assert {r.file: r.job for r in blocks.latest_job(jobs).collect()} == {"f": "2026-02-01", "g": "2026-02-01"}


def test_streams_resume_and_ignore_replays(spark, tmp_path):
    log = tmp_path / "log"
    for part, rows in enumerate([[("m", "a", 1, True), ("m", "a", 2, True)], [("m", "a", 2, True), ("m", "a", 3, True), ("m", "b", 4, False)]]):
        spark.createDataFrame(rows, "model string, id string, seq long, is_error boolean").coalesce(1).write.mode("append").parquet(f"{log}/{part}")
    schema = "model string, id string, seq long, is_error boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{log}/*")
    got = progress.drained(progress.breaker_stream(stream, "model", 3), "update", ["model"]).first()
    assert (got.longest, got.tripped, got.streak) == (3, True, 0)
    batch = spark.read.schema(schema).parquet(f"{log}/0")
    for number in (0, 0, 1):
        progress.append_new(batch, str(tmp_path / "out"), number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_scores_replace_their_own_parts_only(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.createDataFrame([("dev", "a", 1), ("dev", "b", 2)], "split string, model string, x int")
    files.write_scores(rows, path)
    files.write_scores(rows.where("model = 'b'").withColumn("x", F.lit(9)), path)
    assert {(r.model, r.x) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9)}
    assert files.markdown(rows.orderBy("x")).splitlines()[2] == "| dev | a | 1 |"
