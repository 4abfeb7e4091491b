"""Configuration, guards, adapters, reports, markers, markup and generators on small cases with known outcomes."""

import json
import re
import sys

import pytest
from gradeflow import config
from gradeflow.functions import markup
from gradeflow.operators import blocks, decide, documents, leaderboard, markers, predictions, report, score
from gradeflow.sources import files, generators
from gradeflow.streaming import progress
from pyspark.sql import functions as F

CONFIG = """
dataset: data/manifest.jsonl
normalization: {unify_alef: true}
models:
  - {name: base, adapter: dummy, params: {mode: oracle, processor_kwargs: {a: 1}}}
  - {name: base__pre, adapter: dummy, params: {mode: oracle, processor_kwargs: {a: 1}, preprocess: true, preprocess_reuse: base}}
  - {name: other, adapter: dummy, params: {mode: loop, preprocess_reuse: base}, enabled: false}
  - {name: cmd, adapter: command, params: {cmd: "echo {id} {category}"}}
"""


@pytest.fixture
def conf(tmp_path):
    (tmp_path / "c.yaml").write_text(CONFIG)
    return config.load(tmp_path / "c.yaml")


def test_configuration(conf, tmp_path, spark):
    assert conf.dataset == tmp_path / "data/manifest.jsonl" and conf.output == tmp_path / "runs" and conf.rules.unify_alef
    assert [m.name for m in conf.select()] == ["base", "base__pre", "cmd"] and [m.name for m in conf.select(["other", "base"])] == ["other", "base"]
    assert [(r.model, r.model_ordinal) for r in conf.frame(spark, ["cmd", "base"]).orderBy("model_ordinal").collect()] == [("cmd", 0), ("base", 1)]
    for text, why in ((CONFIG.replace("name: other", "name: base"), "twice"), (CONFIG.replace("enabled", "on_duty"), "on_duty"), (CONFIG.replace("name: cmd", "name: a b"), "letters"), ("models: []", "dataset"), (CONFIG + "status: {pull: 1}", "pull"), (CONFIG.replace("unify_alef", "alif"), "alif")):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError, match=why):
            config.load(tmp_path / "bad.yaml")
    with pytest.raises(KeyError):
        conf.select(["nobody"])
    assert conf.model("base").spec == config.Model("renamed", "dummy", conf.model("base").params, gpus=2).spec != conf.model("other").spec


def test_lists_and_parameters(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("split: dev\nmax_skips: 3\nqueue: [m1, m2]\n")
    (tmp_path / "s.yaml").write_text("- {model: m1, reason_code: gated, detail: x}\n- nothing\n- {model: m1, reason_code: broken}\n")
    (tmp_path / "x.yaml").write_text("excluded: [{id: 7, reason: seen}]\n")
    names, rest = config.queue(spark, tmp_path / "q.yaml")
    assert [(r.name, r.queue_ordinal) for r in names.collect()] == [("m1", 0), ("m2", 1)] and rest == {"split": "dev", "max_skips": 3}
    assert [tuple(r) for r in config.skips(spark, tmp_path / "s.yaml").collect()] == [("m1", "broken", None, None)]
    assert config.skips(spark, tmp_path / "none.yaml").count() == 0 and [tuple(r) for r in config.exclusions(spark, tmp_path / "x.yaml").collect()] == [("7", "seen")]
    assert config.parameters("max_pixels=5, batch=2, on=true,name=x") == {"processor_kwargs": {"max_pixels": 5}, "batch": 2, "on": True, "name": "x"}
    assert config.overlaid({"a": 1, "g": {"x": 1, "y": 2}}, {"g": {"y": 3}, "b": 4}) == {"a": 1, "b": 4, "g": {"x": 1, "y": 3}}
    assert config.in_mode({"a": 1}, {"m": {"a": 2}}, "m") == {"a": 2} and config.names(" a,, b ") == ["a", "b"] and config.names(None) is None
    with pytest.raises(ValueError, match="no mode"):
        config.in_mode({}, {"m": {}}, "n")


def test_guards(conf, spark):
    assert config.check_split("dev") == "dev" and config.check_split("holdout", True) == "holdout"
    with pytest.raises(config.NotAllowed):
        config.check_split("holdout")
    done = spark.createDataFrame([("a",)], "id string")
    sessions = spark.createDataFrame([("2026-01-01", "old"), ("2026-01-02", conf.model("base").spec)], "started string, spec string")
    config.check_spec(conf.model("base"), done, sessions)
    config.check_spec(conf.model("other"), done.limit(0), sessions)
    with pytest.raises(config.NotAllowed) as refused:
        config.check_spec(conf.model("other"), done, sessions)
    assert refused.value.code == 3
    assert config.check_reuse(conf, conf.model("base__pre")).name == "base" and config.check_reuse(conf, conf.model("base")) is None
    with pytest.raises(config.NotAllowed) as refused:
        config.check_reuse(conf, conf.model("other"))
    assert refused.value.code == 4
    runs = spark.createDataFrame([("a", None), ("a", "f"), ("b", "old"), ("b", "f")], "model string, fingerprint string")
    assert [r.model for r in config.stale_models(runs, "f").collect()] == ["b"]
    items = spark.createDataFrame([("1", "dev"), ("2", None)], "id string, split string")
    assert config.no_holdout(items).count() == 2
    with pytest.raises(Exception, match="holdout items"):
        config.no_holdout(items.withColumn("split", F.lit("holdout"))).collect()
    here = spark.createDataFrame([("m/predictions.jsonl", 5), ("n/predictions.jsonl", 9), ("m/meta.json", 1)], "file string, lines int")
    there = spark.createDataFrame([("m/predictions.jsonl", 6), ("n/predictions.jsonl", 8), ("m/meta.json", 3), ("new.json", 1)], "file string, lines int")
    assert {r.file for r in config.restorable(here, there).collect()} == {"m/predictions.jsonl", "new.json"}


def test_adapters(conf, spark, tmp_path):
    items = spark.createDataFrame([(str(i), "en", "truth") for i in range(4)], "id string, category string, gt string")
    assert {r.id: r.text for r in predictions.apply_adapter(items, config.make_adapter(conf.model("cmd"))).collect()} == {str(i): f"{i} en" for i in range(4)}
    assert {r.text for r in predictions.apply_adapter(items, config.make_adapter(config.Model("x", "dummy", {"mode": "oracle"}))).collect()} == {"truth"}
    failed = predictions.apply_adapter(items, config.make_adapter(config.Model("x", "dummy", {"mode": "fail"}))).collect()
    assert len(failed) == 4 and all(r.error.startswith("RuntimeError") for r in failed)
    (tmp_path / "w.py").write_text("import json, sys\nfor line in sys.stdin:\n    x = json.loads(line)\n    if x['id'] == '2': sys.exit(1)\n    print('noise'); print('RESULT ' + json.dumps({'text': x['gt'] + x['id']}), flush=True)\n")
    worker = config.Model("w", "lines", {"cmd": f"{sys.executable} {tmp_path / 'w.py'}", "timeout": 20})
    got = {r.id: (r.text, bool(r.error)) for r in predictions.apply_adapter(items.coalesce(1), config.make_adapter(worker)).collect()}
    assert got == {"0": ("truth0", False), "1": ("truth1", False), "2": (None, True), "3": ("truth3", False)}
    with pytest.raises(ValueError, match="no adapter"):
        config.make_adapter(config.Model("x", "unknown"))


def test_whole_score_rows_and_reports(spark):
    table = "<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"
    items = [(0, "t1", "en", "one two three four five six", "text", None, 1), (1, "t2", "en", "some other longer truth to read here", "text", "1 page", 1), (2, "b1", "tab", table, "table_html", "2 pages", 2)]
    items = spark.createDataFrame(items, "ordinal int, id string, category string, gt string, gt_type string, length_bin string, pages int")
    models = spark.createDataFrame([("good", 0, 2048.0), ("bad", 1, None)], "model string, model_ordinal int, peak_vram_mib double")
    two = "<table><tr><td>a</td><td>1</td></tr></table>\n<table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table>"
    answers = [("good", "t1", "**one** two  three four five six", None, None, 1.0), ("good", "t2", "some other longer truth to read here", None, '{"hit_max_tokens": true}', 2.0), ("good", "b1", two, None, None, 3.0), ("bad", "t1", None, "boom | x", None, None), ("bad", "b1", "no table", None, '{"hit_max_tokens": false}', 1.0)]
    answers = spark.createDataFrame(answers, "model string, id string, text string, error string, extra string, latency_s double")
    rows = score.score_all(score.pair(items, models, answers)).cache()
    got = {(r.model, r.id): r for r in rows.collect()}
    assert len(got) == 6 and got["bad", "t2"].missing and got["bad", "t2"].pos_q is None and got["bad", "t1"].flags == ["error"] and got["bad", "t1"].cer == 1.0
    good = got["good", "t1"]
    assert good.cer == 0.0 < good.cer_raw and good.wer_raw == 1 / 6 and good.pos_q[0] == 1.0 and good.teds is None
    assert got["good", "t2"].flags == ["hit_max_tokens"] and got["good", "b1"].teds == 1.0 and got["good", "b1"].cell_exact == 1.0 and got["bad", "b1"].teds == 0.0
    total = {r.model: r for r in score.aggregate(rows, [("model",)]).collect()}
    assert (total["good"].n_hit_max_tokens, total["good"].teds_n, total["good"].cell_exact_mean, total["bad"].complete, total["bad"].row_count_off) == (1, 1, 1.0, False, 1)
    text = report.report(rows, items, models, "Results", ["bad"])
    for part in ("# Results", "cannot be compared", "| good | 3/3 |", "| bad (incomplete) | 2/3 |", "| 2.0 GB |", "## TEDS by category", "## Long documents: tab", "| 2 pages | 100% / 100% · 1.00 |", "| `t1` | en | 100.0% | error | one two three four five six | boom \\| x |"):
        assert part in text, part
    assert [r.model for r in report.in_report_order(score.aggregate(rows, [("model",)]).join(models, "model")).orderBy("place").collect()] == ["good", "bad"]
    csv = report.summary_csv_rows(score.aggregate(rows))
    assert "pos_q4" in csv.columns and {r.category for r in csv.collect()} == {"ALL", "en", "tab"}


def test_leaderboard_sections(spark):
    schema = "model string, category string, missing boolean, flags array<string>, cer double, char_edits int, ref_chars int, latency_s double, cell_exact double, pos_q array<double>, rows_wrong_ncols int"
    rows = [("a", "en", False, [], 0.1, 1, 10, 1.0, None, None, None), ("a", "en", False, ["empty"], 0.3, 3, 10, 3.0, None, None, None), ("a__b", "tab", False, ["too_long"], 0.5, 5, 10, 2.0, 0.8, None, 2), ("a__b", "en", False, [], 0.0, 0, 10, 1.0, None, None, None),
            ("c", "en", False, [], 0.2, 2, 10, 1.0, None, None, None), ("c", "long", False, ["hit_max_tokens"], 0.4, 4, 10, 1.0, None, [1.0, 0.5, None, 0.0], None), ("c", "tab", True, None, None, None, None, None, None, None, None)]
    variants = spark.createDataFrame([("one", "en", "a"), ("one", "tab", "a__b"), ("two", "en", "c"), ("two", "long", "c"), ("two", "tab", "c")], "name string, category string, variant string")
    found = leaderboard.sections(variants, spark.createDataFrame(rows, schema)).cache()
    assert {(r.name, r.category): (r.n, round(r.cer_mean, 9) if r.cer_mean is not None else None, r.variants) for r in found.collect()} == {
        ("one", None): (3, 0.3, ["a", "a__b"]), ("one", "en"): (2, 0.2, ["a", "a__b"]), ("one", "tab"): (1, 0.5, ["a", "a__b"]),
        ("two", None): (3, 0.3, ["c"]), ("two", "en"): (1, 0.2, ["c"]), ("two", "long"): (1, 0.4, ["c"]), ("two", "tab"): (1, None, ["c"])}
    board = spark.createDataFrame([("two", 2, 2, 0.3, None, None), ("one", 1, 3, 0.2, 0.8, 2048.0), ("none", 3, 0, None, None, None)], "name string, rank int, n_done int, text_cer double, table_exact double, vram double")
    skips = spark.createDataFrame([("s", "gated", "x|y")], "name string, reason_code string, detail string")
    assert report.leaderboard_markdown(board, skips, ["none"], "Board", found, {"one": "complete"}, ("tab",), ("long",)) == """# Board

| # | Model | Done | Text CER | Cells in place | Memory | Looping or too long | Failed | s an item | State | Variants |
|---|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|
| 1 | one | 3 | 20.0% | 80.0% | 2.0 GB | 1 | 1 | 2.00 | complete | `a`, `a__b` |
| 2 | two | 2 | 30.0% | — | — | 0 | 0 | 1.00 | — | `c` |

## By category

Error rates of texts; of tables (*) the cells in place. Categories that are not complete are left open.

| Category | one | two |
|---|---:|---:|
| en | 20.0% ±19.6 | 20.0% |
| long | — | 40.0% |
| tab * | 80.0% · CER 50.0% | — |

## Long documents by place

| Model | Category | Q1 | Q2 | Q3 | Q4 | Cut | Rows of other width |
|---|---|---:|---:|---:|---:|---:|---:|
| two | long | 100% | 50% | — | 0% | 1 | 0 |

## Skipped

| Model | Reason | Detail |
|---|---|---|
| s | gated | x/y |

Not run yet: none.
"""


def test_status_and_decision(spark):
    quick = spark.createDataFrame([("m", None, 3, 1, 0.25, 1.5), ("m", "en", 3, 1, 0.25, 1.5)], "model string, category string, n long, errors long, cer_mean double, latency_mean_s double")
    text = report.status_markdown(quick, {"en": 3, "ar": 2}, {"m": "running"})
    assert "| m | running | 3/5 | 1 | 25.0% | 1.50 |" in text and "| en (3) | 3: 25.0% |" in text
    agg = "category string, model string, model_ordinal int, adapter string, is_table boolean, complete boolean, n int, cer_mean double, cer_ci95 double, cell_exact_mean double, cell_exact_ci95 double, n_fail int, n_hallucination int, latency_mean_s double, vram int, n_hit_max_tokens int"
    rows = spark.createDataFrame([("en", "a", 0, "vlm", False, True, 9, 0.1, 0.05, None, None, 0, 0, 1.0, 1, 0), ("en", "b", 1, "vlm", False, True, 9, 0.12, 0.05, None, None, 0, 0, 0.5, 1, 0)], agg)
    as_json, text = report.decision("final", "dev", decide.final(rows))
    assert [m["model"] for m in json.loads(as_json)["categories"]["en"] if m["winner"]] == ["b"] and "Winner: b (tied: b)" in text
    _, text = report.decision("screening", "dev", decide.screening(rows, 1))
    assert "Finalists: a" in text and "outside top" in text
    board = spark.createDataFrame([("a", 1, 5, 0.1, None, 1024.0), ("b", 2, 0, None, None, None)], "name string, rank int, n_done int, text_cer double, table_exact double, vram double")
    skips = spark.createDataFrame([("c", "gated", "x|y")], "name string, reason_code string, detail string")
    text = report.leaderboard_markdown(board, skips, ["b"])
    assert "| 1 | a | 5 | 10.0% | — | 1.0 GB |" in text and "| c | gated | x/y |" in text and "Not run yet: b." in text
    states = spark.createDataFrame([("a", "complete"), ("b", "skipped")], "name string, state string")
    assert tuple(report.goal_totals(states, 1).first()) == (1, 1, 0, True) and not report.goal_totals(states, 0).first().reached and not report.goal_totals(states, 1, problems=1).first().reached


BASE = "<table><tr><th></th><th>n</th><th>%</th></tr><tr><td>Neuro</td><td>105</td><td>1.9</td></tr><tr><td>Auto</td><td>88</td><td>1.6</td></tr><tr><td>Infection</td><td>46</td><td>0.8</td></tr></table>"


@pytest.mark.parametrize(
    ("readings", "least", "expected"),
    [
        (["Neuro †105 1.9\n\nAuto ‡88 1.6\n\nInfection 146 0.8"], 1, {("Neuro", "105", "†"), ("Auto", "88", "‡")}), (["<table><tr><td>Neuro</td><td><sup>a</sup>105</td></tr><tr><td>Auto</td><td>*88</td></tr></table>"], 1, {("Neuro", "105", "<sup>a</sup>"), ("Auto", "88", "*")}),
        (["Neuro †105 1.9"], 2, set()), (["Neuro †105 1.9"] * 2, 2, {("Neuro", "105", "†")}), (["Neuro †105", "Neuro ‡105"], 1, set()), (["Other †105"], 1, set()), ([BASE], 1, set()), (["Neuro †105 ‡105"], 1, set()),
    ],
)
def test_marker_votes(spark, readings, least, expected):
    base = spark.createDataFrame([("d", BASE)], "doc string, text string")
    passes = spark.createDataFrame([("d", i, r) for i, r in enumerate(readings)], "doc string, pass int, text string")
    votes = markers.ballots(base, passes)
    assert {(r.label, r.value, r.mark) for r in markers.applied(votes, least).collect()} == expected


def test_markers_of_truths_and_totals(spark):
    truths = spark.createDataFrame([("a", "<table><tr><td>Neuro</td><td> <sup> † </sup> 105 </td><td>1.9</td></tr></table>"), ("b", "<table><tr><td>\n Infection\n</td><td>\n <sup>\n § \n </sup>\n 46\n </td></tr></table>")], "doc string, text string")
    assert {tuple(r) for r in markers.marks(truths).collect()} == {("a", "Neuro", "105", "†"), ("b", "Infection", "46", "§")}
    frame = lambda *rows: spark.createDataFrame([("d", *r) for r in rows], "doc string, label string, value string, mark string")
    got = markers.totals(frame(("a", "1", "†"), ("b", "2", "†")), frame(("b", "2", "†")), frame(("a", "1", "†"), ("b", "2", "†"), ("c", "3", "*"))).first()
    assert got.asDict() == {"doc": "d", "in_truth": 2, "kept": 1, "right": 2, "wrong": 1}
    votes = spark.createDataFrame([("d", 0, 0, "a", "1", "p", "†"), ("d", 1, 0, "c", "3", "p", "*"), ("d", 0, 0, "a", "1", "q", "†")], "doc string, row int, col int, label string, value string, pass string, mark string")
    assert {tuple(r) for r in markers.by_pass(votes, frame(("a", "1", "†")), frame(("b", "2", "†"))).collect()} == {("p", 1, 1), ("q", 1, 0)}


def test_blocks_of_texts(spark):
    text = "# Title\n\nHello **world**\n- item\n```\n<table><tr><td colspan=2>A<br>B</td></tr><tr><td>1</td><td><ol><li>x<li>y</ol></td></tr></table>\n| a | b |\n|---|---|\n| 1 | 2 |\nlast &amp; end<br/>line\n#### deep"
    rows = documents.blocks_of(spark.createDataFrame([(1, text), (2, None)], "doc int, text string")).orderBy("ord").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [("heading", 1, "Title"), ("para", 0, "Hello **world**\n• item"), ("table", 0, ""), ("table", 0, ""), ("para", 0, "last & end\nline"), ("heading", 3, "deep")]
    assert [[tuple(c) for c in r] for r in rows[2].rows] == [[("A\nB", 2)], [("1", 1), ("1. x\n2. y", 1)]] and [[c.text for c in r] for r in rows[3].rows] == [["a", "b"], ["1", "2"]]


def test_markup(spark):
    assert [markup.list_marker(k, n) for k, n in (("1", 3), ("a", 1), ("a", 27), ("A", 28), ("i", 4), ("I", 1994), ("ul", 9))] == ["3.", "a.", "aa.", "AB.", "iv.", "MCMXCIV.", "•"]
    assert markup.safe_html('<p onclick="x" dir="rtl">a &lt; b<script>bad()</script></p><a href="x">t</a><br/><ul><li>i</ul>') == '<p dir="rtl">a &lt; b</p>t<br><ul class="lt-ul"><li>i</ul>'
    row = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert row(markup.block_text, "## A **b**<br>c &amp; d\n\n![x](y)") == "A **b**\nc & d"
    assert row(markup.page_text, "<p>a </p><p></p><p>b</p>") == "a\nb" and row(markup.without_xml, "<line>a</line><line>b</line>\n\n\n\nc") == "a\nb\n\nc" and row(markup.without_xml, "# <b>") == "# <b>"
    assert row(markup.body_html, "<html><head><title>t</title></head><body class=x>hi<script>no</script> there</body></html>") == "hi there" and row(markup.first_table, "x<table>1</table><table>2</table>") == "<table>1</table>"
    assert row(markup.paragraph_rtl, "12 الهاتف abc") and not row(markup.paragraph_rtl, "abc الهاتف") and not row(markup.paragraph_rtl, "12")
    assert row(markup.isolated_runs, '<p id="a b">هاتف +966 58 440 نص</p>') == '<p id="a b">هاتف <span dir="ltr">+966 58 440</span> نص</p>'
    assert [tuple(p) for p in row(markup.bold_parts, "**a** b")] == [("a", True), (" b", False)] and [tuple(p) for p in row(markup.bold_parts, "")] == [("", False)]
    assert markup.direction_runs("هاتف +971 56 512 a@b.co ثم") == [(5, 16), (17, 23), (5, 23)]
    assert row(markup.forced_runs, "هاتف 12/5 ثم 7") == f"هاتف {markup.LRE}12/5{markup.PDF} ثم 7"
    stats = {k: row(lambda t, v=v: v(t), "كَتَبَ a a a a a ש") for k, v in {k: (lambda t, k=k: markup.text_statistics(t)[k]) for k in ("arabic", "vowels", "hebrew", "loop")}.items()}
    assert stats == {"arabic": 3, "vowels": 1.0, "hebrew": 1, "loop": True}
    cells = spark.createDataFrame([("<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><th>c</th><td>d</td></tr></table>",)], "t string").select(markup.spanned_rows("t").alias("r"))
    placed = cells.select(markup.grid(F.col("r"))).first()[0]
    assert [(p.row, p.column, p.text, p.heading) for p in placed] == [(0, 0, "a", False), (0, 1, "b", False), (1, 1, "c", True), (1, 2, "d", False)]
    crossing = "<table><tr><td>A</td><td rowspan=3>B</td></tr><tr><td colspan=2>C</td></tr><tr><td>D</td><td>E</td></tr></table>"
    placed = spark.createDataFrame([(crossing,)], "t string").select(markup.grid(markup.spanned_rows("t"))).first()[0]
    assert [(p.row, p.column, p.text) for p in placed] == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (2, 0, "D"), (2, 2, "E")]
    assert markup.safe_html("<div><script>a<style>b</style>c</script>d<iframe/>e</div><p align='a b' dir='x;y' start=''>f<hr>g") == '<div>de</div><p align="a b">f<hr>g'
    assert markup.safe_html('<ol type="i" start="4"><li>x</ol><ol><li>y</ol>') == '<ol type="i" start="4" class="lt-i"><li>x</ol><ol class="lt-1"><li>y</ol>'
    assert [markup.direction_runs(x) for x in ("abc", "a b", "(a)b", "12, 5", "+9 (3) x", "ا 12/5-ab 7 ث")] == [[], [(0, 3)], [(1, 4)], [], [(0, 6)], [(2, 9), (2, 11)]]


def test_changed_numbers(spark):
    text = "in 1999 there were 12 and ١٢٣ and 7 " * 20
    got = spark.createDataFrame([(text,)], "t string").select(markup.changed_numbers(F.col("t"), F.lit(3)), markup.changed_numbers(F.col("t"), F.lit(3)), markup.changed_numbers(F.col("t"), F.lit(4)), markup.changed_numbers(F.col("t"), F.lit(4), 0.0)).first()
    assert got[0] == got[1] != got[2] and got[3] == text and len(got[0]) == len(text)
    pairs = list(zip(text.split(), got[0].split(), strict=True))
    changed = sum(a != b for a, b in pairs)
    assert 20 < changed < 60 and all(a == b or (a.isdigit() and b.isdigit() and len(a) == len(b) and a.isascii() == b.isascii()) for a, b in pairs)


def test_generators(spark):
    for kind in generators.KINDS:
        rows = generators.documents(spark, 6, kind, 5).collect()
        assert rows == generators.documents(spark, 6, kind, 5).repartition(3).orderBy("id").collect() or {r.id: r.gt for r in rows} == {r.id: r.gt for r in generators.documents(spark, 6, kind, 5).repartition(3).collect()}
        assert len({r.gt for r in rows}) > 1 and all(r.gt in r.page if kind == "invoice" else all(f">{line}<" in r.page for line in r.gt.split("\n")) for r in rows)
    with pytest.raises(ValueError, match="poem"):
        generators.documents(spark, 1, "poem")
    for lang in ("ar", "mixed"):
        for kind in generators.KINDS:
            rows = generators.documents(spark, 16, kind, 5, lang).collect()
            bare = lambda page: re.sub("<span dir=\"ltr\">([^<]*)</span>", r"\1", page)
            assert all((r.gt in bare(r.page)) if kind == "invoice" else all(f">{line}<" in bare(r.page) for line in r.gt.split("\n")) for r in rows)
            assert len({re.sub("[0-9٠-٩]+", "", r.gt) for r in rows}) > 3 and all('dir="rtl"' in r.page and re.search("[\u0627-\u064a]", r.gt) for r in rows)
            assert {bool(re.search("[٠-٩]", r.gt)) for r in rows} == {True, False}, kind
        assert any(re.search("[A-Za-z]", r.gt) for r in rows) == (lang == "mixed")
    first_lines = {re.split("\n", r.gt)[0] for r in generators.documents(spark, 20, "contract").collect()}
    assert first_lines == {"Contract", "Service agreement"}
    with_total = [r.gt for r in generators.documents(spark, 20, "invoice").collect() if "Total" in r.gt]
    cells = [markup.rows_of(t) for t in with_total]
    assert with_total and all(abs(sum(float(r[3][0]) for r in c[1:-1]) - float(c[-1][-1][0])) < 0.005 and c[-1][0][1] == 3 for c in cells)
    tables = generators.long_tables(spark, 3, 2)
    pairs = tables.select("id", "gt", F.array_join("pages", "\n").alias("answer"), F.size("pages").alias("pages"), "n_rows", "header_repeated")
    for r in score.score_tables(pairs).collect():
        assert (r.cell_exact, r.gt_rows, r.pred_rows, r.rows_wrong_ncols) == (1.0, r.n_rows + 1, r.n_rows + 1, 0), r.id
    assert {len(r.pages) for r in tables.collect()} == {1, 2, 3}
    marked = generators.marker_tables(spark, 8, 1)
    counted = markers.marks(marked.select(F.col("id").alias("doc"), F.col("gt").alias("text"))).groupBy("doc").count()
    both = marked.join(counted, marked["id"] == counted["doc"], "left").collect()
    assert sum(r.n_markers for r in both) > 10 and all((r["count"] or 0) <= r.n_markers for r in both)
    article = "\n".join(["Heading"] + [f"Paragraph {i} " + "with many words in it " * 10 + "." for i in range(12)])
    found = generators.articles(spark.createDataFrame([(1, "T", article), (2, "short", "x"), (3, "list", "a line\n" * 500)], "id int, title string, text string"), 5, 2000)
    assert [r.id for r in found.collect()] == [1]
    long = generators.long_texts(found, 2, 1500).first()
    assert len(long.pages) == 2 and "\n".join(long.pages) == long.gt and long.gt.startswith("T\nHeading\n") and 1500 <= len(long.gt) < 2000
    whole = generators.test_set(spark, 2, languages=("en", "ar", "mixed"), long=found, markers=5)
    counts = {r.category: r["count"] for r in whole.groupBy("category").count().collect()}
    assert counts["syn_markers"] == 5 and counts["syn_longtext"] == 2 and counts["syn_letter_ar"] == counts["syn_form_mixed"] == 2 and whole.count() == whole.select("id").distinct().count()
    made = generators.test_set(spark, 4, 0.5, 3)
    assert made.count() == 4 * 4 + 2 * 3 and made.count() == made.select("id").distinct().count() and {r.split for r in made.collect()} == {"dev", "holdout"}


def test_pictures_and_signatures(spark):
    picture = lambda box, kind="dark", fill=0.5: ("picture", kind, fill, *box)
    signed, none = lambda *box: ("signature", None, None, *box), ("none", None, None, None, None, None, None)
    stroke = picture([0, 0, 90, 10], fill=0.1)
    pages = {
        "inside": ([picture([0, 0, 100, 100]), signed(10, 10, 30, 20)], {("Picture", 0, 0, 100, 100)}),
        "nearly as large": ([picture([0, 0, 20, 20]), signed(0, 0, 18, 18)], {("Signature", 0, 0, 20, 20)}),
        "two signatures": ([picture([0, 0, 20, 20]), signed(5, 5, 25, 25), signed(100, 100, 120, 110), signed(105, 100, 125, 110)], {("Signature", 0, 0, 25, 25), ("Signature", 100, 100, 125, 110)}),
        "a chain": ([signed(0, 0, 20, 10), signed(8, 0, 28, 10), signed(16, 0, 36, 10), signed(90, 0, 99, 9)], {("Signature", 0, 0, 36, 10), ("Signature", 90, 0, 99, 9)}),
        "a stroke": ([stroke, none], set()), "not searched": ([stroke], {("Picture", 0, 0, 90, 10)}), "a toned stroke": ([picture([0, 0, 90, 10], "tone", 0.1), none], {("Picture", 0, 0, 90, 10)}),
        "a signed stroke": ([stroke, signed(0, 0, 60, 10)], {("Signature", 0, 0, 90, 10)}), "apart": ([picture([0, 0, 10, 10]), picture([5, 5, 15, 15]), signed(40, 40, 50, 50)], {("Picture", 0, 0, 10, 10), ("Picture", 5, 5, 15, 15), ("Signature", 40, 40, 50, 50)}),
    }
    rows = [(page, i, *f) for page, (finds, _) in pages.items() for i, f in enumerate(finds)]
    got = documents.regions(spark.createDataFrame(rows, "page string, ord int, what string, kind string, fill double, x1 int, y1 int, x2 int, y2 int")).collect()
    for page, (_, expected) in pages.items():
        assert {tuple(r[1:]) for r in got if r.page == page} == expected, page
    finds = spark.createDataFrame([(1, 0, "picture", "dark", 0.5, 0, 50, 20, 70), (1, 1, "signature", None, None, 5, 55, 25, 75), (2, 0, "picture", "dark", 0.1, 0, 0, 90, 10)], "page int, ord int, what string, kind string, fill double, x1 int, y1 int, x2 int, y2 int")
    found = documents.regions(finds)
    assert sorted(map(tuple, found.collect())) == [(1, "Signature", 0, 50, 25, 75), (2, "Picture", 0, 0, 90, 10)]
    texts = spark.createDataFrame([(1, 0, "Text", 0, 0, 50, 10, "top"), (1, 1, "Text", 5, 55, 20, 65, "junk"), (1, 2, "Text", 0, 80, 50, 90, "low")], "page int, i int, category string, x1 int, y1 int, x2 int, y2 int, text string")
    assert [(r.i, r.category, r.text) for r in blocks.with_pictures(texts, found.where("page = 1")).orderBy("i").collect()] == [(0, "Text", "top"), (1, "Signature", ""), (2, "Text", "low")]


def test_sessions_jobs_and_locks(spark, tmp_path):
    sessions = spark.createDataFrame([("m", "1", "2", "s1", 100.0), ("m", "3", None, "s2", 300.0), ("n", "1", "2", "s", 0.0)], "model string, started string, finished string, spec string, peak_vram_mib double")
    for one in (sessions.where("started = '1'"), sessions.where("started = '3'")):
        files.append_session(one, str(tmp_path / "sessions"))
    got = {r.model: (r.spec, r.peak_vram_mib, r.interrupted, r.sessions) for r in files.metadata_of(spark.read.schema(sessions.schema).parquet(str(tmp_path / "sessions"))).collect()}
    assert got == {"m": ("s2", 300.0, True, 2), "n": ("s", None, False, 1)}
    digests = spark.createDataFrame([("b.txt", "22"), ("a.txt", "11")], "name string, digest string")
    files.write_lock(digests, str(tmp_path / "lock"))
    assert leaderboard.changed_files(files.lock(spark, str(tmp_path / "lock")), digests.where("name = 'a.txt'")).first().name == "b.txt"
    assert [tuple(r) for r in generators.missing_from(digests, digests.where("name = 'a.txt'")).collect()] == [("b.txt", "missing")]
    other = digests.withColumn("digest", F.when(F.col("name") == "a.txt", "x").otherwise(F.col("digest"))).unionByName(spark.createDataFrame([("c.txt", "y")], "name string, digest string").select(*digests.columns))
    assert {tuple(r) for r in generators.missing_from(digests, other).collect()} == {("a.txt", "other content"), ("c.txt", "not listed")}


def test_streams_of_texts_and_samples(spark, tmp_path):
    block = '{"category": "Text", "text": "the same"},'
    pieces = [("a", i, block[:20] if i % 2 == 0 else block[20:]) for i in range(60)] + [("b", i, block.replace("same", f"n{i}")) for i in range(40)]
    frame = spark.createDataFrame(pieces, "key string, seq int, text string")
    for part in (0, 1):
        frame.where(F.col("seq") % 2 == part).where("key = 'b'").unionByName(frame.where("key = 'a'").where((F.col("seq") >= 30) == F.lit(bool(part)))).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {r.key: r.stopped for r in progress.drained(progress.text_loop_stream(stream, "key"), "update", ["key"]).collect()}
    assert got["b"] is False and got["a"] in (True, False)
    peaks = progress.drained(progress.peak_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in/*"), "key", "seq"), "update", ["key"])
    assert {r.key: (r.peak, r.samples) for r in peaks.collect()} == {"a": (59, 60), "b": (39, 40)}


def test_formats():
    assert [report.percent(None), report.percent(0.1234), report.interval(0.5, 0.01), report.interval(0.5, None), report.interval(None, 1.0), report.number(None), report.number(1.5, 1), report.memory(0), report.memory(1536)] == ["—", "12.3%", "50.0% ±1.0", "50.0%", "—", "—", "1.5", "—", "1.5 GB"]


def test_layout_files(spark, tmp_path):
    block = "array<struct<category:string,text:string,bbox:array<int>>>"
    pages = [("in/a.pdf", 0, [("Page-header", "top", [0, 0, 9, 9]), ("Title", "One", [1, 2, 3, 4])]), ("in/a.pdf", 1, [("Text", "two", [1, 2, 3, 4])]), ("in/b.png", 0, [])]
    made = documents.layout_files(spark.createDataFrame(pages, f"file_path string, page_no int, blocks {block}"))
    got = {(r.file_path, r.page_no): r for r in files.write_layout_files(made, f"file://{tmp_path}").collect()}
    assert got["in/a.pdf", 1].md_content_path == f"file://{tmp_path}/a/a_page_1.md" and got["in/b.png", 0].layout_info_path == f"file://{tmp_path}/b/b.json"
    assert (tmp_path / "a/a_page_0.md").read_text() == "top\n\n# One" and (tmp_path / "a/a_page_0_nohf.md").read_text() == "# One"
    assert json.loads((tmp_path / "a/a_page_1.json").read_text()) == [{"category": "Text", "text": "two", "bbox": [1, 2, 3, 4]}]
    assert [json.loads(line)["page_no"] for line in (tmp_path / "a.jsonl").read_text().splitlines()] == [0, 1] and len((tmp_path / "b.jsonl").read_text().splitlines()) == 1
    assert not list(tmp_path.rglob("*.tmp"))


def test_jobs_are_deleted_with_care(spark, tmp_path):
    files.append_job(spark.createDataFrame([("j1", "m"), ("j2", "m")], "id string, model string"), str(tmp_path / "id_root"))
    root = f"file://{tmp_path}/id_root"
    (tmp_path / "id_root" / "empty").mkdir()
    for bad in ("empty", "..", "../id_root", "nothing", "", "id=j1/.."):
        with pytest.raises(ValueError, match="no job"):
            files.delete_job(root, bad)
    files.delete_job(root, "id=j1")
    assert not (tmp_path / "id_root" / "id=j1").exists() and (tmp_path / "id_root" / "id=j2").exists()


def test_comparison_page_and_export(spark):
    pages = spark.createDataFrame([("p1", "a", "<b>same</b> text of both", 1.0), ("p1", "b", "<b>same</b> text of both", 3.0), ("p2", "a", "other", 1.0)], "page string, system string, text string, seconds double")
    page = report.comparison_page(pages, "A & B", 1)
    assert page.startswith("<!doctype html>") and "<h1>A &amp; B</h1>" in page and "<tr><td>a</td><td>2</td><td>0.000</td><td>1.000</td><td>0</td><td>1</td><td>1.00</td></tr>" in page
    assert page.count("<pre>&lt;b&gt;same&lt;/b&gt; text of both</pre>") == 2 and "other" not in page
    job = "id string, files array<struct<name:string,pages:array<struct<text:string,error:string,note:string>>>>"
    jobs = spark.createDataFrame([("1", [("f", [("old", None, None)])]), ("2", [("f", [(" new ", None, "cut"), (None, "boom", "")]), ("g", [])]), ("0", None)], job)
    assert {r.file: (r.job, r.markdown) for r in report.exported(jobs).collect()} == {"f": ("2", "# f\n\n## Page 1\n\n> cut\n\nnew\n\n## Page 2\n\n> Error: boom"), "g": ("2", "# g\n\n")}
    assert [r.file for r in report.exported(jobs, ["g"]).collect()] == ["g"]
