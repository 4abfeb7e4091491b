"""Text, metrics, tables and layout on cases with known values."""

import math
import random

import pytest
from gradeflow.functions import hashing, layout, metrics, tables, text
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("مُحَمَّد", "محمد"), ("كتـــاب", "كتاب"), ("١٢٣ ٫ ۴", "123 . 4"), ("ﻻ", "لا"), ("a‏ b﻿", "a b"), ("# Title\n\n- item **bold**", "Title item bold"),
        ("x < 5 and y > 3", "x < 5 and y > 3"), ("<p>a&amp;b</p><p>c</p>", "a&b c"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a b 1 2"), ("[t](u) ![i](v)", "t"), (" a b\u001cc ", "a b c"),
    ],
)
def test_normalize(spark, given, expected):
    assert spark.createDataFrame([(given,)], "t string").select(text.normalize(F.col("t"))).first()[0] == expected


def test_plain_text_lines(spark):
    given = ["a\n", "", "```py\ncode\n```", "<td>1</td><td>2 &lt; 3</td><br/>x", "1. a\r\n* b\x0bc", "a &amp; b", "[![alt](i)](u) __x__", "|a|\n|:--:|"]
    expected = ["a", "", "code", "1  2 < 3\nx", "1. a\nb\nc", "a &amp; b", " x", "a"]
    got = [r[0] for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string").orderBy("i").select(text.plain_text(F.col("t"))).collect()]
    assert [g.strip() for g in got] == [e.strip() for e in expected]


def test_native_normalisation_agrees(spark):
    cases = ["مُحَمَّد ٣", "a  b\u001cc\n", "كتـــاب", "", "plain"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.normalize_native(F.col("t")).alias("n"), text.normalize(F.col("t")).alias("p")).collect()
    assert all(r.n == r.p for r in rows)


def test_unknown_rules_are_errors():
    with pytest.raises(ValueError, match="nfk"):
        text.Rules.of({"nfk": True})


def test_answers_and_pages(spark):
    row = spark.sql("SELECT '<think>x</think> {\"text\": \" hi \", \"n\": 1} tail' AS a, '1-3,5' AS s, '' AS e, '2-99' AS o, '5-3' AS back")
    got = row.select(text.answer_of(F.col("a"), "text"), text.answer_of(F.col("a"), "n"), *(text.page_numbers(F.col(c), F.lit(n)) for c, n in (("s", 10), ("e", 3), ("o", 4), ("back", 9)))).first()
    assert got[0] == "hi" and got[1].startswith("{") and list(got[2:]) == [[1, 2, 3, 5], [1, 2, 3], [2, 3, 4], []]


def test_edit_rates(spark):
    rows = spark.createDataFrame([("Total due: 1250 USD", "Total due: 1205 USD"), ("Total due: 1250 USD", "Tota1 due 1250 USD"), ("", ""), ("", "x"), ("كتب", "كتبة")], "g string, a string")
    s = metrics.edit_stats(F.col("g"), F.col("a"))
    got = rows.select(s["char_edits"], s["ref_chars"], s["word_edits"], s["ref_words"], metrics.error_rate(s["char_edits"], s["ref_chars"])).collect()
    assert [tuple(r[:4]) for r in got] == [(2, 19, 1, 4), (2, 19, 2, 4), (0, 0, 0, 0), (1, 0, 1, 0), (1, 3, 1, 1)] and [r[4] for r in got[2:4]] == [0.0, 1.0]


def test_word_edits_against_python(spark):
    rng = random.Random(1)
    pairs = [tuple(" ".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(0, 15))) for _ in range(2)) for _ in range(40)]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, g string, a string").orderBy("i").select(metrics.word_edits(F.col("g"), F.col("a")).alias("n")).collect()

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    assert [r.n for r in got] == [brute(a.split(), b.split()) for a, b in pairs]


@pytest.mark.parametrize(("k", "n", "percent"), [(0, 20, 16.1), (0, 60, 6.0), (0, 300, 1.3), (1, 60, 8.9), (3, 60, 13.7)])
def test_wilson(spark, k, n, percent):
    got = spark.range(1).select(metrics.wilson_upper(F.lit(k), F.lit(n)).alias("u"), metrics.wilson_upper(F.lit(0), F.lit(0)).alias("none")).first()
    assert round(100 * got.u, 1) == percent and got.none is None


def test_quantiles(spark):
    import statistics

    rng = random.Random(3)
    groups = {f"g{n}": [float(rng.randint(0, 5)) for _ in range(n)] for n in (1, 2, 3, 6, 11, 16)}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    got = {r.g: (r.v_median, r.v_p) for r in metrics.quantiles(rows, [("g",), ()], "v").collect()}
    groups[None] = [v for vs in groups.values() for v in vs]
    assert got == {g: (statistics.median(vs), sorted(vs)[min(len(vs) - 1, round(0.9 * (len(vs) - 1)))]) for g, vs in groups.items()}


def test_repetition():
    assert metrics.repeated_unit("normal normal normal") is None
    assert metrics.repeated_unit("the same phrase " * 30)
    assert metrics.repeated_unit("0.00 " * 50) is None and metrics.repeated_unit("." * 300) is None
    assert metrics.repeated_unit("ab" * 49) is None and metrics.repeated_unit("ab" * 50) and metrics.repeated_unit("x " * 50)
    assert metrics.repeated_unit("a b" * 9) is None and metrics.repeated_unit("one two\n" * 8 + "one  two " * 8) is None


def test_repetition_of_columns(spark):
    cells = "<table>" + "<tr><td></td><td></td></tr>" * 60 + "</table>"
    rows = spark.createDataFrame([(0, "a line that comes again\n" * 12), (1, cells), (2, None), (3, "short")], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(metrics.has_repetition(F.col("t"))).collect()] == [True, False, False, False]


def test_flags(spark):
    ref = "r" * 100
    rows = spark.createDataFrame([(ref, "", None), (ref, "x" * 160, None), (ref, "x" * 40, None), (ref, "", "boom"), ("short", "x" * 90, None), (ref, ref, None)], "g string, a string, e string")
    assert [r[0] for r in rows.select(metrics.flags(F.col("g"), F.col("a"), F.col("e"))).collect()] == [["empty"], ["too_long"], ["too_short"], ["error"], [], []]


def test_position_recall():
    words = [f"w{i}" for i in range(400)]
    assert metrics.recall_by_position(" ".join(words), " ".join(words[:250]))[::3] == [1.0, 0.0]
    got = metrics.recall_by_position(" ".join(words), " ".join(words[:200]))
    assert got[0] == 1.0 and got[3] == 0.0 and metrics.recall_by_position("", "x") == [None] * 4


def test_passages_are_found_as_by_all_windows():
    rng = random.Random(4)
    for _ in range(400):
        passage = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 40)))
        changed = [rng.choice("abcdx") if rng.random() < 0.15 else c for c in passage]
        whole = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) + "".join(changed[rng.randint(0, 3) :]) + "abc" * rng.randint(0, 5)
        assert metrics.Searched(whole).holds(passage, 85) == (metrics.partial_ratio(passage, whole) >= 85)


def test_distance_by_bits():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 150))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        assert metrics.distance(a, b) == row[-1]


def test_partial_ratio():
    assert metrics.partial_ratio("abc", "xxabcxx") == 100 and metrics.partial_ratio("", "") == 100 and metrics.partial_ratio("abc", "") == 0
    assert 0 < metrics.partial_ratio("abcd", "xxabxd") < 100


def html(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


TRUTH = [["Item", "Count", "Price"], ["Pen", "10", "12345"], ["Ink", "2", "500"], ["Pad", "7", "900"]]


def measured(spark, pairs):
    from gradeflow.operators import score

    rows = spark.createDataFrame([(i, t, a, n) for i, (t, a, n) in enumerate(pairs)], "i int, gt string, answer string, pages int")
    return score.score_tables(rows).orderBy("i").collect()


def test_table_measures(spark):
    digit = [r[:] for r in TRUTH]
    digit[1][2] = "12346"
    row, cell = TRUTH[:1] + TRUTH[2:], [r[:] for r in TRUTH]
    cell[1] = ["Pen", "12345"]
    nodes = 2 + 4 + 12
    cases = [(digit, 0.2, 11 / 12, 11 / 12, 0), (row, 4, 3 / 12, 9 / 12, 0), (cell, 1, 10 / 12, 10 / 12, 1)]
    got = measured(spark, [(html(TRUTH), html(a), 1) for a, *_ in cases] + [("no table", html(TRUTH), 1), (html(TRUTH), "none", 1), ("<table></table>", "x", 1)])
    for r, (_, distance, exact, aligned, wrong) in zip(got, cases):
        assert (r.cell_exact, r.cell_aligned, r.rows_wrong_ncols) == (exact, aligned, wrong) and math.isclose(r.teds, 1 - distance / nodes, abs_tol=1e-9)
    assert got[0].teds_struct == 1.0 and got[3].teds is None and got[3].gt_rows is None and (got[4].teds, got[4].cell_exact, got[4].pred_rows) == (0.0, 0.0, 0) and got[5].gt_rows is None


def test_tree_distance_against_recursion():
    rng = random.Random(5)

    def random_table():
        return [[[tables.Cell(rng.choice(["a", "b", ""]), rng.choice([1, 1, 2])) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 2))]

    def forest(ts):
        return (("body", 1, 1, "", tuple(("table", 1, 1, "", tuple(("tr", 1, 1, "", tuple(("td", c.colspan, c.rowspan, c.text, ()) for c in r)) for r in t)) for t in ts)),)

    def size(f):
        return sum(1 + size(n[4]) for n in f)

    known = {}

    def distance(f, g):
        if not f or not g:
            return size(f) + size(g)
        if (f, g) not in known:
            (*fs, a), (*gs, b) = f, g
            rename = float(a[:3] != b[:3]) or float(a[3] != b[3])
            known[f, g] = min(distance((*fs, *a[4]), g) + 1, distance(f, (*gs, *b[4])) + 1, distance(tuple(fs), tuple(gs)) + distance(a[4], b[4]) + rename)
        return known[f, g]

    for _ in range(60):
        a, b = random_table(), random_table()
        assert tables.tree_distance(tables.Tree.of(a), tables.Tree.of(b)) == distance(forest(a), forest(b))
    shared = random_table()[:1] or [[]]
    for _ in range(60):
        a, b = ([shared[0] + (random_table() or [[]])[0] + shared[0]] for _ in range(2))
        rows = [[[[{"text": c.text, "colspan": c.colspan, "rowspan": c.rowspan} for c in r] for r in t] for t in side] for side in (a, b)]
        most = max(size(forest(t)) for t in (a, b))
        assert math.isclose(tables._similar(*rows, 1)["teds"], max(0.0, 1 - distance(forest(a), forest(b)) / most))


def test_long_tables_and_markdown(spark):
    rows = [["d", "x", "in", "out"], *([f"{i}", f"t{i}", str(i) if i % 2 else "", "" if i % 2 else str(i)] for i in range(40))]
    short = [rows[0], *([c for k, c in enumerate(r) if c or k < 2] for r in rows[1:])]
    pages = html(rows[:21]) + html(rows[:1] + rows[21:])
    got = measured(spark, [
        (html(rows), html(rows[:5] + rows[6:]), 1), (html(rows), html(rows[:20] + rows[:1] + rows[20:]), 1), (html([["أ", "١"], ["b", "2"]]), "| أ | 1 |\n|---|---|\n| b | 2 |", 1),
        (html(rows), pages, 2), (html(rows), html(short), 1), (html([["a<b>x</b>&amp;", "2"]]), "| a**x**& | <i>2</i> |", 1),
    ])
    assert got[0].cell_aligned > 0.95 and got[0].cell_exact < 0.4 and got[0].pos_q[3] == 1.0 > min(got[0].pos_q)
    assert got[1].cell_exact == 1.0 and got[2].teds == 1.0 and got[3].teds == 1.0 and got[4].rows_wrong_ncols == 40 and got[5].teds == 1.0


def test_exact_cells_native(spark):
    cases = [(TRUTH, TRUTH[:1] + TRUTH[2:]), (TRUTH, TRUTH[:2] + TRUTH[:1] + TRUTH[2:]), (TRUTH, [r[:2] for r in TRUTH]), (TRUTH, [])]
    got = spark.createDataFrame(cases, "t array<array<string>>, a array<array<string>>").select(tables.exact_cells(F.col("t"), F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == [3 / 12, 1.0, 8 / 12, 0.0]


def parsed(spark, texts, size=(None, None)):
    rows = spark.createDataFrame([(i, t, *size) for i, t in enumerate(texts)], "i int, t string, w int, h int")
    return [r.p for r in rows.orderBy("i").select(layout.parse_layout(F.col("t"), F.col("w"), F.col("h")).alias("p")).collect()]


def test_layout_parse_and_repair(spark):
    import json

    blocks = [{"bbox": [0, 0, 28, 28], "category": "Title", "text": "T"}, {"bbox": [0, 28, 28, 56], "category": "Text", "text": "a \"q\" {x}"}]
    whole = json.dumps(blocks)
    odd = [{"bbox": [1.9, "2", 3, 4], "text": 5}, {"category": None, "bbox": [1]}, 7]
    got = parsed(spark, [whole, "```json\n" + json.dumps({"n": 1, "layout": blocks}) + "\n```", json.dumps({"category": "Title", "text": "T"}), whole[:-30], "nothing", json.dumps(blocks + blocks), json.dumps(odd), whole[:-3] + ",}, {", None, "[]"])
    assert [p.status for p in got] == ["ok", "ok", "ok", "repaired", "failed", "repaired", "ok", "repaired", "failed", "failed"]
    assert [[b.text for b in p.blocks] for p in got[:4]] == [["T", blocks[1]["text"]]] * 2 + [["T"]] * 2  # a block's own box is the first list of an object
    assert [tuple(b) for b in got[6].blocks] == [("Text", "5", [1, 2, 3, 4]), ("Text", "", None)] and len(got[7].blocks) >= 1
    assert parsed(spark, [whole], (56, 112))[0].blocks[0].bbox == [0, 0, 28, 28]
    closed = layout.close_truncated(whole[:-4])
    assert json.loads(closed)[0] == blocks[0] and layout.close_truncated(whole) == whole and layout.close_truncated(whole[:10]) == whole[:10]
    assert json.loads(layout.close_truncated(whole[:-3] + "the same line. " * 40))[1]["text"].count("same") == 2
    assert json.loads(layout.close_truncated(whole[:-3] + "end\\u00"))[1]["text"].endswith("end")


def test_layout_loops(spark):
    cells = lambda n, t: "[" + ",".join(f'{{"bbox":[0,{i},1,2],"category":"Text","text":"{t}"}}' for i in range(n))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([cells(4, "repeated"), cells(30, "repeated"), cells(60, "ab"), cells(30, "repeated") + cells(1, "other ones"), "", "x" * 50_000])], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(layout.layout_loops(F.col("t"))).collect()] == [False, True, False, False, False, False]
    assert layout.stream_loops(list(range(100)) * 8) and not layout.stream_loops(list(range(100)) * 7) and layout.stream_loops([1, 2] * 300)


def test_layout_columns(spark):
    sizes = [(1000, 700), (10, 10), (9000, 6000), (42, 98), (2800, 1400)]
    got = spark.createDataFrame(sizes, "h int, w int").select(F.struct(*layout.model_size(F.col("h"), F.col("w")))).collect()
    for (h, w), r in zip(sizes, got, strict=True):
        assert r[0][0] % 28 == r[0][1] % 28 == 0 and 3136 <= r[0][0] * r[0][1] <= 11289600 and abs(r[0][0] / r[0][1] / (h / w) - 1) < 0.5
    assert [tuple(r[0]) for r in got][:2] == [(1008, 700), (56, 56)]
    blocks = spark.sql("SELECT array(named_struct('category', 'Title', 'text', 'A'), named_struct('category', 'Page-footer', 'text', '1'), named_struct('category', 'List-item', 'text', '2. x'), named_struct('category', 'Text', 'text', ' ')) AS b")
    assert blocks.select(layout.to_markdown(F.col("b"), ("Page-footer",))).first()[0] == "# A\n\n2. x"


def test_hash_fraction_against_python(spark):
    import hashlib

    keys = ["a", "13:src4", "é"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(hashing.fraction(F.col("k")), hashing.shard_of(F.col("k"), 7)).collect()
    for k, r in zip(keys, got, strict=True):
        digest = hashlib.sha256(k.encode()).digest()
        assert r[0] == int.from_bytes(digest[:8], "big") / 2**64 and r[1] == int.from_bytes(digest[:4], "big") % 7
