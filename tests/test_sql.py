"""The SQL facade, merged logs, wrapped texts and the window of work."""

import os
import time

import pandas as pd
import pytest
from gradeflow import sql
from gradeflow.functions import metrics, text
from gradeflow.operators import documents, predictions
from gradeflow.sources import records
from gradeflow.streaming import work
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def registered(spark):
    sql.register(spark)


def test_functions(spark, registered):
    row = spark.sql("SELECT error_rate(3, 4), error_rate(0, 0), error_rate(2, 0), wilson_upper(0, 0), wilson_upper(5, 5), split_of('a', 13, 1.0D), split_of('a', 13, 0.0D), shard_of('x', 1)").first()
    assert tuple(row) == (0.75, 0.0, 1.0, None, 1.0, "holdout", "dev", 0)
    for r in spark.sql("SELECT id AS k, wilson_upper(id, 10) AS bound FROM range(11)").withColumn("own", metrics.wilson_upper(F.col("k"), F.lit(10))).collect():
        assert abs(r.bound - r.own) < 1e-12


def test_functions_are_inlined(spark, registered):
    plan = spark.sql("SELECT error_rate(id, id + 1) AS r FROM range(5)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CASE WHEN" in plan


def test_table_functions_keep_the_other_columns(spark, registered):
    rows = spark.createDataFrame([(1, "x", '[{"bbox":[1,2,3,4],"category":"Text","text":"a"},{"bbox":[1,2,3,4],"category":"Text","text":"a"},{"bbox":[5,6,7,8],"text":"b"'), (2, None, None), (3, "y", "```json\n[]\n```")], "id int, other string, json string")
    rows.createOrReplaceTempView("pages_of_test")
    got = spark.sql("SELECT * FROM layout_blocks(TABLE(pages_of_test), 'json')")
    assert got.columns == ["id", "other", "ord", "category", "text", "bbox", "status"]
    assert [tuple(r) for r in got.collect()] == [(1, "x", 0, "Text", "a", [1, 2, 3, 4], "repaired")]
    for call, why in (("layout_blocks(TABLE(pages_of_test), 'nothing')", "name of a column"), ("text_blocks(TABLE(SELECT 1 AS ord, 'x' AS t), 't')", "columns of the function")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_table_cells(spark, registered):
    html = "<table><tr><td>A</td><td rowspan=3>B</td></tr><tr><td colspan=2>C</td></tr><tr><td>D</td><td>E<br>F</td></tr></table>"
    spark.createDataFrame([(html,), (None,), ("no table",)], "html string").createOrReplaceTempView("tables_of_test")
    assert [tuple(r)[:3] for r in spark.sql("SELECT * FROM table_cells(TABLE(tables_of_test), 'html')").collect()] == [(0, 0, "A"), (0, 1, "B"), (1, 0, "C"), (2, 0, "D"), (2, 2, "E\nF")]


def test_text_blocks_are_those_of_the_engine(spark, registered, sf_dir):
    said = "# Title #\n\nHello **world**\n- item\n```\n<table><tr><td colspan=2>A<br>B</td></tr><tr><td>1</td><td>2</td></tr></table>\n| a | b |\n|---|---|\n| 1 | 2 |\nlast &amp; end<br/>line\n#### deep\n# two\n|x"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("int").alias("doc"), "text").unionByName(spark.createDataFrame([(-1, said), (-2, None), (-3, "")], "doc int, text string"))
    docs.createOrReplaceTempView("texts_of_test")
    mine = spark.sql("SELECT doc, ord, kind, level, said FROM text_blocks(TABLE(texts_of_test), 'text')")
    lines = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: c["text"]), " | ")), "\n")
    theirs = documents.blocks_of(docs).select("doc", "ord", "kind", "level", F.when(F.col("kind") == "table", lines).otherwise(F.col("text")).alias("said"))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))


def test_logs_merge_in_any_order(spark):
    schema = "id string, seq long, text string, error string"
    a = spark.createDataFrame([("x", 1, "one", None), ("x", 2, None, "torn"), ("y", 1, "p", None), (None, 5, "n", None)], schema)
    b = spark.createDataFrame([("x", 2, "two", None), ("x", 3, "three", None), ("x", 3, "three", None), ("y", 1, "q", None)], schema)
    expected = {("x", 1, "one", None), ("x", 2, "two", None), ("x", 3, "three", None), ("y", 1, "q", None), (None, 5, "n", None)}
    for logs in ((a, b), (b, a), (b, a, b)):
        got = predictions.merged_logs(*logs)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
        assert predictions.lost_records(got, a.where("id IS NOT NULL")).isEmpty() and predictions.lost_records(got, b).isEmpty()
    more = predictions.merged_logs(a.limit(0), b.withColumn("extra", F.lit(1)))
    assert more.columns == ["id", "seq", "text", "error", "extra"] and more.count() == 3


def brute_wrap(said, width):
    def wide(t):
        return sum(next((w for alike, w in text.NARROW_AND_WIDE.items() if c in alike), text.COMMON_WIDTH) for c in t)

    lines = []
    for paragraph in said.split("\n"):
        line = ""
        for word in paragraph.split(" "):
            longer = f"{line} {word}" if line else word
            if line and wide(longer) > width:
                lines.append(line)
                longer = word
            line = longer
        lines.append(line)
    return lines


def test_wrapped_lines(spark):
    said = ["", "one", "a few words that go over several lines, with (marks) and WIDE LETTERS", "two\n\nparagraphs  with   blanks ", "averyverylongwordthatfitsnowhere and more", " leading", "é ü \U0001f600 mm"]
    frame = spark.createDataFrame([(i, s, w) for i, s in enumerate(said) for w in (0, 3000, 9000, 10**6)], "i int, said string, width int")
    for r in frame.select("*", text.wrapped(F.col("said"), F.col("width")).alias("lines")).collect():
        assert r.lines == brute_wrap(r.said, r.width), (r.said, r.width)
    assert spark.createDataFrame([(None,)], "s string").select(text.wrapped(F.col("s"), F.lit(5))).first()[0] is None


def test_a_bounded_window_of_work(spark, tmp_path):
    class Model:
        """Fails on some items, and on every batch that holds one."""

        def load(self):
            self.most = 0

        def predict_batch(self, frame):
            if frame["id"].isin(["3", "17"]).any():
                raise ValueError("bad item")
            return pd.DataFrame({"id": frame["id"], "text": frame["gt"].str.upper(), "confidence": [float(len(frame))] * len(frame)})

        def close(self):
            pass

    for i in range(20):
        pd.DataFrame({"id": [str(i)], "gt": [f"text {i}"]}).to_parquet(tmp_path / f"{i:02d}.parquet")
        os.utime(tmp_path / f"{i:02d}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    places = str(tmp_path / "log"), str(tmp_path / "state")
    query = work.worked(spark, f"{tmp_path}/*.parquet", "id string, gt string", Model(), *places, adapters=1, batch=3)
    query.awaitTermination()
    assert [b.numInputRows for b in query.recentProgress if b.numInputRows] == [6, 6, 6, 2]
    schema = spark.createDataFrame([], predictions.ANSWERS).schema
    got = {r.id: r for r in records.read(spark, places[0], schema).collect()}
    assert len(got) == 20 and {i for i, r in got.items() if r.error} == {"3", "17"} and got["3"].error == "ValueError: bad item" and got["4"].text == "TEXT 4"
    assert max(r.confidence for r in got.values() if r.confidence) <= 3
    pd.DataFrame({"id": ["new"], "gt": ["x"]}).to_parquet(tmp_path / "later.parquet")
    work.worked(spark, f"{tmp_path}/*.parquet", "id string, gt string", Model(), *places, adapters=1, batch=3).awaitTermination()
    assert sorted(r.id for r in records.read(spark, places[0], schema).collect()) == sorted([*got, "new"])
