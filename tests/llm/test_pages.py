"""WARC archives and URL rules."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("gradeflow.llm")
from gradeflow.llm import queries, storage, urlfilter, warc  # noqa: E402

LONG = "<p>" + "payload " * 200 + "</p>"
PAGES = [(1, "http://a.com/x", LONG), (2, "http://a.com/y", LONG), (3, None, None), (4, "http://b.com/", ""), (5, "u\r\nEvil: yes", "short"), (6, "s", "short"), (7, "é", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + LONG), (7, "é2", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + LONG), (None, "n", "x")]


@pytest.fixture(scope="module")
def archive(spark):
    uri = f"{storage.shared_dir(spark)}/test-warc-{storage.unique()}"
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("bytes", F.lit("clash")), uri)
    return uri


def test_round_trip(spark, archive):
    got = warc.check_payloads(warc.read(spark, archive)).collect()
    sizes = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got if r.page_id is not None)
    assert sizes == sorted((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in PAGES if i is not None)
    by = {r.page_id: r for r in got if r.page_id not in (7, None)}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type, by[2].refers_to) == ("revisit", 2, "response", None)
    assert all(by[i].record_type == "response" for i in (3, 4, 5, 6))
    assert sorted(r.record_type for r in got if r.page_id == 7) == ["response", "revisit"]
    assert len(got) == len(PAGES)
    payloads = {r.page_id: bytes(r.payload) for r in warc.read(spark, archive).where("record_type = 'response'").collect()}
    assert payloads[2] == LONG.encode() and payloads[3] == b""


def test_splits_and_pushed_filters(spark, archive):
    small = spark.read.format("warc").option("splitBytes", "700").schema(warc.HEADER_COLUMNS).load(archive)
    assert small.count() == len(PAGES)
    kept = small.where("record_type = 'revisit' AND page_id = 1")
    assert [r.refers_to for r in kept.collect()] == [2]
    assert "record_type" in kept._jdf.queryExecution().executedPlan().toString()
    reader = warc.WarcReader(warc.read(spark, archive).schema, {"path": archive})
    from pyspark.sql.datasource import EqualTo, StringContains

    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("url",), "a")])) == [StringContains(("url",), "a")]
    found = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert {r["record_type"] for r in found} == {"revisit"} and all(r["payload"] is None for r in found)


def test_archives_are_as_the_standard_asks(spark, archive):
    from pathlib import Path

    text = "".join(p.read_text(newline="") for p in sorted(Path(archive.removeprefix("file://")).glob("part-*")))
    heads = [h for h in text.split("\r\n\r\n") if h.startswith("WARC/1.1\r\nWARC-Type")]
    assert len(heads) == len(PAGES) and len({h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in heads}) == len(PAGES)
    assert all(h.count("\r\nWARC-Date: 2") == 1 and "\r\nContent-Length: " in h for h in heads)


def test_very_long_payloads_and_an_index(spark, monkeypatch):
    pages = [(i, f"http://a.com/{i}", f"{i} " + "long payload WARC/1.1\r\n\r\n" * (40_000 if i % 5 == 0 else 50)) for i in range(40)]
    uri = f"{storage.shared_dir(spark)}/test-warc-{storage.unique()}"
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), uri)
    got = {r.page_id: bytes(r.payload).decode() for r in spark.read.format("warc").option("splitBytes", "300000").schema(warc.SCHEMA).load(uri).collect()}
    assert got == {i: h for i, _, h in pages}


def test_empty_archive(spark):
    uri = f"{storage.shared_dir(spark)}/test-warc-{storage.unique()}"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), uri)
    assert warc.read(spark, uri).collect() == []


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:].split("?")[0].split("#")[0]
    fits = [(-len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(min(fits)[1:] if fits else (None, "allow")))


def test_rules(spark, sf_dir):
    rules = [*queries.URL_RULES, *(("allow" if k % 2 else "block", "deep.org", "/" + "d" * k) for k in range(60)), ("block", "com", ""), ("allow", "a.com", "/x/y"), ("block", "a.com", "/x"), ("allow", "a.com", "/x/"), ("block", "b.a.com", "/x/y/z")]
    urls = [None, "", "no scheme", "http://", "http://A.com", "https://a.com/x/y/z?q", "x://b.a.com/x/y/z", "x://ba.com/x/y", "http://a.com?x/", "http://a.com#/x", "http://a.com/xy", "://a.com/x/", "http://é.net/de/", "http://example.net/de/8?a#b", "http://a.com/x\n/y", "HTTP://B.A.COM/X", "http://a.com/x/\U0010ffffx", "http://deep.org/" + "d" * 80, "http://x.deep.org/ddd/d", "http://deep.org/" + "d" * 59 + "\uffff", "http://a.com/x/" + "long" * 5000] * 2
    urls += [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    frame = spark.createDataFrame(list(enumerate(urls)), "id long, url string").withColumn("host", F.lit("clash"))
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(frame, urlfilter.rule_table(spark, rules)).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    spread = [(i % 3 if i % 7 else None, f"http://s{i}.a.com/x/y{i}") for i in range(300)]
    assert Counter((r.id, r.rule) for r in urlfilter.judge(spark.createDataFrame(spread, "id long, url string"), urlfilter.rule_table(spark, rules), swept=5).collect()) == Counter((i, brute_verdict(u, rules)[2]) for i, u in spread)
    assert {r.verdict for r in urlfilter.judge(frame, urlfilter.rule_table(spark, rules).limit(0)).collect()} == {"allow"}
    assert urlfilter.judge(frame.limit(0), urlfilter.rule_table(spark, rules)).collect() == []
