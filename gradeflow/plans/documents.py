"""Queries of texts in relational form: blocks, runs, statistics, notes, markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import markup
from ..operators import documents, markers
from ..sources import generators
from .registry import query, table


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS k, regexp_replace(unnest(x), '^ +| +$', '', 'g') AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r]') AS x FROM documents)),
  k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '|') AND length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(line, '^#{1,6}\s+') THEN 'heading' ELSE 'para' END AS kind FROM l WHERE NOT starts_with(line, '```')),
  f AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY k) IS DISTINCT FROM kind OR kind = 'heading' THEN 1 ELSE 0 END AS fresh FROM k),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM f),
  b AS (SELECT doc_id, run, kind, min(k) AS first, string_agg(CASE kind WHEN 'para' THEN regexp_replace(regexp_replace(line, '^-\s+', '• '), '^[*+]\s+', '• ') WHEN 'heading' THEN trim(regexp_replace(line, '^#{1,6}\s+', '')) END, chr(10) ORDER BY k) AS text FROM r WHERE kind <> 'blank' GROUP BY ALL)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INTEGER AS ord, kind, coalesce(text, '') AS text FROM b""")
def text_to_blocks(spark, sf_dir):
    """Documents have lines and empty lines, but no HTML."""
    out = documents.blocks_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return out.select("doc_id", "ord", "kind", "text")


@query(r"""WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '<style\b[^>]*>.*?</style\s*>', '', 'gis'), '<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<head\b[^>]*>.*?</head\s*>', '', 'gis') AS bare FROM pages)
  SELECT page_id, sha256(trim(regexp_extract(bare, '<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1, 'is'))) AS body, CASE WHEN page_id % 2 = 1 THEN '<TABLE x="1">' || page_id || chr(10) || '</table>' ELSE sha256(html) END AS first_table FROM t""")
def page_bodies(spark, sf_dir):
    """Pages have no tables, so the first table is the page; every second gets two."""
    pages, odd = table(spark, sf_dir, "pages"), F.col("page_id") % 2 == 1
    tables = F.concat("html", F.lit('<TABLE x="1">'), F.col("page_id").cast("string"), F.lit("\n</table><p></p><table></table>"))
    found = markup.first_table(F.when(odd, tables).otherwise(F.col("html")))
    return pages.select("page_id", F.sha2(markup.body_html(F.col("html")), 256).alias("body"), F.when(odd, found).otherwise(F.sha2(found, 256)).alias("first_table"))


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\s\x0B\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]+'), lambda x: x <> '') AS w FROM documents)
  SELECT doc_id, length(text)::INTEGER AS n_chars, len(regexp_extract_all(text, '[\x{0621}-\x{063A}\x{0641}-\x{064A}\x{0671}-\x{06D3}]'))::INTEGER AS arabic, len(regexp_extract_all(text, '[\x{05D0}-\x{05EA}]'))::INTEGER AS hebrew,
    len(list_filter(range(5, len(w) + 1), lambda i: w[i] = w[i - 1] AND w[i] = w[i - 2] AND w[i] = w[i - 3] AND w[i] = w[i - 4])) > 0 AS loop FROM w""")
def text_statistics(spark, sf_dir):
    found = markup.text_statistics(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(found[k].alias(k) for k in ("n_chars", "arabic", "hebrew", "loop")))


#: Letters that become Arabic letters and vowel marks.
_LATIN, _ARABIC = "nrtslaeiou", "نرتسلَُِْٰ"


@query(rf"""WITH t AS (SELECT doc_id, translate(text, '{_LATIN}', '{_ARABIC}') AS text FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{{0646}}\x{{0631}}\x{{062A}}\x{{0633}}\x{{0644}}]')) AS n, len(regexp_extract_all(text, '[\x{{064E}}\x{{0650}}\x{{064F}}\x{{0652}}\x{{0670}}]')) AS m FROM t)
  SELECT doc_id, n::INTEGER AS arabic, round(m / greatest(n, 1)::DOUBLE, 3) AS vowels FROM c""")
def vowel_marks(spark, sf_dir):
    found = markup.text_statistics(F.translate("text", _LATIN, _ARABIC))
    return table(spark, sf_dir, "documents").select("doc_id", found["arabic"].alias("arabic"), found["vowels"].alias("vowels"))


@query(r"""WITH t AS (SELECT doc_id AS line, generate_subscripts(x, 1) - 1 AS ord, unnest(x) AS token FROM (SELECT doc_id, string_split(text, ' ') AS x FROM documents)),
  m AS (SELECT *, regexp_matches(token, '[A-Za-z]') AS alpha FROM t), f AS (SELECT *, CASE WHEN lag(alpha) OVER (PARTITION BY line ORDER BY ord) IS DISTINCT FROM alpha THEN 1 ELSE 0 END AS fresh FROM m),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY line ORDER BY ord) AS run FROM f)
  SELECT line, min(ord)::INTEGER AS first, max(ord)::INTEGER AS last, any_value(alpha) AS alpha FROM r GROUP BY line, run""")
def token_runs(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.posexplode(F.split("text", " ")).alias("ord", "token"))
    return documents.token_runs(tokens)


@query(r"""WITH s AS (SELECT doc_id, regexp_extract(text, '[A-Za-z\x{00C0}-\x{024F}\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]') AS c FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '12 שלום ' || text ELSE text END AS text FROM documents))
  SELECT doc_id, c <> '' AND unicode(c) >= 1424 AS rtl FROM s""")
def paragraph_directions(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("12 שלום "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", markup.paragraph_rtl(text).alias("rtl"))


@query(r"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ش' || text ELSE text END AS text FROM documents), t AS (SELECT doc_id, trim(nfc_normalize(CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 35) ELSE text END)) AS t FROM n)
  SELECT doc_id, CASE WHEN length(t) >= 30 AND NOT regexp_matches(t, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]') THEN sha256(t) END AS layer FROM t""")
def text_layers(spark, sf_dir):
    """Texts as the layers of pages: every fifth begins with an Arabic letter, every second is cut."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("ش"), "text")).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 2 == 0, F.substring(text, 1, 35)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(documents.text_layer(text), 256).alias("layer"))


@query("""SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
  nullif(concat_ws('; ', CASE WHEN l_returnflag = 'R' THEN 'looping, stopped early' END, CASE WHEN l_linestatus = 'O' THEN 'cut at the most tokens' END,
    CASE WHEN l_linenumber > 5 THEN l_linenumber || ' blocks may be copied from others' END, CASE WHEN l_linenumber = 2 THEN 'layout repaired, blocks that can be read are kept' WHEN l_linenumber = 3 THEN 'layout not readable, raw result kept' END), '') AS note FROM lineitem""")
def page_notes(spark, sf_dir):
    n = F.col("l_linenumber")
    extra = F.to_json(F.struct((F.col("l_returnflag") == "R").alias("stopped_loop"), (F.col("l_linestatus") == "O").alias("hit_max_tokens"), F.when(n > 5, n).alias("copied_cells"), F.when(n == 2, "repaired").when(n == 3, "failed").otherwise("ok").alias("layout")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), documents.page_note(extra).alias("note"))


@query("""SELECT doc_id AS id, CASE lang WHEN 'de' THEN 'Lies den Text.' ELSE CASE WHEN doc_id % 4 = 0 THEN 'Make a table.' ELSE 'Read all.' END END AS prompt FROM documents""")
def prompts(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 4 == 0, "table_html").otherwise("text").alias("gt_type"))
    return config.prompts(items, {"de": "Lies den Text.", "fr": "", "table_html": "Make a table.", "default": "Read all."}).select("id", "prompt")


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS x FROM documents WHERE length(text) >= 1500),
  p AS (SELECT doc_id, x, list_filter(x, lambda s: NOT (length(s) < 60 AND NOT regexp_matches(s, '[.!?؟:،,;]$'))) AS p FROM l)
  SELECT doc_id AS id, len(x)::INTEGER AS parts, len(p)::INTEGER AS paragraphs FROM p WHERE len(p) >= 8 AND list_sum(list_transform(p, lambda s: length(s))) >= 150 * len(p) ORDER BY doc_id LIMIT 40""")
def article_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")
    return generators.articles(docs, 40, 1500).select("id", F.size("parts").alias("parts"), F.size(F.filter("parts", lambda p: p["kind"] == "p")).alias("paragraphs"))


@query("""SELECT doc_id::VARCHAR AS uid, sha256(text) AS gt FROM documents WHERE lang = 'en' AND length(text) > 200 ORDER BY sha256('7:' || doc_id) LIMIT 25""")
def public_samples(spark, sf_dir):
    found = generators.samples(table(spark, sf_dir, "documents"), 25, 7, "lang = 'en' AND length(text) > 200", "text", "doc_id")
    return found.select("uid", F.sha2("gt", 256).alias("gt"))


def _marker_texts(spark, sf_dir):
    """Suppliers as documents, their parts as rows with a count: a base without marks, readings that add some, and the truth.

    Of the labels p1, p2, ... of a supplier the first of each part counts; reading a marks odd parts, b those divisible by 3
    and others than a would, c takes every fifth for a digit more.
    """
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("p")).agg(F.min("l_quantity").cast("int").cast("string").alias("n"))
    mark = {"base": F.lit(""), "a": F.when(F.col("p") % 2 == 1, "†").otherwise(""), "b": F.when((F.col("p") % 6 == 3), "‡").when(F.col("p") % 3 == 0, "<sup>a</sup>").otherwise(""), "c": F.when(F.col("p") % 5 == 0, "1").otherwise("")}
    line = lambda m: F.concat(F.lit("<tr><td>p"), F.col("p").cast("string"), F.lit("</td><td>"), m, F.col("n"), F.lit("</td></tr>"))
    whole = lambda k: F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(line(mark[k]))), ""), F.lit("</table>"))
    return rows.groupBy("doc").agg(*(whole(k).alias(k) for k in mark))


@query("""WITH r AS (SELECT l_suppkey AS doc, l_partkey AS p, min(l_quantity)::INT::VARCHAR AS value FROM lineitem GROUP BY ALL),
  v AS (SELECT *, p % 2 = 1 AS a, p % 3 = 0 AS b FROM r)
  SELECT doc, 'p' || p AS label, value, CASE WHEN a THEN '†' ELSE '<sup>a</sup>' END AS mark, 1::BIGINT AS votes FROM v WHERE (a OR b) AND NOT (a AND b)""")
def marker_fusion(spark, sf_dir):
    """A mark is applied where all readings that vote agree; odd multiples of 3 get two different ones."""
    texts = _marker_texts(spark, sf_dir)
    readings = texts.select("doc", F.explode(F.create_map(*(x for k in "abc" for x in (F.lit(k), F.col(k))))).alias("pass", "text"))
    votes = markers.ballots(texts.select("doc", F.col("base").alias("text")), readings)
    return markers.applied(votes).select("doc", "label", "value", "mark", "votes")


@query("""WITH r AS (SELECT l_suppkey AS doc, l_partkey AS p FROM lineitem GROUP BY ALL)
  SELECT doc, count(*) FILTER (p % 2 = 1)::BIGINT AS in_truth, 0::BIGINT AS kept, count(*) FILTER (p % 2 = 1 AND p % 3 <> 0)::BIGINT AS "right", count(*) FILTER (p % 6 = 0)::BIGINT AS wrong FROM r GROUP BY doc HAVING count(*) FILTER (p % 2 = 1 OR p % 3 = 0) > 0""")
def marker_totals(spark, sf_dir):
    """The truth is what the first reading says; the fusion's marks as in `marker_fusion`."""
    texts = _marker_texts(spark, sf_dir)
    readings = texts.select("doc", F.explode(F.create_map(*(x for k in "abc" for x in (F.lit(k), F.col(k))))).alias("pass", "text"))
    base = texts.select("doc", F.col("base").alias("text"))
    fused = markers.applied(markers.ballots(base, readings)).select("doc", "label", "value", "mark").distinct()
    return markers.totals(markers.marks(texts.select("doc", F.col("a").alias("text"))), markers.marks(base), fused)
