"""Queries that are written in SQL alone, over registered functions and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from . import catalog
from .catalog import _BLOCKS, _FRACTION, _ROWS, _WILSON
from .registry import ORACLES, query, table


@query(f"""WITH {_ROWS}, c AS (SELECT model, category, count(*) FILTER (NOT missing)::BIGINT AS n, count(*) FILTER (is_empty)::BIGINT AS k, round(avg(cer), 9) AS cer_mean FROM scored GROUP BY model, category)
  SELECT model, category, n, cer_mean, cer_mean AS rate, round({_WILSON}, 9) AS failed95 FROM c""")
def sql_scores(spark, sf_dir):
    sql.register(spark, scores=catalog.short_rows(spark, sf_dir))
    return spark.sql("""WITH c AS (SELECT model, category, count_if(NOT missing) AS n, count_if(array_contains(flags, 'empty')) AS k, avg(cer) AS cer, avg(if(missing, NULL, error_rate(char_edits, ref_chars))) AS rate FROM scores GROUP BY model, category)
        SELECT model, category, n, round(cer, 9) AS cer_mean, round(rate, 9) AS rate, round(wilson_upper(k, n), 9) AS failed95 FROM c""")


@query(f"""SELECT doc_id, {_FRACTION.format("cast(doc_id AS VARCHAR)")} AS fraction, CASE WHEN {_FRACTION.format("'5:' || cast(doc_id AS VARCHAR)")} < 0.3 THEN 'holdout' ELSE 'dev' END AS split,
  cast(cast('0x' || substr(sha256(cast(doc_id AS VARCHAR)), 1, 8) AS UBIGINT) % 7 AS INTEGER) AS shard FROM documents""")
def sql_splits(spark, sf_dir):
    sql.register(spark, documents=table(spark, sf_dir, "documents"))
    return spark.sql("SELECT doc_id, hash_fraction(doc_id::STRING) AS fraction, split_of(doc_id::STRING, 5, 0.3D) AS split, shard_of(doc_id::STRING, 7) AS shard FROM documents")


@query(ORACLES["text_to_blocks"])
def sql_text_blocks(spark, sf_dir):
    sql.register(spark, documents=table(spark, sf_dir, "documents"))
    return spark.sql("SELECT doc_id, ord, kind, said AS text FROM text_blocks(TABLE(SELECT doc_id, text FROM documents), 'text')")


@query(f"""WITH {_BLOCKS}, c AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY i DESC, category DESC, text DESC, y1 DESC) AS back FROM b),
  k AS (SELECT page, category, text, y1, y2, count(*) AS times FROM c WHERE NOT (page % 3 = 1 AND back = 1) GROUP BY ALL)
  SELECT page, count(*)::BIGINT AS n, sum(10 + y1 + 200 + y2)::BIGINT AS ends, CASE WHEN page % 3 = 1 OR max(times) > 1 THEN 'repaired' ELSE 'ok' END AS status FROM k GROUP BY page""")
def sql_layout_blocks(spark, sf_dir):
    """Pages of layout JSON, every third cut short in its last box; pages of which no block is whole have no rows."""
    one = F.struct("category", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    rows = catalog.order_blocks(spark, sf_dir).groupBy("page").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("b")))), lambda x: x["b"])).alias("json"))
    sql.register(spark, layouts=rows)
    return spark.sql("""SELECT page, count(*) AS n, sum(aggregate(bbox, 0, (a, v) -> a + v)) AS ends, any_value(status) AS status
        FROM layout_blocks(TABLE(SELECT page, if(page % 3 = 1, substr(json, 1, length(json) - 5), json) AS json FROM layouts), 'json') GROUP BY page""")


@query("""SELECT l_orderkey AS id, count(*)::BIGINT * 4 AS cells, sum(l_linenumber::INT)::BIGINT AS first, count(DISTINCT l_returnflag)::BIGINT AS flags FROM lineitem GROUP BY 1""")
def sql_table_cells(spark, sf_dir):
    sql.register(spark, tables=catalog.order_tables(spark, sf_dir).select("id", catalog.html_of(F.col("truth")).alias("html")))
    return spark.sql("""SELECT id, count(*) AS cells, sum(if(place = 0, cell::BIGINT, 0)) AS first, count(DISTINCT if(place = 3, cell, NULL)) AS flags
        FROM (SELECT id, inline(said) FROM (SELECT id, if(bare_tables(html), bare_cells(html), read_cells(if(bare_tables(html), NULL, coalesce(html, '')))) AS said FROM tables)) GROUP BY id""")
