"""The queries of this subpackage, one for each operator, over whole tables; and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, decontam, fim, gru_lm, licenses, mixing, ngram_join, storage, telephony, tokenbin, toxicity, urlfilter, warc, winnow

#: Name of the tokenizer's vocabulary file; its place comes from the installed package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"
#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{storage.shared_dir(spark)}/warc-{storage.unique()}"
    storage.until_exit(uri)
    warc.write(_table(spark, sf_dir, "pages"), uri)
    return warc.check_payloads(warc.read(spark, uri)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = storage.new_dir(spark, "tokens")
    storage.until_exit(uri)
    tokenbin.write(_table(spark, sf_dir, "documents"), uri, tokenizer_path())
    return tokenbin.read(spark, uri, keep_ids=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return urlfilter.judge(urls, urlfilter.rule_table(spark, URL_RULES)).withColumnRenamed("id", "page_id")


OP6_SQL = """
WITH rules(verdict, host, prefix) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts),
best AS (
  SELECT page_id, u.host, path, arg_min(r.host || r.prefix, -length(r.host || r.prefix)) AS rule, arg_min(verdict, -length(r.host || r.prefix)) AS verdict
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(path, r.prefix)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best"""


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_groups(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted on labelled rows whose crc32 of the id as text is not 2 modulo 4."""
    labels = _table(spark, sf_dir, "labels").where(F.pmod(toxicity.crc_of_id(), F.lit(4)) != 2)
    return toxicity.train(docs, labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, sf_dir, docs), worst=True)
    held, predicted = F.pmod(toxicity.crc_of_id(), F.lit(4)) == 2, (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "worst_sentence", "worst_score", "worst_start", "worst_end")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score(_table(spark, sf_dir, "documents"), F.pmod(toxicity.crc_of_id(), F.lit(7)) == 2)


def op11_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.round_trip(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_mix_sources, op2_winnowing, op3_license_scan, op4_warc, op5_token_binary, op6_url_filter, op7_ngram_jaccard, op8_decontaminate, op9_toxicity, op10_language_model,
        op11_telephony, op12_fill_in_middle, op13_centroids,
    )
    return {f.__name__: f for f in every}


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.oracle(), "op4_warc": OP4_SQL, "op6_url_filter": OP6_SQL, "op12_fill_in_middle": fim.oracle(), "op13_centroids": centroids.oracle()}
