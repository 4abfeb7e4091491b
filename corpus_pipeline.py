"""A training corpus from raw documents, in stages; each works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeflow.llm import decontam, mixing, ngram_join, queries, rows, storage, tokenbin, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the threshold; the model is fitted on the labelled ones among them.

    Rows without text or words score what such rows did in training; rows with null or repeated ids are judged each by
    itself. All columns of docs pass through, whatever their names. An empty table gives an empty one.
    """
    model, score = queries.toxicity_model(spark, sf_dir, docs), rows.fresh(docs, "toxicity")
    return toxicity.score(docs, model, name=score).where(F.col(score) < toxicity.REJECT).select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least doc_id; rows without words stay, once each.

    Null ids come last within a group; of equal rows one stays. Extra columns go with their rows.
    """
    return rows.take(docs, ngram_join.representatives(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage like a benchmark item.

    A row goes by its own text: clean rows stay that share a null or repeated id with a contaminated one. Rows without
    words stay; without benchmark items all do. Extra columns go with their rows.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.leave_out(docs, decontam.find(docs, benchmark).select("doc_id", "text_hash"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or up to three times.

    Rows without words weigh nothing and are not taken. Rows that agree in id, text and source share what they are taken;
    a null source is one of its own. Extra columns go with their rows.
    """
    mixed = mixing.mix(docs).groupBy("doc_id", "text_hash", "source").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    return rows.take(docs, storage.checkpointed(mixed))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all rows as token ids and returns what the files hold: doc_id, start, n_tokens, ids_crc32.

    Rows without text are the end id alone; rows with null or repeated ids are written each by itself.
    """
    uri = storage.new_dir(spark, "tokens")
    storage.until_exit(uri)
    tokenbin.write(docs, uri, queries.tokenizer_path())
    return tokenbin.read(spark, uri, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_binary", write_tokens),
]

#: Training a model and tokenizing are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        uri = f"{storage.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(uri)
        docs = spark.read.parquet(uri)
        if before:
            storage.remove(before)
        before = uri
    return STAGES[-1][1](spark, docs, sf_dir)
