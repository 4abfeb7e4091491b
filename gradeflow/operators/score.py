"""Score rows, and their aggregation over grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import metrics, tables, text as texts
from ..sources import scratch

FAIL, HALLUCINATION = ("error", "empty"), ("repetition", "too_long")


def pair(items: DataFrame, models: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row for each model and item, spread evenly; missing where the model has no record. An error is a record with an empty text.

    Only ids are paired; items' texts join afterwards, once a pair that has to be scored. `models` (model, model_ordinal)
    is the configuration's list.
    """
    answers = predictions.select("model", "id", F.lit(True).alias("_has"), F.coalesce("text", F.lit("")).alias("answer"), F.col("error").alias("error"), *(c for c in ("latency_s", "confidence", "extra") if c in predictions.columns))
    listed = F.array(*(F.struct(F.lit(r.model).alias("model"), F.lit(r.model_ordinal).alias("model_ordinal")) for r in models.select("model", "model_ordinal").collect()))
    every = items.select("id", F.explode(listed).alias("_m")).select("id", "_m.model", "_m.model_ordinal")
    met = every.join(answers, ["model", "id"], "left").withColumn("missing", F.col("_has").isNull()).drop("_has")
    return met.join(items, "id").repartition("id", "model")  # a distance costs more than a row's size tells


def score(pairs: DataFrame, normalised: bool = False, repetition: bool = True, rules: texts.Rules = texts.Rules()) -> DataFrame:
    """Edit counts, rates (also of raw texts) and flags of (gt, answer, error, missing[, extra]). normalised: both texts are normal already."""
    truth, answer, rows = F.col("gt"), F.col("answer"), pairs
    scored = ~F.col("missing")
    if not normalised:
        rows = rows.withColumns({"gt_norm": texts.normalize(truth, rules), "answer_norm": texts.normalize(answer, rules), "_gt_raw": texts.normalize_raw(truth), "_answer_raw": texts.normalize_raw(answer)})
        truth, answer = F.col("gt_norm"), F.col("answer_norm")
        raw = metrics.edit_stats(F.col("_gt_raw"), F.col("_answer_raw"))
    else:
        raw = None
    rows = rows.withColumns({k: F.when(scored, v) for k, v in metrics.edit_stats(truth, answer).items()})
    if raw:
        rows = rows.withColumns({"cer_raw": F.when(scored, metrics.error_rate(raw["char_edits"], raw["ref_chars"])), "wer_raw": F.when(scored, metrics.error_rate(raw["word_edits"], raw["ref_words"]))})
    cut = F.coalesce(F.try_variant_get(F.try_parse_json("extra"), "$.hit_max_tokens", "boolean"), F.lit(False)) if "extra" in pairs.columns else None
    marks = metrics.flags(truth, answer, F.col("error"), metrics.has_repetition(F.col("answer")) if repetition else None, cut)
    return rows.withColumns({
        "cer": F.when(scored, metrics.error_rate(F.col("char_edits"), F.col("ref_chars"))), "wer": F.when(scored, metrics.error_rate(F.col("word_edits"), F.col("ref_words"))),
        "flags": F.when(scored, marks),
    }).drop("_gt_raw", "_answer_raw")


TABLE_MEASURES = {"teds": "double", "teds_struct": "double", "cell_exact": "double", "cell_aligned": "double", "gt_rows": "int", "pred_rows": "int", "rows_wrong_ncols": "int", "pos_q": "array<double>"}


def score_tables(pairs: DataFrame, rules: texts.Rules = texts.Rules()) -> DataFrame:
    """Table measures of pairs (gt, answer, pages); all null where the truth has no table. An answer of several pages is one table for the trees."""
    rows = pairs.withColumns({"_truth": tables.cells(F.col("gt"), rules), "_answer": tables.cells(F.col("answer"), rules)})
    rows = rows.withColumns({"_like": tables.similarity(F.col("_truth"), F.col("_answer"), F.coalesce("pages", F.lit(1))), "_t": tables.texts_of(F.col("_truth")), "_a": tables.texts_of(F.col("_answer"))})
    return tables.placement(rows, "_t", "_a").select(*pairs.columns, "_like.*", "cell_exact", "cell_aligned", "gt_rows", "pred_rows", "rows_wrong_ncols", "pos_q")


def score_all(pairs: DataFrame, rules: texts.Rules = texts.Rules()) -> DataFrame:
    """Whole score rows of pairs (..., gt, gt_type, pages, answer, error, missing): texts by position, tables by cells and trees."""
    rows = score(pairs, rules=rules)
    table = (F.col("gt_type") == "table_html") & ~F.col("missing")
    texts_ = rows.where(~table | table.isNull())
    recall = metrics.position_recall(F.when(F.col("missing"), None).otherwise(F.col("gt_norm")), F.col("answer_norm"))
    texts_ = texts_.withColumns({c: F.lit(None).cast(t) for c, t in TABLE_MEASURES.items()}).withColumn("pos_q", F.when(~F.col("missing") & (F.col("gt_type") != "table_html"), recall))
    return score_tables(rows.where(table), rules).unionByName(texts_)


#: Columns of score rows besides the keys that `aggregate` reads.
MEASURED = ("missing", "flags", "cer", "wer", "cer_raw", "char_edits", "ref_chars", "latency_s", *TABLE_MEASURES)


def stored(rows: DataFrame, *keys: str, measures: tuple[str, ...] = MEASURED) -> DataFrame:
    """The keys and measures of score rows as a table in the shared folder. Means and ranks both read the rows: those that are still to be
    computed would be computed for either, and distances cost more than a narrow table. Of measures left out nothing is computed; `missing` and
    `flags` are always among them."""
    found = rows.select(*(c for c in (*keys, *dict.fromkeys(("missing", "flags", *measures))) if c in rows.columns))
    uri = f"{scratch.new_dir(rows.sparkSession, 'scores')}/rows"
    found.write.parquet(uri)
    return rows.sparkSession.read.schema(found.schema).parquet(uri)


def aggregate(rows: DataFrame, sets: list[tuple[str, ...]] = (("model",), ("model", "category"))) -> DataFrame:
    """Aggregates of score rows for every grouping set; columns not in a set are null there. Middle and rank values come from counts of equal ones.

    Rows that are not a table yet are best `stored` first, for they are read twice. What would follow from measures that rows do not have is null."""
    keys = list(dict.fromkeys(c for s in sets for c in s))
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("double")
    any_of = lambda names: F.count_if(F.arrays_overlap("flags", F.array(*map(F.lit, names))))
    mean_ci = lambda c, name: [F.avg(has(c)).alias(f"{name}_mean"), metrics.half_width(has(c)).alias(f"{name}_ci95")]
    halluc = any_of(HALLUCINATION)
    n_scored = F.count_if(~F.col("missing"))
    measures = [
        F.count("*").alias("n"), n_scored.alias("n_scored"), (n_scored == F.count("*")).alias("complete"),
        *mean_ci("cer", "cer"),
        (F.sum(has("char_edits")) / F.nullif(F.sum(has("ref_chars")), F.lit(0))).alias("cer_micro"), F.avg(has("wer")).alias("wer_mean"), F.avg(has("cer_raw")).alias("cer_raw_mean"),
        F.count(has("teds")).alias("teds_n"), *mean_ci("teds", "teds"), F.avg(has("teds_struct")).alias("teds_struct_mean"),
        any_of(FAIL).alias("n_fail"), halluc.alias("n_hallucination"), metrics.wilson_upper(halluc, n_scored).alias("hallucination_upper95"),
        F.avg(has("latency_s")).alias("latency_mean_s"), *mean_ci("cell_exact", "cell_exact"), F.avg(has("cell_aligned")).alias("cell_aligned_mean"),
        F.coalesce(F.sum(has("rows_wrong_ncols")), F.lit(0)).alias("rows_wrong_ncols"), F.count_if(has("gt_rows") != has("pred_rows")).alias("row_count_off"),
        any_of(("hit_max_tokens",)).alias("n_hit_max_tokens"),
    ]
    if "pos_q" in rows.columns:
        measures.append(F.array(*(F.avg(F.get("pos_q", F.lit(i))) for i in range(4))).alias("pos_q"))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in keys)).agg(*measures, F.grouping_id().alias("_set"))
    if "cer" not in rows.columns:
        return out.drop("_set").withColumns({c: F.lit(None).cast("double") for c in ("cer_median", "cer_p90")})
    ranks = metrics.quantiles(rows, sets, "cer").withColumnsRenamed({c: f"_of_{c}" for c in ("_set", *keys)})
    same = F.col("_set") == F.col("_of__set")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = out.join(ranks, same, "left").withColumnRenamed("cer_p", "cer_p90")
    return out.drop("_set", "_of__set", *(f"_of_{c}" for c in keys))


def worst(rows: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """The k worst rows of each model by error rate, manifest order among equals; long texts are fetched for these only."""
    best = Window.partitionBy("model").orderBy(F.desc("cer"), "ordinal")
    ranked = rows.where("cer IS NOT NULL").select("model", "id", "ordinal", "cer").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return items.select("id", "gt").join(F.broadcast(ranked), "id").select("model", "rank", "id", "cer", "gt")  # k rows a model


def by_length(rows: DataFrame) -> DataFrame:
    """Aggregates of the rows of long documents by model, category and length_bin."""
    return aggregate(rows.where("length_bin IS NOT NULL"), [("model", "category", "length_bin")])
