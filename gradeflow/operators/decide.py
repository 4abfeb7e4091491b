"""Rules that eliminate, rank and choose models per category, as windows over aggregates.

Aggregates are (category, model, model_ordinal, adapter, is_table, complete, n, cer_mean, cer_ci95,
cell_exact_mean, cell_exact_ci95, n_fail, n_hallucination, latency_mean_s, vram, n_hit_max_tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_UNSTABLE = 0.15
FINALISTS = 4
TRADITIONAL = ("tesseract", "easyocr", "paddleocr", "kraken_layout")


#: Models of a configuration that are broadcast; more are joined.
MAX_MODELS = 10_000


def category_kinds(items: DataFrame) -> DataFrame:
    """(category, any_table, is_table): any item a table, for reports; all items tables, for decisions."""
    table = F.col("gt_type") == "table_html"
    return items.groupBy("category").agg(F.bool_or(table).alias("any_table"), F.bool_and(table).alias("is_table"))


def entries(aggregates: DataFrame) -> DataFrame:
    """Each model's primary value with its interval, and its share of unstable rows (a row may count twice)."""
    value = F.when(F.col("is_table"), F.col("cell_exact_mean")).otherwise(F.col("cer_mean"))
    ci = F.coalesce(F.when(F.col("is_table"), F.col("cell_exact_ci95")).otherwise(F.col("cer_ci95")), F.lit(0.0))
    rows = aggregates.withColumns({"value": value, "lo": value - ci, "hi": value + ci, "cost": F.when(F.col("is_table"), -value).otherwise(value)})
    unstable = (F.col("n_fail") + F.col("n_hallucination")) / F.greatest(F.col("n"), F.lit(1))
    status = F.when(~F.col("complete"), "skipped").when(F.col("value").isNull(), "skipped")
    return rows.withColumns({"unstable": unstable, "status": status})


def eliminate(aggregates: DataFrame, max_unstable: float = MAX_UNSTABLE) -> DataFrame:
    """status: skipped, eliminated or kept; reason: incomplete, no value, unstable, or worse for certain."""
    rows = entries(aggregates).withColumn("stable", F.col("status").isNull() & (F.col("unstable") < max_unstable))
    by = Window.partitionBy("category").orderBy(F.desc("stable"), "cost", "model_ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = {k: F.first(F.when(F.col("stable"), F.col(k))).over(by) for k in ("lo", "hi")}
    rows = rows.withColumns({f"best_{k}": v for k, v in best.items()})
    worse = F.when(F.col("is_table"), F.col("hi") < F.col("best_lo")).otherwise(F.col("lo") > F.col("best_hi"))
    reason = F.when(~F.col("complete"), "incomplete").when(F.col("value").isNull(), "no value").when(~F.col("stable"), "unstable").when(worse, "certainly worse")
    rows = rows.withColumn("reason", reason)
    status = F.coalesce("status", F.when(F.col("reason").isNotNull(), "eliminated").otherwise("kept"))
    return rows.withColumn("status", status).withColumn("rank", F.when(F.col("status") == "kept", F.row_number().over(Window.partitionBy("category").orderBy(F.col("status") != "kept", "cost", "model_ordinal"))))


def _warned(reason: Column) -> Column:
    """The reason with a warning of truncated answers, which changes no status."""
    return F.concat_ws("; ", reason, F.when(F.col("n_hit_max_tokens") > 0, F.concat(F.col("n_hit_max_tokens").cast("string"), F.lit(" answers cut"))))


def screening(aggregates: DataFrame, finalists: int = FINALISTS, max_unstable: float = MAX_UNSTABLE, traditional: tuple[str, ...] = TRADITIONAL) -> DataFrame:
    """(category, model, value, status, reason, rank, finalist): the first survivors, and the best stable traditional model if none is among them."""
    rows = eliminate(aggregates, max_unstable)
    rows = rows.withColumn("finalist", F.coalesce(F.col("rank") <= finalists, F.lit(False)))
    old = F.col("adapter").isin(*traditional) & F.col("stable")
    first_old = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("_old"), "cost", "model_ordinal"))
    none = ~F.bool_or(F.col("finalist") & F.col("_old")).over(Window.partitionBy("category"))
    rows = rows.withColumn("_old", F.coalesce(old, F.lit(False))).withColumn("_back", F.col("_old") & (first_old == 1) & none)
    status = F.when(F.col("_back"), "kept").when((F.col("status") == "kept") & ~F.col("finalist"), "outside top").otherwise(F.col("status"))
    reason = F.when(F.col("_back"), "best traditional model").when(status == "outside top", "outside top").otherwise(F.col("reason"))
    return rows.select("category", "model", "value", status.alias("status"), _warned(reason).alias("reason"), "rank", (F.col("finalist") | F.col("_back")).alias("finalist"))


def final(aggregates: DataFrame, max_unstable: float = MAX_UNSTABLE) -> DataFrame:
    """(category, model, value, rank, tied, winner) of survivors. All overlap the best; the fewest hallucinations, then
    latency, then memory decide (null counts as 0), then accuracy."""
    rows = eliminate(aggregates, max_unstable).where("status = 'kept'")
    order = Window.partitionBy("category").orderBy("n_hallucination", F.coalesce("latency_mean_s", F.lit(0.0)), F.coalesce("vram", F.lit(0)), "rank")
    return rows.select("category", "model", "value", "rank", (F.col("rank") > 1).alias("tied"), (F.row_number().over(order) == 1).alias("winner"))


def with_models(aggregates: DataFrame, models: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Aggregates (category, model, ...) with what the configuration says of models (model, model_ordinal, adapter, vram), and with is_table
    of the categories' kinds (of `category_kinds`; without them no category is of tables). Models that it does not know are left out."""
    small = models.limit(MAX_MODELS + 1).count() <= MAX_MODELS
    met = aggregates.join(F.broadcast(models) if small else models, "model")
    if kinds is None:
        return met.withColumn("is_table", F.lit(False))
    return met.join(kinds.select("category", "is_table"), "category", "left").withColumn("is_table", F.coalesce("is_table", F.lit(False)))
