"""The leaderboard over variants, coverage of the queue, its states, and plans for the memory of a device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .score import aggregate, stored

#: Names of which more is broadcast no more.
MAX_NAMES = 10_000
REASONS = ("gated", "no_memory", "unsupported", "broken", "license")


def coverage(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """(variant, done, total, errors): records with an error are done."""
    total = items.agg(F.count("*").alias("total"))
    done = predictions.join(items.select("id"), "id", "left_semi").groupBy("variant", "variant_ordinal").agg(F.count("*").alias("done"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))
    return done.join(F.broadcast(total)).select("variant", "variant_ordinal", "done", "total", "errors")  # one row


def is_variant(variant: Column, name: Column) -> Column:
    return (variant == name) | variant.startswith(F.concat(name, F.lit("__")))


def best_variant(queue: DataFrame, covered: DataFrame, long: bool = False) -> DataFrame:
    """Of each queued name the variant with most items done, then fewest errors, then the first; long runs count for long items only."""
    if not long:
        covered = covered.where(~F.col("variant").endswith("__long"))
    base = covered.withColumn("name", F.split("variant", "__").getItem(0))  # an equi-join, then the exact rule
    found = queue.join(base, "name").where(is_variant(F.col("variant"), F.col("name")))
    order = F.struct("done", (-F.col("errors")).alias("e"), (-F.col("variant_ordinal")).alias("o"))
    return found.groupBy("name").agg(F.max_by(F.struct("variant", "done", "total", "errors"), order).alias("b")).select("name", "b.*")


def leaderboard(queue: DataFrame, variants: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Ranks stitched rows: each (name, category) by its variant. Means over complete categories, not over items.

    variants: (name, category, variant, vram); aggregates: (model, category, is_table, complete, n_scored, cer_mean, cell_exact_mean).
    """
    rows = variants.join(aggregates.withColumnRenamed("model", "variant"), ["variant", "category"])
    text, table = F.col("complete") & ~F.col("is_table"), F.col("complete") & F.col("is_table")
    scored = rows.groupBy("name").agg(
        F.avg(F.when(text, F.col("cer_mean"))).alias("text_cer"), F.avg(F.when(table, F.col("cell_exact_mean"))).alias("table_exact"),
        F.sum("n_scored").alias("n_done"), F.max("vram").alias("vram"), F.count_if("complete").alias("complete_categories"),
    )
    board = queue.join(scored, "name", "left")
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.col("text_cer").isNull(), "text_cer", "queue_ordinal")))  # a row a model


def stitched(variants: DataFrame, rows: DataFrame) -> DataFrame:
    """Score rows (model, category, ...) of each queued name by the variants (name, category, variant) that stand for it, with the name."""
    return rows.withColumnRenamed("model", "variant").join(variants.select("name", "category", "variant"), ["variant", "category"])


def sections(variants: DataFrame, rows: DataFrame) -> DataFrame:
    """Aggregates of stitched rows by name, and by name and category, with the variants that were used."""
    met = stitched(variants, rows)
    used = variants.groupBy("name").agg(F.array_sort(F.collect_set("variant")).alias("variants"))  # a few of a name
    return aggregate(stored(met, "name", "category"), [("name",), ("name", "category")]).join(F.broadcast(used) if used.count() <= MAX_NAMES else used, "name")


def skip_problem(code: Column, detail: Column, evidence_exists: Column) -> Column:
    """What is wrong with a skip entry; null if nothing is."""
    return F.when(~code.isin(*REASONS), "unknown reason").when(F.trim(F.coalesce(detail, F.lit(""))) == "", "no detail").when((code != "gated") & ~F.coalesce(evidence_exists, F.lit(False)), "no evidence")


def is_complete(done: Column, total: Column, errors: Column, max_errors: float) -> Column:
    return F.coalesce((done == total) & (errors <= max_errors * total), F.lit(False))


def goal_states(queue: DataFrame, known: DataFrame, normal: DataFrame, long: DataFrame, skips: DataFrame, published: DataFrame, max_errors: float = 0.01) -> DataFrame:
    """(name, queue_ordinal, state) of every queued model, by the first rule that holds.

    known: (name) in the configuration; normal and long: best variants; skips: (name, problem); published:
    (name, in_benchmark, pushed, cached).
    """
    take = lambda df, p: df.select("name", *(F.col(c).alias(f"{p}_{c}") for c in ("done", "total", "errors")))
    rows = queue.join(known.select("name", F.lit(True).alias("known")), "name", "left").join(take(normal, "normal"), "name", "left").join(take(long, "long"), "name", "left")
    rows = rows.join(skips.where("problem IS NULL").select("name", F.lit(True).alias("skip")), "name", "left").join(published, "name", "left")
    ok = {p: is_complete(F.col(f"{p}_done"), F.col(f"{p}_total"), F.col(f"{p}_errors"), max_errors) for p in ("normal", "long")}
    off = lambda c: ~F.coalesce(c, F.lit(False))
    state = (
        F.when(F.col("known").isNull() & F.col("normal_done").isNull(), "not configured").when(F.col("skip"), "skipped")
        .when(F.coalesce("normal_done", F.lit(0)) == 0, "not started").when(~ok["normal"], "running").when(~ok["long"], "running long")
        .when(off(F.col("in_benchmark")), "not in leaderboard").when(off(F.col("pushed")), "not published").when(F.coalesce("cached", F.lit(False)), "weights kept").otherwise("complete")
    )
    return rows.select("name", "queue_ordinal", state.alias("state"))


def next_item(states: DataFrame) -> DataFrame:
    return states.where("state NOT IN ('complete', 'skipped')").orderBy("queue_ordinal").limit(1)


def changed_files(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files of a lock (name, digest) that are missing or differ; others are not looked at."""
    met = expected.join(actual.withColumnRenamed("digest", "now"), "name", "left")
    return met.where(~F.col("digest").eqNullSafe(F.col("now"))).select("name")


# GB a billion parameters, GB besides, and the levels in order: code, weights, devices, GB saved by small images.
GB_PER_BILLION = {"fp16": 2.0, "8bit": 1.1, "4bit": 0.6}
OVERHEAD_GB, LONG_OVERHEAD_GB = 2.5, 7.0
USABLE, TWO_DEVICES = 0.9, 0.92
LEVELS = [("A", "fp16", 1, 0.0), ("B", "fp16", 2, 0.0), ("C", "fp16", 2, 1.5), ("D", "8bit", 1, 0.0), ("E", "8bit", 2, 0.0), ("F", "4bit", 1, 0.0), ("G", "4bit", 2, 0.0), ("H", "4bit", 0, 0.0)]


def memory_plans(models: DataFrame, free: list[float], long: bool = False) -> DataFrame:
    """(model, level, need_gb, fits): every level for models (model, params_b); H moves layers off the device and always fits one."""
    spark = models.sparkSession
    levels = spark.createDataFrame([(i, c, GB_PER_BILLION[w], d, s) for i, (c, w, d, s) in enumerate(LEVELS)], "ord int, level string, per double, devices int, saved double")
    one = max(free, default=0.0) * USABLE
    two = sum(sorted(free, reverse=True)[:2]) * USABLE * TWO_DEVICES if len(free) > 1 else 0.0
    need = F.round(F.round(F.col("params_b") * F.col("per") + (LONG_OVERHEAD_GB if long else OVERHEAD_GB), 1) - F.col("saved"), 1)
    room = F.when(F.col("devices") == 1, one).otherwise(two)
    fits = F.when(F.col("devices") == 0, F.lit(bool(free))).otherwise((room > 0) & (need <= room))
    return models.crossJoin(F.broadcast(levels)).select("model", "ord", "level", need.alias("need_gb"), fits.alias("fits"))  # eight levels


def recommended(plans: DataFrame) -> DataFrame:
    return plans.where("fits").groupBy("model").agg(F.min_by(F.struct("level", "need_gb"), "ord").alias("b")).select("model", "b.*")
