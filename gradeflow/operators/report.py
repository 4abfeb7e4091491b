"""Reports: their figures as frames, and Markdown of the few rows that remain (models x categories)."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions import metrics, text as texts
from ..functions.markup import text_statistics
from .blocks import agreement
from .score import TABLE_MEASURES, aggregate, by_length

NONE = "—"


def percent(x: float | None, digits: int = 1) -> str:
    return NONE if x is None else f"{100 * x:.{digits}f}%"


def interval(mean: float | None, half: float | None) -> str:
    return NONE if mean is None else percent(mean) + (f" ±{100 * half:.1f}" if half is not None else "")


def number(x: float | None, digits: int = 3) -> str:
    return NONE if x is None else f"{x:.{digits}f}"


def memory(mib: float | None) -> str:
    return f"{mib / 1024:.1f} GB" if mib else NONE


def markdown_table(head: list[str], rows: Iterable[list], numbers_from: int = 1) -> list[str]:
    rule = "|" + "|".join("---" if i < numbers_from else "---:" for i in range(len(head))) + "|"
    return [f"| {' | '.join(head)} |", rule, *(f"| {' | '.join(str(c) for c in row)} |" for row in rows), ""]


# Figures.


def in_report_order(aggregates: DataFrame) -> DataFrame:
    """Overall aggregates (model, model_ordinal, complete, cer_mean, ...) with their place: complete ones first, then by error rate, those without last."""
    order = Window.orderBy(~F.col("complete"), F.coalesce("cer_mean", F.lit(9e9)), "model_ordinal")  # a row a model
    return aggregates.withColumn("place", F.row_number().over(order))


def quick_rate(truth: Column, answer: Column) -> Column:
    """Edits by the truth's length, which counts as 1 at least: the rate of a first look, not that of the scores."""
    return metrics.char_edits(truth, answer) / F.greatest(F.length(truth), F.lit(1))


def quick_status(items: DataFrame, latest: DataFrame) -> DataFrame:
    """(model, category, n, errors, cer_mean, latency_mean_s) of records so far, by model and by model and category; records
    of items that the set has not do not count, and an error is an empty answer. Texts are normal already."""
    met = latest.select("model", "id", F.coalesce("text", F.lit("")).alias("answer"), F.coalesce("error", F.lit("")).alias("error"), "latency_s").join(items.select("id", "category", "gt"), "id")
    rows = met.repartition("id", "model").withColumn("cer", quick_rate(F.col("gt"), F.col("answer")))
    return rows.groupingSets([[F.col("model")], [F.col("model"), F.col("category")]], F.col("model"), F.col("category")).agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("errors"), F.avg("cer").alias("cer_mean"), F.avg("latency_s").alias("latency_mean_s"))


def speed_test(pages: DataFrame) -> DataFrame:
    """(variant, n, per_minute, times_faster, cer_mean, cer_median, cut, loops, errors) of pages (variant, variant_ordinal, id, gt, answer, error, wall_s, cut, looped);
    wall_s is the variant's, and the first variant is what the others are compared with."""
    rows = pages.repartition("id", "variant").withColumn("cer", quick_rate(F.col("gt"), F.col("answer")))
    one = rows.groupBy("variant").agg(
        F.min("variant_ordinal").alias("variant_ordinal"), F.count("*").alias("n"), (60 * F.count("*") / F.max("wall_s")).alias("per_minute"), F.avg("cer").alias("cer_mean"),
        F.count_if("cut").alias("cut"), F.count_if("looped").alias("loops"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )
    middle = metrics.quantiles(rows, [("variant",)], "cer").select("variant", "cer_median")
    first = F.first("per_minute").over(Window.orderBy("variant_ordinal"))  # a row a variant
    return one.join(middle, "variant").withColumn("times_faster", F.col("per_minute") / first)


def card(items: DataFrame) -> DataFrame:
    """(category, dev, holdout, gt_types, sources) of each category and, with null, of all."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return items.rollup("category").agg(F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "holdout").alias("holdout"), listed("gt_type").alias("gt_types"), listed("source").alias("sources"))


def comparison(pages: DataFrame) -> DataFrame:
    """(system, n, vowels, agreement, loops, blanks, seconds) of texts (page, system, text, seconds) without truths: the mean
    share of vowel marks, the mean agreement with the other systems, loops, and texts of fewer than 20 characters."""
    rows = pages.select("system", "seconds", *(v.alias(k) for k, v in text_statistics(F.col("text")).items()))
    one = rows.groupBy("system").agg(F.count("*").alias("n"), F.avg("vowels").alias("vowels"), F.count_if("loop").alias("loops"), F.count_if(F.col("n_chars") < 20).alias("blanks"), F.avg("seconds").alias("seconds"))
    others = agreement(pages.where("text <> ''")).groupBy(F.col("a").alias("system")).agg(F.avg("agreement").alias("agreement"))
    return one.join(others, "system", "left")


def history(jobs: DataFrame) -> DataFrame:
    """(id, files, pages, warnings) of jobs (id, files array<struct<name, pages array<struct<error, note>>>>): a page with an error or a note is a warning."""
    pages = F.flatten(F.transform(F.coalesce("files", F.array().cast(jobs.schema["files"].dataType)), lambda f: f["pages"]))
    odd = F.filter(pages, lambda p: (F.coalesce(p["error"], F.lit("")) != "") | (F.coalesce(p["note"], F.lit("")) != ""))
    names = F.array_join(F.transform("files", lambda f: f["name"]), ", ")
    return jobs.select("id", F.coalesce(F.nullif(names, F.lit("")), F.lit(NONE)).alias("files"), F.coalesce(F.size(pages), F.lit(0)).alias("pages"), F.coalesce(F.size(odd), F.lit(0)).alias("warnings"))


def goal_totals(states: DataFrame, max_skips: int, problems: int = 0) -> DataFrame:
    """(complete, skipped, pending, reached): reached if nothing is pending, no problem is known and no more than max_skips are skipped."""
    n = lambda s: F.count_if(F.col("state") == s)
    pending = F.count_if(~F.col("state").isin("complete", "skipped"))
    return states.agg(n("complete").alias("complete"), n("skipped").alias("skipped"), pending.alias("pending"), ((pending == 0) & (n("skipped") <= max_skips) & F.lit(problems == 0)).alias("reached"))


def mentioned(names: DataFrame, published: str | Column) -> DataFrame:
    """names (name) with in_text: whether the published text has a row of that name."""
    text = F.lit(published) if isinstance(published, str) else published
    return names.withColumn("in_text", F.contains(text, F.concat(F.lit("| "), "name", F.lit(" |"))))


# Markdown.


def _by(rows: list[Row], *keys: str) -> dict:
    return {tuple(r[k] for k in keys): r for r in rows}


def summary_csv_rows(aggregates: DataFrame) -> DataFrame:
    """Aggregates as the summary file's rows: ALL for a model's own row, quarters in columns of their own."""
    quarters = [F.get("pos_q", F.lit(i)).alias(f"pos_q{i + 1}") for i in range(4)] if "pos_q" in aggregates.columns else []
    return aggregates.select("model", F.coalesce("category", F.lit("ALL")).alias("category"), *(c for c in aggregates.columns if c not in ("model", "category", "pos_q")), *quarters)


def report(rows: DataFrame, items: DataFrame, models: DataFrame, title: str, stale: list[str] = (), worst: int = 5) -> str:
    """The whole report of score rows: overview, categories, tables, long documents by place, and the worst answers.

    rows: of `score.score_all`; items: (id, ordinal, category, gt, gt_type, length_bin); models: (model, model_ordinal, peak_vram_mib).
    """
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in TABLE_MEASURES.items() if c not in rows.columns})
    totals = aggregate(rows).join(models, "model").cache()
    overall = in_report_order(totals.where("category IS NULL")).orderBy("place").collect()
    each = _by(totals.where("category IS NOT NULL").collect(), "model", "category")
    totals.unpersist()
    kinds = items.groupBy("category").agg(F.count("*").alias("n"), F.bool_or(F.col("gt_type") == "table_html").alias("any_table")).orderBy("category").collect()
    order = [r.model for r in overall]
    out = [f"# {title}", ""]
    if stale:
        out += [f"> The data set has changed since these models ran: {', '.join(stale)}. Their results cannot be compared with the others'.", ""]
    out += ["## Overview", ""]
    out += markdown_table(
        ["Model", "Items", "CER", "CER micro", "CER raw", "WER", "TEDS", "Failed", "Looping or too long", "s an item", "Memory"],
        ([r.model + ("" if r.complete else " (incomplete)"), f"{r.n_scored}/{r.n}", interval(r.cer_mean, r.cer_ci95), percent(r.cer_micro), percent(r.cer_raw_mean), percent(r.wer_mean), number(r.teds_mean), r.n_fail, f"{r.n_hallucination} (≤{percent(r.hallucination_upper95)})", number(r.latency_mean_s, 2), memory(r.peak_vram_mib)] for r in overall),
    )
    cell = lambda a: NONE if a is None else interval(a.cer_mean, a.cer_ci95) + ("" if a.complete else f" ({a.n_scored}/{a.n})")
    out += ["## CER by category", "", *markdown_table(["Category", *order], ([f"{k.category} ({k.n})", *(cell(each.get((m, k.category))) for m in order)] for k in kinds))]
    tables = [k.category for k in kinds if k.any_table]
    if tables:
        both = lambda a: NONE if a is None else f"{number(a.teds_mean)} / {number(a.teds_struct_mean)}"
        out += ["## TEDS by category (content / structure)", "", *markdown_table(["Category", *order], ([c, *(both(each.get((m, c))) for m in order)] for c in tables))]
    if "length_bin" in rows.columns:
        bins = _by(by_length(rows).collect(), "category", "length_bin", "model")
        for category in sorted({k[0] for k in bins}):
            labels = sorted({k[1] for k in bins if k[0] == category})
            table = category in tables
            said = (lambda a: f"{percent(a.cell_exact_mean, 0)} / {percent(a.cell_aligned_mean, 0)} · {number(a.teds_mean, 2)}") if table else (lambda a: f"{percent(a.cer_mean)} · {percent(a.pos_q[3], 0)}")
            out += [f"## Long documents: {category} ({'cells in place / in aligned rows · TEDS' if table else 'CER · last quarter'})", ""]
            out += markdown_table(["Length", *order], ([b, *(said(bins[category, b, m]) if (category, b, m) in bins else NONE for m in order)] for b in labels))
            extra = [(b, m, bins[category, b, m]) for m in order for b in labels if (category, b, m) in bins]
            out += markdown_table(["Model", "Length", "Q1", "Q2", "Q3", "Q4", "Cut", *["Rows of other width", "Other row counts"] * table], ([m, b, *(percent(q, 0) for q in a.pos_q), a.n_hit_max_tokens, *[a.rows_wrong_ncols, a.row_count_off] * table] for b, m, a in extra), 2)
    out += [f"## The {worst} worst answers of each model", ""]
    ranked = rows.where("NOT missing").withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("cer"), "ordinal"))).where(F.col("place") <= worst)
    shown = ranked.select("model", "place", "id", "category", "cer", "flags", texts.clip(F.coalesce("gt", F.lit(""))).alias("truth"), texts.clip(F.coalesce(F.nullif("error", F.lit("")), "answer")).alias("said")).collect()  # `worst` rows a model
    for m in order:
        mine = sorted((r for r in shown if r.model == m), key=lambda r: r.place)
        if mine:
            out += [f"### {m}", "", *markdown_table(["id", "Category", "CER", "Flags", "Truth", "Answer"], ([f"`{r.id}`", r.category, percent(r.cer), ", ".join(r.flags) or NONE, r.truth, r.said] for r in mine), 6)]
    return "\n".join(out)


def status_markdown(quick: DataFrame, totals: dict[str, int], states: dict[str, str], title: str = "Status") -> str:
    """Progress by model, and rates by category; totals: items of the set, states: of models."""
    rows = quick.collect()
    all_, each = sorted((r for r in rows if r.category is None), key=lambda r: r.model), _by([r for r in rows if r.category is not None], "model", "category")
    models, categories = [r.model for r in all_], sorted({k[1] for k in each})
    out = [f"# {title}", "", *markdown_table(["Model", "State", "Done", "Errors", "CER so far", "s an item"], ([r.model, states.get(r.model, NONE), f"{r.n}/{sum(totals.values())}", r.errors, percent(r.cer_mean), number(r.latency_mean_s, 2)] for r in all_), 2)]
    cell = lambda r: f"{r.n}: {percent(r.cer_mean)}" if r else NONE
    return "\n".join([*out, *markdown_table(["Category", *models], ([f"{c} ({totals.get(c, 0)})", *(cell(each.get((m, c))) for m in models)] for c in categories))])


def decision(stage: str, split: str, rows: DataFrame) -> tuple[str, str]:
    """(JSON, Markdown) of the rows of `decide.screening` or `decide.final`."""
    found: dict[str, list[dict]] = {}
    for r in rows.collect():
        found.setdefault(r.category, []).append({k: v for k, v in r.asDict().items() if k != "category"})
    for models in found.values():
        models.sort(key=lambda e: (e.get("rank") is None, e.get("rank") or 0, e["model"]))
    out = [f"# Decision: {stage} ({split})", ""]
    for category, models in sorted(found.items()):
        chosen = [e["model"] for e in models if e.get("finalist") or e.get("winner")]
        tied = [e["model"] for e in models if e.get("tied")]
        out += [f"## {category}", "", f"{'Finalists' if stage == 'screening' else 'Winner'}: {', '.join(chosen) or NONE}" + (f" (tied: {', '.join(tied)})" if tied else ""), ""]
        out += markdown_table(["Model", "Value", "Status", "Reason"], ([e["model"], percent(e["value"]), e.get("status", "kept"), e.get("reason", "")] for e in models))
    return json.dumps({"stage": stage, "split": split, "categories": found}, ensure_ascii=False, indent=2), "\n".join(out)


def leaderboard_markdown(board: DataFrame, skips: DataFrame, waiting: list[str], title: str = "Leaderboard", sections: DataFrame | None = None, states: dict[str, str] = {}, tables: tuple[str, ...] = (), long: tuple[str, ...] = ()) -> str:  # noqa: B006 - never changed
    """The leaderboard in rank order. With sections (of `leaderboard.sections`): failures, latency and variants of each model, its measure
    in each category with its interval (of `tables` the cells in place, and the texts' errors beside them), and the places of
    `long` categories by quarter. states: of models, as of `goal_states`."""
    rows = [r for r in board.orderBy("rank").collect() if r.n_done]
    found = _by(sections.collect(), "name", "category") if sections is not None else {}
    whole = lambda r: found.get((r.name, None))
    head = ["#", "Model", "Done", "Text CER", "Cells in place", "Memory", *["Looping or too long", "Failed", "s an item", "State", "Variants"] * bool(found)]
    more = lambda r: [whole(r).n_hallucination, whole(r).n_fail, number(whole(r).latency_mean_s, 2), states.get(r.name, NONE), ", ".join(f"`{v}`" for v in whole(r).variants)] if whole(r) else [NONE] * 5 * bool(found)
    out = [f"# {title}", "", *markdown_table(head, ([r["rank"], r.name, r.n_done, percent(r.text_cer), percent(r.table_exact), memory(r.vram), *more(r)] for r in rows), 2)]
    categories = sorted({c for _, c in found if c is not None})
    if rows and categories:

        def measure(name: str, category: str) -> str:
            a = found.get((name, category))
            if a is None or not a.complete:
                return NONE
            return f"{interval(a.cell_exact_mean, a.cell_exact_ci95)} · CER {percent(a.cer_mean)}" if category in tables else interval(a.cer_mean, a.cer_ci95)

        out += ["## By category", "", "Error rates of texts; of tables (*) the cells in place. Categories that are not complete are left open.", ""]
        out += markdown_table(["Category", *(r.name for r in rows)], ([c + " *" * (c in tables), *(measure(r.name, c) for r in rows)] for c in categories))
        by_place = [(r.name, c, a) for r in rows for c in categories if c in long and (a := found.get((r.name, c))) and a.n_scored]
        if by_place:
            quarters = lambda a: [percent(q, 0) for q in a.pos_q] if "pos_q" in a else [NONE] * 4
            out += ["## Long documents by place", ""]
            out += markdown_table(["Model", "Category", "Q1", "Q2", "Q3", "Q4", "Cut", "Rows of other width"], ([n, c, *quarters(a), a.n_hit_max_tokens, a.rows_wrong_ncols] for n, c, a in by_place), 2)
    if left := skips.collect():
        out += ["## Skipped", "", *markdown_table(["Model", "Reason", "Detail"], ([s.name, s.reason_code, (s.detail or "").replace("|", "/")] for s in left), 3)]
    return "\n".join([*out, *([f"Not run yet: {', '.join(waiting)}.", ""] if waiting else [])])


def frame_markdown(frame: DataFrame, head: list[str], show: dict[str, Callable] = {}) -> str:  # noqa: B006 - never changed
    """A report's frame (speed test, comparison, card) as a table; show: formatters by column."""
    rows = [[show.get(c, lambda v: NONE if v is None else v)(r[c]) for c in frame.columns] for r in frame.collect()]
    return "\n".join(markdown_table(head, rows))


def comparison_page(pages: DataFrame, title: str = "Comparison", shown: int = 20) -> str:
    """An HTML page of texts (page, system, text, seconds) without truths: the systems' measures, and the first `shown` pages' texts side by
    side, which may be anything and are shown as they are."""
    measures = comparison(pages).orderBy("system").collect()
    systems = [r.system for r in measures]
    few = pages.select("page").distinct().orderBy("page").limit(shown)
    texts_of = {(r.page, r.system): r.text for r in pages.join(F.broadcast(few), "page").select("page", "system", "text").collect()}  # `shown` pages
    cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
    head = ["System", "Pages", "Vowel marks", "Agreement", "Loops", "Blank", "s a page"]
    rows = [[r.system, r.n, number(r.vowels), number(r.agreement), r.loops, r.blanks, number(r.seconds, 2)] for r in measures]
    table = lambda head, rows: "<table><tr>" + "".join(cell("th", h) for h in head) + "</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>"
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>", cell("h1", title), table(head, rows)]
    for page in sorted({p for p, _ in texts_of}):
        side = "".join(f'<td dir="auto"><pre>{html.escape(texts_of.get((page, s)) or "")}</pre></td>' for s in systems)
        out.append(f"{cell('h2', page)}<table><tr>{''.join(cell('th', s) for s in systems)}</tr><tr>{side}</tr></table>")
    return "\n".join(out)


def exported(jobs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(file, job, markdown) of files by name (all, if none is given) from the newest job that holds each: its pages' texts in order, with what
    went wrong. jobs: (id, files array<struct<name, pages array<struct<text, error, note>>>>)."""
    files = jobs.select("id", F.explode("files").alias("f")).select("id", F.col("f.name").alias("file"), F.col("f.pages").alias("pages"))
    files = files.where(F.col("file").isin(*names)) if names else files
    newest = files.groupBy("file").agg(F.max_by(F.struct("id", "pages"), "id").alias("n")).select("file", F.col("n.id").alias("job"), "n.pages")
    said = lambda p: F.concat_ws("\n\n", F.when(F.coalesce(p["error"], F.lit("")) != "", F.concat(F.lit("> Error: "), p["error"])), F.when(F.coalesce(p["note"], F.lit("")) != "", F.concat(F.lit("> "), p["note"])), F.nullif(F.trim(p["text"]), F.lit("")))
    page = lambda p, i: F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), said(p))
    whole = F.concat(F.lit("# "), F.col("file"), F.lit("\n\n"), F.array_join(F.transform("pages", page), "\n\n"))
    return newest.select("file", "job", whole.alias("markdown"))
