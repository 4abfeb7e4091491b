"""Seeded documents with known truths, made by column expressions: the same seed gives the same rows on any cluster.

Every choice is a hash of the seed, the document's number and the name of what is chosen, so rows do not depend on each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.markup import changed_numbers, isolated_runs

# What documents are made of.
COMPANIES = ("Northwind Traders", "Gulf Horizon LLC", "Blue Harbor Ltd", "Cedar & Sons", "Delta Instruments")
PEOPLE = ("Sara Haddad", "John Carter", "Omar Nasser", "Emily Stone", "Lina Farah", "David Reed")
GOODS = ("Printer paper", "LED lamp", "Steel bolt", "Office chair", "Copper wire", "Water pump", "Notebook")
UNITS = ("pcs", "box", "carton", "m", "kg")
SHOPS = ("Corner Market", "Book House", "City Pharmacy", "Fuel Station 12", "Coffee Yard")
LABELS = ("Neurological", "Autoimmune", "Infection", "Cardiac", "Renal", "Hepatic", "Endocrine", "Respiratory", "Dermal", "Ocular", "Skeletal", "Vascular", "Metabolic", "Genetic")
GROUPS = (("Treatment", "Control"), ("Men", "Women"), ("Before", "After"))
CLAUSES = ("The supplier delivers the goods within {n} days.", "Payment is due {n} days after the invoice.", "Either party may end this contract with {n} days notice.", "Delays beyond {n} days cost one percent of the price.")
MARKS = ("†", "‡", "§", "*")
#: (pages, least and most rows) of long tables, (pages, characters) of long texts, by bin.
TABLE_BINS = ((1, 30, 45), (2, 60, 90), (3, 100, 140))
TEXT_BINS = ((1, 4000), (2, 8500))
KINDS = ("contract", "letter", "invoice", "form")


class Draw:
    """Choices for a row: by the seed, the row's number and a name; `at` tells repeated ones apart."""

    def __init__(self, seed: int, number: Column) -> None:
        self.seed, self.number = F.lit(seed), number

    def below(self, n: int | Column, name: str, at: Column | int = 0) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return F.pmod(F.xxhash64(self.seed, self.number, F.lit(name), at), F.lit(n).cast("long") if isinstance(n, int) else n.cast("long"))

    def between(self, low: int, high: int, name: str, at: Column | int = 0) -> Column:
        return self.below(high - low + 1, name, at) + low

    def one(self, choices: tuple, name: str, at: Column | int = 0) -> Column:
        return F.get(F.array(*map(F.lit, choices)), self.below(len(choices), name, at).cast("int"))

    def money(self, low: int, high: int, name: str, at: Column | int = 0) -> Column:
        return (self.between(100 * low, 100 * high, name, at) / 100).cast("decimal(12,2)")


def _row(cells: list[Column], tag: str = "td") -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), c.cast("string"), F.lit(f"</{tag}>")) for c in cells), F.lit("</tr>"))


def _table(*rows: Column) -> Column:
    return F.concat(F.lit("<table>"), *rows, F.lit("</table>"))


def _date(draw: Draw, name: str, at: Column | int = 0) -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), draw.below(900, name, at).cast("int")), "dd/MM/yyyy")


#: What documents say, by language; {..} are drawn. Each kind has several templates of paragraphs (h: a heading), of which one is drawn.
SAID = {
    "en": {
        "companies": COMPANIES, "people": PEOPLE, "goods": GOODS, "heads": ("No.", "Item", "Qty", "Price"), "invoice": ("Invoice", "Tax invoice"), "total": "Total",
        "clauses": CLAUSES,
        "contract": (("h:Contract", "Between {company} and {person}.", "{clauses}"), ("h:Service agreement", "Made on {date} by {company}.", "{clauses}", "Signed: {person}")),
        "letter": (("{date}", "Dear {person},", "we thank you for your order of {count} {good}.", "{company}"), ("{company}", "{date}", "Dear {person},", "the {count} {good} you asked for have left our store.", "Yours sincerely,", "{other}")),
        "form": (("h:Form", "Name: {person}", "Born: {date}", "Employer: {company}", "Number: {number}"), ("h:Application", "Number: {number}", "Employer: {company}", "Name: {person}", "Since: {date}")),
    },
    "ar": {
        "companies": ("شركة الأفق للتجارة", "مؤسسة النور", "مصنع الخليج", "مكتبة المدينة"), "people": ("سارة حداد", "عمر ناصر", "لينا فرح", "خالد منصور", "نور الدين"),
        "goods": ("ورق طباعة", "مصباح", "كرسي مكتب", "مضخة ماء", "دفتر"), "heads": ("رقم", "الصنف", "الكمية", "السعر"), "invoice": ("فاتورة", "فاتورة ضريبية"), "total": "المجموع",
        "clauses": ("يسلم المورد البضائع خلال {n} يوما.", "يستحق الدفع بعد {n} يوما من تاريخ الفاتورة.", "لكل طرف إنهاء العقد بإشعار قبل {n} يوما."),
        "contract": (("h:عقد", "بين {company} و{person}.", "{clauses}"), ("h:اتفاقية خدمات", "حررت في {date} من {company}.", "{clauses}", "التوقيع: {person}")),
        "letter": (("{date}", "السيد {person}،", "نشكركم على طلب {count} من {good}.", "{company}"), ("{company}", "السيد {person}،", "تم شحن {count} من {good}.", "مع التحية", "{other}")),
        "form": (("h:استمارة", "الاسم: {person}", "تاريخ الميلاد: {date}", "جهة العمل: {company}", "الرقم: {number}"), ("h:طلب", "الرقم: {number}", "الاسم: {person}", "جهة العمل: {company}")),
    },
}
#: Arabic documents with names, goods and dates in English.
SAID["mixed"] = SAID["ar"] | {k: SAID["en"][k] for k in ("companies", "goods")}
LANGUAGES = tuple(SAID)


def _filled(draw: Draw, template: str, said: dict, place: int) -> Column:
    """A template with what is drawn for it; several clauses are paragraphs of their own."""
    n = lambda low, high, name, at=0: draw.between(low, high, name, at).cast("string")
    clause = lambda i: F.concat(i.cast("string"), F.lit(". "), F.replace(draw.one(said["clauses"], "clause", i), F.lit("{n}"), n(5, 90, "days", i)))
    drawn = {
        "{company}": lambda: draw.one(said["companies"], "company"), "{person}": lambda: draw.one(said["people"], "person"), "{other}": lambda: draw.one(said["people"], "other"), "{good}": lambda: draw.one(said["goods"], "good"),
        "{date}": lambda: _date(draw, "date"), "{count}": lambda: n(2, 500, "count"), "{number}": lambda: n(10**6, 10**7, "number"),
        "{clauses}": lambda: F.array_join(F.transform(F.sequence(F.lit(1), draw.between(3, 6, "clauses").cast("int")), clause), "</p><p>"),
    }
    text = F.lit(template.removeprefix("h:"))
    for key, value in drawn.items():
        if key in template:
            text = F.replace(text, F.lit(key), value())
    return F.concat(F.lit("<h2>"), text, F.lit("</h2>")) if template.startswith("h:") else F.concat(F.lit("<p>"), text, F.lit("</p>"))


def documents(spark: SparkSession, n: int, kind: str, seed: int = 0, lang: str = "en") -> DataFrame:
    """(id, kind, lang, page, gt, gt_type) of n documents of a kind; the page holds the truth. Invoices' truths are tables.

    Some Arabic documents write their numbers in Arabic digits. On Arabic pages runs of Latin words and numbers are kept from left to right,
    which the truth does not show.
    """
    if kind not in KINDS or lang not in SAID:
        raise ValueError(f"no such kind or language: {kind}, {lang}")
    rows, said = spark.range(n), SAID[lang]
    draw = Draw(seed, F.concat(F.lit(f"{kind}:{lang}:"), F.col("id").cast("string")))
    if kind == "invoice":
        lines = F.sequence(F.lit(1), draw.between(3, 8, "lines").cast("int"))
        price = lambda i: draw.money(1, 900, "price", i)
        each = F.transform(lines, lambda i: _row([i, draw.one(said["goods"], "good", i), draw.between(1, 40, "count", i), price(i)]))
        total = F.aggregate(F.transform(lines, price), F.lit(0).cast("decimal(14,2)"), lambda a, v: (a + v).cast("decimal(14,2)"))
        last = F.when(draw.below(2, "total") == 0, F.concat(F.lit(f'<tr><td colspan="3">{said["total"]}</td><td>'), total.cast("string"), F.lit("</td></tr>"))).otherwise("")
        body = F.concat(F.lit("<h2>"), draw.one(said["invoice"], "title"), F.lit("</h2><p>"), draw.one(said["companies"], "company"), F.lit("</p>"), _table(_row([F.lit(h) for h in said["heads"]], "th"), F.array_join(each, ""), last))
    else:
        forms = [F.concat(*(_filled(draw, part, said, i) for i, part in enumerate(form))) for form in said[kind]]
        body = F.get(F.array(*forms), draw.below(len(forms), "form").cast("int"))
    if lang != "en":
        outside = lambda part: F.when(part.startswith("<"), part).otherwise(F.translate(part, "0123456789", "٠١٢٣٤٥٦٧٨٩"))
        body = F.when(draw.below(2, "digits") == 0, F.array_join(F.transform(F.split(body, "(?=<)|(?<=>)"), outside), "")).otherwise(body)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "</(?:p|h2)>", "\n"), "<[^>]+>", ""), "\n$", "")
    shown = body if lang == "en" else isolated_runs(body)
    page = F.concat(F.lit(f'<!doctype html><html lang="{lang[:2]}"{"" if lang == "en" else ' dir="rtl"'}><body><div class="page">'), shown, F.lit("</div></body></html>"))
    name = F.concat(F.lit(f"syn_{kind}_" if lang == "en" else f"syn_{kind}_{lang}_"), F.col("id").cast("string"))
    return rows.select(name.alias("id"), F.lit(kind).alias("kind"), F.lit(lang).alias("lang"), page.alias("page"), (body if kind == "invoice" else text).alias("gt"), F.lit("table_html" if kind == "invoice" else "text").alias("gt_type"))


def page_bounds(rows: Column, pages: int) -> Column:
    """Where the pages of a table begin and end, evenly: pages + 1 positions, shorter pages first."""
    return F.array(*(F.floor(rows * k / pages).cast("int") for k in range(pages + 1)))


def long_tables(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, length_bin, n_rows, header_repeated, pages, gt, gt_type): account statements and stock lists over one to three pages.

    The truth is one table. On half of those with several pages the heading stands on each.
    """
    made = []
    for b, (pages, low, high) in enumerate(TABLE_BINS):
        draw = Draw(seed, F.concat(F.lit(f"table{b}:"), F.col("id").cast("string")))
        n_rows = draw.between(low, high, "rows").cast("int")
        statement, repeated = draw.below(2, "kind") == 0, (draw.below(2, "repeat") == 0) & F.lit(pages > 1)
        debit = lambda i: draw.below(100, "side", i) < 65
        paid = lambda i: [_date(draw, "day", i), F.concat(F.lit("TRX"), draw.between(10**7, 10**8 - 1, "ref", i).cast("string")), draw.one(SHOPS, "shop", i), F.when(debit(i), draw.money(10, 3000, "amount", i).cast("string")).otherwise(""), F.when(~debit(i), draw.money(500, 15000, "amount", i).cast("string")).otherwise(""), draw.money(100, 90000, "balance", i)]
        kept = lambda i: [F.concat(F.lit("G"), draw.between(1000, 9999, "code", i).cast("string")), draw.one(GOODS, "good", i), draw.one(UNITS, "unit", i), draw.between(1, 400, "count", i), draw.money(1, 900, "price", i), draw.one((0, 0, 5, 10, 15), "off", i), draw.money(1, 900, "tax", i), draw.money(10, 99999, "total", i)]
        head = F.when(statement, _row([F.lit(h) for h in ("Date", "Reference", "Description", "Debit", "Credit", "Balance")], "th")).otherwise(_row([F.lit(h) for h in ("Code", "Item", "Unit", "Qty", "Unit price", "Off", "Tax", "Total")], "th"))
        body = F.transform(F.sequence(F.lit(1), n_rows), lambda i: F.when(statement, _row(paid(i))).otherwise(_row(kept(i))))
        rows = spark.range(n).select("id", n_rows.alias("n_rows"), repeated.alias("header_repeated"), head.alias("head"), body.alias("body"))
        bounds = page_bounds(F.col("n_rows"), pages)
        part = lambda k: F.slice("body", F.get(bounds, F.lit(k)) + 1, F.get(bounds, F.lit(k + 1)) - F.get(bounds, F.lit(k)))
        of_page = [_table(F.col("head") if k == 0 else F.when(F.col("header_repeated"), F.col("head")).otherwise(""), F.array_join(part(k), "")) for k in range(pages)]
        made.append(rows.select(F.concat(F.lit(f"syn_longtable_{b}_"), F.col("id").cast("string")).alias("id"), F.lit(f"{pages} pages, {low}-{high} rows").alias("length_bin"), "n_rows", "header_repeated", F.array(*of_page).alias("pages"), _table(F.col("head"), F.array_join("body", "")).alias("gt"), F.lit("table_html").alias("gt_type")))
    return reduce(DataFrame.unionByName, made)


def marker_tables(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, gt, n_markers): tables of 7 to 12 rows, with raised marks before about 28 % of the counts."""
    draw = Draw(seed, F.col("id"))
    rows = F.sequence(F.lit(1), draw.between(7, 12, "rows").cast("int"))
    first = draw.below(len(LABELS), "first")
    label = lambda i: F.get(F.array(*map(F.lit, LABELS)), F.pmod(first + i, F.lit(len(LABELS))).cast("int"))
    marked = lambda i, j: draw.below(100, f"marked{j}", i) < 28
    number = lambda i, j: draw.between(1, 999, f"n{j}", i).cast("string") if j % 2 == 0 else (draw.between(0, 999, f"n{j}", i) / 10).cast("decimal(4,1)").cast("string")
    cell = lambda i, j: F.when(marked(i, j), F.concat(F.lit("<sup>"), draw.one(MARKS, f"mark{j}", i), F.lit("</sup>"), number(i, j))).otherwise(number(i, j)) if j % 2 == 0 else number(i, j)
    pair = lambda k: F.get(F.array(*(F.lit(g[k]) for g in GROUPS)), draw.below(len(GROUPS), "groups").cast("int"))
    top = F.concat(F.lit('<tr><td></td><td colspan="2">'), pair(0), F.lit('</td><td colspan="2">'), pair(1), F.lit("</td></tr>"), _row([F.lit(h) for h in ("", "n", "(%)", "n", "(%)")]))
    body = F.array_join(F.transform(rows, lambda i: _row([label(i), *(cell(i, j) for j in range(4))])), "")
    count = F.aggregate(F.transform(rows, lambda i: marked(i, 0).cast("int") + marked(i, 2).cast("int")), F.lit(0), lambda a, b: a + b)
    return spark.range(n).select("id", _table(top, body).alias("gt"), count.alias("n_markers"))


def articles(frame: DataFrame, n: int, least: int = 12_000) -> DataFrame:
    """(id, title, parts array<struct<kind, text>>) of the first n articles (id, title, text) by id that are long and of
    paragraphs: at least 8, of 150 characters on the average. Short lines without an end are headings."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line: F.trim(line)), lambda x: x != "")
    kind = lambda x: F.when((F.length(x) < 60) & ~x.rlike("[.!?؟:،,;]$"), "h2").otherwise("p")
    rows = frame.where(F.length("text") >= least).select("id", "title", F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), x.alias("text"))).alias("parts"))
    said = F.transform(F.filter("parts", lambda p: p["kind"] == "p"), lambda p: F.length(p["text"]))
    fit = (F.size(said) >= 8) & (F.aggregate(said, F.lit(0), lambda a, b: a + b) >= 150 * F.size(said))
    return rows.where(fit).orderBy("id").limit(n)


def long_texts(found: DataFrame, pages: int, budget: int, seed: int = 0) -> DataFrame:
    """(id, pages array<string>, gt): an article's first parts up to a budget of characters, numbers changed, cut into pages at parts."""
    before = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, q: a + F.length(q["text"])))
    rows = found.withColumn("before", before).withColumn("parts", F.filter("parts", lambda p, i: F.get("before", i) < budget))
    last = F.array_max(F.transform("parts", lambda p, i: F.when(p["kind"] == "p", i + 1).otherwise(0)))  # no heading at the end
    rows = rows.withColumn("parts", F.slice("parts", F.lit(1), F.coalesce(last, F.lit(0))))
    said = F.transform("parts", lambda p, i: F.struct(p["kind"].alias("kind"), changed_numbers(p["text"], F.xxhash64(F.lit(seed), "id", i)).alias("text")))
    rows = rows.withColumn("parts", F.concat(F.array(F.struct(F.lit("h1").alias("kind"), F.col("title").alias("text"))), said))
    total = F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p["text"]))
    upto = F.transform("parts", lambda p, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, q: a + F.length(q["text"])))
    rows = rows.withColumns({"total": total, "upto": upto})
    # a part belongs to the page in which it begins; a heading to that of the part after it
    page = lambda i: F.least(F.lit(pages - 1), F.floor(F.get("upto", i) * pages / F.greatest("total", F.lit(1))).cast("int"))
    at = F.transform("parts", lambda p, i: F.when((p["kind"] == "h2") & (i + 1 < F.size("parts")), page(i + 1)).otherwise(page(i)))
    rows = rows.withColumn("at", at)

    def on_page(k: int) -> Column:
        return F.array_join(F.transform(F.filter("parts", lambda p, i: F.get("at", i) == k), lambda p: p["text"]), "\n")

    texts = [on_page(k) for k in range(pages)]
    return rows.select("id", F.filter(F.array(*texts), lambda t: t != "").alias("pages"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("gt"))


def samples(frame: DataFrame, n: int, seed: int = 0, keep: str = "true", gt: str = "text", uid: str = "id", gt_type: str = "text") -> DataFrame:
    """(uid, gt, gt_type) of n rows that `keep` holds for, those with the least hash of seed and uid: a fixed sample of a public source,
    whose truth, name and filter are SQL expressions."""
    rows = frame.where(keep).select(F.expr(uid).cast("string").alias("uid"), F.expr(gt).alias("gt"), F.lit(gt_type).alias("gt_type"))
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "uid"), 256), "uid").limit(n)


def test_set(spark: SparkSession, n: int, holdout: float = 0.5, seed: int = 0, public: DataFrame | None = None, languages: tuple[str, ...] = ("en",), long: DataFrame | None = None, markers: int = 0) -> DataFrame:
    """(id, category, gt, gt_type, split, source) of the generators: documents of every kind and language, long tables, `markers` tables
    with raised marks, long texts of the articles `long` (of `articles`) in every length; and of public samples (uid, gt, gt_type, category, source)."""
    from ..functions.hashing import split_of

    own = lambda frame, category: frame.select("id", F.lit(category).alias("category"), "gt", "gt_type", F.lit("synthetic").alias("source"))
    made = [own(documents(spark, n, kind, seed, lang), f"syn_{kind}" if lang == "en" else f"syn_{kind}_{lang}") for lang in languages for kind in KINDS]
    made.append(own(long_tables(spark, -(-n // len(TABLE_BINS)), seed), "syn_longtable"))
    if markers:
        marked = marker_tables(spark, markers, seed).select(F.concat(F.lit("syn_markers_"), F.col("id").cast("string")).alias("id"), "gt", F.lit("table_html").alias("gt_type"))
        made.append(own(marked, "syn_markers"))
    for pages, characters in TEXT_BINS if long is not None else ():
        texts = long_texts(long, pages, characters, seed).select(F.concat(F.lit(f"syn_longtext_{pages}_"), F.col("id").cast("string")).alias("id"), "gt", F.lit("text").alias("gt_type"))
        made.append(own(texts, "syn_longtext"))
    if public is not None:
        made.append(public.select(F.concat_ws("_", "source", "uid").alias("id"), "category", "gt", "gt_type", "source"))
    return reduce(DataFrame.unionByName, made).withColumn("split", split_of(F.col("id"), seed, holdout))


def missing_from(listed: DataFrame, present: DataFrame) -> DataFrame:
    """(name, problem) of files that a data set lists (name, digest) and a folder (name, digest) has not, has with other content, or has besides:
    the check after a download. The fingerprint of the whole set is `operators.dataset.fingerprint`."""
    both = listed.alias("l").join(present.alias("p"), "name", "full_outer")
    problem = F.when(F.col("p.digest").isNull(), "missing").when(F.col("l.digest").isNull(), "not listed").when(F.col("l.digest") != F.col("p.digest"), "other content")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")
