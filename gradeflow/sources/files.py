"""Sources and sinks of files: manifests, prediction logs, run metadata, job histories, locks, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import scratch

PREDICTION = "id string, text string, confidence double, latency_s double, extra string, error string"
MANIFEST = "id string, image string, category string, gt string, gt_file string, gt_type string, doc_id string, split string, lang string"
# The type of a truth by its file's suffix.
TRUTH_TYPES = {"html": "table_html", "htm": "table_html", "md": "text", "txt": "text"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line) of text files, read in splits; at orders the lines of a file: struct(start of the split, place in it)."""
    text = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"), "value")
    return text.select(F.col("file_path").alias("file"), F.struct(F.col("file_block_start").alias("start"), "place").alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, line): lines with their numbers over all files, in order of the files' paths. Only the number of lines of
    each split meets in one place."""
    read = lines(spark, path)
    splits = read.groupBy("file", "at.start").agg(F.min("at.place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    offsets = splits.withColumn("before", before).select(F.col("file").alias("_file"), "start", "first", "before")
    met = read.join(F.broadcast(offsets), (F.col("at.start") == F.col("start")) & (F.col("file") == F.col("_file")))
    return met.select("file", (F.col("before") + F.col("at.place") - F.col("first")).alias("ordinal"), "line")


def truth_type(path: Column, explicit: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    known = F.coalesce(*(F.when(suffix == s, t) for s, t in TRUTH_TYPES.items()))
    return F.coalesce(F.nullif(explicit, F.lit("")), known, F.lit("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON Lines manifest; blank lines and those that begin with # are skipped. `image` may be a text or a list."""
    rows = numbered(spark, path).where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    rows = rows.select("file", "ordinal", "line", F.from_json("line", MANIFEST).alias("j"), F.try_parse_json("line").alias("meta"))
    images = F.coalesce(F.try_variant_get("meta", "$.image", "array<string>"), F.array("j.image"))
    group = F.coalesce(F.nullif("j.doc_id", F.lit("")), F.col("j.id"))
    kind = truth_type(F.coalesce("j.gt_file", F.lit("")), F.col("j.gt_type"))
    raw = F.to_json(F.try_variant_get("meta", "$.id", "variant"))  # as it stands: 1 and "1" are two ids here
    folder = F.regexp_replace("file", "[^/]*$", "")
    return rows.select("ordinal", "j.id", raw.alias("raw_id"), images.alias("images"), "j.category", "j.gt", "j.gt_file", kind.alias("gt_type"), group.alias("doc_id"), "j.split", "j.lang", folder.alias("folder"), "meta")


def manifest_errors(items: DataFrame) -> DataFrame:
    """(ordinal, id, problem): a check of its own over all items, which no selection can prune."""
    problem = (
        F.when(F.col("meta").isNull(), "bad JSON").when(F.col("id").isNull(), "no id").when(F.col("category").isNull(), "no category")
        .when(F.size(F.filter("images", lambda x: x.isNotNull() & (x != ""))) == 0, "no image")
        .when(F.col("split").isNotNull() & ~F.col("split").isin("dev", "holdout"), "bad split").when(F.coalesce("gt", "gt_file").isNull(), "no truth")
    )
    twice = items.groupBy("raw_id").agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal"), F.max("id").alias("id")).where("n > 1 AND id IS NOT NULL").select("ordinal", "id", F.lit("duplicate id").alias("problem"))
    return items.select("ordinal", "id", problem.alias("problem")).where("problem IS NOT NULL").unionByName(twice)


def _resolved(folder: Column, path: Column) -> Column:
    """A path relative to a folder, without `.` and `..`, as files are listed."""
    whole = F.when(path.startswith("/") | path.rlike("^[a-z]+:"), path).otherwise(F.concat(folder, path))
    parts = F.split(F.regexp_replace(whole, "^[a-z]+:/*", "/"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def with_truth_files(items: DataFrame, root: str) -> DataFrame:
    """Truths that stand in files below root, joined by their whole path, which is relative to the manifest; inline truths stay."""
    spark = items.sparkSession
    text = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(_resolved(F.lit("/"), F.col("_metadata.file_path")).alias("_path"), F.col("value").alias("_text"))
    met = items.withColumn("_path", _resolved(F.col("folder"), F.col("gt_file"))).join(text, "_path", "left")
    return met.withColumn("gt", F.coalesce("gt", "_text")).drop("_path", "_text")


def missing_files(items: DataFrame, root: str) -> DataFrame:
    """(id, path) of images and truth files that items (id, images, gt_file, folder) name and that are not below root."""
    spark = items.sparkSession
    present = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_resolved(F.lit("/"), F.col("path")).alias("path"))
    named = items.select("id", "folder", F.explode(F.array_compact(F.array_append("images", F.col("gt_file")))).alias("name"))
    return named.select("id", _resolved(F.col("folder"), F.col("name")).alias("path")).join(present, "path", "left_anti").select("id", "path")


def paired_files(spark: SparkSession, root: str) -> DataFrame:
    """(category, stem, doc_id, image, truth) of a directory: category is the folder, a truth the first of .html .htm .txt .md beside the image; images without one are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)/([^/]+)\.([^./]+)$", 0)
    parts = [F.regexp_extract(name, r"([^/]+)/([^/]+)\.([^./]+)$", i) for i in (1, 2, 3)]
    files = files.select("path", parts[0].alias("category"), parts[1].alias("stem"), F.lower(parts[2]).alias("kind"))
    order = F.array_position(F.array(*map(F.lit, ("html", "htm", "txt", "md"))), F.col("kind"))
    truths = files.withColumn("_order", order).where("_order > 0").groupBy("category", "stem").agg(F.min_by("path", "_order").alias("truth"))
    images = files.where(F.col("kind").isin("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")).groupBy("category", "stem").agg(F.min("path").alias("image"))
    return images.join(truths, ["category", "stem"]).withColumn("doc_id", F.split("stem", "__").getItem(0))


def prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of append-only JSON Lines logs with seq, which orders those of a log; torn and blank lines are left out."""
    rows = lines(spark, path).select("file", F.col("at").alias("seq"), F.from_json("line", PREDICTION).alias("p"), F.try_parse_json("line").alias("whole"))
    return rows.where("whole IS NOT NULL AND p.id IS NOT NULL").select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("model"), "seq", "p.*")


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sessions with what follows from them: finished or interrupted, and the peak memory (0 is unknown)."""
    runs = spark.read.option("multiLine", "true").json(path)
    return runs.withColumn("interrupted", F.exists("sessions", lambda s: s["finished"].isNull())).withColumn("peak", F.nullif(F.array_max(F.transform("sessions", lambda s: s["peak_vram_mib"])), F.lit(0)))


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """Job histories below root, unreadable ones left out, newest first."""
    found = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(f"{root}/*/job.json")
    return found.orderBy(F.desc("id"))


def lock(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest) of lines `digest  name`."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[1].alias("name"), parts[0].alias("digest"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("digest"))


def spec_hash(adapter: str, params: dict, env: dict) -> str:
    """Of what makes answers comparable; the number of devices does not."""
    import hashlib

    return hashlib.sha256(json.dumps({"adapter": adapter, "env": env, "params": params}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def write_scores(rows: DataFrame, path: str) -> None:
    """Score rows by (split, model): a run replaces the parts that it holds and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "model").parquet(path)


def write_summary(aggregates: DataFrame, path: str) -> None:
    plain = [F.col(f.name) if f.dataType.typeName() != "array" else F.array_join(F.col(f.name).cast("array<string>"), " ").alias(f.name) for f in aggregates.schema.fields]
    aggregates.select(*plain).write.mode("overwrite").option("header", "true").csv(path)


def write_lock(digests: DataFrame, path: str) -> None:
    """One file of lines `digest  name`, by name, as `lock` reads it."""
    digests.orderBy("name").select(F.concat_ws("  ", "digest", "name")).coalesce(1).write.mode("overwrite").text(path)


def append_session(sessions: DataFrame, path: str) -> None:
    """Sessions of runs (model, started, finished, spec, fingerprint, peak_vram_mib, ...) are only ever added; what is true of a model follows from all of them."""
    sessions.write.mode("append").partitionBy("model").parquet(path)


def metadata_of(sessions: DataFrame) -> DataFrame:
    """(model, spec, peak_vram_mib, interrupted, sessions) from a model's sessions: the last specification, the peak over all (0 is unknown), any without an end."""
    return sessions.groupBy("model").agg(F.max_by("spec", "started").alias("spec"), F.nullif(F.max("peak_vram_mib"), F.lit(0)).alias("peak_vram_mib"), F.bool_or(F.col("finished").isNull()).alias("interrupted"), F.count("*").alias("sessions"))


def append_job(job: DataFrame, root: str) -> None:
    """A job's record, in a folder of its own by id."""
    job.write.mode("append").partitionBy("id").json(root)


def delete_job(root: str, id: str) -> None:
    """Removes a job's folder: one directly below root that holds a job's record, and nothing else."""
    fs, top = pafs.FileSystem.from_uri(root)
    place = f"{top}/{id}"
    own = [i for i in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if i.base_name == id and i.type == pafs.FileType.Directory]
    records = fs.get_file_info(pafs.FileSelector(place, recursive=True)) if own else []
    if not any(i.base_name.endswith(".json") for i in records):
        raise ValueError(f"there is no job {id!r} in {root}")
    fs.delete_dir(place)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]+$", 0), r"\.[^.]*$", "")


def write_layout_files(pages: DataFrame, root: str) -> DataFrame:
    """Writes what `operators.documents.layout_files` gives of each page to <root>/<name>/: layout as .json, Markdown as .md, and without
    headers and footers as _nohf.md; and for each document <root>/<name>.jsonl with a line a page. Pages of a document with
    several are named by their number. Returns (file_path, page_no, and the files' paths); files are whole under their names or not there."""
    # fixed values: the columns that name the files, and the files' ends
    kinds = {"layout": ("layout_info_path", ".json"), "markdown": ("md_content_path", ".md"), "markdown_body": ("md_content_nohf_path", "_nohf.md")}
    paths = [p for p, _ in kinds.values()]
    schema = "name string, file_path string, page_no int, " + ", ".join(f"{p} string" for p in paths)

    def put(uri: str, said: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temp) as out:
            out.write(said.encode())
        fs.move(temp, path)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, (path, suffix) in kinds.items():
                frame[path] = [f"{root}/{r.name_}/{r.page}{suffix}" if getattr(r, kind) is not None else None for r in frame.itertuples()]
                for uri, said in zip(frame[path], frame[kind], strict=True):
                    if uri is not None:
                        put(uri, said)
            yield frame.rename(columns={"name_": "name"})[["name", "file_path", "page_no", *paths]]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, list[str]] | None = None
        for frame in frames:
            for name, line in zip(frame["name"], frame["line"], strict=True):  # a document's pages follow each other
                if held and held[0] != name:
                    put(f"{root}/{held[0]}.jsonl", "".join(held[1]))
                held = (name, [*(held[1] if held and held[0] == name else []), f"{line}\n"])
            yield frame[["name"]]
        if held:
            put(f"{root}/{held[0]}.jsonl", "".join(held[1]))

    several = F.count("*").over(Window.partitionBy("file_path")) > 1
    name = _stem(F.col("file_path"))
    named = pages.select(name.alias("name_"), F.when(several, F.concat(name, F.lit("_page_"), F.col("page_no").cast("string"))).otherwise(name).alias("page"), "file_path", F.col("page_no").cast("int").alias("page_no"), *kinds)
    place = scratch.new_dir(pages.sparkSession, "layout")
    named.mapInPandas(write, schema).write.mode("overwrite").parquet(f"{place}/pages")
    written = pages.sparkSession.read.schema(schema).parquet(f"{place}/pages")
    line = F.to_json(F.struct("page_no", "file_path", *paths))
    written.select("name", "page_no", line.alias("line")).repartition("name").sortWithinPartitions("name", "page_no").mapInPandas(index, "name string").agg(F.count("*")).collect()
    return written.drop("name")


def markdown(frame: DataFrame) -> str:
    """A Markdown table of a report's rows, which are few; percent signs and rounding are the report's."""
    rows = frame.collect()
    show = lambda v: "—" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
