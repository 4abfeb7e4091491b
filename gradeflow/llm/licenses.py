"""Licence scan: text units against licence templates by the Dice coefficient over word bigrams.

Units are the lines of a text and, as line 0, a whole text of several lines; and, as line -p, the p-th of several paragraphs
(cut at empty lines) if it has a line break, so that a notice wrapped over lines is found in a longer text. A unit is normalised to words:
A-Z lower-cased, everything but letters and digits a separator. Dice is 2 |A and B| / (|A| + |B|) over the
sets of distinct bigrams; a unit of one word is the bigram of that word and nothing. A Dice of at least t
bounds the sizes: |B| t / (2 - t) <= |A| <= |B| (2 - t) / t. Each template therefore only meets units of
sizes in that range, by a join on the size; the templates' table has one row for each template and size, and
is as long as the templates are, whatever the corpus.

Bigrams are compared by 64-bit hashes. Units with too many distinct words for any template's size are left out first.

The result has the best template of each unit with a match: the highest Dice, then the first by name.
Null and empty texts, and units without words, match nothing. Rows with the same doc_id give one result a line,
the best of them all.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

THRESHOLD = 0.8
#: Broadcast only up to so many rows of (template, size).
MAX_BROADCAST = 200_000
# Short licence notices in common use, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATOR = r"[^\p{L}\p{N}]+"
_PARAGRAPHS = r"\n[ \t\r\f\n]*\n"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or {f"{w} " for w in words})


def size_range(size: int, threshold: float) -> tuple[int, int]:
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def template_table(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    rows = []
    for name, text in sorted(templates.items()):
        grams = template_bigrams(text)
        low, high = size_range(len(grams), threshold)
        rows += [(name, len(grams), n, grams) for n in range(max(1, low), high + 1)]
    table = spark.createDataFrame(rows, "license string, template_size int, size int, template array<string>")
    pair = lambda g: F.xxhash64(F.get(F.split(g, " "), F.lit(0)), F.get(F.split(g, " "), F.lit(1)))
    table = table.withColumn("template", F.transform("template", pair))
    return F.broadcast(table) if len(rows) <= MAX_BROADCAST else table


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line, license, dice) of all units of docs (doc_id, text) that match a template."""
    table = template_table(docs.sparkSession, templates, threshold)
    most = max((size_range(len(template_bigrams(t)), threshold)[1] for t in templates.values()), default=0)
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    words = lambda line: F.filter(F.split(line, _SEPARATOR), lambda w: w != "")
    unit = lambda line, said: F.struct(line.cast("long").alias("line"), said.alias("words"))
    parts = F.split(text, _PARAGRAPHS)
    wrapped = F.filter(F.transform(parts, lambda p, i: F.struct((-i - 1).alias("at"), p.alias("p"))), lambda x: x["p"].contains("\n") & (F.size(parts) > 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(F.split(text, "\n"), words).alias("lines"), F.transform(wrapped, lambda x: unit(x["at"], words(x["p"]))).alias("wrapped"))
    # a unit's distinct bigrams may be fewer than its words, so only lines of one repeated phrase go on in vain
    whole = F.when(F.size("lines") > 1, F.flatten("lines")).otherwise(F.array().cast("array<string>"))
    units = F.concat(F.array(unit(F.lit(0), whole)), F.transform("lines", lambda w, i: unit(i + 1, w)), F.col("wrapped"))
    rows = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.line", "u.words").where("size(words) > 0")
    # every word but the first that a unit has not had makes a bigram that it has not had: so many are too many
    rows = rows.where((F.size("words") <= most + 1) | (F.size(F.array_distinct("words")) <= most + 1))
    pairs = F.transform(F.slice("words", F.lit(2), F.size("words")), lambda w, i: F.xxhash64(F.get("words", i), w))
    grams = F.array_distinct(F.when(F.size("words") > 1, pairs).otherwise(F.array(F.xxhash64(F.get("words", F.lit(0)), F.lit("")))))
    # a size that Spark must not compute twice keeps it from computing the bigrams in the filter once more
    once = (0 * F.monotonically_increasing_id()).cast("int")
    rows = rows.select("doc_id", "line", grams.alias("grams")).withColumn("size", F.size("grams") + once).where(F.col("size").between(1, most))
    met = rows.join(table, "size").withColumn("dice", 2.0 * F.size(F.array_intersect("grams", "template")) / (F.col("size") + F.col("template_size"))).where(F.col("dice") >= threshold)
    best = met.groupBy("doc_id", "line").agg(F.min(F.struct((-F.col("dice")).alias("dice"), "license")).alias("b"))
    return best.select("doc_id", F.col("line").cast("long").alias("line"), "b.license", (-F.col("b.dice")).alias("dice"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over table documents in DuckDB, by comparing every unit with every template."""
    values = ", ".join("('" + n.replace("'", "''") + "', ['" + "', '".join(template_bigrams(t)) + "'])" for n, t in sorted(templates.items()))
    return f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
paragraphs AS (SELECT doc_id, string_split_regex(text, '{_PARAGRAPHS}') AS parts FROM texts),
pieces AS (SELECT doc_id, -unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS part FROM paragraphs WHERE len(parts) > 1),
lines AS (SELECT doc_id, list_transform(string_split(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), chr(10)), lambda l: list_filter(string_split_regex(l, '{_SEPARATOR}'), lambda w: w <> '')) AS lines FROM documents),
units AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS words FROM lines
  UNION ALL SELECT doc_id, 0, flatten(lines) FROM lines WHERE len(lines) > 1
  UNION ALL SELECT doc_id, line, list_filter(string_split_regex(part, '{_SEPARATOR}'), lambda w: w <> '') FROM pieces WHERE contains(part, chr(10))),
grams AS (SELECT doc_id, line, list_distinct(CASE WHEN len(words) > 1 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE [words[1] || ' '] END) AS grams FROM units WHERE len(words) > 0),
templates(license, template) AS (VALUES {values}),
met AS (SELECT doc_id, line, license, 2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)) AS dice FROM grams, templates WHERE len(grams) BETWEEN len(template) * 0.5 AND len(template) * 2)
SELECT doc_id::BIGINT AS doc_id, line::BIGINT AS line, license, dice FROM met WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1"""
