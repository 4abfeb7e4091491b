"""Fill-in-middle: a text is cut into prefix, middle and suffix between its units, and put together in another order.

A unit grammar names the places between units by the classes of the two characters that meet there. `boundary`
translates it to a regular expression of look-behinds and look-aheads that matches nothing but these places, so that
Spark's `split` keeps every character of the text in its pieces. An empty text has no units, where `split` would give one
empty piece; it is set apart.

Units of one code point are the finest grammar, and a text may have millions of them: such a text is taken in blocks of
BLOCK code points, and only the blocks in which a cut falls, and the last, are split, so no more than BLOCK pieces exist at once.
Other grammars have fewer and longer pieces; their texts are one block.

A text that holds one of the sentinels stays plain, for it could not be restored. Null texts are empty. The draws are
from a hash of the id, so rows with the same id are cut at the same shares of their units; a null id draws as the
word null. Repeated rows are transformed each by itself, and an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Code points split at once.
BLOCK = 1 << 16

_SPACE, _SOLID = r"\s", r"\S"
#: Places between units by (class before, class after).
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "character": [(r"\x{0}-\x{10FFFF}", r"\x{0}-\x{10FFFF}")],
    "word": [(_SPACE, _SOLID)],  # a word and the blanks after it
    "token": [(a, f"^{a}") for a in (r"\p{L}\p{M}", r"\p{Nd}", r"\s")] + [(r"^\p{L}\p{M}\p{Nd}\s", r"\x{0}-\x{10FFFF}")],  # letters, digits, blanks; every other character alone
    "line": [(r"\n", r"\x{0}-\x{10FFFF}")],
    "sentence": [(r".!?\x{3002}\x{061F}", _SPACE), (r"\n", _SOLID)],
}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def pattern(self) -> str:
        return "|".join(re.escape(s) for s in (self.prefix, self.suffix, self.middle))


def boundary(grammar: str) -> str:
    """A regular expression that matches the empty place between two units of a grammar."""
    return "|".join(f"(?<=[{a}])(?=[{b}])" for a, b in GRAMMARS[grammar])


def _pieces(text: Column, grammar: str) -> Column:
    return F.split(text, boundary(grammar), -1)


def _blocks(text: Column, grammar: str) -> Column:
    """The text as an array of blocks of whole units, of BLOCK units each but for the last."""
    if grammar != "character":
        return F.array(text)
    starts = F.sequence(F.lit(0), ((F.length(text) - 1) / BLOCK).cast("int"))
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.transform(starts, lambda k: F.substr(text, k * BLOCK + 1, F.lit(BLOCK))))


def _between(blocks: Column, first: Column, begin: Column, end: Column, grammar: str) -> Column:
    """The units from `begin` up to `end`, joined; first: the pieces of a text that is a single block, else null."""

    def part(block: Column, k: Column) -> Column:
        low, high = (F.least(F.greatest(x - k.cast("long") * BLOCK, F.lit(0)), F.lit(BLOCK)).cast("int") for x in (begin, end))
        some = F.array_join(F.slice(_pieces(block, grammar), low + 1, high - low), "")
        return F.when(high == low, "").when(high - low == BLOCK, block).otherwise(some)

    whole = F.array_join(F.slice(first, begin.cast("int") + 1, (end - begin).cast("int")), "")
    return F.when(first.isNotNull(), whole).otherwise(F.array_join(F.transform(blocks, part), ""))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits by an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, grammar: str = "character", seed: int = 1, plain: int = 10, spm: int = 20, sentinels: Sentinels = Sentinels()) -> DataFrame:  # noqa: B008
    """(doc_id, text, n, form, prefix, middle, suffix, output) of every row (doc_id, text; other columns are ignored).

    n counts units. Of 100 texts `plain` stay as they are, and `spm` of 100 others have the suffix first. The parts of a plain
    text are null.
    """
    known = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    drawn = known.withColumns({f"h{i + 1}": h for i, h in enumerate(draws(F.col("doc_id"), seed))}).withColumn("blocks", _blocks(F.col("text"), grammar))
    split = drawn.withColumn("first", F.when(F.size("blocks") == 1, _pieces(F.col("text"), grammar)))
    rest = (F.size("blocks") - 1).cast("long") * BLOCK + F.size(_pieces(F.element_at("blocks", -1), grammar))
    n = F.when(F.col("text") == "", F.lit(0)).when(F.col("first").isNotNull(), F.size("first")).otherwise(rest).cast("long")
    form = F.when((F.col("n") == 0) | F.col("text").rlike(sentinels.pattern()) | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    ends = [F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)]
    placed = split.withColumn("n", n).withColumns({"form": form, "low": F.least(*ends), "high": F.greatest(*ends)})
    cut = lambda a, b: F.when(F.col("form") != "plain", _between(F.col("blocks"), F.col("first"), a, b, grammar))
    parts = placed.select("doc_id", "text", "n", "form", cut(F.lit(0), F.col("low")).alias("prefix"), cut(F.col("low"), F.col("high")).alias("middle"), cut(F.col("high"), F.col("n")).alias("suffix"))
    psm = F.concat(F.lit(sentinels.prefix), "prefix", F.lit(sentinels.suffix), "suffix", F.lit(sentinels.middle), "middle")
    spm_ = F.concat(F.lit(sentinels.suffix), "suffix", F.lit(sentinels.prefix), "prefix", F.lit(sentinels.middle), "middle")
    return parts.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:  # noqa: B008
    """The text that an output was made from."""
    part = F.split(output, sentinels.pattern(), -1)
    psm, spm = (F.concat(*(F.element_at(part, i) for i in order)) for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    rows = transformed(docs, **how)
    sha = lambda c: F.sha2(c, 256)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"), how.get("sentinels", Sentinels()))).alias("restored_sha256"),
    )


def oracle() -> str:
    """The same for units of one code point, in SQL."""
    h = ", ".join(f"cast('0x' || substr(d, {1 + 8 * i}, 8) AS UBIGINT)::BIGINT AS h{i + 1}" for i in range(4))
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS d FROM documents),
b AS (SELECT doc_id, t, length(t)::BIGINT AS n, {h} FROM a),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM b),
p AS (SELECT *, substr(t, 1, low) AS prefix, substr(t, low + 1, high - low) AS middle, substr(t, high + 1, n - high) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
