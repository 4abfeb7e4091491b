"""Error rates, intervals and flags. Columns where Spark can; Arrow-batched Python for long distances, repetition and fuzzy search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import plain_text
from .udf import batched

Z = 1.96
#: Spark's own distance fills a table; from so many cells on, distances are counted by bits.
LONG_TABLE = 250_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\u001c-\u001f\u0085]+"), lambda w: w != "")


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance by the bits of whole numbers (Myers 1999, Hyyrö 2003): a step for each item of the shorter one."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    low = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    a, b = a[low:], b[low:]
    high = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), len(b))
    a, b = a[: len(a) - high], b[: len(b) - high]
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    masks = {x: sum(1 << i for i in at) if len(at) < 64 else int("".join("1" if i in held else "0" for held in [set(at)] for i in range(len(a) - 1, -1, -1)), 2) for x, at in places.items()}
    whole, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, edits = whole, 0, len(a)
    for y in b:
        match = masks.get(y, 0)
        zero = ((match & plus) + plus ^ plus) | match | minus
        more, less = minus | whole & ~(zero | plus), zero & plus
        edits += bool(more & last) - bool(less & last)
        more = more << 1 | 1
        plus, minus = (less << 1 | ~(zero | more)) & whole, more & zero & whole
    return edits


@batched("int")
def _character_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@batched("int")
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else distance(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _settled(a: Column, b: Column) -> Column:
    """Edits of texts of which one begins the other; null for other pairs."""
    return F.when(a.startswith(b), F.length(a) - F.length(b)).when(b.startswith(a), F.length(b) - F.length(a))


def char_edits(truth: Column, answer: Column) -> Column:
    """Levenshtein distance over code points. No pair that one look can settle is counted."""
    open_ = _settled(truth, answer).isNull()
    long = open_ & (F.length(truth).cast("long") * F.length(answer) > LONG_TABLE)
    by_bits = _character_distance(F.when(long, truth), F.when(long, answer))
    return F.coalesce(_settled(truth, answer), F.when(long, by_bits).otherwise(F.levenshtein(truth, answer)))


def word_edits(truth: Column, answer: Column) -> Column:
    """Levenshtein distance over words."""
    other = truth != answer
    return F.when(truth == answer, 0).otherwise(_word_distance(F.when(other, truth), F.when(other, answer)))


def edit_stats(truth: Column, answer: Column) -> dict[str, Column]:
    return {"char_edits": char_edits(truth, answer), "ref_chars": F.length(truth), "word_edits": word_edits(truth, answer), "ref_words": F.size(word_list(truth))}


def error_rate(edits: Column, length: Column) -> Column:
    """edits / length, without a bound above; for length 0: 0 without edits, else 1."""
    return F.when(length > 0, edits / length).otherwise(F.when(edits == 0, 0.0).otherwise(1.0))


def half_width(value: Column) -> Column:
    """95 % half width of a mean; null below two values."""
    return Z * F.stddev_samp(value) / F.sqrt(F.count(value))


def quantiles(rows: DataFrame, sets: list[tuple[str, ...]], value: str, q: float = 0.9) -> DataFrame:
    """Of each group of each grouping set: `value`_median (mean of the middle two) and `value`_p, the value of rank
    min(n - 1, round half even(q (n - 1))) from 0. Null values do not count.

    Equal values are counted before the shuffle, and ranks follow from running sums, so no group's values are held in memory.
    """
    keys = list(dict.fromkeys(c for s in sets for c in s))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = counts.groupingSets([[F.col(c) for c in (*s, value)] for s in sets], *(F.col(c) for c in (*keys, value))).agg(F.sum("_n").alias("_n"), F.grouping_id().alias("_set"))
    group = Window.partitionBy("_set", *keys)
    upto = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"_upto": upto, "_all": F.sum("_n").over(group)})
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    last = F.col("_all") - 1
    found = ranked.groupBy("_set", *keys).agg(((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias(f"{value}_median"), at(F.least(last.cast("double"), F.rint(q * last))).alias(f"{value}_p"))
    return found.withColumn("_set", F.shiftright("_set", 1))  # the value itself is the last bit


def wilson_upper(k: Column, n: Column, z: float = Z) -> Column:
    """Upper bound of a share, at most 1; null for n = 0."""
    n = F.nullif(n, F.lit(0))
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n.isNotNull(), F.least(F.lit(1.0), (centre + spread) / (1 + z * z / n)))


def length_flags(truth: Column, answer: Column, error: Column) -> list[Column]:
    """error, else empty; too_long or too_short for truths of at least 20 characters. Null where a flag is not set."""
    ratio, long_enough = F.length(answer) / F.nullif(F.length(truth), F.lit(0)), F.length(truth) >= 20
    failed = F.coalesce(error, F.lit("")) != ""
    return [
        F.when(failed, "error").when((answer == "") & (truth != ""), "empty"),
        F.when(long_enough & (ratio > 1.5), "too_long").when(long_enough & (ratio < 0.5) & (answer != ""), "too_short"),
    ]


def flags(truth: Column, answer: Column, error: Column, repeated: Column | None = None, cut: Column | None = None) -> Column:
    first, *rest = length_flags(truth, answer, error)
    marks = [first, *([F.when(repeated, "repetition")] if repeated is not None else []), *rest, *([F.when(cut, "hit_max_tokens")] if cut is not None else [])]
    return F.array_compact(F.array(*marks))


# The unit's length, how often it follows itself, and over how many characters.
UNIT_MOST, UNIT_TIMES, UNIT_SPAN = 80, 10, 100


def _periodic(codes: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts with this period that hold enough copies."""
    same = np.flatnonzero(np.diff(np.r_[False, codes[period:] == codes[:-period], False]))
    for start, end in same.reshape(-1, 2):
        if end - start >= period * (UNIT_TIMES - 1):
            yield int(start), int(end) + period


#: Characters up to which all periods of a text are tried in one table.
ONE_TABLE = 4096


def _periods(codes: np.ndarray, most: int) -> Sequence[int]:
    """Of the periods up to `most` those that some part may have; all of a long text, where a period at a time costs no more."""
    n = len(codes)
    if most < 1 or n > ONE_TABLE:
        return range(1, most + 1)
    ahead = np.lib.stride_tricks.sliding_window_view(np.r_[codes, np.full(most, 1 << 31, np.uint32)], most + 1)  # no character is 1 << 31
    at = np.arange(1, n + 1, dtype=np.int16)[:, None]
    broken = np.where(ahead[:, 1:] == ahead[:, :1], np.int16(0), at)
    return (np.flatnonzero((at - np.maximum.accumulate(broken, 0)).max(0) >= np.arange(1, most + 1) * (UNIT_TIMES - 1)) + 1).tolist()


def repeated_unit(text: str) -> str | None:
    """A unit of 2 to 80 characters with a letter that follows itself nine times or more, white space between or not, over at least 100 characters.

    Without white space such a text is periodic. So the periods of the text without it come first, a comparison of
    the text with itself moved by each; only in a periodic part are the copies compared as they stand.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blanks = [c for c in np.unique(codes) if chr(c).isspace()]
    place = np.flatnonzero(~np.isin(codes, blanks))
    bare = codes[place]
    for period in _periods(bare, min(UNIT_MOST, len(bare) // UNIT_TIMES)):
        for start, end in _periodic(bare, period):
            if not any(map(str.isalpha, text[place[start] : place[start + period - 1] + 1])):  # all copies have the same letters
                continue
            for first in range(start, min(start + period, end - period * UNIT_TIMES + 1)):
                heads = place[np.arange(first, end - period + 1, period)]
                tails = place[np.arange(first + period - 1, end, period)][: len(heads)] + 1
                copies = [text[a:b] for a, b in zip(heads, tails, strict=True)]
                # a unit of one visible character has a blank, too
                breaks = [0, *(k for k in range(1, len(copies)) if copies[k] != copies[k - 1] or period == 1 and heads[k] == tails[k - 1]), len(copies)]
                for a, b in zip(breaks, breaks[1:]):
                    unit, span = copies[a], int(tails[b - 1] - heads[a])
                    between = int((heads[a + 1 : b] - tails[a : b - 1]).min()) if b - a > 1 else 0  # white space that the unit may end in
                    span += min(between, len(text[tails[b - 1] :]) - len(text[tails[b - 1] :].lstrip())) if between and b - a >= UNIT_TIMES else 0
                    if b - a >= UNIT_TIMES and span >= UNIT_SPAN and 2 <= len(unit) + between and len(unit) <= UNIT_MOST and any(map(str.isalpha, unit)):
                        return unit
    return None


@batched("boolean")
def _repeats(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: repeated_unit(t) is not None if t else False)


def has_repetition(text: Column) -> Column:
    """Of the text without mark-up, so that rows of empty cells are no repetition."""
    text = plain_text(F.coalesce(text, F.lit("")))
    return _repeats(F.when(F.length(text) >= UNIT_SPAN, text))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        held = row & places.get(c, 0)
        row = (row + held | row - held) & full
    return len(a) - row.bit_count()


def _alike(short: str, part: str) -> float:
    return 200.0 * common_subsequence(short, part) / (len(short) + len(part))


def partial_ratio(a: str, b: str) -> float:
    """100 times the best similarity 2 LCS / (sum of lengths) of the shorter text with a window of the longer one,
    of the same length or, at its ends, shorter."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    return 100.0 if short in long else max(_alike(short, long[max(0, at) : at + n]) for at in range(1 - n, len(long)))


class Searched:
    """A text in which passages are looked for by the grams that they share with it."""

    def __init__(self, text: str) -> None:
        self.text, self.codes, self.sorted = text, self._codes(text), {}

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    @staticmethod
    def _grams(codes: np.ndarray, q: int) -> np.ndarray:
        out = np.zeros(max(0, len(codes) - q + 1), np.uint64)
        for i in range(q):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
        return out

    def _starts(self, passage: str, edits: int, q: int, need: int) -> Iterator[range]:
        """Runs of windows, the likeliest window first, that share `need` grams of q characters with the passage, none further than `edits` from its place."""
        if q not in self.sorted:
            grams = self._grams(self.codes, q)
            order = np.argsort(grams, kind="stable")
            self.sorted[q] = grams[order], order
        grams, order = self.sorted[q]
        wanted = self._grams(self._codes(passage), q)
        low, high = np.searchsorted(grams, wanted), np.searchsorted(grams, wanted, "right")
        counts = high - low
        places = order[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] - np.repeat(np.arange(len(wanted)), counts)
        places.sort()
        first, last = places[: max(0, len(places) - need + 1)], places[need - 1 :]
        if len(places):
            fresh = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
            best = int(places[fresh[np.diff(np.r_[fresh, len(places)]).argmax()]])
            yield range(best, best + 1)
        at = -len(passage)
        for a, b in zip(first[last - first <= 2 * edits].tolist(), last[last - first <= 2 * edits].tolist()):
            yield range(max(at, b - edits), a + edits + 1)
            at = max(at, a + edits + 1)

    def holds(self, passage: str, least: float) -> bool:
        """Whether partial_ratio with the text, the longer of both, is at least `least`.

        A whole window that is alike keeps all but k characters of the passage and adds at most k others; an edit breaks
        q grams at most, and an addition one fewer, so a number of grams stays, each within k of its place. Windows that are cut
        at the ends of the text are few and are all compared.
        """
        n, size = len(passage), len(self.text)
        if passage in self.text:
            return True
        if n > size:
            return partial_ratio(passage, self.text) >= least
        k = int(n * (100 - least) / 100 + 1e-9)
        q = max((q for q in range(1, 9) if n - q + 1 - k * (2 * q - 1) > 0), default=0)
        whole = self._starts(passage, k, q, n - q + 1 - k * (2 * q - 1)) if q else (range(at, at + 16) for at in range(0, size - n + 1, 16))
        short = int(n * least / (200 - least))  # a shorter window cannot be alike enough
        for run in whole:
            run = range(max(0, run.start), min(run.stop, size - n + 1))
            # no window has more of the passage than all of a run's windows together
            if len(run) > 1 and 100.0 * common_subsequence(passage, self.text[run.start : run.stop - 1 + n]) / n < least:
                continue
            if any(_alike(passage, self.text[at : at + n]) >= least for at in run):
                return True
        # no window that is cut has more of the passage than the widest one at its end has
        able = [end for end in (True, False) if (most := common_subsequence(passage, self.text[: n - 1] if end else self.text[size - n + 1 :])) * 200.0 / (n + max(most, short)) >= least]
        return any(_alike(passage, self.text[:m] if end else self.text[size - m :]) >= least for end in able for m in range(short, n))


def quarters(marks: list[float]) -> list[float | None]:
    """Means of the marks in each quarter of their positions."""
    sums, counts = np.zeros(4), np.zeros(4)
    for i, m in enumerate(marks):
        at = min(3, 4 * i // max(1, len(marks)))
        sums[at] += m
        counts[at] += 1
    return [float(s / c) if c else None for s, c in zip(sums, counts, strict=True)]


def recall_by_position(truth: str, answer: str, chunk: int = 8, least: float = 85) -> list[float | None]:
    """Share of the truth's chunks of words that occur, about, in the answer; by quarters of the truth; four nulls without words."""
    words = truth.split()
    chunks = [" ".join(words[i : i + chunk]) for i in range(0, len(words), chunk)]
    searched = Searched(answer)
    return quarters([float(searched.holds(c, least)) for c in chunks])


@batched("array<double>")
def position_recall(truths: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([recall_by_position(t or "", a or "") for t, a in zip(truths, answers, strict=True)])
