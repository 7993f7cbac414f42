"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is an expression over the text alone; no user function, shuffle or join takes part.
A rule is a named measure with a least and a most value; the table is compiled into an array of
the names of the rules that a document breaks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import WORD, let


class Rule(NamedTuple):
    """A document breaks the rule where ``measure`` is under ``least`` or over ``most`` (null: no bound)."""

    name: str
    measure: str
    least: float | None
    most: float | None


#: Common words of the four languages, by which prose is told from lists and junk.
STOP_WORDS = (
    "the be to of and that have with in is was for on as a an by at it or from are "
    "le la les de des du et un une en est que qui dans pour sur pas au aux ce "
    "der die das und ist in den von zu mit ein eine nicht auf sich dem des es im "
    "el los las y que un una por con para se no es su al lo como"
).split()

RULES = (
    Rule("too_few_words", "n_words", 50, None),
    Rule("too_many_words", "n_words", None, 1_000_000),
    Rule("short_words", "mean_word_length", 2.0, None),
    Rule("long_words", "mean_word_length", None, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("repeated_lines", "dup_line_ratio", None, 0.3),
    Rule("repeated_words", "repeat_word_ratio", None, 0.5),
    Rule("no_stop_words", "stop_words", 2, None),
    Rule("few_stop_words", "stop_word_ratio", 0.01, None),
    Rule("few_letters", "letter_word_ratio", 0.6, None),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first finding included.

    Windows become numbers of 34 bits of hash over 30 bits of position and are sorted; neighbours that
    agree in the hash are candidates, and these alone sort again by their words, which decide. With the
    windows found twice in ascending places, each covers min(3, distance to the next) words, the last 3.
    """
    rest = lambda c, n: F.slice(c, n, F.size(c))
    place = (1 << 30) - 1
    end = lambda c: F.size(c) - 1

    def keys(hashes: Column) -> Column:
        two = F.zip_with(hashes, rest(hashes, 2), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(two, rest(hashes, 3), lambda a, b: F.xxhash64(a, b))
        packed = F.transform(three, lambda h, i: h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long")))
        return F.sort_array(F.slice(packed, 1, F.size(packed) - 2))

    def candidates(sort: Column) -> Column:
        both = F.zip_with(sort, rest(sort, 2), lambda a, b: F.when(F.shiftright(a.bitwiseXOR(b), 30) == 0, F.array(a, b)))
        return F.transform(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))), lambda k: k.bitwiseAND(F.lit(place)).cast("int"))

    def covered(places: Column) -> Column:
        rows = F.array_sort(F.transform(places, lambda p: F.struct(F.concat_ws(" ", words[p], words[p + 1], words[p + 2]).alias("w"), p.alias("p"))))
        twice = lambda r: F.filter(F.zip_with(r, rest(r, 2), lambda a, b: F.when(a["w"] == b["w"], F.array(a["p"], b["p"]))), lambda x: x.isNotNull())
        return let(let(rows, lambda r: F.array_sort(F.array_distinct(F.flatten(twice(r))))), steps)

    def steps(found: Column) -> Column:
        gaps = F.zip_with(found, rest(found, 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    found = let(let(F.transform(words, lambda w: F.xxhash64(w)), keys), candidates)
    return F.when(end(words) < 2, F.lit(0)).otherwise(let(found, lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(covered(c))))


def counts_of(text: Column) -> Column:
    """The counts of a text as one struct; a null text counts as an empty one. Characters are code points."""
    text = F.coalesce(text, F.lit(""))
    stop_words = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})

    def over(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        line_count = lambda ls, pattern: F.size(F.filter(ls, lambda x: x.rlike(pattern))).cast("long")
        of_words = [
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(words, F.array(*map(F.lit, stop_words)))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.isin(stop_words))).cast("long").alias("n_stop_uses"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        ]
        of_lines = lambda ls: [
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            line_count(ls, r"^[\x20\t]*[-*•]").alias("n_bullet_lines"),
            line_count(ls, r"(?:\.\.\.|…)[\x20\t\r]*$").alias("n_ellipsis_lines"),
        ]
        return let(lines, lambda ls: F.struct(*of_words, *of_lines(ls)))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), over)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of its text as the struct ``quality`` (a column of that name is replaced)."""
    return docs.withColumn("quality", counts_of(F.col(text_col)))


#: Measures over the counts of the projection; a ratio over nothing is zero.
RATIOS = {
    "n_words": ("n_words", None),
    "mean_word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "stop_words": ("n_stop_words", None),
    "stop_word_ratio": ("n_stop_uses", "n_words"),
    "letter_word_ratio": ("n_letter_words", "n_words"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def compiled(rules: Sequence[Rule], counts: Column) -> Column:
    """The names of the broken rules as an array, in the table's order."""
    unknown = {r.measure for r in rules} - set(RATIOS)
    if unknown:
        raise ValueError(f"unknown measures: {sorted(unknown)}")

    def broken(rule: Rule) -> Column:
        top, under = RATIOS[rule.measure]
        value = counts[top].cast("double")
        if under:
            value = F.when(counts[under] > 0, value / counts[under]).otherwise(0.0)
        out = F.lit(False)
        if rule.least is not None:
            out = out | (value < rule.least)
        if rule.most is not None:
            out = out | (value > rule.most)
        return F.when(out, F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


def judged(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the structs ``quality`` (counts) and ``broken`` (names of broken rules).

    Every row of ``docs`` comes back once, with its own columns; ``quality`` and ``broken`` are replaced
    where ``docs`` has such columns. No rows give no rows.
    """
    return measured(docs, text_col).withColumn("broken", compiled(rules, F.col("quality")))
