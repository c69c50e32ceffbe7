"""Statistics of whole texts as Column expressions; shared by the quality operators.

Everything stays in the JVM, one row at a time: no shuffle, no explode.  Eight-word windows are hashed
by doubling (a word's hash with its neighbour's, those with the ones two on, then four on), so each
word costs three hash steps whatever its text's length.  Only texts in which some window occurs
twice sort their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import WORD_SEP

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _count(text: Column, kept: str) -> Column:
    """Characters of the class ``kept``."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _paired(column: str, step: int) -> Column:
    """Each hash with the one ``step`` places on."""
    return F.transform(column, lambda x, i: F.xxhash64(x, F.get(F.col(column), i + step)))


def _covered(windows: str) -> Column:
    """Words in windows that occur twice or more, from the sorted (hash, place) pairs of a text."""
    pairs = F.col(windows)
    same = lambda a, b: a["h"] == b["h"]
    twice = F.filter(
        pairs,
        lambda e, i: F.coalesce(same(e, F.get(pairs, i - 1)), F.lit(False)) | F.coalesce(same(e, F.get(pairs, i + 1)), F.lit(False)),
    )
    places = F.array_sort(F.transform(twice, lambda e: e["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(places, start, step)["n"]


def base_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks, n_digits,
    n_same_next (words equal to the word before), n_distinct_words of each ``text``; null is an empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = rf"[^\x20\x09-\x0D]"
    rows = docs.select(
        *keep,
        text.alias("_text"),
        F.array_remove(F.split(text, WORD_SEP), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(has_word)).alias("_lines"),
    )
    rows = rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("_text"), r"\p{Lu}").alias("n_upper"),
        _count(F.col("_text"), "!?").alias("n_marks"),
        _count(F.col("_text"), "0-9").alias("n_digits"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    own = [c for c in rows.columns if c != "_h1"]
    same_next = F.size(F.filter("_h1", lambda x, i: x == F.get(F.col("_h1"), i - 1))).cast("long")
    rows = rows.select(*own, same_next.alias("n_same_next"), _paired("_h1", 1).alias("_h2"))
    own.append("n_same_next")
    rows = rows.select(*own, _paired("_h2", 2).alias("_h4"))
    rows = rows.select(*own, _paired("_h4", 4).alias("_h8"))
    rows = rows.select(*own, F.slice("_h8", 1, F.greatest(F.lit(0), F.col("n_words").cast("int") - WINDOW + 1)).alias("_h8"))
    some = F.size(F.array_distinct("_h8")) < F.size("_h8")
    pairs = F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    rows = rows.select(*own, F.when(some, F.array_sort(pairs)).alias("_pairs"))
    return rows.select(*own, F.when(F.col("_pairs").isNull(), 0).otherwise(_covered("_pairs")).cast("long").alias("n_repeat_words"))


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.when(F.col(whole) > 0, F.col(whole)), F.lit(0.0))


#: Ratios of the counts; each is 0 for an empty text.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "upper_ratio": ("n_upper", "word_chars"),
    "mark_ratio": ("n_marks", "n_words"),
    "digit_ratio": ("n_digits", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "same_next_ratio": ("n_same_next", "n_words"),
    "distinct_ratio": ("n_distinct_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
}


def with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: _ratio(*of) for name, of in RATIOS.items()})
