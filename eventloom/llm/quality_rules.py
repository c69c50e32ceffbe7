"""Operator 7, quality rules with risk-controlled cutoffs.  Native: DataFrame functions only.

Base rules need no labels: under ``min_words`` words, or over 30 % of the words in repeated eight-word
windows.  The rest is learned.  A document is rejected if one of its ratios exceeds the cutoff of its
stratum (language).  Labelled good documents that pass the base rules are dealt into two halves:

1. On the first half, a ratio's base cutoff in a stratum is its ``quantile``, but not under a fixed floor.
2. On the second half, multiples of all base cutoffs together are tested from the most lenient to the
   strictest.  A multiple passes if the exact binomial probability of as few false rejections as were
   seen, were their rate ``max_false_rejection``, is at most ``delta`` divided by the number of strata
   (Bonferroni between strata; within one a fixed sequence stops at the first that fails).

The trials are distinct texts: copies of one text, and several labels of one document, count once, and a text is in one
half only.  So with confidence 1 - delta, no stratum loses more than that share of its distinct good texts to
learned cutoffs.  That takes log(delta / strata) / log(1 - max_false_rejection) good texts in a stratum's second half, 459
with the defaults, even if none of them is rejected; a stratum with fewer labels rejects by the base rules alone.

Strata are the languages in ``strata`` and ``other``, so the table of cutoffs has a fixed size.  Edge
cases: null text has no words and fails the base rules; a null or unknown language is ``other``; null
labels teach nothing; equal rows are judged alike, each on its own; a doc_id with labels of both
kinds is a good one; an empty table, or one without labels, works; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialize
from eventloom.llm.textstats import base_stats, with_ratios

#: Fixed floors of the cutoffs: no ratio under them is a reason to reject.
FLOORS = {
    "symbol_ratio": 0.03,
    "upper_ratio": 0.3,
    "mark_ratio": 0.15,
    "dup_line_ratio": 0.3,
    "repeat_ratio": 0.15,
    "same_next_ratio": 0.1,
    "mean_word_chars": 10.0,
}
MULTIPLES = (4.0, 3.0, 2.0, 1.5, 1.25, 1.1, 1.0)
STRATA = ("en", "de", "fr", "es")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k up to n * p; 1 beyond, where no test can pass.

    Sums the exact terms by their recursion, in logarithms.
    """
    n, k = n.cast("long"), k.cast("long")
    start = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, 1.0).otherwise(F.aggregate(terms, start, step)["sum"])


def _rejected(multiple: float) -> Column:
    """Some ratio is over its cutoff times ``multiple``."""
    out = F.lit(False)
    for name in FLOORS:
        out = out | (F.col(name) > F.col(f"cut_{name}") * multiple)
    return out


def fit_cutoffs(
    labelled: DataFrame,
    max_false_rejection: float = 0.01,
    delta: float = 0.05,
    quantile: float = 0.998,
    n_strata: int = len(STRATA) + 1,
) -> DataFrame:
    """Cutoffs ``cut_*`` of each stratum that may reject, from good documents' ratios (``stratum``, ``half``, ratios)."""
    first = labelled.where("half = 0").groupBy("stratum").agg(
        *(F.greatest(F.percentile_approx(name, F.lit(quantile), F.lit(20_000)), F.lit(floor)).alias(f"cut_{name}") for name, floor in FLOORS.items())
    )
    # one row for each stratum
    second = labelled.where("half = 1").join(F.broadcast(first), "stratum")
    counts = second.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(_rejected(m)).alias(f"k{i}") for i, m in enumerate(MULTIPLES)))
    best = F.lit(None).cast("double")
    passing = F.lit(True)
    for i, m in enumerate(MULTIPLES):
        passing = passing & (F.col(f"p{i}") <= delta / n_strata)
        best = F.when(passing, m).otherwise(best)
    tested = counts.select("stratum", *(binomial_tail(F.col("n"), F.col(f"k{i}"), max_false_rejection).alias(f"p{i}") for i in range(len(MULTIPLES))))
    chosen = tested.select("stratum", best.alias("multiple")).where("multiple is not null")
    return first.join(F.broadcast(chosen), "stratum").select("stratum", *((F.col(f"cut_{n}") * F.col("multiple")).alias(f"cut_{n}") for n in FLOORS))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    min_words: int = 20,
    strata: tuple = STRATA,
    keep: tuple = (),
    **fit,
) -> DataFrame:
    """Counts, ratios, ``base_failed``, ``reject_reasons`` and ``kept`` of each row of ``docs(doc_id, text, lang)``.

    The counts are written to the shared folder once, without texts; columns in ``keep`` go along.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    stratum = F.when(lang.isin(*strata), lang).otherwise("other")
    rows = docs.withColumn("stratum", stratum).withColumn("_of", F.xxhash64("text"))
    stats = with_ratios(materialize(base_stats(rows, "doc_id", "stratum", "_of", *keep), "quality-stats"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    good = labels.where("quality = 1").select("doc_id").distinct()
    # equal texts are one trial, in one half
    labelled = stats.where("not base_failed").join(good, "doc_id").select("stratum", "_of", *FLOORS).dropDuplicates(["stratum", "_of"])
    labelled = labelled.withColumn("half", F.pmod(F.xxhash64("_of", F.lit("half")), F.lit(2)))
    cuts = materialize(fit_cutoffs(labelled, n_strata=len(strata) + 1, **fit), "quality-cutoffs")
    judged = stats.join(F.broadcast(cuts), "stratum", "left")
    reasons = F.filter(F.array(*(F.when(F.col(n) > F.col(f"cut_{n}"), n) for n in FLOORS)), lambda x: x.isNotNull())
    judged = judged.drop("_of").withColumn("reject_reasons", reasons)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("reject_reasons") == 0))
