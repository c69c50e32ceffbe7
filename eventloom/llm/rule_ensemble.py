"""Operator 2, quality classifier: a sparse ensemble of rules.

Shallow trees are grown on statistics of labelled texts (each on a bootstrap of the sample and some
of the features); every path from a root to a node is a rule, a conjunction of comparisons.  Rules are
the 0/1 inputs of a logistic model with a lasso penalty, so most weights are exactly zero.  What is
left is compiled to one Column expression: the logistic function of a sum of ``CASE WHEN`` weights.

The model is fitted on the driver from at most ``max_rows`` labelled rows, those with the smallest
hash of their id, whose statistics alone are collected.  Scoring runs over all rows in the JVM.

Edge cases: null or empty text has all statistics 0 and gets the score of that row; null labels aren't
used; without training rows, or with one class only, the score is the share of label 1 (0.5 if there
is none); repeated rows score alike; a doc_id labelled twice trains twice; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import bounded_sample, fold, materialize
from eventloom.llm.textstats import RATIOS, base_stats, with_ratios

FEATURES = (*RATIOS, "n_words", "n_lines")


def _split(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], features, least: int):
    """The comparison (feature, cut) that lowers the squared error most; None if none does."""
    best, found, n, total = 1e-9, None, len(y), y.sum()
    for f in features:
        if not len(cuts[f]):
            continue
        bins = np.searchsorted(cuts[f], x[:, f], side="left")  # bin b: cuts[b-1] < x <= cuts[b]
        size = np.cumsum(np.bincount(bins, minlength=len(cuts[f]) + 1))[:-1]
        ones = np.cumsum(np.bincount(bins, weights=y, minlength=len(cuts[f]) + 1))[:-1]
        ok = (size >= least) & (n - size >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, ones**2 / size + (total - ones) ** 2 / (n - size) - total**2 / n, 0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (f, float(cuts[f][k]))
    return found


def _grow(x, y, cuts, features, depth, least, path, rules) -> None:
    if depth == 0 or len(set(y.tolist())) < 2:
        return
    found = _split(x, y, cuts, features, least)
    if found is None:
        return
    f, cut = found
    low = x[:, f] <= cut
    for side, name in ((low, "<="), (~low, ">")):
        longer = (*path, (f, name, cut))
        rules.add(frozenset(longer))
        _grow(x[side], y[side], cuts, features, depth - 1, least, longer, rules)


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[tuple]:
    """Distinct rules of all paths of ``trees`` trees."""
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.005, 0.995, 80))) for f in range(x.shape[1])]
    rules: set[frozenset] = set()
    for _ in range(trees):
        rows = draw.integers(0, len(y), len(y))
        features = draw.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        _grow(x[rows], y[rows], cuts, features, depth, max(5, len(y) // 500), (), rules)
    return sorted(tuple(sorted(r)) for r in rules)


def holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, name, cut in rule:
        out &= x[:, f] <= cut if name == "<=" else x[:, f] > cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, m = z.shape
    design = np.hstack([np.ones((n, 1)), z])
    v = np.ones(m + 1)
    for _ in range(20):  # largest curvature
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(design @ v) ** 2 / n * 1.02 + 1e-12)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w = np.zeros(m + 1)
    w[0] = math.log(share / (1 - share))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        new = ahead - rate * (design.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


class RuleModel:
    """An intercept and (rule, weight) pairs over ``features``."""

    def __init__(self, features: tuple, intercept: float, rules: list[tuple[tuple, float]]):
        self.features, self.intercept, self.rules = features, intercept, rules

    def score(self) -> Column:
        """The probability of label 1 as a Column over the features' columns."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            all_hold = F.lit(True)
            for f, name, cut in rule:
                column = F.col(self.features[f])
                all_hold = all_hold & (column <= cut if name == "<=" else column > cut)
            z = z + F.when(all_hold, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * holds(x, r) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, features: tuple, trees: int = 40, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> RuleModel:
    if len(y) == 0 or len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return RuleModel(features, math.log(share / (1 - share)), [])
    rules = extract_rules(x, y, trees, depth, seed)
    columns: dict[bytes, tuple] = {}  # of rules that hold for the same rows, the shortest
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        columns.setdefault(np.packbits(holds(x, rule)).tobytes(), rule)
    rules = list(columns.values())
    z = np.stack([holds(x, r) for r in rules], 1).astype("float64") if rules else np.zeros((len(y), 0))
    intercept, weights = lasso_logistic(z, y, penalty)
    return RuleModel(features, intercept, [(r, float(w)) for r, w in zip(rules, weights) if w != 0])


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, cutoff: float = 0.7, max_rows: int = 20_000, **fit) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the statistics, for each row of ``docs(doc_id, text)``."""
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_fold, F.lit(False))
    stats = with_ratios(materialize(base_stats(docs, "doc_id"), "rule-stats")).withColumn("held_out", held)
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("_y"))
    train = stats.where("not held_out").join(known, "doc_id")
    sample = bounded_sample(train, max_rows, F.col("doc_id"), F.col("_y")).select(*(F.col(f).cast("double") for f in FEATURES), "_y").toPandas()
    x, y = sample[list(FEATURES)].to_numpy(), sample["_y"].to_numpy()
    model = fit_rules(x, y, FEATURES, **fit)
    scored = stats.withColumn("score", model.score())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), *FEATURES)
