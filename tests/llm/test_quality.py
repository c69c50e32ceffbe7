"""Quality rules and rule ensemble against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import quality_rules, queries, rule_ensemble
from eventloom.llm.textstats import base_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h " * 2, "a b c d e f g h a b c d e f g h i", "a a a a a a a a a", "a a a a a a a a",
    "x y\nx y\n\n\nx y \nx y", "# * $ % & | < > a#b c", "line\r\nline\r\n", "É ÜÖ! ?? 12", "w " * 25_000, " ".join(map(str, range(20_000))) + " 0 1 2 3 4 5 6 7",
    " ".join("p q r s t u v w".split() + list("abcdefg") + "p q r s t u v w".split() + ["r", "s"]), "  wide \x1c x",
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force_on_edge_texts(spark):
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 9, "h") for i, t in rows], "doc_id long, text string, n_words int, _words string")
    got = base_stats(docs, "doc_id").collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(i), *brute(t)) for i, t in rows)


def test_quality_query_matches_brute_force(spark, sf_dir):
    texts = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    got = queries.op7_quality_rules(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n, chars, symbols, dup, repeat = brute(texts[r.doc_id])
        failed = n < 20 or 100 * repeat > 30 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert not (failed and r.kept)


def exact_tail(n, k, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 0), (1, 0), (10, 0), (665, 0), (1000, 3), (1000, 10), (5000, 31), (200_000, 1900)]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.select("n", "k", quality_rules.binomial_tail(df.n, df.k, 0.01).alias("p")).collect():
        assert r.p == pytest.approx(exact_tail(r.n, r.k, 0.01), rel=1e-6)
    assert df.limit(1).select(quality_rules.binomial_tail(df.n + 100, df.k + 50, 0.01).alias("p")).first().p == 1.0


def synthetic(spark, n=6000):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = [("".join(draw.choice(list("abcdefghij"), 5))) for _ in range(40)]
        bad = i % 10 == 0
        rows.append((i, " ".join(w + "***" if bad else w for w in words), "en" if i % 2 else "xx", 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").cache()


def test_cutoffs_reject_junk_and_keep_the_promise(spark):
    data = synthetic(spark)
    out = quality_rules.judge_quality(data.drop("quality"), data.select("doc_id", "quality"), keep=("lang",)).join(data.select("doc_id", "quality"), "doc_id").collect()
    for lang in ("en", "xx"):
        good = [r for r in out if r.lang == lang and r.quality == 1]
        bad = [r for r in out if r.lang == lang and r.quality == 0]
        assert sum(not r.kept for r in good) <= 0.01 * len(good)
        assert sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_verdicts_match_a_plain_computation(spark):
    """Cutoffs, their tests and ``kept`` by plain loops over distinct labelled texts; every third good text is there twice."""
    data = synthetic(spark)
    twice = data.where("quality = 1 and doc_id % 3 = 0").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "quality")
    data = data.unionByName(twice)
    out = quality_rules.judge_quality(data.drop("quality"), data.select("doc_id", "quality"), keep=("lang",)).collect()
    names = list(quality_rules.FLOORS)
    facts = {r.doc_id: (r.half, r.quality, r.text) for r in data.selectExpr("doc_id", "pmod(xxhash64(xxhash64(text), 'half'), 2) as half", "quality", "text").collect()}
    multiple, cuts = {}, {}
    for stratum in ("en", "other"):
        trials = {facts[r.doc_id][2]: (facts[r.doc_id][0], r) for r in out if r.stratum == stratum and facts[r.doc_id][1] == 1 and not r.base_failed}.values()
        first, second = ([r for half, r in trials if half == h] for h in (0, 1))
        cuts[stratum] = {n: max(sorted(r[n] for r in first)[math.ceil(0.998 * len(first)) - 1], quality_rules.FLOORS[n]) for n in names}
        for m in quality_rules.MULTIPLES:
            k = sum(any(r[n] > cuts[stratum][n] * m for n in names) for r in second)
            if k > 0.01 * len(second) or exact_tail(len(second), k, 0.01) > 0.05 / 5:
                break
            multiple[stratum] = m
    assert multiple and any(not r.kept for r in out)
    for r in out:
        rejected = r.stratum in multiple and any(r[n] > cuts[r.stratum][n] * multiple[r.stratum] for n in names)
        assert r.kept == (not r.base_failed and not rejected)


def test_too_few_labels_reject_nothing_more(spark):
    data = synthetic(spark, 300)
    out = quality_rules.judge_quality(data, data.select("doc_id", "quality")).collect()
    assert all(r.kept for r in out)
    none = quality_rules.judge_quality(data.limit(0), data.select("doc_id", "quality").limit(0))
    assert none.count() == 0


def test_ensemble_separates_held_out_rows(spark):
    scored = queries.op2_rule_ensemble(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.score for r in scored if r.quality == 1]
    bad = [r.score for r in scored if r.quality == 0]
    assert len(bad) > 5 and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in scored)


def test_held_out_labels_teach_nothing(spark):
    data = synthetic(spark, 400)
    labels = data.select("doc_id", "quality").collect()
    flipped = [(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.quality) for r in labels]
    a = rule_ensemble.score_quality(data, data.select("doc_id", "quality"))
    b = rule_ensemble.score_quality(data, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert sorted(map(tuple, a.select("doc_id", "score").collect())) == sorted(map(tuple, b.select("doc_id", "score").collect()))


def test_column_and_model_agree_and_lasso_is_sparse(spark):
    draw = np.random.default_rng(1)
    x = draw.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4)).astype(float)
    model = rule_ensemble.fit_rules(x, y, ("a", "b", "c"), penalty=2e-3)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    assert np.allclose([r.s for r in df.select(model.score().alias("s")).collect()], model.predict(x))
    assert 1 <= len(model.rules) < 60
    assert ((model.predict(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_ensemble_edge_tables(spark):
    docs = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (2, "", "h"), (None, "a", "h")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in rule_ensemble.score_quality(docs, labels).collect()] == pytest.approx([0.5] * 4)
    assert rule_ensemble.score_quality(docs.limit(0), labels).count() == 0
    one = rule_ensemble.fit_rules(np.zeros((3, 1)), np.ones(3), ("a",))
    assert one.predict(np.zeros((1, 1)))[0] == pytest.approx(0.99)
