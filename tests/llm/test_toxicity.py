"""Toxicity: automata against edit distance, contexts, held-out accuracy, edge rows."""

import random
import zlib

import pytest

from eventloom.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_matches_edit_distance():
    draw = random.Random(1)
    terms = [("".join(draw.choices("abc", k=draw.randint(2, 11))), False, float(i)) for i in range(60)]
    terms = list({t: (t, s, w) for t, s, w in terms}.values())
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(4000):
        word = "".join(draw.choices("abcd", k=draw.randint(1, 12)))
        near = [(d, -w) for t, _, w in terms if (d := distance(word, t)) <= (len(t) >= 5) + (len(t) >= 9)]
        assert automaton[word] == ((-min(near)[1], min(near)[0]) if near else None)


def test_stems_and_words():
    automaton = toxicity.LexiconAutomaton([("lowe", True, 2.0), ("idiot", False, 3.0), ("worthless", False, 4.0), ("bad", False, 1.0)])
    assert automaton["loweschaft"] == (2.0, 0) and automaton["lowe"] == (2.0, 0) and automaton["lwe"] is None
    assert automaton["idiot"] == (3.0, 0) and automaton["idiott"] == (3.0, 1) and automaton["idxxt"] is None
    assert automaton["wrthles"] == (4.0, 2) and automaton["bat"] is None
    assert toxicity.words_of("1D10T id*ot") == ["idiot", "id*ot"] and automaton["id*ot"] == (3.0, 1)


def test_quotations_and_addresses_are_told_apart():
    automaton = toxicity.LexiconAutomaton([("idiot", False, 3.0)])
    plain, quoted, said, address = (toxicity.hit_features(t, automaton) for t in ("a clear idiot indeed", 'he read "an idiot" aloud', "people said idiot then", "you idiot"))
    assert plain[0] > 0 == plain[2] and quoted[2] > 0 == quoted[0] and said[2] > 0 == said[0] and address[0] > 0 and address[3] > 0
    assert toxicity.hit_features("nothing here", automaton) == [0.0] * toxicity.N_FEATURES


def synthetic(spark, n=1500):
    draw = random.Random(2)
    words = ["".join(draw.choices("abdefgh", k=6)) for _ in range(300)]
    rows = []
    for i in range(n):
        text, bad = draw.choices(words, k=40), i % 8 == 0
        if bad:
            text[draw.randrange(40)] = draw.choice(["zorkun", "vexami", "zorkum", "quolib"])
        rows.append((i, " ".join(text), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy_and_held_out_labels_teach_nothing(spark):
    data = synthetic(spark).cache()
    rows = {r.doc_id: r for r in data.collect()}
    out = toxicity.score_toxicity(data.select("doc_id", "text"), data.select("doc_id", "toxic")).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and len(held) == sum(r.held_out for r in out)
    assert sum(r.predicted == rows[r.doc_id].toxic for r in held) >= 0.98 * len(held)
    flipped = [(i, 1 - r.toxic if zlib.crc32(str(i).encode()) % 5 == 0 else r.toxic) for i, r in rows.items()]
    again = toxicity.score_toxicity(data.select("doc_id", "text"), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert sorted((r.doc_id, r.score) for r in out) == sorted((r.doc_id, r.score) for r in again)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert sum(out[i].predicted for i, t in known.items() if t == 0) <= 0.02 * len(known)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "h"), (2, "", "h"), (3, "what an idiot", "h"), (3, "what an idiot", "h"), (None, "x " * 50_000, "h")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None, 0), (2, None, 0)], "doc_id long, toxic int, quality int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "3", "None"]
    assert {r.doc_id: r.predicted for r in out} == {1: 0, 2: 0, 3: 1, None: 0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_lexicon_choice():
    counts = [("lowe*", 20, 0), ("lowea", 9, 0), ("loweb", 8, 0), ("lowec", 7, 0), ("idiot", 30, 0), ("idio*", 30, 0), ("the", 50, 400), ("rare", 3, 0)]
    terms = {(t, stem) for t, stem, _ in toxicity.choose_terms(counts, 100, 900, 10)}
    assert terms == {("lowe", True), ("idiot", False)}
    assert len(toxicity.choose_terms(counts, 100, 900, 1)) == 1


@pytest.mark.parametrize("rows", [0, 1])
def test_logistic_survives_few_rows(rows):
    import numpy as np

    assert np.isfinite(toxicity.fit_logistic(np.ones((rows, 2)), np.ones(rows))).all()


def test_misspellings_inside_a_stem_and_of_short_terms_are_found():
    counts = [("tras*", 40, 0), ("trash", 12, 0), ("trashy", 11, 0), ("trashed", 10, 0), ("trashing", 7, 0), ("scum", 9, 0)]
    terms = toxicity.choose_terms(counts, 100, 900, 10)
    terms += toxicity.family_terms(counts, terms, 100, 900, 10)
    assert {(t, stem) for t, stem, _ in terms} >= {("tras", True), ("trash", False), ("trashing", False), ("scum", False)}
    real = toxicity.near_short_terms({"slum", "tree"}, terms)
    assert real == {"slum"}
    automaton = toxicity.LexiconAutomaton(toxicity.with_short_edits(terms), real)
    for word in ("trqsh", "trsh", "trqshy", "tashed", "trqshing", "scuum", "scm", "skum"):
        assert automaton[word] and automaton[word][1] == 1, word
    assert automaton["trasher"][1] == automaton["scum"][1] == 0 and automaton["slum"] is None and automaton["tree"] is None


def test_misspelled_seed_terms_raise_the_score(spark):
    docs = spark.createDataFrame([(1, "what a scum indeed"), (2, "what a skum indeed"), (3, "what a plain thing")], "doc_id long, text string")
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int, quality int")).collect()}
    assert out[1] > out[3] and out[2] != out[3]
