"""Benchmark decontamination against planted and brute-force cases."""

import math
import random

import numpy as np
import pytest

from eventloom.llm import lsa_decontam, queries

VOCABULARY = [f"word{i}" for i in range(3000)]


def items(n=30):
    draw = random.Random(1)
    return [(i, " ".join(draw.choices(VOCABULARY, k=draw.randint(12, 60))) + ". " + " ".join(draw.choices(VOCABULARY, k=4)) + ".") for i in range(n)]


def noise(draw, n):
    return " ".join(draw.choice(VOCABULARY) + draw.choice(["", "", ",", "."]) for _ in range(n))


def marked(spark, docs, bench, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, contamination int")
    out = lsa_decontam.with_contamination(df, spark.createDataFrame(bench, "item_id long, text string, source string"), **options)
    assert out.columns == ["doc_id", "text", "lang", "contamination"]
    return {r.doc_id: {m.item_id for m in r.contamination} for r in out.collect()}


def test_copies_and_paraphrases_are_found_and_clean_texts_left(spark):
    draw = random.Random(2)
    bench = items()
    docs, expected = [], {}
    for i in range(120):
        text, k = noise(draw, draw.choice([3, 40, 300])), i % 30
        if i % 3 == 0:  # a copy in another case
            text += " " + bench[k][1].upper() + " " + noise(draw, 50)
        elif i % 3 == 1:  # one word in six is another, some are added
            words = [w if draw.random() > 1 / 6 else draw.choice(VOCABULARY) for w in bench[k][1].split()[:-4]] + bench[k][1].split()[-4:]
            text += "\n" + " ".join(words) + " " + noise(draw, 20)
        expected[i] = {k} if i % 3 < 2 else set()
        docs.append((i, text, "en", 0))
    got = marked(spark, docs, [(*b, "h") for b in bench])
    missed = [i for i in expected if not expected[i] <= got[i]]
    assert [i for i in got if got[i] - expected[i]] == []
    assert [i for i in missed if i % 3 == 0] == [] and len(missed) <= 4
    assert marked(spark, docs, [(*b, "h") for b in bench], block_items=7) == got


def test_query_finds_every_whole_copy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    expected = {(d, i) for d, t in docs.items() for i, b in bench.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in queries.op5_lsa_decontam(spark, sf).collect()}
    assert expected and got == expected


def test_candidates_recall_what_an_exhaustive_search_finds(spark, sf_dir):
    """Every passage against every item by longest common subsequence and content: recall of at least 0.9."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))

    def found(**options):
        marked = lsa_decontam.with_contamination(docs.select("doc_id", "text"), bench, **options)
        return {(r.doc_id, m.item_id) for r in marked.collect() for m in r.contamination}

    every, got = found(min_cosine=-2.0, min_share=1e-12), found()
    assert got <= every and len(every) > 0 and len(got) >= 0.9 * len(every)


def test_edge_rows(spark):
    bench = [*((i, t, "h") for i, t in items(4)), (90, None, "h"), (91, "", "h"), (92, "too short", "h"), (None, items(4)[0][1], "h")]
    docs = [(1, None, "en", 1), (2, "", None, 1), (3, " \n", "en", 1), (4, items(4)[2][1], "en", 1), (4, items(4)[2][1], "en", 1), (None, items(4)[1][1], "en", 1), (5, "pad " * 30_000 + items(4)[3][1], "en", 1), (6, items(4)[0][1], "en", 1)]
    got = marked(spark, docs, bench)
    assert got == {1: set(), 2: set(), 3: set(), 4: {2}, None: {1}, 5: {3}, 6: {0, None}}
    assert marked(spark, [], bench) == {}
    assert marked(spark, docs, []) == {r[0]: set() for r in docs}


def test_common_subsequence_matches_the_textbook():
    draw = random.Random(3)

    def textbook(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(200):
        a, b = draw.choices("abcdef", k=draw.randint(1, 90)), draw.choices("abcdefg", k=draw.randint(0, 120))
        assert lsa_decontam.common_subsequence(lsa_decontam.masks_of(a), len(a), b) == textbook(a, b)


def test_answers():
    assert lsa_decontam.answer_of("What is it? It is a big dog.") == ["it", "is", "a", "big", "dog"]
    assert lsa_decontam.answer_of("One two three. Four.") == ["one", "two", "three", "four"]
    assert lsa_decontam.answer_of("") == []


@pytest.mark.parametrize("sizes", [[0], [1], [31, 0, 33], [32, 48, 500]])
def test_windows_cover_every_word(sizes):
    import numpy as np

    doc, begin, end = lsa_decontam._windows(np.array(sizes), 32)
    at = np.cumsum([0, *sizes])
    seen = {w for a, b in zip(begin, end) for w in range(a, b)}
    assert seen == set(range(sum(sizes)))
    assert all(at[d] <= a < b <= at[d + 1] and b - a <= 32 for d, a, b in zip(doc, begin, end))


def test_copies_of_long_items_are_found_as_those_of_short_ones_are(spark):
    draw = random.Random(5)
    vocabulary = [f"term{i}" for i in range(20_000)]
    sizes = [20, 33, 64, 100, 200, 500]
    bench = [(i, " ".join(draw.choices(vocabulary, k=sizes[i % 6])), "h") for i in range(36)]
    docs = [(i, " ".join(draw.choices(vocabulary, k=77 + i) + [bench[i][1]] + draw.choices(vocabulary, k=60)), "en", 0) for i in range(36)]
    docs += [(100 + i, " ".join(draw.choices(vocabulary, k=400)), "en", 0) for i in range(12)]
    # one passage of a long item is no copy of it
    docs += [(200, " ".join(bench[5][1].split()[100:140] + draw.choices(vocabulary, k=200)), "en", 0)]
    expected = {i: {i} if i < 36 else set() for i, *_ in docs}
    assert marked(spark, docs, bench) == expected
    assert marked(spark, docs, bench, block_items=7) == expected


def whole_cosines(docs, bench, rank, item_weight, weight_docs=2000):
    """Cosine of each document, all of it one passage, with its item, by the basis of all passages; dense and by itself."""
    words = [t.split() for _, t, *_ in docs]
    at = {w: i for i, w in enumerate(sorted({w for _, t in bench for w in t.split()}), 1)}
    idf = np.full(len(at) + 1, math.log(1 + len(docs)) + 0.05)
    for w, i in at.items():
        idf[i] -= math.log(1 + sum(w in set(d) for d in words))

    def matrix(texts):
        out = np.zeros((len(texts), len(idf)))
        for row, text in zip(out, texts):
            for w in set(text) & set(at):
                row[at[w]] = (1 + math.log(text.count(w))) * idf[at[w]]
        return out

    a, items = matrix(words), matrix([t.split() for _, t in bench])
    gram = min(1, weight_docs / len(docs)) * a.T @ a + item_weight**2 * items.T @ items
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((len(idf), rank + 8)))[0]
    for _ in range(2):
        q = np.linalg.svd(gram @ q, full_matrices=False)[0]
    x, y = a @ q[:, :rank], items @ q[:, :rank]
    return {d: float(x[n] @ y[i] / np.linalg.norm(x[n]) / np.linalg.norm(y[i])) for n, (d, _, i) in enumerate(docs) if i is not None}


@pytest.mark.parametrize("options", [{}, {"pair_terms": 0}])
def test_the_basis_is_that_of_every_passage(spark, options):
    draw = random.Random(7)
    pool = [f"term{i}" for i in range(150)]
    bench = [(i, " ".join(draw.choices(pool, k=14))) for i in range(40)]
    docs = [(i, " ".join(draw.choices(pool, k=draw.randint(1, 30))), None) for i in range(2600)]
    docs += [(3000 + i, " ".join([t, *draw.choices(pool, k=10)]), i) for i, t in bench]
    expected = whole_cosines(docs, bench, rank=20, item_weight=1.0)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    marked = lsa_decontam.with_contamination(df, spark.createDataFrame(bench, "item_id long, text string"), rank=20, item_weight=1.0, min_cosine=-1.0, min_share=1e-9, **options)
    got = {r.doc_id: m.cosine for r in marked.collect() for m in r.contamination if r.doc_id == 3000 + m.item_id}
    assert got == pytest.approx(expected, abs=1e-4)


def test_pair_sums_meet_over_blocks_and_tasks():
    draw = random.Random(8)
    full = np.array([[draw.choice([0, 0, 1.5, 2]) for _ in range(700)] for _ in range(700)])
    full = np.triu(full) + np.triu(full, 1).T
    triangle = full[np.triu_indices(700)]
    back = np.zeros_like(triangle)
    for r in lsa_decontam._added([*lsa_decontam._records(triangle), *lsa_decontam._records(triangle)]):
        block, slots, sums = (c[0].as_py() for c in r.columns)
        back[block * lsa_decontam._SLOTS + np.frombuffer(slots, "uint16").astype("int64")] = np.frombuffer(sums)
    assert (back == 2 * triangle).all() and (triangle[lsa_decontam._triangle(700)[5] + 9]) == full[5, 9]
    q = np.random.default_rng(1).standard_normal((700, 3))
    assert np.allclose(lsa_decontam._symmetric_times(triangle, q), full @ q)
