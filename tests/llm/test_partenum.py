"""PartEnum join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from eventloom.llm import graph, partenum, queries
from eventloom.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(rows, k):
    out = []
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        out.append((i, {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()))
    return out


def brute(rows, k, num, den):
    sets = brute_sets(rows, k)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def run(spark, rows, k, num, den, **options):
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, sig string, rep int").repartition(3)
    return sorted(map(tuple, partenum.near_components(docs, k, num, den, **options).collect()), key=str)


def near_copies(seed, n, length, edits):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [draw.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_matches_brute_force_on_near_copies(spark, k, num, den):
    texts = [t for s, (n, length, edits) in enumerate([(30, 60, 6), (25, 25, 2), (20, 200, 12), (12, 9, 1), (10, 14, 1)]) for t in near_copies(s, n, length, edits)]
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    random.Random(0).shuffle(rows)
    assert run(spark, rows, k, num, den) == brute(rows, k, num, den)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a b c"), (8, "a  b\tC"), (9, "É é"), (10, "é é"), (None, "a b c"), (12, "x y z w"), (12, "a b c"), (13, "x y z w"), (-5, "a\x1cb c"), (2**62 + 5, "A B C d"), (-(2**62) - 9, "a b c D")]
    rows += [(100 + i, f"{i} " + "long text " * 20_000) for i in range(2)]
    got = run(spark, rows, 3, 90, 100)
    expected = brute([r for r in rows if r[0] != 12], 3, 90, 100)
    # 12 has two texts and so links 7 and 13
    own = {7: 7, 8: 7, 13: 7}
    expected = [(i, n, own.get(i, c)) for i, n, c in expected] + [(12, 2, 7), (12, 1, 7)]
    assert got == sorted(expected, key=str)
    assert run(spark, [], 3, 90, 100) == []


def test_copies_among_texts_that_share_a_passage(spark):
    """Long texts with one passage in common, half of them near copies of another: the passage's buckets are hot."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [draw.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(60):
        own = [draw.choice(vocabulary) for _ in range(draw.choice([60, 150, 400]))]
        rows.append((3 * i, " ".join(own + passage)))
        if i % 2:
            for j in draw.sample(range(len(own)), len(own) // 60):
                own[j] = "changed"
            rows.append((3 * i + 1, " ".join(own + passage)))
    assert run(spark, rows, 5, 80, 100) == brute(rows, 5, 80, 100)


def test_an_id_with_several_texts_links_near_copies_of_each(spark):
    words = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(other)), (5, " ".join(words)), (5, " ".join(other)), (9, " ".join([*words, "end"])), (11, " ".join(["start", *other]))]
    got = run(spark, rows, 3, 90, 100)
    assert {(i, c) for i, _, c in got} == {(1, 1), (5, 1), (9, 1), (11, 1)}


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op3_partenum(spark, sf_dir).collect()), key=str) == brute(rows, 3, 90, 100)


def test_groups_beyond_the_leader_are_found(spark, monkeypatch):
    """A chain: each text is similar to the next only, so the smallest of a bucket links few."""
    draw = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((draw.randrange(10**6), " ".join(words)))
        for j in draw.sample(range(120), 2):
            words[j] = f"n{i}.{j}"
    monkeypatch.setattr(partenum, "FLUSH", 700)
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_similar_sets_always_share_a_signature():
    draw = np.random.default_rng(2)
    for num, den, budget in ((90, 100, 24), (80, 100, 48), (80, 100, 80), (50, 100, 40)):
        for size in (*range(1, 40), 61, 110, 150, 333, 1000):
            for _ in range(4):
                a = np.unique(draw.integers(0, 2**63, size).astype("uint64"))
                most = partenum.most_differing(*[h for h in partenum.bands(num, den, size)[-1:]][0][1:], num, den)
                gone = draw.integers(0, most + 1)
                b = np.unique(np.append(draw.permutation(a)[gone // 2 :], draw.integers(0, 2**63, gone - gone // 2).astype("uint64")))
                both = len(np.intersect1d(a, b))
                if not both or den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
                    continue
                at, sigs = partenum.signatures([a, b], num, den, budget)
                n = min(len(a), len(b))
                odd, least, _ = partenum.band_facts(n, num, den)
                both = set(sigs[at == 0]) & set(sigs[at == 1])
                assert sum((int(x) & 1 == 1) == odd for x in both) >= least


def test_parity_sketch_never_exceeds_the_difference():
    draw = np.random.default_rng(4)
    for n in (1, 20, 500, 5000):
        a = np.unique(draw.integers(0, 2**63, n).astype("uint64"))
        b = np.unique(np.append(a[n // 3 :], draw.integers(0, 2**63, n // 4).astype("uint64")))
        bits = sum(int(x).bit_count() for x in (partenum.parity_sketch(a) ^ partenum.parity_sketch(b)).view("uint64"))
        assert bits <= len(np.setxor1d(a, b))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}
    assert graph.components(links.limit(0)).count() == 0


def test_what_the_driver_plans_stays_small(spark):
    """Large and small star were planned within each other, with their inputs four times each."""
    store = spark._jsparkSession.sharedState().statusStore()

    def listed():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in map(found.apply, range(found.size()))}

    def plans(run):
        before = listed()
        run()
        return [len(re.findall(r"^\(\d+\) ", text, re.M)) for i, text in sorted(listed().items()) if i not in before]

    links = materialize(spark.createDataFrame([(i, i + 1) for i in range(1, 30)], "a long, b long"), "t-links")
    sizes = plans(lambda: graph.components(links).count())
    assert max(sizes) <= 60, sizes
