"""Operator 8, toxicity: Levenshtein automata over a lexicon trie, with context windows.

A weighted lexicon of words and stems is learned from one half of a sample of labelled texts.  All its
words' Levenshtein automata are intersected with its trie at once: a state is a set of (trie node,
edits so far), states and transitions are made when first met and then remembered, so a word costs a
dictionary look-up per letter.  Words of five letters or more may have one edit, of nine or more two;
stems match exactly at the start of a word, and the words they were learned from stay beside them with
their edits.  A term of four letters may have one edit where its entry says so, as those of the lexicon
that is fitted do: a word that the sample's clean texts have is then no misspelling.  Digits that stand for letters are read as those.

Each hit is weighed in a window of ``window`` words: inside quotation marks, or beside a reporting word,
it counts as a quotation; beside a second-person word as an address.  A logistic model over the sums of
weights, fitted on the sample's other half, gives the score.

The sample is at most ``max_rows`` labelled rows of the training folds, by smallest hash of the id; the
lexicon has at most ``max_terms`` terms, and as many words of its stems.  Scoring runs over all rows and whole texts.

Edge cases: null or empty text has no hits and gets the score of that; null labels aren't used; without
training rows the seed terms and fixed weights stand; repeated rows score alike, and an id trains once a label, with the
first of its texts; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import bounded_sample, fold, materialize, small_batches

#: Insults that hold without labels.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting")
SEED_WEIGHT = 3.0
#: Words beside a quotation, and words that address someone.
REPORTING = frozenset("said says wrote quote quoted quotes quoting called term word zitat sagte schrieb dijo cita dit cite écrit".split())
ADDRESS = frozenset("you your yours youre ur du dich dein deine ihr euch tu te tus vosotros usted toi ton ta vous votre".split())
LEET = str.maketrans("013457", "oieast")
_WORD = re.compile(r"[^\W\d_]+(?:\*[^\W\d_]+)*")
_QUOTES = re.compile("[\"“”„«»]")
STEMS = (4, 5, 6)
#: Hits by kind: exact, misspelled, quoted, addressed; then hits a word.
N_FEATURES = 5
#: Words and transitions that a worker remembers before it starts again.
MAX_WORDS = 300_000


class LexiconAutomaton(dict):
    """Maps a word to (weight, edits) of the closest term, or None.

    ``terms``: (text, is a stem, weight), or with the edits it allows.  ``real``: words that are matched without edits only.
    """

    def __init__(self, terms: list[tuple], real: frozenset[str] = frozenset()):
        super().__init__()
        self.real = real
        self.children: list[dict[str, int]] = [{}]
        self.word_end: dict[int, float] = {}
        self.stem_end: dict[int, float] = {}
        self.edits = [0]  # most edits that any word below allows
        self.allowed: dict[int, int] = {}
        for text, stem, weight, *most in terms:
            node, may = 0, most[0] if most else 0 if stem else (len(text) >= 5) + (len(text) >= 9)
            self.edits[0] = max(self.edits[0], may)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], may)
            if stem:
                self.stem_end[node] = weight
            else:
                self.word_end[node], self.allowed[node] = weight, may
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.dead = self._state({})
        self.start = self._state({(0, False): 0})

    def _state(self, reached: dict[tuple[int, bool], int]) -> int:
        """The number of a set of places; a place is a node, or a stem that the word has passed."""
        todo = list(reached)
        while todo:  # letters of a term that the word lacks
            node, passed = todo.pop()
            if passed:
                continue
            e = reached[node, False] + 1
            for child in self.children[node].values():
                if e <= self.edits[child] and e < reached.get((child, False), 99):
                    reached[child, False] = e
                    todo.append((child, False))
        for (node, passed), e in list(reached.items()):
            if not passed and e == 0 and node in self.stem_end:
                reached[node, True] = 0
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            found = [(e, -self.stem_end[n]) if passed else (e, -self.word_end[n]) for (n, passed), e in key if passed or (n in self.word_end and e <= self.allowed[n])]
            self.accepts.append((-min(found)[1], min(found)[0]) if found else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[tuple[int, bool], int] = {}

        def put(place, e):
            if e < reached.get(place, 99):
                reached[place] = e

        for (node, passed), e in self.sets[state]:
            if passed:
                put((node, True), 0)
                continue
            if e + 1 <= self.edits[node]:
                put((node, False), e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                if letter == c:
                    put((child, False), e)
                elif e + 1 <= self.edits[child]:
                    put((child, False), e + 1)
        to = self.moves[state, c] = self._state(reached)
        return to

    def match(self, word: str):
        state = self.start
        for c in word:
            to = self.moves.get((state, c))
            state = self._move(state, c) if to is None else to
            if state == self.dead:
                return None
        return self.accepts[state]

    def __missing__(self, word: str):
        if len(self) > MAX_WORDS:
            self.clear()
        if len(self.moves) > MAX_WORDS:
            self.moves.clear()
        found = self.match(word)
        if found and found[1] and word in self.real:
            found = None
        self[word] = found
        return found


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower().translate(LEET))


def hit_features(text: str, automaton: LexiconAutomaton, window: int = 5) -> list[float]:
    """Sums of the hits' weights by kind, as logarithms, and hits for each word."""
    words = words_of(text)
    if not any(automaton[w] for w in set(words)):
        return [0.0] * N_FEATURES
    sums, hits = [0.0] * 4, 0
    quoted = _QUOTES.search(text) is not None
    inside: list[bool] = []
    if quoted:  # whether an odd number of quotation marks stands before each word
        low, odd, at = text.lower().translate(LEET), False, 0
        for m in _WORD.finditer(low):
            odd ^= len(_QUOTES.findall(low[at : m.start()])) % 2 == 1
            inside.append(odd)
            at = m.end()
    for i, w in enumerate(words):
        found = automaton[w]
        if not found:
            continue
        weight, edits = found
        hits += 1
        near = set(words[max(0, i - window) : i + window + 1])
        if (quoted and inside[i]) or near & REPORTING:
            sums[2] += weight
        else:
            sums[1 if edits else 0] += weight
            if near & ADDRESS:
                sums[3] += weight
    return [math.log1p(s) for s in sums] + [min(1.0, 10 * hits / len(words))]


def _terms_of(text: str) -> set[str]:
    """Distinct words, and stems with a star."""
    out = set(words_of(text))
    return out | {w[:k] + "*" for w in out for k in STEMS if len(w) >= k + 2}


def _count_terms(batches):
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(*(c.to_pylist() for c in batch.columns)):
            (toxic if label else clean).update(_terms_of(text or ""))
    terms = [*toxic, *(t for t in clean if t not in toxic)]
    for at in range(0, len(terms), 50_000):
        some = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([toxic[t] for t in some], pa.int64()), pa.array([clean[t] for t in some], pa.int64())], ["term", "t", "c"])


def term_weight(t: int, c: int, n_toxic: int, n_clean: int) -> float:
    return math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, max_terms: int, least: int = 4) -> list[tuple[str, bool, float]]:
    """The lexicon from (term, toxic texts, clean texts): words and stems that are far likelier in toxic texts."""

    def weight(t, c):
        return term_weight(t, c, n_toxic, n_clean)

    good = [(t, n, c) for t, n, c in counts if n >= least and 20 * c <= n]
    stems: set[str] = set()
    out: list[tuple[str, bool, float, int]] = []
    for t, n, c in sorted((x for x in good if x[0].endswith("*") and x[1] >= 2 * least), key=lambda x: (len(x[0]), x[0])):
        stem = t[:-1]
        if not any(stem.startswith(s) for s in stems):
            stems.add(stem)
            out.append((stem, True, weight(n, c), n))
    spread = Counter(next(s for s in stems if t.startswith(s)) for t, _, _ in good if not t.endswith("*") and any(t.startswith(s) for s in stems))
    whole = {t: (n, c) for t, n, c in good if not t.endswith("*")}
    out = [x for x in out if spread[x[0]] >= 3]  # a stem of one word is that word
    kept = [x[0] for x in out]
    out += [(t, False, weight(n, c), n) for t, (n, c) in whole.items() if not any(t.startswith(s) for s in kept)]
    out.sort(key=lambda x: (-x[3], x[0]))
    return [(t, stem, min(6.0, w)) for t, stem, w, _ in out[:max_terms]]


def family_terms(counts: list[tuple[str, int, int]], terms: list[tuple], n_toxic: int, n_clean: int, max_terms: int) -> list[tuple[str, bool, float]]:
    """Whole words that a stem of ``terms`` stands for; they have edits, which stems lack."""
    stems = tuple(t for t, stem, _ in terms if stem)
    words = [x for x in counts if not x[0].endswith("*") and x[0].startswith(stems)] if stems else []
    whole = [x for x in words if x[1] >= 4 and 20 * x[2] <= x[1]]
    return [(t, False, min(6.0, term_weight(n, c, n_toxic, n_clean))) for t, n, c in sorted(whole, key=lambda x: (-x[1], x[0]))[:max_terms]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Intercept and weights by Newton's method with a ridge penalty."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def with_short_edits(terms: list[tuple]) -> list[tuple]:
    """``terms`` where words of four letters allow one edit."""
    return [(*t, 1) if len(t[0]) == 4 and not t[1] else t for t in terms]


def near_short_terms(words, terms: list[tuple]) -> frozenset[str]:
    """Those of ``words`` that are a term of four letters but for one edit."""
    short = LexiconAutomaton([t for t in with_short_edits(terms) if len(t) > 3])
    longer = LexiconAutomaton([t for t in terms if len(t[0]) > 4])
    return frozenset(w for w in words if 3 <= len(w) <= 5 and short[w] and short[w][1] and not longer[w])


def _features(terms, real=frozenset()):
    def run(batches):
        automaton = LexiconAutomaton(with_short_edits(terms), real)
        for batch in batches:
            rows = [hit_features(t or "", automaton) for t in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[]] * N_FEATURES
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *(f"f{i}" for i in range(N_FEATURES))])

    return run


def hits(docs: DataFrame, terms: list, real: frozenset = frozenset()) -> DataFrame:
    small_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"f{i} double" for i in range(N_FEATURES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features(terms, real), schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, max_rows: int, max_terms: int) -> tuple[list, frozenset, np.ndarray]:
    """(terms, real words beside short ones, weights) from labelled rows of the training folds."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != held_fold))
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(2))
    sample = bounded_sample(known.select("doc_id", "toxic"), max_rows, F.col("doc_id"), F.col("toxic")).select("doc_id", F.col("toxic").cast("int").alias("_y"), half.alias("_half"))
    # max_rows rows of three numbers at most
    sample = docs.select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id")
    # however many rows an id has, one text of it is a trial
    sample = materialize(sample.groupBy("doc_id", "_y", "_half").agg(F.min("text").alias("text")), "toxicity-sample")
    sizes = {(r["_half"], r["_y"]): r["n"] for r in sample.groupBy("_half", "_y").agg(F.count("*").alias("n")).collect()}
    small_batches(docs.sparkSession)
    counted = sample.where("_half = 0").select("text", "_y").mapInArrow(_count_terms, "term string, t long, c long")
    counted = materialize(counted.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-terms")
    # terms of the sample only, whose rows are bounded
    counts, n_toxic, n_clean = [tuple(r) for r in counted.where("t >= 4 and 20 * c <= t").collect()], sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    terms = choose_terms(counts, n_toxic, n_clean, max_terms)
    terms += family_terms(counts, terms, n_toxic, n_clean, max_terms)
    have = {t for t, stem, _ in terms if not stem}
    terms += [(t, False, SEED_WEIGHT) for t in SEED_TERMS if t not in have]
    # words of three to five letters, of the sample only
    short = counted.where("c > 0 and 20 * c > t and length(term) between 3 and 5 and not endswith(term, '*')").select("term")
    real = near_short_terms((r.term for r in short.toLocalIterator()), terms)
    rows = hits(sample.where("_half = 1").select(F.col("_y").cast("long").alias("doc_id"), "text"), terms, real).toPandas()
    x, y = rows[[f"f{i}" for i in range(N_FEATURES)]].to_numpy("float64"), rows["doc_id"].to_numpy("float64")
    # two rows that stand for what is known without labels: a text without hits is clean, one with an insult isn't
    prior = np.zeros((2, N_FEATURES))
    prior[1, 0], prior[1, 4] = math.log1p(SEED_WEIGHT), 0.5
    return terms, real, fit_logistic(np.vstack([x, prior]), np.append(y, [0.0, 1.0]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, cutoff: float = 0.5, max_rows: int = 20_000, max_terms: int = 2000
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the features, for each row of ``docs(doc_id, text)``."""
    terms, real, weights = fit_toxicity(docs, labels, folds, held_fold, max_rows, max_terms)
    z = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        z = z + F.col(f"f{i}") * float(w)
    scored = hits(docs, terms, real).withColumn("score", 1 / (1 + F.exp(-z)))
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_fold, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), *(f"f{i}" for i in range(N_FEATURES)))
