"""Operator 5, benchmark decontamination by latent semantic retrieval.

1. Vocabulary: the words of the benchmark items (lower case, no punctuation).  Document
   frequencies of these are counted over all documents.
2. Basis: a randomised SVD of the TF-IDF matrix A of all passages of all documents and, with weight ``item_weight``, of
   the items and their passages, computed in distributed steps.  Where the vocabulary has at most ``pair_terms`` words, each
   task sums the products of terms that share a passage, from which the driver has A'A, in the pass that counts documents;
   for a larger one, each task sums A'(A Q) over its passages in every round.  Either way the driver orthonormalises
   A'(A Q) (terms by rank).  The documents weigh together what ``weight_docs`` average ones do, if they are more, so that
   the items' share in the basis doesn't fall as the corpus grows.
3. Candidates: items are searched for whole and, where longer than ``window`` words, also by passages
   of their own, cut as the documents' are, so that a copy of a long item is found as one of a short
   one is.  A candidate is a passage of ``window`` words every ``window / 2``, whose cosine with such a
   query in the latent space is at least ``min_cosine``, and that reaches ``min_share`` of the query's
   length along it (common words point the right way, but not far).  Passages whose terms together
   can't reach that of any query are passed over.
4. Checks on the text around a candidate: the longest common subsequence with the item's words, and
   with its answer, the last sentence.  A document is contaminated by an item if the first covers
   ``min_lcs`` of the item, or ``min_lcs_with_answer`` of it and ``min_answer`` of the answer, so that
   reordered or partly reworded copies count.  In either case, the item's words there must have
   ``min_content`` of the item's inverse document frequencies: common words alone are no copy.

The benchmark is the query set, which the driver holds: vocabulary, frequencies and basis are those of all its items, of
which ``block_items`` at a time are held against all rows, with the same matches whatever that number is.  Only sums of
vocabulary size reach the driver, and those of pairs of at most ``pair_terms`` words.  Documents pass through as they are,
so only such sums are shuffled.

Edge cases: null and empty texts match nothing; null or empty items, and those with under ``min_item_words``
words, are not searched for; equal items each match; repeated rows are each judged; a null doc_id is
judged like any other; an empty documents or benchmark table works; a column called ``contamination``
is replaced, other extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import small_batches

_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("content", pa.float64())]))
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("cosine", "lcs", "answer", "content"))]))
_PUNCTUATION = re.compile("[!-/:-@\\[-`{-~«»“”„‘’–—…]+")
_ASCII_PUNCTUATION = {c: " " for c in range(128) if _PUNCTUATION.match(chr(c))}
#: Passages whose terms a task holds at once, and slots of one record of pair sums.
_PASSAGES, _SLOTS = 2048, 1 << 16


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without punctuation."""
    text = text.lower() if text else ""
    return (text.translate(_ASCII_PUNCTUATION) if text.isascii() else _PUNCTUATION.sub(" ", text)).split()


def places(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """Each word's place in the vocabulary; 0 for the others."""
    words = plain_words(text)
    return np.fromiter(map(vocabulary.get, words, repeat(0)), "int32", len(words))


def answer_of(text: str, least: int = 3) -> list[str]:
    """Words of the last sentence, or of the last ones that have ``least`` words together."""
    words: list[str] = []
    for sentence in reversed(re.split(r"(?<=[.!?])\s+|\n", text)):
        words = plain_words(sentence) + words
        if len(words) >= least:
            break
    return words


def common_subsequence(masks: dict, size: int, words: list[str]) -> int:
    """Length of the longest common subsequence of ``words`` with the ``size`` words behind ``masks`` (bit-parallel)."""
    full = (1 << size) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _windows(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of all passages of texts of ``sizes`` words that stand one after another."""
    step = window // 2
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - step) // step)), 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.cumsum(sizes) - sizes
    begin = at[doc] + k * step
    return doc, begin, np.minimum(begin + window, at[doc] + sizes[doc])


def _passage_terms(places: np.ndarray, begin: np.ndarray, end: np.ndarray, idf: np.ndarray):
    """The TF-IDF matrix of passages as (passage, term, value); term frequencies are damped by logarithm."""
    size = end - begin
    row = np.repeat(np.arange(len(size)), size)
    term = places[np.repeat(begin, size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)].astype("int64")
    known = term > 0
    keys, tf = np.unique(row[known] * len(idf) + term[known], return_counts=True)
    row, term = keys // len(idf), keys % len(idf)
    return row, term, (1 + np.log(tf)) * idf[term]


def _project(row, term, value, n: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]), basis.dtype)
    value = value.astype(basis.dtype)[:, None]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    sizes = np.diff(np.append(starts, len(row)))
    order = np.argsort(-sizes, kind="stable")
    # some hundred passages at a time, those with most terms first, a term of each at once: what is added to stays in the cache
    for a in range(0, len(order), 256):
        first, left = starts[order[a : a + 256]], -sizes[order[a : a + 256]]
        sums = np.zeros((len(first), basis.shape[1]), basis.dtype)
        for k in range(-left[0]):
            at = first[: np.searchsorted(left, -k)] + k
            sums[: len(at)] += basis[term[at]] * value[at]
        out[row[first]] = sums
    return out


def _document_counts(vocabulary: dict):
    def run(batches):
        counts, n, known = np.zeros(len(vocabulary) + 1, "int64"), 0, vocabulary.keys()
        for batch in batches:
            for text in batch.column(0):
                counts[[vocabulary[w] for w in known & set(plain_words(text.as_py()))]] += 1
                n += 1
        counts[0] = n
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])

    return run


def _placed(batches, vocabulary: dict, window: int):
    """(each document's places, those of all, begin and end of their passages) of some hundred texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            docs = [places(t.as_py(), vocabulary) for t in batch.column(0).slice(at, 200)]
            _, begin, end = _windows(np.array([len(d) for d in docs], "int64"), window)
            yield docs, np.concatenate(docs), begin, end


def _triangle(n: int) -> np.ndarray:
    """What to add to j for the slot of (i, j), i <= j, in the upper triangle of an n by n matrix."""
    i = np.arange(n, dtype="int64")
    return i * (2 * n - i - 1) // 2


def _pair_sums(vocabulary: dict, window: int):
    """Sums B'B over the passages, B their damped term frequencies, as an upper triangle; row 0 counts documents."""

    def run(batches):
        n = len(vocabulary) + 1
        base, total, flat = _triangle(n), np.zeros(n * (n + 1) // 2), np.ones(n)
        for docs, every, begin, end in _placed(batches, vocabulary, window):
            has = np.zeros((len(docs), n), bool)
            has[np.repeat(np.arange(len(docs)), [len(d) for d in docs]), every] = True
            has[:, 0] = True
            total[:n] += has.sum(0)
            for a in range(0, len(begin), _PASSAGES):
                row, term, value = _passage_terms(every, begin[a : a + _PASSAGES], end[a : a + _PASSAGES], flat)
                first = base[term]
                np.add.at(total, first + term, value * value)
                # terms of a passage ascend, so those at each distance are pairs above the diagonal
                for gap in range(1, len(row)):
                    here = np.flatnonzero(row[gap:] == row[:-gap])
                    if not len(here):
                        break
                    np.add.at(total, first[here] + term[here + gap], value[here] * value[here + gap])
        yield from _records(total)

    return run


def _records(total: np.ndarray, first: int = 0):
    """The slots of ``total`` that aren't 0, ``_SLOTS`` at a time."""
    for at in range(0, len(total), _SLOTS):
        part = total[at : at + _SLOTS]
        slots = np.flatnonzero(part)
        if len(slots):
            columns = pa.array([first + at // _SLOTS]), *(pa.array([x.tobytes()], pa.binary()) for x in (slots.astype("uint16"), part[slots]))
            yield pa.RecordBatch.from_arrays(list(columns), ["block", "slots", "sums"])


def _added(batches):
    """One record of each block."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, slots, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if block not in totals:
                totals[block] = np.zeros(_SLOTS)
            totals[block][np.frombuffer(slots, "uint16")] += np.frombuffer(sums)
    for block, total in totals.items():
        yield from _records(total, block)


def _symmetric_times(triangle: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The product of a symmetric matrix, of which ``triangle`` is the upper one, with ``q``; 256 rows at a time."""
    n, out = len(q), np.zeros_like(q)
    base = _triangle(n)
    for a in range(0, n, 256):
        rows = np.zeros((min(256, n - a), n - a))
        for k in range(len(rows)):
            rows[k, k:] = triangle[base[a + k] + a + k : base[a + k] + n]
        out[a : a + 256] += rows @ q[a:]
        rows[np.arange(len(rows)), np.arange(len(rows))] = 0
        out[a:] += rows.T @ q[a : a + 256]
    return out


def _gram(vocabulary: dict, idf: np.ndarray, basis: np.ndarray, window: int):
    """Sums A'(A Q) over the passages: rows of vocabulary size."""

    def run(batches):
        total = np.zeros_like(basis)
        for _, every, begin, end in _placed(batches, vocabulary, window):
            for a in range(0, len(begin), _PASSAGES):
                row, term, value = _passage_terms(every, begin[a : a + _PASSAGES], end[a : a + _PASSAGES], idf)
                _add_transposed(total, row, term, value, _project(row, term, value, len(begin[a : a + _PASSAGES]), basis))
        slots = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(list(total[slots]), pa.list_(pa.float64()))], ["slot", "v"])

    return run


def _add_transposed(out: np.ndarray, row, term, value, y: np.ndarray) -> np.ndarray:
    if len(row):
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
        out[term[order][starts]] += np.add.reduceat(y[row[order]] * value[order][:, None], starts, axis=0)
    return out


def _queries(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, begin, end) of what items of ``sizes`` words are searched by: each whole, and passages of the longer ones."""
    item, begin, end = _windows(sizes, window)
    long = sizes[item] > window
    at = np.cumsum(sizes) - sizes
    return np.append(np.arange(len(sizes)), item[long]), np.append(at, begin[long]), np.append(at + sizes, end[long])


def _item_matrix(items: list, vocabulary: dict, idf: np.ndarray, window: int):
    """(item of each query, the TF-IDF matrix of the queries)."""
    found = [places(text, vocabulary) for _, text in items]
    item, begin, end = _queries(np.array([len(p) for p in found], "int64"), window)
    return item, _passage_terms(np.concatenate(found), begin, end, idf)


def passage_sums(docs: DataFrame, vocabulary: dict, window: int, pair_terms: int) -> tuple[np.ndarray, Callable]:
    """(documents with each term, at 0 all; what gives A'(A Q) for idf and Q), A of all passages of all documents."""
    texts, n = docs.select("text"), len(vocabulary) + 1
    if len(vocabulary) <= pair_terms:
        triangle = np.zeros(n * (n + 1) // 2)
        parts = texts.mapInArrow(_pair_sums(vocabulary, window), "block long, slots binary, sums binary").repartition("block")
        for r in parts.mapInArrow(_added, parts.schema).toLocalIterator():
            triangle[r.block * _SLOTS + np.frombuffer(r.slots, "uint16").astype("int64")] = np.frombuffer(r.sums)
        counts = triangle[:n].copy()
        triangle[:n] = 0
        return counts, lambda idf, q: idf[:, None] * _symmetric_times(triangle, idf[:, None] * q)
    counts = np.zeros(n)
    for r in texts.mapInArrow(_document_counts(vocabulary), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r.slot] = r.n

    def times(idf: np.ndarray, q: np.ndarray) -> np.ndarray:
        z = np.zeros_like(q)
        sums = texts.mapInArrow(_gram(vocabulary, idf, q, window), "slot long, v array<double>").groupBy("slot")
        for r in sums.agg(F.array(*(F.sum(F.col("v")[i]) for i in range(q.shape[1]))).alias("v")).collect():
            z[r.slot] = r.v
        return z

    return counts, times


def fit_basis(times: Callable, weight: float, items: list, vocabulary: dict, idf: np.ndarray, rank: int, window: int, item_weight: float, rounds: int = 2) -> np.ndarray:
    """Orthonormal right singular vectors (terms by rank) of the TF-IDF matrix of all passages, of ``weight`` in its squares, and of the items."""
    item, (row, term, value) = _item_matrix(items, vocabulary, idf, window)
    wide = min(rank + 8, len(idf) - 1)
    q = np.linalg.qr(np.random.default_rng(11).standard_normal((len(idf), wide)))[0]
    spread = np.ones(wide)
    for _ in range(rounds):
        z = weight * times(idf, q)
        z += item_weight**2 * _add_transposed(np.zeros_like(q), row, term, value, _project(row, term, value, len(item), q))
        q, spread, _ = np.linalg.svd(z, full_matrices=False)
    return np.ascontiguousarray(q[:, : min(rank, int((spread > 1e-9).sum()) or 1)], "float32")


def _search(vocabulary: dict, idf: np.ndarray, basis: np.ndarray, items: list, text_at: int, window: int, min_cosine: float, min_share: float, limits: tuple):
    item_of, (row, term, value) = _item_matrix(items, vocabulary, idf, window)
    latent = _project(row, term, value, len(item_of), basis)
    lengths = np.linalg.norm(latent, axis=1)
    queries = latent / np.maximum(lengths, 1e-9)[:, None]
    # what one occurrence of a term can add to the share of a query's length that a passage reaches, at most
    usable = lengths > 1e-9
    reach = np.zeros(len(idf))
    for a in range(0, len(item_of), 512):
        b = np.arange(a, min(a + 512, len(item_of)))[usable[a : a + 512]]
        if len(b):
            reach = np.maximum(reach, idf * (np.abs(basis @ queries[b].T) / (min_share * lengths[b])).max(1))
    reach[0] = 0
    item_words = [plain_words(text) for _, text in items]
    item_masks = [masks_of(w) for w in item_words]
    answers = [answer_of(text) for _, text in items]
    answer_masks = [masks_of(w) for w in answers]
    item_mass = [{w: float(idf[vocabulary[w]]) for w in words} for words in item_words]
    item_total = [sum(mass.values()) for mass in item_mass]
    min_lcs, min_lcs_with_answer, min_answer, min_content = limits

    def joined(passages: list[tuple[int, int, float]], size: int) -> list[tuple[int, int, float]]:
        """Passages with an item's length of words around them; those that overlap are one."""
        out: list[tuple[int, int, float]] = []
        for begin, end, cosine in passages:
            begin, end = max(0, begin - size), end + size
            if out and begin <= out[-1][1] and end - out[-1][0] <= 4 * (size + window):
                out[-1] = out[-1][0], end, max(cosine, out[-1][2])
            else:
                out.append((begin, end, cosine))
        return out

    def checked(text: str, near: dict[int, list[tuple[int, int, float]]]) -> list[dict]:
        every, out = plain_words(text), []
        for i, passages in near.items():
            best = (0.0, 0.0, 0.0, 0.0)
            size = len(item_words[i])
            for begin, end, cosine in joined(passages, size):
                words = every[begin:end]
                content = sum(item_mass[i].get(w, 0.0) for w in set(words)) / item_total[i]
                if content >= min_content:
                    lcs = common_subsequence(item_masks[i], size, words) / size
                    answer = common_subsequence(answer_masks[i], len(answers[i]), words) / len(answers[i])
                    best = max(best, (lcs, answer, cosine, content))
            if best[0] >= min_lcs or best[0] >= min_lcs_with_answer and best[1] >= min_answer:
                out.append({"item_id": items[i][0], "cosine": best[2], "lcs": best[0], "answer": best[1], "content": best[3]})
        return out

    def found(texts: list) -> list[list[dict]]:
        docs = [places(t, vocabulary) for t in texts]
        sizes = np.array([len(d) for d in docs], "int64")
        matches: list[list[dict]] = [[] for _ in texts]
        if not sizes.sum():
            return matches
        every = np.concatenate(docs)
        doc, begin, end = _windows(sizes, window)
        run = np.concatenate([[0.0], np.cumsum(reach[every])])
        hopeful = np.flatnonzero(run[end] - run[begin] >= 0.999)
        if not len(hopeful):
            return matches
        begin, end, doc = begin[hopeful], end[hopeful], doc[hopeful]
        at = np.cumsum(sizes) - sizes
        near: dict[int, dict[int, list]] = {}
        some = max(1, min(4096, (1 << 21) // len(item_of)))
        for a in range(0, len(begin), some):
            b = slice(a, a + some)
            x = _project(*_passage_terms(every, begin[b], end[b], idf), len(begin[b]), basis)
            along = x @ queries.T
            cosine = along / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
            for p, i in zip(*np.nonzero((cosine >= min_cosine) & (along >= min_share * lengths))):
                d = int(doc[a + p])
                near.setdefault(d, {}).setdefault(int(item_of[i]), []).append((int(begin[a + p] - at[d]), int(end[a + p] - at[d]), float(cosine[p, i])))
        for d, by_item in near.items():
            matches[d] = checked(texts[d], by_item)
        return matches

    def run(batches):
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                out += found(batch.column(text_at).slice(at, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _MATCHES)], [*batch.schema.names, "contamination"])

    return run


def with_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = 200,
    window: int = 32,
    min_cosine: float = 0.4,
    min_share: float = 0.35,
    min_lcs: float = 0.7,
    min_lcs_with_answer: float = 0.5,
    min_answer: float = 0.8,
    min_content: float = 0.6,
    min_item_words: int = 5,
    weight_docs: int = 2000,
    item_weight: float = 100.0,
    block_items: int = 4096,
    pair_terms: int = 4096,
) -> DataFrame:
    """``docs`` with ``contamination``: the items of ``benchmark(item_id, text)`` that a text has, with their figures."""
    small_batches(docs.sparkSession)
    docs = docs.drop("contamination")
    asked = [(r.item_id, r.text) for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator()]
    asked = sorted((x for x in asked if len(plain_words(x[1])) >= min_item_words), key=lambda x: (x[0] is None, x[0], x[1]))
    out = docs.withColumn("contamination", F.array().cast(MATCHES))
    if not asked:
        return out
    # vocabulary, frequencies and basis are those of all items, so blocks of them find what one block would
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in asked for w in plain_words(t)}), 1)}
    counts, times = passage_sums(docs, vocabulary, window, pair_terms)
    idf = np.log((1 + counts[0]) / (1 + counts)) + 0.05
    basis = fit_basis(times, min(1.0, weight_docs / max(1.0, counts[0])), asked, vocabulary, idf, rank, window, item_weight)
    for at in range(0, len(asked), block_items):
        search = _search(vocabulary, idf, basis, asked[at : at + block_items], docs.columns.index("text"), window, min_cosine, min_share, (min_lcs, min_lcs_with_answer, min_answer, min_content))
        # earlier blocks' matches ride along as one more column
        before = out.withColumnRenamed("contamination", "_before")
        both = before.mapInArrow(search, T.StructType([*before.schema.fields, T.StructField("contamination", MATCHES)]))
        out = both.withColumn("contamination", F.concat("_before", "contamination")).drop("_before")
    return out
