"""Operator 3, n-gram Jaccard join by PartEnum signatures: an exact similarity join of shingle sets.

Two sets with Jaccard similarity of at least num/den have sizes in the same or neighbouring size
bands, and at most k elements in only one of them, where k follows from the band.  The feature domain
(hashed shingles) is dealt into n1 partitions; in one of them at most k2 = k // n1 elements differ.
Each is dealt into n2 parts, and every subset of n2 - k2 parts is enumerated: one of these holds the
same elements in both sets.  A signature is a hash of (band, partition, subset, the elements there), so
sufficiently similar sets share one.  A set signs for its own band and the one below.  n1 and n2 are
chosen for each band so that signatures cover as many elements as possible within a number of them.
Bands with many differing elements have pairs of three parts in more partitions than these can spoil
(``parameters``), so similar sets share several signatures there (``least_shared``).  That is
used twice, and loses no true link: a set that shares fewer with all others together has no
partner; and half of that number, the set's most frequent ones, need not be met on at all, as the
rarer ones that two similar sets share are still there, which are counted.  Passages that many sets have
are thereby passed over where a set has enough of its own.

Steps, none of which collects a group in one place or emits all pairs within one:

1. Equal sets are one class (128-bit fingerprint, smallest id counted before the shuffle).
2. Signatures are packed into binary blocks by slice; within a task's flush, a signature that several
   documents share keeps one entry, the others become pairs with the smallest id at once, so the
   entries of a hot signature are bounded by the number of flushes.  A slice's blocks meet in one call.
3. Rounds, linear in the signatures: each bucket names a leader, one of the component that most of
   its members are in, at first the one that shares most signatures.  A document is verified on whole
   texts against the leader of another component that most of its buckets name.  Links' components
   are found, buckets within one component are done, and the next round follows, until the pairs of
   different components that are left are few or a round finds hardly any link.
4. Buckets that still hold several components get every pair of different components (bounded by
   size, by a parity sketch and by how many signatures large sets must share, all of which drop no true
   link), which are verified too.

So each true link either is verified or joins two documents that others already connect.

Edge cases: null or empty texts, and those without words, have no shingles and link with nothing;
fewer words than a shingle are one shingle; rows with equal ids are one document that has all their
texts; rows with a null id have a null component and link with nothing; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import gc
from bisect import bisect_left
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import discard, materialize, small_batches
from eventloom.llm.graph import components

SKETCH = 8  # longs of parity bits
MAX_WORDS = 250_000
#: Elements, or signatures, that a task holds before it flushes.
FLUSH = 600_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each element (SplitMix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Distinct shingles of a text as sorted 64-bit hashes; remembers words' hashes."""

    def __init__(self, words: int):
        super().__init__()
        self.words = words
        self.factors = [np.uint64(mix(np.array([i + 1], "uint64"))[0] | np.uint64(1)) for i in range(words)]

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # of bytes: A-Z only, and the contract's separators
        n, k = len(words), self.words
        if n == 0:
            return np.zeros(0, "uint64")
        if n < k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], "uint64")
        ids = np.fromiter(map(self.__getitem__, words), "uint64", n)
        with np.errstate(over="ignore"):
            grams = sum((ids[i : n - k + 1 + i] * f for i, f in enumerate(self.factors)), np.zeros(n - k + 1, "uint64"))
        return np.unique(mix(grams))


@lru_cache(maxsize=4096)
def bands(num: int, den: int, up_to: int) -> tuple[tuple[int, int], ...]:
    """Size bands (least, most), the last of which holds ``up_to``."""
    out, low = [], 1
    while low <= up_to:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return tuple(out)


def most_differing(high: int, num: int, den: int) -> int:
    """Most elements in only one of two similar sets, the smaller with up to ``high`` elements."""
    total = high + high * den // num
    return max(s - 2 * -(-num * s // (den + num)) for s in range(max(2, total - den), total + 1))


#: From so many differing elements on, similar sets share several signatures.
MANY = 24


def empty_subsets(k: int) -> int:
    """Subsets of parts without elements that a set of such a band may leave out."""
    return 4 + k // 12


def least_shared(k: int) -> int:
    """Signatures that similar sets share at least, if ``k`` elements differ at most.

    Of the three subsets of a partition, a first differing element leaves one and a second none, so k of
    them, dealt as badly as can be, leave 2 * n1 - k.
    """
    return 2 * many_partitions(k) - k - empty_subsets(k) if k >= MANY else 1


def many_partitions(k: int) -> int:
    return 5 * k // 8 + 4


@lru_cache(maxsize=4096)
def parameters(low: int, high: int, num: int, den: int, budget: int) -> tuple[int, int, int]:
    """(n1, n2, k2) of a band: signatures of as many elements as possible, for at most max(budget, k + 1) of them.

    With many differing elements: subsets of two of three parts, in more partitions than these can spoil.
    """
    k = most_differing(high, num, den)
    if k >= MANY:
        return many_partitions(k), 3, 1
    best, found = (-1.0, 0), (k + 1, 1, 0)
    for n1 in range(1, k + 2):
        k2 = k // n1
        for n2 in range(k2 + 1, k2 + 7):
            count = n1 * comb(n2, k2)
            if count > max(budget, k + 1):
                break
            if (rank := (min(64.0, round(low / n1 * (n2 - k2) / n2, 3)), -count)) > best:
                best, found = rank, (n1, n2, k2)
    return found


def band_facts(size: int, num: int, den: int) -> tuple[bool, int, int]:
    """Of a set's size: whether its band is an odd one, and ``least_shared`` of that band and of the one below."""
    if not size:
        return False, 1, 1
    table = bands(num, den, 1 << max(10, size.bit_length()))
    own = bisect_left([high for _, high in table], size)
    least = [least_shared(most_differing(table[max(0, i)][1], num, den)) for i in (own, own - 1)]
    return own % 2 == 1, *least


def signatures(sets: list[np.ndarray], num: int, den: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all signatures of ``sets``."""
    sizes = np.array([len(s) for s in sets], "int64")
    at, out = [np.zeros(0, "int64")], [np.zeros(0, "uint64")]
    if not sizes.size or not sizes.max():
        return at[0], out[0]
    table = bands(num, den, int(sizes.max()))
    own = np.searchsorted([high for _, high in table], sizes)
    for tag, (low, high) in enumerate(table):
        who = np.flatnonzero((sizes > 0) & ((own == tag) | (own == tag + 1)))
        if not len(who) or most_differing(high, num, den) < 1:
            continue  # where nothing may differ, equal sets are one class already
        n1, n2, k2 = parameters(low, high, num, den, budget)
        elements = mix(np.concatenate([sets[i] for i in who]), tag)
        cells = np.repeat(np.arange(len(who)) * (n1 * n2), sizes[who])
        cells += ((elements >> np.uint64(40)) % np.uint64(n1)).astype("int64") * n2 + ((elements & np.uint64(0xFFFF)) % np.uint64(n2)).astype("int64")
        values, n = mix(elements, 77), len(who) * n1 * n2
        sums = np.bincount(cells, (values & np.uint64(0xFFFFFFFF)).astype("float64"), n).astype("uint64")
        with np.errstate(over="ignore"):
            sums = sums + (np.bincount(cells, (values >> np.uint64(32)).astype("float64"), n).astype("uint64") << np.uint64(32))
            sums = sums.reshape(len(who), n1, n2)
            k = most_differing(high, num, den)
            filled = np.bincount(cells, minlength=n).reshape(len(who), n1, n2) if k >= MANY else None
            subsets = list(combinations(range(n2), n2 - k2))
            kept = np.ones((len(subsets), len(who), n1), bool)
            if filled is not None:
                kept = np.stack([filled[:, :, list(subset)].any(2) for subset in subsets])
                kept |= ((~kept).sum((0, 2)) > empty_subsets(k))[None, :, None]
            for j, subset in enumerate(subsets):
                place = mix(np.arange(n1, dtype="uint64") + np.uint64(tag << 40) + np.uint64(j << 20), 5)
                own_sigs = mix(sums[:, :, list(subset)].sum(2, dtype="uint64") + place)
                # the lowest bit says whether the band is an odd one
                out.append((own_sigs & ~np.uint64(1) | np.uint64(tag & 1))[kept[j]])
                at.append(np.repeat(who, kept[j].sum(1)))
    return np.concatenate(at), np.concatenate(out)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view("int64"))


def parity_sketch(grams: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs; as many bits differ between two sets' sketches as elements, at most."""
    bits = np.bincount((grams >> np.uint64(55)).astype("int64"), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype("uint8")).view("int64")


def _set_rows(words: int, num: int, den: int):
    names = ["doc_id", "n", "fp1", "fp2", "odd_own", "least_own", "least_below", *(f"s{i}" for i in range(SKETCH))]

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            n, fp1, fp2, sketch, facts = [], [], [], [], []
            for text in batch.column(1):
                grams = shingle(text.as_py())
                n.append(len(grams))
                fp1.append(mix(grams, 1).sum(dtype="uint64"))
                fp2.append(mix(grams, 2).sum(dtype="uint64"))
                sketch.append(parity_sketch(grams))
                facts.append(band_facts(len(grams), num, den))
            odd, own, below = zip(*facts) if facts else ((), (), ())
            rows = np.array(sketch, "int64").reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _longs(np.array(fp1, "uint64")), _longs(np.array(fp2, "uint64")), pa.array(odd, pa.bool_()), pa.array(own, pa.int32()), pa.array(below, pa.int32()), *(_longs(rows[:, i].copy()) for i in range(SKETCH))], names
            )

    return run


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, first all lowest ones: high ones that are zero compress away."""
    return np.ascontiguousarray(x.view("uint8").reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, "uint8").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), "uint8")
    out[:, :width] = planes.T
    return out.reshape(-1).view("uint64")


#: Bytes of a signature that are kept; the slice adds to them.
SIG_BYTES = 6


def _pack(words: int, num: int, den: int, budget: int, slices: int):
    schema = pa.schema([("slice", pa.int32()), ("sigs", pa.binary()), ("docs", pa.binary()), ("pairs", pa.binary())])

    def flush(ids: list[int], sets: list[np.ndarray], turn: int):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        seen, first = set(), []
        for i in order:  # equal sets: the smallest id stands for them
            key = xxhash.xxh3_128_digest(sets[i])
            if key not in seen:
                seen.add(key)
                first.append(i)
        at, sigs = signatures([sets[i] for i in first], num, den, budget)
        docs = np.array([ids[i] for i in first], "int64")[at]
        keep = sigs & np.uint64((1 << 8 * SIG_BYTES) - 1)
        slice_of = (sigs >> np.uint64(48)).astype("int64") * slices >> 16 if slices <= 1 << 16 else (mix(sigs, 9) % np.uint64(slices)).astype("int64")
        order = np.lexsort((docs, keep, slice_of))
        keep, docs, slice_of = keep[order], docs[order], slice_of[order]
        head = np.ones(len(keep), bool)
        head[1:] = (keep[1:] != keep[:-1]) | (slice_of[1:] != slice_of[:-1])
        leader = docs[head][np.cumsum(head) - 1] if len(docs) else docs
        shared = np.zeros(len(keep), bool)  # with another of this flush
        shared[:-1] |= ~head[1:]
        shared |= ~head
        rows = []
        tell = np.flatnonzero(shared)
        if len(tell):  # signature, smallest, member: to any slice, as they need no meeting
            full = keep[tell] ^ (slice_of[tell].astype("uint64") << np.uint64(48))
            rows.append((turn % slices, b"", b"", _planes(full) + _planes(leader[tell].view("uint64")) + _planes(docs[tell].view("uint64"))))
        at = np.flatnonzero(head)
        leaders, flags = docs[at], shared[at].astype("uint8")
        bounds = np.searchsorted(slice_of[at], np.arange(slices + 1))
        for s in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[s], bounds[s + 1]
            rows.append((int(s), _planes(keep[at[a:b]])[: SIG_BYTES * (b - a)], _planes(leaders[a:b]) + flags[a:b].tobytes(), b""))
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), schema.types)], schema=schema)

    def run(batches):
        shingle, ids, sets, held, turn = Shingler(words), [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = shingle(text.as_py())
                if i is None or not len(grams):
                    continue
                ids.append(i)
                sets.append(grams)
                held += len(grams)
                if held > FLUSH:
                    turn = (turn * 31 + i) % (1 << 31)
                    yield from flush(ids, sets, turn)
                    ids, sets, held = [], [], 0
        if ids:
            yield from flush(ids, sets, (turn * 31 + ids[0]) % (1 << 31))

    return run


def _meet(key, group):
    """Of a slice's blocks: (sig, odd, a, b) rows; ``sig`` is null for a pair that has its bucket to itself."""
    number = np.uint64(key[0].as_py())
    sig, a, b = [], [], []
    for data in group["pairs"]:
        if raw := data.as_py():
            three = np.frombuffer(raw, "uint8").reshape(3, -1)
            full, low, doc = (_from_planes(x.tobytes(), 8) for x in three)
            sig.append(full), a.append(low.view("int64")), b.append(doc.view("int64"))
    keep = [_from_planes(x.as_py(), SIG_BYTES) for x in group["sigs"] if x.as_py()]
    alone_a = alone_b = np.zeros(0, "int64")
    alone_odd = np.zeros(0, bool)
    if keep:
        keep = np.concatenate(keep)
        nine = [np.frombuffer(x.as_py(), "uint8").reshape(9, -1) for x in group["docs"] if x.as_py()]
        docs = np.concatenate([_from_planes(x[:8].tobytes(), 8) for x in nine]).view("int64")
        flag = np.concatenate([x[8] for x in nine]).astype(bool)
        order = np.lexsort((docs, keep))
        keep, docs, flag = keep[order], docs[order], flag[order]
        starts = np.flatnonzero(np.append(True, keep[1:] != keep[:-1]))
        runs = np.diff(np.append(starts, len(keep)))
        many = np.repeat((runs > 2) | ((runs == 2) & np.logical_or.reduceat(flag, starts)), runs)
        leader = np.repeat(docs[starts], runs)
        two = starts[(runs == 2) & ~many[starts]]
        alone_a, alone_b, alone_odd = docs[two], docs[two + 1], keep[two] & np.uint64(1) == 1
        sig.append(keep[many] ^ (number << np.uint64(48))), a.append(leader[many]), b.append(docs[many])
    n = len(alone_a)
    sigs = np.concatenate([*sig, np.zeros(0, "uint64")])
    odd = np.concatenate([sigs & np.uint64(1) == 1, alone_odd])
    sigs = sigs.view("int64")
    return pa.table(
        {
            "sig": pa.concat_arrays([pa.array(sigs), pa.nulls(n, pa.int64())]),
            "odd": odd,
            "a": np.concatenate([*a, alone_a]),
            "b": np.concatenate([*b, alone_b]),
        }
    )


def _verify(words: int, num: int, den: int):
    def run(batches):
        shingle = Shingler(words)
        last: tuple = (None, None)
        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                ta = ta.as_py()
                if last[0] != ta:
                    last = ta, shingle(ta)
                x, y = last[1], shingle(tb.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            table = pa.Table.from_batches([batch.select(["a", "b"])]).filter(pa.array(ok, pa.bool_()))
            yield from table.to_batches()

    return run


def _release(df: DataFrame) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are written: their last references go with this."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


#: Rounds that meet leaders, at most; pairs left of different components count as few if under so many a row.
MOST_ROUNDS, FEW = 4, 2


def near_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, budget: int = 48) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``; see the module."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = [f"s{i}" for i in range(SKETCH)]
    facts = ["n", "odd_own", "least_own", "least_below", *sketch]
    schema = "doc_id long, n long, fp1 long, fp2 long, odd_own boolean, least_own int, least_below int, " + ", ".join(f"{s} long" for s in sketch)
    sets = materialize(texts.mapInArrow(_set_rows(words, num, den), schema), "shingle-sets")

    # 1. classes of equal sets; rows without shingles or id are in none
    is_real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    real = sets.where(is_real)
    firsts = real.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    # written, so that adaptive execution can split the join where a class has many rows
    firsts = materialize(firsts, "shingle-firsts")
    classed = real.join(firsts, ["fp1", "fp2", "n"], "left").withColumn("rep", F.coalesce("rep", "doc_id")).select("doc_id", "rep", *facts)
    none = sets.where(~F.coalesce(is_real, F.lit(False))).select("doc_id", F.lit(None).cast("long").alias("rep"), *facts)
    nodes = materialize(classed.unionByName(none), "shingle-classes")
    discard(sets)
    reps = nodes.where("doc_id = rep")
    rep_of = nodes.where("rep <> doc_id").select("doc_id", "rep")
    # ids that have several sets stand for themselves, and link these
    several = nodes.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    links = materialize(nodes.join(several, "doc_id").select("doc_id", "a", F.col("rep").alias("b")), "shingle-several", n=F.count("*"))
    if some_several := links.told["n"]:
        reps = reps.unionByName(nodes.join(links.select("doc_id"), "doc_id", "left_semi").withColumn("rep", F.col("doc_id")))
        rep_of = rep_of.join(links.select("doc_id"), "doc_id", "left_anti")
    # written, as many steps read them: each would plan and run this aggregation again
    reps = materialize(reps.select("rep", *facts).dropDuplicates(["rep", "n", *sketch]), "shingle-reps")

    # 2. documents that share a signature
    # slices of about 16 MB: a document's signatures take about as much as its text
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    slices = min(1 << 20, max(512, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 23))
    blocks = texts.mapInArrow(_pack(words, num, den, budget, slices), "slice int, sigs binary, docs binary, pairs binary")
    met = materialize(blocks.groupBy("slice").applyInArrow(_meet, "sig long, odd boolean, a long, b long"), "shingle-buckets")
    _release(docs)

    def represented(df: DataFrame, name: str) -> DataFrame:
        to = rep_of.select(F.col("doc_id").alias(name), F.col("rep").alias("_rep"))
        return df.join(to, name, "left").withColumn(name, F.coalesce("_rep", name)).drop("_rep")

    alone = represented(represented(met.where("sig is null").groupBy("a", "b", "odd").agg(F.count("*").alias("w")), "a"), "b").where("a <> b")
    alone = alone.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "odd").agg(F.sum("w").alias("w"))
    members = represented(met.where("sig is not null").select("sig", "odd", F.explode(F.array("a", "b")).alias("doc")).distinct(), "doc").distinct()
    members = materialize(members, "shingle-members")
    # a signature's frequency puts the same order on those of all documents
    often = materialize(members.groupBy("sig").agg(F.count("*").alias("df")).where("df > 3"), "shingle-often")
    whole = members.join(often, "sig", "left").select("sig", "odd", "doc", F.lit(None).cast("long").alias("other"), F.lit(1).cast("long").alias("w"), F.coalesce("df", F.lit(3)).alias("df"))
    halves = alone.select("odd", "w", F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("b").alias("other")), F.struct(F.col("b").alias("doc"), F.col("a").alias("other")))).alias("p"))
    halves = halves.select(F.lit(None).cast("long").alias("sig"), "odd", "p.doc", "p.other", "w", F.lit(2).cast("long").alias("df"))
    # a document has as many rows as signatures
    own = Window.partitionBy("doc", "odd")
    # several sets of an id aren't told apart: one shared signature is enough
    demand = reps.groupBy(F.col("rep").alias("doc")).agg(F.count("*").alias("sets"), F.first("odd_own").alias("odd_own"), F.first("least_own").alias("least_own"), F.first("least_below").alias("least_below"))
    least = F.when(F.col("sets") > 1, 1).otherwise(F.when(F.col("odd") == F.col("odd_own"), F.col("least_own")).otherwise(F.col("least_below")))
    ranked = whole.unionByName(halves).join(demand, "doc").withColumn("least", least)
    ranked = ranked.withColumns({"all": F.sum("w").over(own), "rank": F.row_number().over(own.orderBy(F.desc("df"), "sig", "other"))})
    spared = F.floor(F.col("least") / 2)
    ranked = ranked.where((F.col("all") >= F.col("least")) & ((F.col("rank") > spared) | F.col("sig").isNull()))
    kept = materialize(ranked.select("sig", "odd", "doc", "other", "w", "all", (F.col("least") - spared).alias("need")), "shingle-kept")
    discard(met, members, often)
    apart = kept.where("sig is null").groupBy(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"), "odd")
    apart = apart.agg(F.count("*").alias("sides"), F.min("w").alias("w"), F.min("need").alias("need")).where("sides = 2").drop("sides")
    _release(docs)

    # texts of all documents that may be verified
    held = materialize(texts.join(kept.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "shingle-texts")

    def described(df: DataFrame, name: str) -> DataFrame:
        return df.join(reps.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(s).alias(f"{s}_{name}") for s in sketch)), name)

    def may_link(a: str, b: str) -> Column:
        """Necessary for a link: sizes, and no more parity bits that differ than elements may."""
        na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
        bits = sum((F.bit_count(F.col(f"{s}_{a}").bitwiseXOR(F.col(f"{s}_{b}"))) for s in sketch), F.lit(0))
        return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & (bits * (den + num) <= (den - num) * (na + nb))

    def verified(df: DataFrame, tag: str) -> DataFrame:
        left = held.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        right = held.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        joined = df.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
        return materialize(joined.mapInArrow(_verify(words, num, den), "a long, b long"), tag, n=F.count("*"))

    def in_component(df: DataFrame, found: DataFrame | None, name: str) -> DataFrame:
        if found is None:
            return df.withColumn(f"c_{name}", F.col(name))
        to = found.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
        return df.join(to, name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))

    # 3. rounds with leaders
    found, tried = None, []
    if some_several:
        found = links.select("a", "b").union(links.select("doc_id", "b")).where("a <> b")
        found = materialize(components(found), "shingle-components")
    # signatures with the same members tell the same pairs: one of them stands for all, with their number
    contents = (F.bit_xor(F.xxhash64("doc")).alias("k1"), F.bit_xor(F.xxhash64("doc", F.lit(7))).alias("k2"), F.count("*").alias("n"))
    by_sig = kept.where("sig is not null").groupBy("sig", "odd").agg(*contents).where("n > 1")
    single = by_sig.groupBy("k1", "k2", "n", "odd").agg(F.min("sig").alias("sig"), F.count("*").alias("w")).select("sig", "w")
    buckets = materialize(kept.where("sig is not null").drop("w", "other").join(single, "sig"), "shingle-open")
    for turn in range(MOST_ROUNDS):
        placed = in_component(buckets, found, "doc")
        rank = F.col("all") if turn == 0 else F.xxhash64("doc", F.lit(turn))
        by_component = placed.groupBy("sig", "c_doc").agg(F.count("*").alias("n"), F.max(F.struct(rank.alias("rank"), "doc")).alias("top"))
        leaders = by_component.groupBy("sig").agg(F.max(F.struct("n", "top", "c_doc")).alias("lead"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).where("n > lead.n")
        leaders = materialize(leaders.select("sig", F.col("lead.top.doc").alias("lead"), F.col("lead.c_doc").alias("c_lead"), "n", "same"), "shingle-leaders", rows=F.sum("n"), pairs=F.sum((F.col("n").cast("double") * F.col("n") - F.col("same")) / 2))
        left = leaders.told
        if not left["rows"] or left["pairs"] <= FEW * left["rows"] and turn:
            break
        buckets = materialize(placed.drop("c_doc").join(leaders.select("sig"), "sig", "left_semi"), "shingle-open")
        named = in_component(buckets, found, "doc").join(leaders.select("sig", "lead", "c_lead"), "sig").where("c_doc <> c_lead")
        named = described(described(named.groupBy("doc", "lead").agg(F.sum("w").alias("w")), "doc"), "lead").where(may_link("doc", "lead"))
        asked = named.select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b"), "doc", "w")
        for before in tried:
            asked = asked.join(before, ["a", "b"], "left_anti")
        asked = asked.groupBy("doc").agg(F.max(F.struct("w", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
        tried.append(materialize(asked, "shingle-tried", n=F.count("*")))
        new = verified(tried[-1], "shingle-links")
        _release(docs)
        n_new = new.told["n"]
        if n_new:
            found = materialize(components(new if found is None else new.union(found.select("component", "node"))), "shingle-components")
        if 10 * n_new < tried[-1].told["n"] and turn:
            break

    # 4. pairs of different components that share enough signatures
    placed = in_component(buckets, found, "doc")
    open_sigs = placed.groupBy("sig").agg(F.min("c_doc").alias("x"), F.max("c_doc").alias("y")).where("x <> y").select("sig")
    still = materialize(described(placed.join(open_sigs, "sig"), "doc"), "shingle-still")
    sides = [c for c in still.columns if c not in ("sig", "w", "odd", "need", "all")]
    x = still.select("sig", "w", "odd", "need", *(F.col(c).alias(c.replace("doc", "a")) for c in sides))
    y = still.select("sig", *(F.col(c).alias(c.replace("doc", "b")) for c in sides))
    meeting = (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & may_link("a", "b")
    across = x.alias("x").join(y.alias("y"), (F.col("x.sig") == F.col("y.sig")) & meeting).select("a", "b", "odd", "w", "need")
    two = described(in_component(in_component(apart, found, "a"), found, "b").where("c_a <> c_b"), "a")
    two = described(two, "b").where(may_link("a", "b")).select("a", "b", "odd", "w", "need")
    met_often = across.union(two).groupBy("a", "b", "odd").agg(F.sum("w").alias("w"), F.min("need").alias("need")).where("w >= need")
    rest = met_often.select("a", "b").distinct()
    for before in tried:
        rest = rest.join(before, ["a", "b"], "left_anti")
    more = verified(materialize(rest, "shingle-tried"), "shingle-links")
    # components seen so far are links too
    final = materialize(components(more if found is None else more.union(found.select("component", "node"))), "shingle-components")

    out = nodes.where("rep is not null").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("c"))
    out = out.unionByName(nodes.where("rep is null").select("doc_id", "n", F.col("doc_id").alias("c")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
