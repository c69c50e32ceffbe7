"""Operator 1, token-ID output: an ORC store of token ids.

Documents are range-partitioned and sorted by id, encoded, and written as ORC.  The ids are an
``array<int>`` column, which ORC stores with its integer run-length encoding; every file has row
indexes each ``row_index_stride`` rows and Bloom filters on ``doc_id``, so a reader can skip stripes
on ids and read stripes in parallel.  ``part`` and ``part_start`` place each document in the global
token stream: its start is the total of all earlier parts plus ``part_start``.

Encoding is by the tokenizers library.  Texts repeat words, so each worker remembers the ids of a
bounded number of pieces already encoded, in a table that a whole chunk of texts is looked up in by hash, after which
all bytes are compared; a text is cut only where the byte-level pre-tokenizer always cuts (before a
space or newline that is followed by a character which isn't white space, behind such a newline, and between a Latin
letter and ASCII punctuation), so the pieces' ids joined
are the ids of the whole text.  Texts with other white space than single spaces and newlines between words, with the
spelling of a token added to the vocabulary, or with a piece whose hash another has, are encoded whole.

Edge cases: null text is an empty one (only the end id); null ids sort first, spread by a hash of their text; rows with equal ids are
all kept, ordered by a hash of their text; an empty table gives a readable empty store; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import small_batches

STORE_SCHEMA = "part int, part_start long, doc_id long, token_ids array<int>"
#: Pieces that a worker remembers before it starts again; about 60 bytes each.
MAX_PIECES = 2_000_000
#: A text with a longer piece is encoded whole.
LONGEST = 200
#: Bytes of text that are encoded at once.
CHUNK = 2 << 20
_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
#: What ``str.split`` takes for white space, but single spaces and newlines: of one byte, and of two or three.
_ODD_BYTES = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_ODD_WIDE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WIDE_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: ASCII letters, what follows 0xC3 in a Latin-1 letter, ASCII punctuation.
_ASCII_LETTERS = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_AFTER_C3 = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_PUNCTUATION = np.array([33 <= b <= 126 and not chr(b).isalnum() for b in range(256)])


def byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs, one behind the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def letters_of(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 is part of a Latin-1 letter."""
    wide = (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
    out = _ASCII_LETTERS[data]
    out[:-1] |= wide
    out[1:] |= wide
    return out


def irregular(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text has white space that isn't single spaces and newlines between words; ``bounds``: where texts
    begin and the last ends."""
    white = (data == 32) | (data == 10)
    odd = _ODD_BYTES[data]
    odd[1:] |= white[1:] & white[:-1]
    wide = np.flatnonzero(_WIDE_LEADS[data])
    if len(wide):
        near = np.append(data, np.zeros(2, "uint8")).astype("int32")
        two, three = near[wide + 1] & 63, near[wide + 2] & 63
        code = np.where(data[wide] == 0xC2, 0x80 | two, (near[wide] & 15) << 12 | two << 6 | three)
        odd[wide[np.isin(code, _ODD_WIDE)]] = True
    out = np.zeros(len(bounds) - 1, bool)
    out[np.searchsorted(bounds[1:], np.flatnonzero(odd), "right")] = True
    filled = bounds[1:] > bounds[:-1]
    out[filled] |= white[bounds[:-1][filled]] | white[bounds[1:][filled] - 1]
    return out


class Growing:
    """An array that is appended to without being copied each time."""

    def __init__(self, kind: str):
        self.held, self.n = np.zeros(1024, kind), 0

    @property
    def array(self) -> np.ndarray:
        return self.held[: self.n]

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            held = np.empty((self.n + len(values)) * 5 // 4, self.held.dtype)
            held[: self.n] = self.array
            self.held = held
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class PieceEncoder:
    """Ids of whole texts from a table of pieces seen before.

    A piece is a newline, or a word or the punctuation behind one with the space before it, known by a 64-bit polynomial
    hash of its bytes, which running sums give for all pieces of a chunk at once.  ``table`` is open addressing: it says
    under a hash which piece has it, if any.  Of each piece ``keys`` have the hash, ``starts`` and ``sizes`` say where its
    ids are in ``pool``, ``begins`` and ``lengths`` where its bytes are in ``spelling``.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library would spin
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.by_word = Tokenizer.from_file(tokenizer_path)
        self.by_word.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocabulary.values()) + 1, "int32")
        self.widths[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.letters = np.array([ord(x) for x in byte_letters()], "<u4")
        self.letters[10] = 32  # ends a word in ``words``
        self.end_id = end_id
        self.factors, self.inverses = np.zeros(0, "uint64"), np.zeros(0, "uint64")
        self.forget()

    def forget(self) -> None:
        self.table = np.full(1 << 12, -1, "int32")
        self.keys, self.starts, self.sizes = Growing("uint64"), Growing("int32"), Growing("int32")
        self.pool = Growing("int32")
        self.spelling, self.begins, self.lengths = Growing("uint8"), Growing("int32"), Growing("int32")
        self.pool.extend(np.array([self.end_id], "int32"))

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "int32")

    def words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words, how many each has) of words, each one pre-token of letters, perhaps after a space: spelled as
        the vocabulary writes bytes, they go through the same model behind a plain white-space split.  As no id
        spans two words, the bytes of the ids say where one ends."""
        spelled = np.full(len(data) + len(size), 10, "uint8")
        spelled[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
        text = self.letters[spelled].tobytes().decode("utf-32-le")
        ids = np.asarray(self.by_word.encode_batch_fast([text], add_special_tokens=False)[0].ids, "int32")
        done, ends = np.cumsum(self.widths[ids]), np.cumsum(size)
        last = np.searchsorted(done, ends)
        if last[-1] != len(ids) - 1 or (done[last] != ends).any():
            raise ValueError("ids don't have the bytes of their words")
        return ids, np.diff(last, prepend=-1)

    def learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, letters: np.ndarray) -> None:
        """Encode new pieces and put them in the table."""
        places = _runs(begin, size)
        n_letters = np.add.reduceat(letters[places].astype("int32"), np.cumsum(size) - size)
        plain = (n_letters > 0) & (n_letters == size - (data[begin] == 32))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        keys, begin, size, n = keys[order], begin[order], size[order], int(plain.sum())
        raw = data[_runs(begin, size)]
        ends = np.cumsum(size)
        found, counts = [], [np.zeros(0, "int64")]
        if n:
            ids, count = self.words(raw[: ends[n - 1]], size[:n])
            found.append(ids)
            counts.append(count)
        view = raw.tobytes()
        others = [self.whole(view[j - k : j].decode()) for j, k in zip(ends[n:].tolist(), size[n:].tolist())]
        counts = np.concatenate([*counts, np.fromiter(map(len, others), "int64", len(others))])
        at = np.arange(self.keys.n, self.keys.n + len(keys), dtype="int32")
        self.starts.extend(self.pool.n + np.cumsum(counts) - counts)
        self.sizes.extend(counts)
        self.begins.extend(self.spelling.n + ends - size)
        self.lengths.extend(size)
        self.spelling.extend(raw)
        self.pool.extend(np.concatenate([*found, *others]))
        self.keys.extend(keys)
        if 2 * self.keys.n > len(self.table):
            self.table = np.full(1 << (2 * self.keys.n).bit_length(), -1, "int32")
            at = np.arange(self.keys.n, dtype="int32")
        self.put(self.keys.array[at], at)

    def put(self, keys: np.ndarray, at: np.ndarray) -> None:
        slot = (keys & np.uint64(len(self.table) - 1)).astype("int64")
        while len(at):
            free = self.table[slot] < 0
            self.table[slot[free]] = at[free]  # of several one stays
            left = self.table[slot] != at
            slot, at = (slot[left] + 1) & (len(self.table) - 1), at[left]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Which piece has each hash, -1: none."""
        known, last = self.keys.held, len(self.table) - 1
        slot = (keys & np.uint64(last)).astype("int64")
        at = self.table[slot]
        left = np.flatnonzero((known[at] != keys) & (at >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & last
            at[left] = now = self.table[slot]
            more = (known[now] != keys[left]) & (now >= 0)
            left, slot = left[more], slot[more]
        return at

    def differing(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each piece of ``data`` differs from that of its hash in the table: its bytes are compared."""
        same = self.lengths.array[at] == size
        shift = np.where(same, self.begins.array[at] - begin, -begin)  # the others are compared with any bytes
        place = np.repeat(shift, size) + np.arange(len(data))
        np.clip(place, 0, self.spelling.n - 1, out=place)
        equal = np.minimum.reduceat((self.spelling.array[place] == data).view("uint8"), begin)
        return ~(same & (equal == 1))

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) > len(self.factors):
            self.factors = _powers(_FACTOR, len(data) + len(data) // 4)
            self.inverses = _powers(pow(_FACTOR, -1, 1 << 64), len(data) + len(data) // 4)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum((data.astype("uint64") + np.uint64(1)) * self.factors[: len(data)])])
            x = (sums[end] - sums[begin]) * self.inverses[begin]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(31))

    def pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece of the table, -1: none, of each piece of ``data``; pieces in each text; which have a piece that has none)."""
        n = len(bounds) - 1
        if not len(data):
            return np.zeros(0, "int32"), np.zeros(n, "int64"), np.zeros(n, bool)
        letters, newline = letters_of(data), data == 10
        cut = newline | (data == 32)
        cut[1:] |= newline[:-1] | (letters[:-1] & _PUNCTUATION[data[1:]])
        cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(begin, append=len(data))
        of_text = np.diff(np.searchsorted(begin, bounds))
        keys = self.hashes(data, begin, begin + size)
        at = self.find(keys)
        new = np.flatnonzero((at < 0) & (size <= LONGEST))
        if len(new):
            own, first = np.unique(keys[new], return_index=True)
            first = new[first]
            self.learn(own, data, begin[first], size[first], letters)
            at[new] = self.find(keys[new])
        lacking = at < 0
        if self.keys.n:
            lacking |= self.differing(data, begin, size, at)
        bad = np.zeros(n, bool)
        bad[np.repeat(np.arange(n), of_text)[lacking]] = True
        return at, of_text, bad

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; number of ids of each)."""
        held = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "").cast(pa.large_string())
        n = len(held)
        bounds = np.frombuffer(held.buffers()[1], "int64")[held.offset : held.offset + n + 1] if n else np.zeros(1, "int64")
        data = np.frombuffer(held.buffers()[2] or b"", "uint8")[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        odd = irregular(data, bounds)
        view = data.tobytes()
        for x in self.added:
            at = view.find(x)
            while at >= 0:
                odd[np.searchsorted(bounds[1:], at, "right")] = True
                at = view.find(x, at + 1)
        if odd.any():
            data = data[np.repeat(~odd, np.diff(bounds))]
            bounds = np.append(0, np.cumsum(np.where(odd, 0, np.diff(bounds))))
        if self.keys.n > MAX_PIECES:
            self.forget()
        at, of_text, bad = self.pieces(data, bounds)
        if bad.any():
            at, of_text = at[~np.repeat(bad, of_text)], np.where(bad, 0, of_text)
            odd |= bad
        # behind the pieces of a text stand the ids of one encoded whole, which are added to the pool here only, and the end id
        extra = [self.whole(held[k].as_py()) for k in np.flatnonzero(odd).tolist()]
        pool = np.concatenate([self.pool.array, *extra]) if extra else self.pool.array
        n_extra = np.fromiter(map(len, extra), "int64", len(extra))
        where = np.repeat(np.cumsum(of_text), 1 + odd)
        is_end = np.ones(n + len(extra), bool)
        is_end[np.flatnonzero(odd) + np.arange(len(extra))] = False
        starts, sizes = np.zeros(len(is_end), "int64"), np.ones(len(is_end), "int64")
        starts[~is_end], sizes[~is_end] = self.pool.n + np.cumsum(n_extra) - n_extra, n_extra
        starts, sizes = np.insert(self.starts.array[at], where, starts), np.insert(self.sizes.array[at], where, sizes)
        last = np.cumsum(of_text + 1 + odd) - 1
        return pool[_runs(starts, sizes)], np.diff(np.cumsum(sizes)[last], prepend=0)


#: Kept while a worker lives, so that later tasks find the pieces of earlier ones.
_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder_of(tokenizer_path: str, end_id: int) -> PieceEncoder:
    """The worker's encoder.  A module's function, so that tasks share it: what a nested function names is sent by value."""
    if (tokenizer_path, end_id) not in _encoders:
        _encoders[tokenizer_path, end_id] = PieceEncoder(tokenizer_path, end_id)
    return _encoders[tokenizer_path, end_id]


def _slices(texts: pa.Array):
    """(offset, length) of runs of texts of about ``CHUNK`` bytes."""
    at, held = 0, 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + size > CHUNK:
            yield at, k - at
            at, held = k, 0
        held += size
    if len(texts) > at:
        yield at, len(texts) - at


def _encoder(tokenizer_path: str, end_id: int):
    def encode(batches):
        encoder = encoder_of(tokenizer_path, end_id)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, n in _slices(batch.column(1)):
                values, sizes = encoder.encode(batch.column(1).slice(at, n))
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, "int32")),
                        pa.array(start + ends - sizes),
                        batch.column(0).slice(at, n),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("int32")), pa.array(values)),
                    ],
                    ["part", "part_start", "doc_id", "token_ids"],
                )
                start += int(ends[-1])

    return encode


def write_token_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    row_index_stride: int = 2000,
    stripe_bytes: int = 16 << 20,
) -> None:
    """Encode ``docs(doc_id, text)`` and write them to ``path`` in ascending ``doc_id`` order."""
    small_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    (
        ordered.mapInArrow(_encoder(tokenizer_path, end_id), STORE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their global ``start``; filters on ``doc_id`` reach the ORC reader."""
    rows = spark.read.schema(STORE_SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum(F.size("token_ids").cast("long")).alias("n"))
    # one row for each written partition
    before = totals.select(
        "part",
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    joined = rows.join(F.broadcast(before), "part")
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "token_ids")


def _checksums(batches):
    for batch in batches:
        lists = batch.column(2)
        if len(lists) == 0:
            continue
        bounds = lists.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(np.diff(bounds).astype("int64")),
                pa.array([zlib.crc32(values[4 * int(a) : 4 * int(b)]) for a, b in zip(bounds, bounds[1:])], pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(store: DataFrame) -> DataFrame:
    """Per document of a read store: where it starts, how many ids, and their crc32."""
    small_batches(store.sparkSession)
    return store.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
