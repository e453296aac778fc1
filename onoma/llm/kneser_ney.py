"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, stored as sorted hash arrays.

Counting takes one pass over the texts for the words and one for every order above. Words get numbers:
a word's place among the sorted hashes of all. Every task folds its tokens' n-grams before it sends
them, so that frequent ones are one row each. Trigrams are dealt out by their context and bigrams by
themselves, so that a shard has all that their counts and discounts need. Where both words of a context
or bigram are so frequent that it might fill a shard (``hot``), its trigrams are dealt out one by one, and
what the shards know of it is added up afterwards.

A shard merges what it gets into an array sorted by hash in the shared folder. Only sums of sums reach
the driver. Below the highest order a count is the number of different words before the n-gram; n-grams
at the beginning of a text, which have none, keep their plain count.

Scoring: workers map the arrays of the shared folder into memory and look up the sorted distinct
n-grams of a block of documents, shard by shard; no text and no model moves through a shuffle.
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import SHUFFLE_CLEANUP, crc_mod, read_table, session_conf, shared_folder, shuffle_partitions
from onoma.llm.folder import Folder

ORDER = 3
#: Tokens that a task folds before it sends them, and tokens that are looked up at a time.
FOLD_TOKENS = 2_000_000
BLOCK_TOKENS = 1_000_000
#: Bytes of training text for one shard.
SHARD_BYTES = 12 << 20
#: Words grow slower than n-grams: so many word shards for a number of shards, as a power of it.
WORD_POWER = 0.6
#: Two words next to each other are hot if both are counted more often than this.
HOT = 500_000
#: Partitions for each shard, so that hardly any task gets several.
SPREAD = 2
#: Files of a kind that a worker keeps mapped at a time: its memory does not grow with the model.
MAPPED_FILES = 16
#: Bytes of text that are hashed at a time; longer words are hashed alone.
MOST_BYTES = 1 << 20
BASE = 0x9FB21C651E98DF27
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64 bits; different numbers stay different."""
    x = (x ^ (x >> np.uint64(29))) * _M1
    x = (x ^ (x >> _HALF)) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(1)
def _hashing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of every byte (A-Z as a-z, white space 0), powers of a base modulo 2^64 and of its inverse."""
    code = _mix(np.arange(1, 257, dtype=np.uint64) * _M3)
    code[ord("A") : ord("Z") + 1] = code[ord("a") : ord("z") + 1]
    code[[0x20, *range(0x09, 0x0E)]] = 0
    return code, _powers(BASE, MOST_BYTES), _powers(pow(BASE, -1, 1 << 64), MOST_BYTES)


def _word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of at most MOST_BYTES bytes: polynomials over the bytes' codes, from running sums of all."""
    code, power, inverse = _hashing()
    x = code[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], x != 0, [False]]).view(np.int8)))
    first, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])
    return _mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64) * _M2)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, cut at ASCII white space), then the end."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= MOST_BYTES:
        return np.append(_word_hashes(raw), END)
    import xxhash

    parts, held, size = [], [], 0
    for w in [*raw.split(), None]:
        if held and (w is None or len(w) > MOST_BYTES or size + len(w) >= MOST_BYTES):
            parts.append(_word_hashes(b" ".join(held)))
            held, size = [], 0
        if w is not None and len(w) > MOST_BYTES:
            parts.append(np.array([xxhash.xxh3_64_intdigest(w.translate(_UPPER))], np.uint64))
        elif w is not None:
            held.append(w)
            size += len(w) + 1
    return np.append(np.concatenate(parts or [np.zeros(0, np.uint64)]), END)


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two word numbers as one 64-bit number."""
    return a.astype(np.uint64) << _HALF | b.astype(np.uint64)


def triple_key(context_key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(context_key + (word.astype(np.uint64) + np.uint64(1)) * _M3)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so sorted hashes are sorted by shard."""
    return ((h >> _HALF) * np.uint64(shards) >> _HALF).astype(np.int64)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return (keys[begin], *(np.add.reduceat(v[order], begin) if len(keys) else v for v in values))


# ---- files ----


def _small(columns: list[np.ndarray]) -> list[bytes]:
    """Counts in one byte each; those of 255 or more stand apart with their places."""
    body, often = [], []
    for c in columns:
        body.append(np.minimum(c, 255).astype("u1"))
        at = np.flatnonzero(c >= 255)
        often.append((at.astype("<u4"), c[at].astype("<i8")))
    head = np.array([len(columns[0]), len(columns), *(len(at) for at, _ in often)], "<i8")
    return [x.tobytes() for x in (head, *(y for pair in often for y in pair[::-1]), *body)]


class Small:
    """A mapped ``_small`` array."""

    def __init__(self, take):
        self.n, columns = take("<i8", 2).tolist()
        sizes = take("<i8", columns).tolist()
        self.often = [(take("<i8", m), take("<u4", m)) for m in sizes]
        self.columns = [take("u1", self.n) for _ in range(columns)]

    def at(self, place: np.ndarray) -> list[np.ndarray]:
        out = []
        for c, (value, often) in zip(self.columns, self.often, strict=True):
            x = c[place].astype(np.int64)
            many = np.flatnonzero(x == 255)
            x[many] = value[np.searchsorted(often, place[many])]
            out.append(x)
        return out


def _taker(raw: np.ndarray):
    """Cuts one array after the other off the bytes of a file."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        size = n * np.dtype(kind).itemsize
        part, at = raw[at : at + size], at + size
        return np.frombuffer(part, kind)

    return take


def _forty(keys: np.ndarray, bits: int) -> np.ndarray:
    """40 bits of every key, after the first ``bits``, which all keys of a file share."""
    return (keys << np.uint64(bits)) >> np.uint64(24)


def packed(keys: np.ndarray, columns: list[np.ndarray], bits: int) -> list[bytes]:
    """A sorted hash array as bytes: its counts, 32 bits of every key to search by, and 8 to check."""
    k = _forty(keys, bits)
    order = np.argsort(k)
    k = k[order]
    return [*_small([c[order].astype(np.int64) for c in columns]), (k >> np.uint64(8)).astype("<u4").tobytes(), (k & np.uint64(255)).astype("u1").tobytes()]


class Packed:
    """A mapped ``packed`` array. A key that is not there is taken for another one of n with probability n / 2^40."""

    def __init__(self, raw: np.ndarray, bits: int):
        take, self.bits = _taker(raw), bits
        self.counts = Small(take)
        self.n = self.counts.n
        head = raw[len(raw) - 5 * self.n : len(raw) - self.n]
        # searching wants the array aligned, and so as a copy where the file has it otherwise
        self.head = np.frombuffer(head, "<u4") if head.ctypes.data % 4 == 0 else np.frombuffer(head.tobytes(), "<u4")
        self.check = raw[len(raw) - self.n :]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The counts of the keys (best in order), 0 where a key is missing."""
        k = _forty(keys, self.bits)
        head, check = (k >> np.uint64(8)).astype(np.uint32), (k & np.uint64(255)).astype(np.uint8)
        place = np.searchsorted(self.head, head)
        hit, ask = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(ask):  # several keys may share their first 32 bits
            ask = ask[place[ask] < self.n]
            ask = ask[self.head[place[ask]] == head[ask]]
            same = self.check[place[ask]] == check[ask]
            hit[ask[same]] = place[ask[same]]
            ask = ask[~same]
            place[ask] += 1
        there = np.flatnonzero(hit >= 0)
        out = []
        for found in self.counts.at(hit[there]):
            x = np.zeros(len(keys), np.int64)
            x[there] = found
            out.append(x)
        return out


def packed_after(keys: np.ndarray, after: list[np.ndarray], bits: int) -> list[bytes]:
    """A sorted hash array of contexts: a byte for those after which nothing is counted more than twice."""
    total, n1, n2, n3 = after
    plain = (n1 < 63) & (n2 < 4) & (n3 == 0)
    code = np.where(plain, n1 * 4 + n2, 255 + np.cumsum(~plain) - 1)
    wide = [x[~plain].astype("<i8").tobytes() for x in after]
    return [np.array([int((~plain).sum())], "<i8").tobytes(), *wide, *packed(keys, [code], bits)]


class PackedAfter:
    """A mapped ``packed_after`` array."""

    def __init__(self, raw: np.ndarray, bits: int):
        take = _taker(raw)
        m = int(take("<i8", 1)[0])
        self.wide = [take("<i8", m) for _ in range(4)]
        self.codes = Packed(raw[8 + 32 * m :], bits)
        self.n = self.codes.n

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        (code,) = self.codes.find(keys)
        n1, n2 = code >> 2, code & 3
        out = [n1 + 2 * n2, n1, n2, np.zeros(len(code), np.int64)]
        many = np.flatnonzero(code >= 255)
        for o, x in zip(out, self.wide, strict=True):
            o[many] = x[code[many] - 255]
        return out


class _Files:
    """The files of one kind, opened when first asked for; the oldest mappings go first."""

    def __init__(self, folder: Folder, kind: str, cache: dict, opened):
        self.folder, self.kind, self.cache, self.opened = folder, kind, cache, opened
        self.open: dict[int, object] = {}

    def __getitem__(self, shard: int):
        """The file's arrays, None for a shard that got nothing."""
        if shard not in self.open:
            if len(self.open) >= MAPPED_FILES:
                del self.open[next(iter(self.open))]
            try:
                self.open[shard] = self.opened(self.folder.map(f"{self.kind}-{shard:07d}", self.cache))
            except FileNotFoundError:
                self.open[shard] = None
        return self.open[shard]

    def find(self, keys: np.ndarray, shard: np.ndarray, columns: int) -> list[np.ndarray]:
        """The counts of keys that lie in the given shards; 0 where a key is missing."""
        out = [np.zeros(len(keys), np.int64) for _ in range(columns)]
        if not len(keys):
            return out
        order = None if (shard[1:] >= shard[:-1]).all() else np.argsort(shard, kind="stable")
        sorted_ = shard if order is None else shard[order]
        begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        for a, b in zip(begin, [*begin[1:], len(keys)], strict=True):
            if (table := self[int(sorted_[a])]) is not None and table.n:
                at = slice(a, b) if order is None else order[a:b]
                for o, x in zip(out, table.find(keys[at]), strict=True):
                    o[at] = x
        return out


def _rows_of(kinds: list[str]):
    def opened(raw: np.ndarray) -> list[np.ndarray]:
        n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
        for k in kinds:
            size = n * np.dtype(k).itemsize
            out.append(np.frombuffer(raw[at : at + size], k))
            at += size
        return out

    return opened


#: The files of words: hash and count of every word; then what precedes and follows it. (Places of the frequent ones have a file too.)
AROUND = 5


def _vocabulary(raw: np.ndarray) -> tuple[np.ndarray, Small]:
    take = _taker(raw)
    hashes = take("<u8", int(take("<i8", 1)[0]))
    return hashes, Small(take)


@dataclass
class Layout:
    """Where the arrays are and how they are dealt out. offsets: the first word number of every word shard."""

    folder: Folder
    order: int
    shards: int
    word_shards: int
    hot: int
    offsets: list[int] = field(default_factory=list)

    @property
    def bits(self) -> int:
        """The shards are a power of two: so many first bits of a hash are its shard."""
        return self.shards.bit_length() - 1


class Words:
    """The words' numbers and counts, by hash or by number."""

    def __init__(self, layout: Layout, cache: dict):
        self.shards, self.offsets = layout.word_shards, np.array(layout.offsets, np.int64)
        self.files = _Files(layout.folder, "vocabulary", cache, _vocabulary)
        self.around_files = _Files(layout.folder, "around", cache, lambda raw: Small(_taker(raw)))
        self.often_files = _Files(layout.folder, "often", cache, _rows_of(["<i8"]))
        self.often: np.ndarray | None = None

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted different hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cut = np.searchsorted(shard_of(h, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[s], cut[s + 1]
            if self.files[s] is not None:
                have, count = self.files[s]
                at = np.minimum(np.searchsorted(have, h[a:b]), len(have) - 1)
                hit = have[at] == h[a:b]
                ids[a:b] = np.where(hit, self.offsets[s] + at, -1)
                counts[a:b] = np.where(hit, count.at(at)[0], 0)
        return ids, counts

    def around(self, ids: np.ndarray) -> list[np.ndarray]:
        """Different words before; sum of the counts after; words after that are counted once, twice, more often."""
        out = [np.zeros(len(ids), np.int64) for _ in range(AROUND)]
        shard = np.searchsorted(self.offsets, ids, "right") - 1
        for s in np.unique(shard[ids >= 0]).tolist():
            at = np.flatnonzero((shard == s) & (ids >= 0))
            if (table := self.around_files[s]) is not None:
                for o, x in zip(out, table.at(ids[at] - self.offsets[s]), strict=True):
                    o[at] = x
        return out

    def hot(self, pairs: np.ndarray) -> np.ndarray:
        """Whether both words of a pair are listed as frequent ones."""
        if self.often is None:
            lists = [self.often_files[s] for s in range(self.shards)]
            self.often = np.concatenate([o + x[0] for o, x in zip(self.offsets, lists, strict=True) if x is not None]).astype(np.uint64)
        listed = lambda ids: self.often[np.minimum(np.searchsorted(self.often, ids), len(self.often) - 1)] == ids
        return listed(pairs >> _HALF) & listed(pairs & _LOW) if len(self.often) else np.zeros(len(pairs), bool)

    def ends(self) -> tuple[int, int]:
        ids, _ = self.find(np.array([START, END], np.uint64))
        return int(ids[0]), int(ids[1])


# ---- messages: word numbers and counts, a byte of them at a time so that they compress ----

_FIELDS = [f"{x}{k}" for x in "abcd" for k in range(4)]
_MESSAGE = "shard long, kind int, " + ", ".join(f"{f} binary" for f in _FIELDS)
#: Kinds of rows: trigrams; values of bigrams; two rows with what follows a hot context.
GRAMS, VALUES, AFTER, AFTER_TOO = range(4)


def _pieces(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    """The values between neighbouring cuts as one binary each, without copying them apart."""
    offsets = (cuts * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _message(shard: np.ndarray, kind: int, *fields: np.ndarray) -> pa.RecordBatch:
    """A row for every shard that gets something: never more rows than n-grams, however many shards there are."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, int)
    cuts = np.append(first, len(shard))
    columns = [pa.array(shard[first], pa.int64()), pa.array(np.full(len(first), kind), pa.int32())]
    for k in range(4):
        if k < len(fields):
            planes = fields[k][order].astype("<u4").view("u1").reshape(-1, 4)
            columns += [_pieces(cuts, planes[:, p]) for p in range(4)]
        else:
            columns += [_pieces(np.zeros(len(cuts), np.int64), np.zeros(0, "u1"))] * 4
    return pa.RecordBatch.from_arrays(columns, ["shard", "kind", *_FIELDS])


def _blobs(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def _fields(table: pa.Table, kind: int, names: str) -> list[np.ndarray]:
    """The fields of the rows of one kind, as 64-bit numbers."""
    rows = table.filter(pc.equal(table.column("kind"), kind))
    return [sum(_blobs(rows, f"{x}{p}", "u1").astype(np.uint64) << np.uint64(8 * p) for p in range(4)) for x in names]


# ---- counting ----


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Token hashes of about FOLD_TOKENS tokens, whole texts."""
    parts, n = [], 0
    for b in batches:
        for t in b.column(0):
            parts.append(tokens(t.as_py()))
            n += len(parts[-1])
            if n >= FOLD_TOKENS:
                yield np.concatenate(parts)
                parts, n = [], 0
    if parts:
        yield np.concatenate(parts)


def _word_pass(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _folds(batches):
            h, c = np.unique(np.append(w, START), return_counts=True)
            c[h == START] = 0
            shard = shard_of(h, shards)
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            cuts = np.append(first, len(h))
            yield pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int64()), _pieces(cuts, h), _pieces(cuts, c.astype("<i8"))], ["shard", "h", "c"])

    return run


def _merge_vocabulary(folder: Folder, hot: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        h, c = _sum_by(_blobs(table, "h", np.uint64), _blobs(table, "c", np.int64))
        folder.put(f"vocabulary-{shard:07d}", [np.array([len(h)], "<i8").tobytes(), h.astype("<u8").tobytes(), *_small([c])])
        folder.put(f"often-{shard:07d}", [np.flatnonzero(c > hot).astype("<i8").tobytes()])
        sums = [shard, len(h), int(c.sum()), int((c > 0).sum())]
        return pa.table({k: pa.array([x], pa.int64()) for k, x in zip(("shard", "n", "n_tokens", "n_words"), sums, strict=True)})

    return run


def _numbered(w: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of the tokens, of the words before them, and of those before these (-1: none or unknown).

    Before a text stands one START, before which there is nothing.
    """
    uniq, inverse = np.unique(w, return_inverse=True)
    ids, _ = words.find(uniq)
    start, _ = words.ends()
    w_ids = ids[inverse]
    before = np.concatenate([[start], np.where(w[:-1] == END, start, w_ids[:-1])])
    second = np.concatenate([[-1], before[:-1]])
    second[before == start] = -1
    return w_ids, before, second


def _counted(pair: np.ndarray, word: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (pair, word) in order: the pairs, and for each of the rows its pair's place, its word and its count."""
    pairs, at = np.unique(pair, return_inverse=True)
    key = at.astype(np.uint64) << _HALF | word.astype(np.uint64)
    if count is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, n = _sum_by(key, count.astype(np.int64))
    return pairs, (key >> _HALF).astype(np.int64), key & _LOW, n.astype(np.int64)


def _gram_pass(layout: Layout, level: int):
    """Level 3: counted trigrams. Level 2: what bigrams' counts are made of."""
    state: list[Words] = []

    def fold(w: np.ndarray, words: Words) -> Iterator[pa.RecordBatch]:
        w, v, u = _numbered(w, words)
        if level == 2 and layout.order == 2:
            pairs, n = np.unique(pair_of(v, w), return_counts=True)
            yield _message(shard_of(_mix(pairs), layout.shards), VALUES, pairs >> _HALF, pairs & _LOW, n)
            return
        inner = u >= 0
        pairs, at, last, n = _counted(pair_of(u[inner], v[inner]), w[inner])
        if level == 3:
            key = _mix(pairs)
            shard = np.where(words.hot(pairs)[at], shard_of(triple_key(key[at], last), layout.shards), shard_of(key, layout.shards)[at])
            yield _message(shard, GRAMS, (pairs >> _HALF)[at], (pairs & _LOW)[at], last, n)
            return
        middle = (pairs & _LOW)[at]
        bigrams, of = np.unique(pair_of(middle, last), return_inverse=True)
        cold = ~words.hot(bigrams)[of]
        shard = shard_of(_mix(bigrams), layout.shards)[of]
        yield _message(shard[cold], GRAMS, (pairs >> _HALF)[at][cold], middle[cold], last[cold])
        pairs, n = np.unique(pair_of(v[~inner], w[~inner]), return_counts=True)
        yield _message(shard_of(_mix(pairs), layout.shards), VALUES, pairs >> _HALF, pairs & _LOW, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Words(layout, {}))
        for w in _folds(batches):
            yield from fold(w, state[0])

    return run


def _after(at: np.ndarray, n: np.ndarray, contexts: int) -> list[np.ndarray]:
    """For every context: the sum of the counts after it, and how many are 1, 2 and more."""
    parts = [np.bincount(at, n, contexts), *(np.bincount(at[x], minlength=contexts) for x in (n == 1, n == 2, n > 2))]
    return [p.astype(np.int64) for p in parts]


def _seen(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]


_SUMS = [f"s{k}" for k in range(5)]
_PARTIAL = _MESSAGE + ", " + ", ".join(f"{s} long" for s in _SUMS)


def _merge_trigrams(layout: Layout):
    """A shard's trigrams and cold contexts to the folder; on goes what it knows of hot contexts and bigrams."""

    def run(table: pa.Table) -> pa.Table:
        words, shard = Words(layout, {}), table.column("shard")[0].as_py()
        u, v, w, n = _fields(table, GRAMS, "abcd")
        pairs, at, last, n = _counted(pair_of(u, v), w, n)
        key = _mix(pairs)
        layout.folder.put(f"trigrams-{shard:07d}", packed(triple_key(key[at], last), [n], 0))
        after, hot = _after(at, n, len(pairs)), words.hot(pairs)
        told = ~hot & (after[0] > 1)  # a pair that is seen, but not here, is followed by one word once
        layout.folder.put(f"after-{shard:07d}", packed_after(key[told], [x[told] for x in after], layout.bits))
        a, b = pairs[hot] >> _HALF, pairs[hot] & _LOW
        to, values = shard_of(key[hot], layout.shards), [x[hot] for x in after]
        bigrams, before = np.unique(pair_of((pairs & _LOW)[at], last), return_counts=True)
        both = words.hot(bigrams)
        bigrams, before = bigrams[both], before[both]
        rows = [
            _message(to, AFTER, a, b, *values[:2]), _message(to, AFTER_TOO, a, b, *values[2:]),
            _message(shard_of(_mix(bigrams), layout.shards), VALUES, bigrams >> _HALF, bigrams & _LOW, before),
        ]
        told = pa.Table.from_batches([_message(np.array([-1]), -1, np.array([0])), *rows])
        for k, s in zip(_SUMS, _seen(n), strict=True):
            told = told.append_column(k, pa.array([s, *[0] * (len(told) - 1)], pa.int64()))
        return told

    return run


def _merge_hot(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        a, b, *first = _fields(table, AFTER, "abcd")
        c, d, *second = _fields(table, AFTER_TOO, "abcd")
        pairs, *values = _sum_by(np.concatenate([pair_of(a, b), pair_of(c, d)]), *(np.concatenate([x, np.zeros(len(c), np.uint64)]) for x in first), *(np.concatenate([np.zeros(len(a), np.uint64), x]) for x in second))
        layout.folder.put(f"hot-{shard:07d}", packed_after(_mix(pairs), [x.astype(np.int64) for x in values], layout.bits))
        return pa.table({"n": pa.array([len(pairs)], pa.int64())})

    return run


_AROUND = ("w", "before", "v", "total", "n1", "n2", "n3")
_SHARES = pa.schema([("shard", pa.int64()), *((s, pa.int64()) for s in _SUMS), *((n, pa.binary()) for n in _AROUND)])
_SHARES_DDL = "shard long, " + ", ".join(f"{s} long" for s in _SUMS) + ", " + ", ".join(f"{n} binary" for n in _AROUND)


def _merge_bigrams(layout: Layout):
    """A shard's bigrams to the folder; on go the words' shares."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        u, v, w = _fields(table, GRAMS, "abc")
        pairs, at, _, _ = _counted(pair_of(v, w), u)
        a, b, n = _fields(table, VALUES, "abc")
        pairs, n = _sum_by(np.concatenate([pairs, pair_of(a, b)]), np.concatenate([np.bincount(at, minlength=len(pairs)), n.astype(np.int64)]))
        layout.folder.put(f"bigrams-{shard:07d}", packed(_mix(pairs), [n], layout.bits))
        firsts, of = np.unique(pairs >> _HALF, return_inverse=True)
        seconds, before = np.unique(pairs & _LOW, return_counts=True)
        after = _after(of, n, len(firsts))
        offsets = np.array(layout.offsets, np.uint64)
        cuts = lambda ids: np.append(np.searchsorted(ids, offsets), len(ids))
        wcut, vcut = cuts(seconds), cuts(firsts)
        used = np.flatnonzero((np.diff(wcut) > 0) | (np.diff(vcut) > 0))
        wcut, vcut = np.append(wcut[used], len(seconds)), np.append(vcut[used], len(firsts))
        told = [pa.array([x, *[0] * (len(used) - 1)], pa.int64()) for x in _seen(n)]
        arrays = [_pieces(wcut, x.astype("<i8")) for x in (seconds, before)] + [_pieces(vcut, x.astype("<i8")) for x in (firsts, *after)]
        return pa.table([pa.array(used, pa.int64()), *told, *arrays], schema=_SHARES)

    return run


_WORD_SUMS = [*_SUMS, "k1", "k2", "k3", "k4", "more"]


def _merge_around(layout: Layout):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        low = layout.offsets[shard]
        size = len(_vocabulary(layout.folder.map(f"vocabulary-{shard:07d}", {}))[0])
        w, before, v, *after = (_blobs(table, n, np.int64) for n in _AROUND)
        dense = [np.zeros(size, np.int64) for _ in range(AROUND)]
        np.add.at(dense[0], w - low, before)
        for d, x in zip(dense[1:], after, strict=True):
            np.add.at(d, v - low, x)
        layout.folder.put(f"around-{shard:07d}", _small(dense))
        sums = [int(sum(table.column(s).to_pylist())) for s in _SUMS]
        sums += [int((dense[0] == k).sum()) for k in (1, 2, 3, 4)] + [int((dense[0] > 2).sum())]
        return pa.table({n: pa.array([x], pa.int64()) for n, x in zip(_WORD_SUMS, sums, strict=True)})

    return run


Discounts = tuple[float, float, float]


def discounts(n1: int, n2: int, n3: int, n4: int) -> Discounts:
    """Modified Kneser-Ney discounts from the numbers of things counted 1, 2, 3 and 4 times.

    Where a number they divide by is missing (small corpora), 3/4 stands in; never more than the count.
    """
    if not n1 or not n2:
        return (0.75, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75)
    return tuple(min(max(d, 1e-6), k - 1e-6) for k, d in enumerate(raw, 1))


@dataclass
class Model:
    """The layout of the arrays, and the sums that turn their counts into probabilities."""

    layout: Layout
    n_tokens: int = 0
    n_words: int = 0
    n_pairs: int = 0
    discounts: dict[int, Discounts] = field(default_factory=dict)
    #: words that stand after one, two or more different words
    kinds: tuple[int, int, int] = (0, 0, 0)


def train(docs: DataFrame, order: int = ORDER, *, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> Model:
    """Count all texts of ``docs`` and store the model in the shared folder (removed when the driver ends).

    Null text is an empty one: it has the end as its only token. Repeated rows count as often as they
    stand there. Without rows the model knows nothing and gives every token probability 1.
    """
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = docs.sparkSession
    folder = Folder(shared_folder(spark, "ngrams"))
    atexit.register(folder.remove)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 << max(0, -(-size // shard_bytes) - 1).bit_length()
    layout = Layout(folder, order, shards, int(np.ceil(shards**WORD_POWER)), hot)
    texts = docs.select("text")

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        # partitions grow with the shards, so that a task has few of them whatever the session's number is
        return df.repartition(max(shuffle_partitions(spark), SPREAD * parts), "shard").groupBy("shard")

    with session_conf(spark, **{SHUFFLE_CLEANUP.replace(".", "__"): "true"}):
        counted = dealt(texts.mapInArrow(_word_pass(layout.word_shards), "shard long, h binary, c binary"), layout.word_shards)
        found = counted.applyInArrow(_merge_vocabulary(folder, hot), "shard long, n long, n_tokens long, n_words long").collect()
        if not found:
            return Model(layout)
        sizes = {r["shard"]: r["n"] for r in found}
        layout.offsets = np.cumsum([0, *(sizes.get(s, 0) for s in range(layout.word_shards - 1))]).tolist()
        if sum(sizes.values()) >= 2**32:
            raise ValueError("more than 2^32 different words")
        model = Model(layout, sum(r["n_tokens"] for r in found), sum(r["n_words"] for r in found))

        messages = texts.mapInArrow(_gram_pass(layout, 2), _MESSAGE)
        if order == 3:
            told_at = f"{folder.uri}/told"
            dealt(texts.mapInArrow(_gram_pass(layout, 3), _MESSAGE), shards).applyInArrow(_merge_trigrams(layout), _PARTIAL).write.parquet(told_at)
            told = spark.read.parquet(told_at)
            s = told.agg(*[F.sum(k).alias(k) for k in _SUMS]).first()
            model.discounts[3] = discounts(*(s[k] or 0 for k in _SUMS[:4]))
            dealt(told.filter(F.col("kind").isin(AFTER, AFTER_TOO)).drop(*_SUMS), shards).applyInArrow(_merge_hot(layout), "n long").agg(F.sum("n")).collect()
            messages = messages.union(told.filter(F.col("kind") == VALUES).drop(*_SUMS))
        shares = dealt(messages, shards).applyInArrow(_merge_bigrams(layout), _SHARES_DDL)
        sums = dealt(shares, layout.word_shards).applyInArrow(_merge_around(layout), ", ".join(f"{n} long" for n in _WORD_SUMS))
        s = {k: v or 0 for k, v in sums.agg(*[F.sum(n).alias(n) for n in _WORD_SUMS]).first().asDict().items()}
    model.discounts[2] = discounts(*(s[k] for k in _SUMS[:4]))
    model.discounts[1] = discounts(s["k1"], s["k2"], s["k3"], s["k4"])
    model.n_pairs, model.kinds = s["s4"], (s["k1"], s["k2"], s["more"])
    return model


# ---- scoring ----


def _cut(n: np.ndarray, d: Discounts) -> np.ndarray:
    """Counts less their discounts."""
    return n - np.select([n >= 3, n == 2, n == 1], [d[2], d[1], d[0]], 0.0)


def _interpolated(n: np.ndarray, after: list[np.ndarray], d: Discounts, lower: np.ndarray) -> np.ndarray:
    """The discounted share of the context's total, and what the discounts leave for the lower order."""
    total, *seen = after
    spare = np.where(total > 0, sum(x * y for x, y in zip(d, seen, strict=True)) / np.maximum(total, 1), 1.0)
    return _cut(n, d) / np.maximum(total, 1) + spare * lower


class Scorer:
    """The mapped arrays of a model."""

    def __init__(self, model: Model):
        self.m, cache = model, {}
        folder = model.layout.folder
        if model.n_tokens:
            self.words = Words(model.layout, cache)
            bits = model.layout.bits
            kinds = {"trigrams": (Packed, 0), "bigrams": (Packed, bits), "after": (PackedAfter, bits), "hot": (PackedAfter, bits)}
            self.files = {k: _Files(folder, k, cache, partial(made, bits=b)) for k, (made, b) in kinds.items()}

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """n_tokens, n_known, base score and log10 probability of every text."""
        out, block, n = [], [], 0
        for t in texts:
            block.append(tokens(t))
            n += len(block[-1])
            if n >= BLOCK_TOKENS:
                out += self._block(block)
                block, n = [], 0
        return out + (self._block(block) if block else [])

    def _probabilities(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and probabilities of the tokens."""
        m, layout = self.m, self.m.layout
        if not m.n_tokens:
            return np.zeros(len(w), np.int64), np.ones(len(w))
        uniq, of = np.unique(np.append(w, START), return_inverse=True)
        ids, count = self.words.find(uniq)
        kinds, *after = self.words.around(ids)
        of_w, start = of[:-1], of[-1]
        of_v = np.concatenate([[start], np.where(w[:-1] == END, start, of_w[:-1])])
        spare = sum(a * b for a, b in zip(m.discounts[1], m.kinds, strict=True)) / m.n_pairs
        p = (_cut(kinds, m.discounts[1]) / m.n_pairs + spare / (m.n_words + 1))[of_w]

        w_ids, v_ids = ids[of_w], ids[of_v]
        known = (v_ids >= 0) & (w_ids >= 0)
        # by hash, so that shards come one after the other; unknown pairs get a hash that is looked up in vain
        key, back = np.unique(_mix(pair_of(np.where(known, v_ids, 0), np.where(known, w_ids, 0))), return_inverse=True)
        shard = shard_of(key, layout.shards)
        seen = self.files["bigrams"].find(key, shard, 1)[0]
        n = np.where(known, seen[back], 0)
        p = _interpolated(n, [x[of_v] for x in after], m.discounts[2], p)
        if layout.order == 2:
            return count[of_w], p

        # the two words before a token are the pair that ends at the token before it
        inner = np.flatnonzero((of_v != start) & np.concatenate([[False], known[:-1]]))
        context, last = back[inner - 1], w_ids[inner]
        pairs = np.zeros(len(key), np.uint64)
        pairs[back[known]] = pair_of(v_ids[known], w_ids[known])
        hot = self.words.hot(pairs)
        after = self.files["after"].find(key, shard, 4)
        if hot.any():
            for a, x in zip(after, self.files["hot"].find(key[hot], shard[hot], 4), strict=True):
                a[hot] = x
        once = (after[0] == 0) & (seen > 0)
        after[0][once] = after[1][once] = 1
        asked = np.flatnonzero((last >= 0) & (after[0][context] > 0))
        rows, back = np.unique(pair_of(context[asked], last[asked]), return_inverse=True)
        own = (rows >> _HALF).astype(np.int64)
        triples = triple_key(key[own], rows & _LOW)
        where = np.where(hot[own], shard_of(triples, layout.shards), shard[own])
        order = np.lexsort((triples, where))
        found = np.empty(len(rows), np.int64)
        found[order] = self.files["trigrams"].find(triples[order], where[order], 1)[0]
        n = np.zeros(len(inner), np.int64)
        n[asked] = found[back]
        p[inner] = _interpolated(n, [x[context] for x in after], m.discounts[3], p[inner])
        return count[of_w], p

    def _block(self, parts: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        m = self.m
        count, p = self._probabilities(np.concatenate(parts))
        base = np.log10((count + 1) / (m.n_tokens + 1 * (m.n_words + 1)))
        begin = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
        sums = [np.add.reduceat(x, begin) for x in ((count > 0).astype(np.int64), base, np.log10(p))]
        return [(len(x), int(k), float(b), float(s)) for x, k, b, s in zip(parts, *sums, strict=True)]


def score_documents(docs: DataFrame, model: Model, *, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus n_tokens, n_known, base_score, score (log10) and perplexity.

    Columns of those names are replaced. Whole texts are scored row by row; a null text is an empty
    one, with the end as its only token. perplexity is 10 ** (-score / n_tokens).
    """
    own = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    kept = [f for f in docs.schema if f.name not in own]
    names = [f.name for f in kept if keep_text or f.name != "text"]
    state: list[Scorer] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Scorer(model))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                found = state[0].score(b.column(b.schema.names.index("text")).to_pylist())
                n, known, base, score = (np.array(x) for x in zip(*found, strict=True))
                values = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in names), *values], [*names, *own])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name in names), *(f"{k} {t}" for k, t in own.items())])
    return docs.select(*[f.name for f in kept]).mapInArrow(run, ddl)


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 7) == 2


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))), ORDER)
    scored = score_documents(docs, model, keep_text=False)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )
