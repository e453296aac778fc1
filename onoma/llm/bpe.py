"""Byte-pair encoding and decoding with a contiguous array of ranks.

A text is split by the vocabulary's pattern. Each short word then holds two arrays, its part
boundaries and the merge rank of every adjacent pair of parts; the lowest rank is searched, its
boundary deleted and the two neighbouring ranks refreshed, until no pair has a rank. Words recur, so
a bounded cache keeps each word's ids as packed bytes and a text's ids are one join of cached pieces.
Very long words switch to the same merges driven by a heap, which stays fast when the array is long.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import read_table

#: How the byte-level vocabularies split text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes than this are merged with a heap.
SHORT_WORD = 128
#: Words kept by a worker's cache before it starts afresh.
CACHE_WORDS = 200_000
NO_RANK = 1 << 60
#: Texts whose ids are held at a time.
BATCH = 1000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte in byte-level vocabularies -> the byte.

    Printable Latin-1 bytes stand for themselves; the others take code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in set(plain)):
        out[chr(256 + n)] = b
    return out


class BytePairCodec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[vocab[a], vocab[b]] = (n, vocab[a + b])
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for k, v in vocab.items():
            self.token[v] = k
        for k, v in self.special.items():
            self.token[v] = k.encode()
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.cache = _Packed(self, cache_words)

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one word of the pattern."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) < 2:
            return parts
        return self._merge_array(parts) if len(parts) <= SHORT_WORD else self._merge_heap(parts)

    def _merge_array(self, parts: list[int]) -> list[int]:
        rank = self.rank
        none = (NO_RANK, -1)
        near = [rank.get(p, none) for p in zip(parts, parts[1:])]
        while near:
            best = min(near)
            if best[0] == NO_RANK:
                break
            i = near.index(best)
            parts[i] = best[1]
            del parts[i + 1], near[i]
            if i < len(near):
                near[i] = rank.get((parts[i], parts[i + 1]), none)
            if i:
                near[i - 1] = rank.get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_heap(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1])))]
        heap = [(r, i, made, a, b) for r, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := rank.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (r[0], left, r[1], parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.cache.__getitem__, self.words(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(self.cache.__getitem__, self.words(text[at : m.start()]))
            out.append(struct.pack("<I", self.special[m.group()]))
            at = m.end()
        return b"".join([*out, *map(self.cache.__getitem__, self.words(text[at:]))])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        ids = memoryview(packed).cast("I").tolist()
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


class _Packed(dict):
    """word -> packed ids, filled on demand; starts afresh when full."""

    def __init__(self, codec: BytePairCodec, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.merge_word(word.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= SHORT_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec per worker and vocabulary file."""
    return BytePairCodec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``ids`` (array of int): the tokens of each whole text.

    Null text is the empty text and has no tokens; a text of any length is encoded whole. A column
    named ``ids`` is replaced. The vocabulary is read on the workers from an installed file's path.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = _lists([c.encode_packed(t or "") for t in b.column(b.schema.names.index(text_col)).to_pylist()])
            keep = [n for n in b.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), ids], [*keep, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "ids")
    return docs.mapInArrow(run, f"{fields}, ids array<int>")


def decode_documents(tokens: DataFrame, vocabulary: str | None = None, *, ids_col: str = "ids") -> DataFrame:
    """All columns of ``tokens`` plus ``decoded``: the text of each id list (null list: empty)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(i or []) for i in b.column(b.schema.names.index(ids_col)).to_pylist()]
            keep = [n for n in b.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "decoded")
    return tokens.mapInArrow(run, f"{fields}, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text (null: empty); the ids if kept."""
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                b = whole.slice(lo, BATCH)
                n, ids, back, packs = [], [], [], []
                for text in b.column(1):
                    packed = c.encode_packed(text.as_py() or "")
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded = c.decode_bytes(packed).decode("utf-8", "replace")
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    packs.append(packed if keep_ids else b"")
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *[_lists(packs)] * keep_ids], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def _lists(packs: list[bytes]) -> pa.Array:
    """Packed ids as an Arrow column of lists, without a Python object for each id."""
    ends = [0, *accumulate(len(p) // 4 for p in packs)]
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packs))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(read_table(spark, sf_dir, "documents"))
