"""Benchmark decontamination with suffix arrays over the training text.

Every batch of training documents is a shard. Its words become numbers (those that the benchmark
uses; all others become a break), the suffixes that begin with enough benchmark words in a row are
sorted, and every benchmark suffix is binary-searched in that order. The range of suffixes that share
a whole window gives all its verbatim occurrences; occurrences on one diagonal join into the longest
matches, and these are the result: which item, where in it, where in the document, how long. No
document moves between machines: executors prepare the benchmark in blocks of bounded size in the
shared folder, and every shard is searched for one block after the other in a single pass.
"""

from __future__ import annotations

import atexit
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import read_table, restored, shared_folder, shielded
from onoma.llm.folder import Folder

WINDOW = 10
#: Bytes of benchmark text that a task holds at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that are one shard at most (a longer document is a shard alone).
SHARD_BYTES = 16 << 20
#: Blocks that a worker holds at a time.
HELD_BLOCKS = 2
RESULT = ("n_words", "matches", "hit_ranges", "hit_items")


def _word_table() -> bytes:
    """Byte map: A-Z to a-z; all but digits, letters and non-ASCII bytes to a blank."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in b"0123456789abcdefghijklmnopqrstuvwxyz":
        out[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        out[b] = b + 32
    return bytes(out)


TABLE = _word_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class SuffixArray:
    """The suffixes of ``ids`` that begin at ``starts``, sorted by their first ``depth`` words."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, depth: int):
        self.depth = depth
        keys = suffix_keys(ids, starts, depth)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], starts[order]

    def ranges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each sorted key the part of ``starts`` whose suffixes begin with it."""
        return np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")


def suffix_keys(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Fixed-width keys whose byte order is the order of the word numbers."""
    rows = ids[starts[:, None] + np.arange(depth)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel()


@dataclass
class Block:
    """A block of the benchmark: word numbers, and for every window length its distinct windows.

    names: the item's id for every row of the benchmark. windows: length -> (sorted keys, offsets into
    places, places: rows, places: first words in the row). vocab_of: length -> for every word number
    whether an item with windows of that length has it.
    """

    vocabulary: dict[bytes, int]
    names: list[str]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    vocab_of: dict[int, np.ndarray]


def build_block(items: list[tuple[str, bytes]], window: int = WINDOW) -> Block:
    vocab: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
    for row, (_, text) in enumerate(items):
        ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)], np.int32)
        if n := min(len(ids), window):
            by_length.setdefault(n, []).append((ids, row))
    windows, vocab_of = {}, {}
    for n, found in by_length.items():
        keys = np.concatenate([suffix_keys(i, np.arange(len(i) - n + 1), n) for i, _ in found])
        row = np.concatenate([np.full(len(i) - n + 1, k) for i, k in found])
        place = np.concatenate([np.arange(len(i) - n + 1) for i, _ in found])
        order = np.argsort(keys, kind="stable")
        uniq, begin = np.unique(keys[order], return_index=True)
        windows[n] = (uniq, np.append(begin, len(keys)), row[order], place[order])
        used = np.zeros(len(vocab) + 1, bool)
        for i, _ in found:
            used[i] = True
        vocab_of[n] = used
    return Block(vocab, [name for name, _ in items], windows, vocab_of)


#: (row of the block, first word in the item, first word in the document, words)
Match = tuple[int, int, int, int]


def search_shard(texts: list[list[bytes]], block: Block) -> list[list[Match]]:
    """All matches that can't be lengthened, of every document (its words) of a shard, in order."""
    get = block.vocabulary.get
    gap = np.zeros(max(block.windows, default=1), np.int32)
    parts = [x for ws in texts for x in (np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)), gap)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(np.array([len(ws) for ws in texts], np.int64) + len(gap))])
    out: list[list[Match]] = [[] for _ in texts]
    for n, (keys, offsets, rows, places) in block.windows.items():
        breaks = np.concatenate([[0], np.cumsum(~block.vocab_of[n][ids])])
        starts = np.flatnonzero(breaks[n:] == breaks[: len(breaks) - n]) if len(ids) >= n else np.zeros(0, np.int64)
        if not len(starts):
            continue
        array = SuffixArray(ids, starts, n)
        lo, hi = array.ranges(keys)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        here = [array.starts[lo[k] : hi[k]] for k in hit]
        there = [slice(offsets[k], offsets[k + 1]) for k in hit]
        at = np.concatenate([np.repeat(h, t.stop - t.start) for h, t in zip(here, there, strict=True)])
        row = np.concatenate([np.tile(rows[t], len(h)) for h, t in zip(here, there, strict=True)])
        place = np.concatenate([np.tile(places[t], len(h)) for h, t in zip(here, there, strict=True)])
        # windows one after the other on a diagonal of (row, document) are one match
        order = np.lexsort((at, at - place, row))
        at, row, place = at[order], row[order], place[order]
        goes_on = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        length = np.diff(np.append(first, len(at))) + n - 1
        doc = np.searchsorted(begin, at[first], "right") - 1
        found = zip(doc.tolist(), row[first].tolist(), place[first].tolist(), (at[first] - begin[doc]).tolist(), length.tolist(), strict=True)
        for d, *match in found:
            out[d].append(tuple(match))
    return out


def write_blocks(benchmark: DataFrame, folder: Folder, id_col: str, text_col: str, window: int, most: int) -> list[str]:
    """Names of the files in ``folder`` that executors wrote, one for each block of at most ``most`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = [], 0

        def done() -> pa.RecordBatch:
            name = f"block-{uuid.uuid4().hex}"
            folder.put(name, [pickle.dumps(build_block(items, window))])
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if items and size + len(text) > most:
                    yield done()
                    items, size = [], 0
                items.append((name or "", text))
                size += len(text)
        if items:
            yield done()

    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return sorted(r["name"] for r in rows.coalesce(1 + total // most).mapInArrow(run, "name string").collect())


MATCHES = "array<struct<item:string,at:int,start:int,length:int>>"


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    item_col: str = "item_id",
    text_col: str = "text",
    keep_text: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``matches``, ``hit_ranges`` and ``hit_items``.

    ``matches``: the longest verbatim matches of at least a window, sorted: the item's id (as a string),
    the match's first word in the item (``at``) and in the document (``start``), and its words.
    ``hit_ranges``: the merged [start, end) word ranges that they cover; ``hit_items``: the items'
    sorted ids. A window is ``window`` words of an item, or all of an item that has fewer. Words are
    compared with A-Z lower-cased; punctuation and white space between them don't count.

    Null text has no words; items without words match nothing; an item's id may be null (empty
    string) or repeat (one item in ``hit_items``, matches for each of its rows). Rows are judged one by
    one, so repeated rows get repeated results, whatever the length of their texts; an empty table gives
    no rows. Columns of ``docs`` with the result's names are replaced. ``keep_text=False`` drops the text.
    """
    folder = Folder(shared_folder(docs.sparkSession, "benchmark"))
    names = write_blocks(benchmark, folder, item_col, text_col, window, block_bytes)
    atexit.register(folder.remove)
    fields = [f for f in docs.schema if f.name not in RESULT]
    kept = [f for f in fields if keep_text or f.name != "text"]
    ddl = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long", f"matches {MATCHES}"]
    found = docs.select(*[f.name for f in fields]).mapInArrow(_search(folder, names, [f.name for f in kept]), ", ".join(ddl))
    covered = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("end"))))
    return found.withColumns({"hit_ranges": merged_ranges(covered), "hit_items": F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))})


def merged_ranges(ranges: Column) -> Column:
    """Sorted [start, end) ranges with those that overlap or touch joined."""
    ends = lambda acc, r: F.struct(
        F.when(r["start"] > acc["end"], F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]).alias("out"),
        F.when(r["start"] > acc["end"], r["start"]).otherwise(acc["start"]).alias("start"),
        F.greatest(acc["end"], r["end"]).alias("end"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    first = F.get(ranges, F.lit(0))
    zero = F.struct(none.alias("out"), first["start"].alias("start"), first["end"].alias("end"))
    close = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))
    return F.when(F.size(ranges) > 0, F.aggregate(ranges, zero, ends, close)).otherwise(none)


def _search(folder: Folder, names: list[str], kept: list[str]):
    blocks: dict[str, Block] = {}

    def block(name: str) -> Block:
        if name not in blocks:
            if len(blocks) >= HELD_BLOCKS:
                del blocks[next(iter(blocks))]
            blocks[name] = pickle.loads(folder.get(name))
        return blocks[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _shards(whole):
                col = {n: b.column(k) for k, n in enumerate(b.schema.names)}
                texts = [words_of(t or b"") for t in col["text"].cast(pa.binary()).to_pylist()]
                found: list[list[tuple]] = [[] for _ in texts]
                for name in names:
                    for mine, more in zip(found, search_shard(texts, block(name)), strict=True):
                        mine += [(block(name).names[row], *rest) for row, *rest in more]
                kind = pa.struct([("item", pa.string()), ("at", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
                rows = [[dict(zip(kind.names, m, strict=True)) for m in sorted(ms)] for ms in found]
                told = [pa.array([len(ws) for ws in texts], pa.int64()), pa.array(rows, pa.list_(kind))]
                yield pa.RecordBatch.from_arrays([*(col[n] for n in kept), *told], [*kept, "n_words", "matches"])

    return run


def _shards(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text."""
    size = np.cumsum([len(x.as_py() or "") for x in b.column(b.schema.names.index("text")).cast(pa.binary())])
    at = 0
    while at < b.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + SHARD_BYTES, "right")))
        yield b.slice(at, end - at)
        at = end


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their own columns."""
    found = find_contamination(shielded(docs, RESULT), benchmark, window=window)
    return restored(found.filter(F.size("matches") == 0), docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("long").alias("longest"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS br, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT br, item, n, i AS p, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT br, item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, dw.n, i, br, item, p FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
g AS (SELECT r, n, i - row_number() OVER (PARTITION BY r, br, i - p ORDER BY i) AS island, br, i - p AS diagonal FROM m),
x AS (SELECT r, count(*) + any_value(n) - 1 AS len FROM g GROUP BY r, br, diagonal, island),
y AS (SELECT r, count(*) AS n_matches, max(len) AS longest FROM x GROUP BY r),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_matches, 0) AS n_matches, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r LEFT JOIN y ON d.r = y.r
"""
