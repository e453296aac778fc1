"""Exact n-gram Jaccard join with a token-group matrix.

Documents become sets of word shingles. Equal sets are folded into one. Shingles get one global order,
rare ones first, and sets that reach the threshold must share a shingle among the first few of each;
sets whose first shingles occur nowhere else drop out there.

That is done twice: with a sample of the hash space for all sets, to find the few that may meet at
all, and with all tokens for those.

The rest is partitioned into groups of similar sets. A group stores its token union and, for every
token, the members that have it: the rows of the token-group matrix. Groups are linked up inside
first; what remains are queries, sets that share a first shingle with a group they are not in. A
query's overlap with the group's union bounds its overlap with every member, so a group is opened
only if that bound qualifies, and then the counts per member are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import checkpointed, read_table
from onoma.llm.components import connected_components

WORDS = 3
THRESHOLD = (90, 100)
#: Members of a group that are worked off at a time, queries that meet them at a time.
MEMBERS = 192
QUERIES = 256
#: Tokens (of 8 bytes) that the members of a part have in all, about.
PART_TOKENS = 4_000_000
#: Bits of a set's name; sets of one name are told apart by 64 more.
NAME_BITS = 64
#: Ids (of 32 bytes) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
CACHE_WORDS = 150_000
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words than that are one shingle."""
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))
    width = min(words, len(ws))
    out = np.full(len(ws) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def set_names(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a whole set: the one it goes by, and one that tells sets of one name apart."""
    total = (s * _M2).sum(keepdims=True) ^ np.uint64(len(s))
    folded = np.bitwise_xor.reduce(_mix(s), keepdims=True)
    x = _mix(np.concatenate([total ^ _mix(folded), folded + _M1 * total])).view(np.int64)
    return int(x[0]), int(x[1])


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    """First tokens of a set of n of which one at least is shared with any set that reaches the threshold."""
    num, den = threshold
    return n - -(-num * n // den) + 1


def sampled(threshold: tuple[int, int]) -> float:
    """Share of the hash space whose tokens are counted first; a set's first tokens fit in it with room."""
    num, den = threshold
    return min(1.0, 1.5 * (1 - num / den) + 0.02)


_SETS = "n long, tokens array<long>, more array<long>, keys array<long>"
_SPREAD = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def _set_columns(sets: list[np.ndarray], share: float, threshold: tuple[int, int]) -> list[pa.Array]:
    """_SETS of every set.

    tokens: those in the counted part of the hash space; more: as many of the others, smallest first,
    as the set's prefix needs beyond them; keys: four min-hashes of the whole set.
    """
    edge = np.uint64(min(int(share * 2**64), 2**64 - 1))
    n, first, more, keys = [], [], [], []
    for s in sets:
        n.append(len(s))
        cut = int(np.searchsorted(s, edge, "right"))
        need = prefix_length(len(s), threshold) if len(s) else 0
        first.append(s[:cut].view(np.int64))
        more.append(s[cut : max(cut, need)].view(np.int64))
        keys.append(np.array([s[0], s[-1], *((s * m).min() for m in _SPREAD)], np.uint64).view(np.int64) if len(s) else np.zeros(0, np.int64))
    longs = pa.list_(pa.int64())
    return [pa.array(n, pa.int64()), pa.array(first, longs), pa.array(more, longs), pa.array(keys, longs)]


def shingle_sets(docs: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, th, sid, other and _SETS, tokens sampled) of every row. Empty sets have sid and other null."""
    share, drop = sampled(threshold), 64 - NAME_BITS
    names = ["doc_id", "th", "sid", "other", "n", "tokens", "more", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                sets = [shingles(t.as_py(), words) for t in part.column(2)]
                told = [set_names(s) if len(s) else (None, None) for s in sets]
                sid = pa.array([x if x is None else x >> drop for x, _ in told], pa.int64())
                cols = [sid, pa.array([y for _, y in told], pa.int64()), *_set_columns(sets, share, threshold)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, th long, sid long, other long, {_SETS}")


def distinct_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (shingle_sets) and one row of (sid and _SETS) for every different set, both checkpointed.

    Sets of one ``sid`` are the same only if ``other`` is too: where it is not, they get new names
    from both, until every name stands for one set. That is 128 bits for all, at the price of 64.
    """
    rows = checkpointed(rows)
    while True:
        named = rows.filter(F.col("sid").isNotNull()).groupBy("sid")
        sets = checkpointed(named.agg(*[F.first(c).alias(c) for c in ("n", "tokens", "more", "keys")], (F.min("other") != F.max("other")).alias("mixed")))
        mixed = sets.filter("mixed").select("sid", "mixed")
        if mixed.isEmpty():
            return rows, sets.drop("mixed")
        new = F.when(F.col("mixed"), F.xxhash64("sid", "other")).otherwise(F.col("sid"))
        rows = checkpointed(rows.join(mixed, "sid", "left").select(*[new.alias(c) if c == "sid" else c for c in rows.columns]))


def whole_sets(texts: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """(sid and _SETS, all tokens) of (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                cols = _set_columns([shingles(t.as_py(), words) for t in part.column(1)], 1.0, threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["sid", "n", "tokens", "more", "keys"])

    return texts.select("sid", "text").mapInArrow(run, f"sid long, {_SETS}")


def first_tokens(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(sid, n, keys, token, pos): the first tokens of every set that are first tokens of another one too.

    Order: counted tokens by (sets that have them, hash), then the others by hash; pos counts from 1.
    Tokens that only one set has come first and take up places, but lead nowhere and are left out.
    """
    num, den = threshold
    counted = sets.select("sid", F.explode("tokens").alias("token"))
    # Counts that are written first are dealt out for the join like the tokens are, so that the planner
    # can split a token that very many sets have.
    df = checkpointed(counted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1))
    common = counted.join(df, "token")
    lists = common.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
    need = F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}") + 1
    joined = sets.select("sid", "n", "keys", F.size("tokens").alias("a"), "more").join(lists, "sid", "left")
    own = F.col("a") - F.coalesce(F.size("common"), F.lit(0))
    room = F.greatest(F.lit(0), need - own).cast("int")
    some = F.when(F.col("common").isNull(), F.array().cast("array<long>")).otherwise(
        F.transform(F.slice("common", F.lit(1), room), lambda x: x["token"])
    )
    first = joined.select("sid", "n", "keys", own.alias("own"), F.posexplode(F.concat(some, "more")).alias("at", "token"))
    first = checkpointed(first.select("sid", "n", "keys", "token", (F.col("own") + F.col("at") + 1).alias("pos")))
    met = checkpointed(first.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("token"))
    return first.join(met, "token")


def qualifies(union: np.ndarray, query: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Whether the query shares enough with a group's token union to reach the threshold with any member.

    What it shares with a member is no more than that, and a member that shares k of the query's n
    tokens reaches num / den only if den * k >= num * n.
    """
    num, den = threshold
    at = np.searchsorted(union, query)
    shared = int((union[np.minimum(at, len(union) - 1)] == query).sum()) if len(union) else 0
    return den * shared >= num * len(query)


class GroupMatrix:
    """Token rows of one group: its sorted token union, and for every token the members that have it."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.array([len(m) for m in members], np.int64)
        tokens = np.concatenate(members) if members else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.union, begin = np.unique(tokens[order], return_index=True)
        self.begin = np.append(begin, len(tokens))
        self.owner = owner[order]

    def links(self, query: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
        """Members that reach the threshold with the query; none are counted if the union can't."""
        num, den = threshold
        if not qualifies(self.union, query, threshold):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.union, query)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == query]
        lo, hi = self.begin[at], self.begin[at + 1]
        runs = hi - lo
        pos = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        shared = np.bincount(self.owner[pos], minlength=len(self.sizes))
        return np.flatnonzero(den * shared >= num * (len(query) + self.sizes - shared))


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


LINK = "a long, b long"


def _link_members(words: int, threshold: tuple[int, int]):
    """Links inside a group: every member to the smallest one of its part."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("sid").to_pylist()
        sets = [shingles(t, words) for t in table.column("text").to_pylist()]
        m = GroupMatrix(sets)
        root = _roots(len(ids), ((k, int(j)) for k, s in enumerate(sets) for j in m.links(s, threshold) if j != k))
        pairs = [(ids[r], ids[k]) for k, r in enumerate(root) if r != k]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _tokens(table: pa.Table) -> list[np.ndarray]:
    return [np.array(x.as_py(), np.int64).view(np.uint64) for x in table.column("tokens")]


def _group_union(table: pa.Table) -> pa.Table:
    """(g, part, tokens): the token union of a part of a group, all that a query is asked about at first."""
    union = np.unique(np.concatenate(_tokens(table)))
    told = [table.column(c).slice(0, 1).combine_chunks() for c in ("g", "part")]
    return pa.table([*told, pa.array([union.view(np.int64)], pa.list_(pa.int64()))], names=["g", "part", "tokens"])


def _ask_union(threshold: tuple[int, int]):
    """(sid, g, part) of the queries for which the group has to be opened; the row without sid is its union."""

    def run(table: pa.Table) -> pa.Table:
        ids, sets = table.column("sid").to_pylist(), _tokens(table)
        union = sets[ids.index(None)]
        open_for = [k for k, sid in enumerate(ids) if sid is not None and qualifies(union, sets[k], threshold)]
        return table.select(["sid", "g", "part"]).take(pa.array(open_for, pa.int64()))

    return run


def _open_group(threshold: tuple[int, int]):
    """Links between the queries and the members of a group; a query's links to one part count once."""

    def run(table: pa.Table) -> pa.Table:
        ids, query, sets = table.column("sid").to_pylist(), table.column("query").to_pylist(), _tokens(table)
        own = [k for k, q in enumerate(query) if not q]
        m = GroupMatrix([sets[k] for k in own])
        pairs = []
        for k, q in enumerate(query):
            if q and len(found := m.links(sets[k], threshold)):
                pairs.append((ids[k], ids[own[int(found[0])]]))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _parts(size: str, tokens: str) -> Column:
    """In how many parts a group of so many sets with so many tokens in all is kept."""
    return F.greatest(F.ceil(F.col(size) / MEMBERS), F.ceil(F.col(tokens) / PART_TOKENS)).cast("int")


def _inner_links(first: DataFrame, texts: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Links inside groups of sets that share a min-hash: four partitions of the sets by likeness.

    A large group is dealt out in parts of about MEMBERS sets and PART_TOKENS tokens, each with the
    group's smallest set in it, so that parts of one kind join up.
    """
    keyed = first.select("sid", "n", "keys").dropDuplicates(["sid"]).select("sid", "n", F.posexplode("keys").alias("r", "key"))
    groups = keyed.groupBy("r", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"), F.min("sid").alias("leader"))
    groups = checkpointed(groups.filter("size > 1").withColumn("parts", _parts("size", "tokens")))
    members = keyed.join(groups, ["r", "key"])
    dealt = members.select("r", "key", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), "sid")
    leaders = groups.filter("parts > 1").select("r", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("sid"))
    rows = dealt.union(leaders).distinct().join(texts, "sid")
    return rows.groupBy("r", "key", "part").applyInArrow(_link_members(words, threshold), LINK)


def _outer_links(first: DataFrame, labels: DataFrame, texts: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between sets of different groups that share a first token: the queries.

    A group is kept in parts, and each part's token union is stored. A set asks a part only if a first
    token of both leaves room for the threshold: what they share begins at their first common token, so it
    can't be more than what either has from there on. It is asked of the union first, and only the parts
    whose union qualifies for some query are opened: their members are read for those queries alone.
    """
    num, den = threshold
    labelled = first.select("sid", "n", "token", "pos").join(labels, "sid", "left").withColumn("g", F.coalesce("label", "sid")).drop("label")
    labelled = checkpointed(labelled)
    sizes = labelled.select("sid", "n", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    sizes = checkpointed(sizes.select("g", "size", _parts("size", "tokens").alias("parts")))
    met = labelled.select("token", "g").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("gs")).filter("gs > 1")
    met = checkpointed(met.select("token"))
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    shared = labelled.join(met, "token").join(sizes, "g").withColumn("part", part)
    shared = checkpointed(shared.withColumn("rest", F.col("n") - F.col("pos") + 1))
    there = shared.groupBy("token", F.col("g").alias("to"), F.col("size").alias("to_size"), F.col("part").alias("to_part")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("most_rest")
    )
    # the smaller group's sets are the queries
    asks = shared.select("token", "sid", "n", "rest", "g", "size").join(there, "token").filter(
        (F.col("g") != F.col("to"))
        & (F.struct("size", "g") < F.struct(F.col("to_size"), F.col("to")))
        & (den * F.col("most") >= num * F.col("n"))
        & (num * F.col("least") <= den * F.col("n"))
        & ((num + den) * F.least("rest", "most_rest") >= num * (F.col("n") + F.col("least")))
    )
    asks = checkpointed(asks.select("sid", F.col("to").alias("g"), F.col("to_part").alias("part")).distinct())
    members = labelled.select("sid", "g").distinct().join(sizes, "g").select("g", part.alias("part"), "sid")
    members = checkpointed(members.join(asks.select("g", "part").distinct(), ["g", "part"]))
    wanted = asks.select("sid").union(members.select("sid")).distinct()
    sets = checkpointed(whole_sets(texts.join(wanted, "sid"), words, threshold).select("sid", "tokens"))

    unions = checkpointed(members.join(sets, "sid").groupBy("g", "part").applyInArrow(_group_union, "g long, part int, tokens array<long>"))
    asked, turns = _in_turns(asks)
    rows = asked.join(sets, "sid").select("g", "part", "turn", "sid", "tokens")
    rows = rows.union(unions.join(turns, ["g", "part"]).select("g", "part", "turn", F.lit(None).cast("long").alias("sid"), "tokens"))
    opened = checkpointed(rows.groupBy("g", "part", "turn").applyInArrow(_ask_union(threshold), "sid long, g long, part int"))

    asked, turns = _in_turns(opened)
    rows = asked.select("g", "part", "turn", "sid", F.lit(True).alias("query"))
    rows = rows.union(members.join(turns, ["g", "part"]).select("g", "part", "turn", "sid", F.lit(False).alias("query")))
    return rows.join(sets, "sid").groupBy("g", "part", "turn").applyInArrow(_open_group(threshold), LINK)


def _in_turns(asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries of (sid, g, part) with the turn in which they ask, at most about QUERIES in one; and all turns."""
    many = asks.groupBy("g", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))
    asked = asks.join(many, ["g", "part"]).select("g", "part", F.pmod(F.xxhash64("sid"), F.col("turns")).cast("int").alias("turn"), "sid")
    return asked, many.select("g", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))


def jaccard_components(docs: DataFrame, *, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, th, n_shingles, sid, root, component_id) of every row of (doc_id, text).

    Documents whose shingle sets have Jaccard similarity of at least ``threshold`` (a fraction, exact)
    are linked; component_id is the smallest doc_id that links reach. ``sid`` names the set (64 bits,
    sets of one name are told apart by 64 more),
    ``root`` the component (both null for documents without words, which link with nothing),
    ``th`` is the text's hash.

    Null text has no words. Equal texts, whatever their ids, are one set. Null ids never are a
    component's smallest unless it has no other. Repeated rows come out repeated; other columns are
    ignored. An empty table gives no rows.
    """
    rows, sampled_sets = distinct_sets(shingle_sets(docs.select("doc_id", "text"), words, threshold))
    some = rows.filter(F.col("sid").isNotNull())
    source = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("source")
    sets = some.groupBy("sid").agg(source)
    may_meet = first_tokens(sampled_sets, threshold).select("sid").distinct()
    wanted = checkpointed(may_meet.join(sets.select("sid", "source.doc_id", "source.th"), "sid"))
    with_hash = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text")
    same = with_hash["doc_id"].eqNullSafe(wanted["doc_id"]) & (with_hash["th"] == wanted["th"])
    # a broadcast only if its rows are few by count; else the documents move once
    few = wanted.count() <= BROADCAST_ROWS
    texts = checkpointed(
        with_hash.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), same).groupBy("sid").agg(F.first("text").alias("text"))
    )
    first = checkpointed(first_tokens(whole_sets(texts, words, threshold), threshold))
    inner = checkpointed(_inner_links(first, texts, words, threshold))
    labels = connected_components(inner).withColumnRenamed("node", "sid")
    outer = checkpointed(_outer_links(first, labels, texts, words, threshold))
    if not outer.isEmpty():
        labels = connected_components(inner.union(outer)).withColumnRenamed("node", "sid")
    named = sets.select("sid", "source.doc_id").join(labels, "sid", "left")
    named = named.select("sid", "doc_id", F.coalesce("label", "sid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = named.select("sid", "root").join(smallest, "root")
    found = some.select("doc_id", "th", "n", "sid").join(by_set, "sid").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), "sid", "root", "component_id"
    )
    alone = rows.filter(F.col("sid").isNull()).select(
        "doc_id", "th", F.col("n").alias("n_shingles"), "sid", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sim AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM sim JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.x, u.y FROM c JOIN u ON c.y = u.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.y) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN c ON c.x = d.doc_id GROUP BY d.doc_id
"""
