import random
import re

import numpy as np
import pytest

from onoma.llm import decontaminate as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def slow(text, items):
    ws, hit, found = words(text), set(), set()
    for name, t in items:
        b = words(t)
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add("" if name is None else str(name))
    return len(ws), len(hit), ",".join(sorted(found))


def corpus():
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(60)] + ["É", "ü1", "日本"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([10, 11, 25])))) for k in range(12)]
    items += [(12, "v1, V2; v3"), (13, None), (14, "..."), (15, "É"), (3, "v5 " * 30), (None, items[4][1]), (16, items[4][1])]
    docs = [(None, None), (1, ""), (2, "?!"), (3, "v5 " * 50), (4, "v1.v2-v3 É")]
    for k in range(5, 90):
        ws = rng.choices(vocab, k=rng.choice([3, 9, 60]))
        b = words(rng.choice(items)[1])
        at = rng.randrange(len(ws))
        ws[at:at] = b[rng.choice([0, 0, 3]) : len(b) - rng.choice([0, 0, 2])]
        docs.append((k, rng.choice([" ", "\n", ", "]).join(ws).upper() if k % 3 else "/".join(ws)))
    return docs + [docs[9], docs[9]], items


@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 60])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "SHARD_BYTES", 500)
    docs, items = corpus()
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, hit_items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_contamination(table, bench, block_bytes=block).collect()
    got = sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hit_ranges"]), ",".join(r["hit_items"])) for r in found), key=repr)
    assert got == sorted(((i, *slow(t, items)) for i, t in docs), key=repr)
    clean = d.remove_contaminated(table, bench)
    assert clean.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in clean.collect()) == sorted(i or -1 for i, t in docs if not slow(t, items)[1])


def slow_matches(text, items):
    """Matches of a window at least that can't be lengthened, found by trying every pair of places."""
    ws, out = words(text), []
    for name, t in items:
        b = words(t)
        n = min(10, len(b))
        same = {(i, k) for i in range(len(b)) for k in range(len(ws)) if b[i] == ws[k]}
        for i, k in sorted(same):
            if (i - 1, k - 1) not in same:
                length = 1
                while (i + length, k + length) in same:
                    length += 1
                if length >= n > 0:
                    out.append(("" if name is None else str(name), i, k, length))
    return sorted(out)


@pytest.mark.parametrize("block", [d.BLOCK_BYTES, 60])
def test_longest_matches(spark, block):
    docs, items = corpus()
    # a text that repeats a word longer than the window matches on every diagonal
    found = d.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = sorted(((r["doc_id"], [tuple(m) for m in r["matches"]]) for r in found.collect()), key=repr)
    assert got == sorted(((i, slow_matches(t, items)) for i, t in docs), key=repr)


def test_matches_of_one_text():
    text, item = b"a b c d e f g h i j k l x a b c d e f g h i j", b"z a b c d e f g h i j k l m"
    block = d.build_block([("", item), ("s", b"k l")])
    assert d.search_shard([d.words_of(text), [], d.words_of(b"k l")], block) == [[(0, 1, 0, 12), (0, 1, 13, 10), (1, 0, 10, 2)], [], [(1, 0, 0, 2)]]


def test_very_long_text(spark):
    rng = random.Random(3)
    item = " ".join(f"q{k}" for k in range(40))
    long = [f"w{rng.randrange(500)}" for _ in range(400_000)]
    long[300_000:300_000] = item.split()
    docs = spark.createDataFrame([(1, " ".join(long)), (2, "q5 " * 100_000), (3, " ".join(long[:1000]))], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in d.find_contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: [("7", 0, 300_000, 40)], 2: [], 3: []}


def test_suffix_order():
    ids = np.array([3, 1, 256, 1, 65536, 1, 256, 0, 0], np.int32)
    a = d.SuffixArray(ids, np.arange(7), 2)
    assert [tuple(ids[s : s + 2]) for s in a.starts] == sorted(tuple(ids[s : s + 2]) for s in range(7))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert d.find_contamination(none, bench).count() == 0
    (r,) = d.find_contamination(one, bench).collect()
    assert (r["n_words"], r["matches"], r["hit_ranges"], r["hit_items"]) == (2, [], [], [])
