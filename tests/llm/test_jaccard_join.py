import itertools
import random

import numpy as np
import pytest

from onoma.llm import jaccard_join as j
from onoma.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_sets(rows, words):
    out = []
    for _, t in rows:
        ws = (t or "").translate(LOWER).encode().split()
        out.append({tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set())
    return out


def slow(rows, words, threshold):
    sets, root = slow_sets(rows, words), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        k = len(sets[a] & sets[b])
        if sets[a] and sets[b] and threshold[1] * k >= threshold[0] * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for x, (d, _) in enumerate(rows):
        r = find(x)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[x]), least.get(find(x))) for x, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choices(vocab, k=30))
    texts = [None, "", " \n\t", "one", "One", "one two", "one two", "ONE two\x0bthree", "é É"]
    while len(texts) < n:
        base = rng.choices(vocab, k=rng.choice([3, 4, 12, 40, 90, 200]))
        for _ in range(rng.choice([1, 1, 1, 2, 6, 25])):
            ws = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(ws))
                ws[at : at + rng.choice([0, 1])] = rng.choices(vocab, k=rng.choice([0, 1]))
            texts.append((common + "\n" if rng.random() < 0.4 else "") + " ".join(ws))
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[7], (rows[9][0], "another row of the id"), (None, texts[11]), (None, "all alone here now")]


@pytest.mark.parametrize(("words", "threshold", "members"), [(3, (90, 100), 192), (5, (80, 100), 4), (2, (50, 100), 3)])
def test_equals_all_pairs(spark, monkeypatch, words, threshold, members):
    monkeypatch.setattr(j, "MEMBERS", members)
    monkeypatch.setattr(j, "QUERIES", members)
    rows = corpus(words)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sid string, n int").repartition(5)
    got = j.jaccard_components(docs, words=words, threshold=threshold)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == slow(rows, words, threshold)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(700):
        ws = list(base)
        ws[rng.randrange(150)] = f"edit{k}"
        rows.append((k, " ".join(ws)))
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_empty_table(spark):
    assert j.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 100), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 200: 200, 201: 200}


def test_components_of_long_chains_with_shuffled_ids(spark):
    ids = list(range(4000))
    random.Random(7).shuffle(ids)
    links = [*itertools.pairwise(ids[:3000]), *itertools.pairwise(ids[3000:])]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids[:3000], min(ids[:3000])), **dict.fromkeys(ids[3000:], min(ids[3000:]))}


@pytest.mark.parametrize(("bits", "tokens"), [(5, 4_000_000), (64, 100)])
def test_colliding_names_and_small_parts(spark, monkeypatch, bits, tokens):
    """32 names for all sets; parts of very few tokens."""
    monkeypatch.setattr(j, "NAME_BITS", bits)
    monkeypatch.setattr(j, "PART_TOKENS", tokens)
    rows = corpus(5, 150)
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=(80, 100))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == slow(rows, 3, (80, 100))


def test_union_bound_never_shuts_a_group_that_links():
    rng = random.Random(2)
    shut = 0
    for _ in range(300):
        base = rng.sample(range(1000), 40)
        members = [np.unique(np.array([x for x in base if rng.random() < 0.95] + rng.sample(range(1000), 2), np.uint64)) for _ in range(5)]
        query = np.unique(np.array([x for x in base if rng.random() < 0.97] + rng.sample(range(2000, 3000), rng.choice([0, 1, 20])), np.uint64))
        want = [k for k, m in enumerate(members) if 10 * len(np.intersect1d(m, query)) >= 8 * len(np.union1d(m, query))]
        matrix = j.GroupMatrix(members)
        assert matrix.links(query, (8, 10)).tolist() == want
        if not j.qualifies(matrix.union, query, (8, 10)):
            shut += 1
            assert not want
    assert shut


def test_very_long_text(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(100_000)}" for _ in range(200_000)]
    near = list(long)
    for k in range(0, len(near), 400):
        near[k] = "changed"
    rows = [(3, " ".join(long)), (1, " ".join(near)), (2, " ".join(long[:1000])), (4, "x " * 300_000), (5, "x x x")]
    got = j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=(90, 100))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 3: 1, 2: 2, 4: 4, 5: 4}
