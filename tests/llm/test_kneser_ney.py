import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from onoma.llm import kneser_ney as kn

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(t):
    return [x.decode() for x in (t or "").translate(LOWER).encode().split()] + ["</s>"]


def slow(train, texts, order=3):
    """The textbook model: dictionaries of counts, one level after the other."""
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        ws = ["<s>", *toks(t)]
        for k in range(1, order + 1):
            grams[k].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    uni = {g[0]: c for g, c in grams[1].items() if g != ("<s>",)}
    N, V = sum(uni.values()), len(uni)
    value = {order: grams[order]}
    for k in range(order - 1, 0, -1):
        value[k] = Counter({g: c for g, c in grams[k].items() if g[0] == "<s>" and k > 1})
        value[k].update(g[1:] for g in grams[k + 1])
    after, total, d = {}, {}, {}
    for k in range(1, order + 1):
        n = Counter(value[k].values())
        d[k] = (0, *kn.discounts(n[1], n[2], n[3], n[4]))
        after[k], total[k] = defaultdict(Counter), Counter()
        for g, c in value[k].items():
            after[k][g[:-1]][min(c, 3)] += 1
            total[k][g[:-1]] += c

    def p(h, w, k):
        if k == 0:
            return 1 / (V + 1)
        if len(h) < k - 1:
            return p(h, w, k - 1)
        c = h[len(h) - k + 1 :]
        low = p(h, w, k - 1)
        if not total[k][c]:
            return low
        n = value[k][(*c, w)]
        return (n - d[k][min(n, 3)]) / total[k][c] + sum(d[k][j] * m for j, m in after[k][c].items()) / total[k][c] * low

    out = []
    for t in texts:
        ws = ["<s>", *toks(t)]
        out.append((
            len(ws) - 1, sum(uni.get(w, 0) > 0 for w in ws[1:]), sum(math.log10((uni.get(w, 0) + 1) / (N + V + 1)) for w in ws[1:]),
            sum(math.log10(p(tuple(ws[max(0, i - order + 1) : i]), ws[i], order)) for i in range(1, len(ws))),
        ))
    vocab = [*uni, "unknown!"]
    contexts = [("<s>",), *list(grams[order])[:15], *((w,) for w in list(uni)[:10] if w != "</s>"), ("unknown!", "w1")]
    sums = [sum(p(c[-(order - 1) :], w, order) for w in vocab) for c in contexts if c[-1] != "</s>"]
    return N, out, sums


def corpus():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(80)] + ["É", "日本", "The", "the"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    return [rng.choice([" ", "\n", " \x0b"]).join(rng.choices(vocab, weights, k=rng.choice([0, 1, 5, 60]))) for _ in range(150)] + [None, "", "new words here", "w1 " * 5000]


@pytest.mark.parametrize(("order", "shard_bytes", "hot"), [(2, 1 << 30, 10**9), (2, 500, 50), (3, 1 << 30, 10**9), (3, 500, 20), (3, 700, 0)])
def test_equals_textbook(spark, monkeypatch, order, shard_bytes, hot):
    monkeypatch.setattr(kn, "FOLD_TOKENS", 300)
    monkeypatch.setattr(kn, "BLOCK_TOKENS", 200)
    texts = corpus()
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(3, texts[3], 1.0)], "doc_id long, text string, score double").repartition(3)
    train = [t for k, t in enumerate(texts) if k % 7 != 2] + [texts[3]]
    model = kn.train(docs.filter("doc_id % 7 <> 2"), order, shard_bytes=shard_bytes, hot=hot)
    n, want, sums = slow(train, texts, order)
    assert model.n_tokens == n and all(abs(s - 1) < 1e-9 for s in sums)
    got = kn.score_documents(docs, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == w[:2] and math.isclose(r["base_score"], w[2], rel_tol=1e-9)
        assert math.isclose(r["score"], w[3], rel_tol=1e-9, abs_tol=1e-9) and r["perplexity"] >= 1


def test_query(spark, tmp_path):
    texts = corpus()
    rows = [*enumerate(texts), (None, "w1 w2")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = {d: crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows}
    n, want, _ = slow([t for d, t in rows if not held[d]], [t for _, t in rows])
    out = {r["doc_id"]: r for r in kn.op5_kneser_ney(spark, str(tmp_path)).collect()}
    for (d, _), w in zip(rows, want, strict=True):
        r = out[d]
        assert (r["held_out"], r["train_tokens"], r["n_tokens"], r["n_known"]) == (held[d], n, *w[:2])
        assert math.isclose(r["base_score"], w[2], rel_tol=1e-9) and math.isclose(r["score"], w[3], rel_tol=1e-9)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = kn.score_documents(one, kn.train(none)).collect()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (3, 0, 0.0, 0.0)
    assert kn.score_documents(none, kn.train(one)).count() == 0


def test_packed_arrays():
    rng = random.Random(1)
    keys = np.array(sorted({rng.getrandbits(61) for _ in range(5000)}), np.uint64)
    keys = np.concatenate([keys, keys[:50] ^ np.uint64(1 << 25)])  # the same first 32 bits
    counts = [np.array([rng.choice([1, 2, 254, 255, 256, 10**12]) for _ in keys]) for _ in range(2)]
    raw = lambda parts: np.frombuffer(b"".join(parts), np.uint8)
    got = kn.Packed(raw(kn.packed(keys, counts, 3)), 3)
    assert all((x == y).all() for x, y in zip(got.find(keys), counts, strict=True))
    other = np.array([rng.getrandbits(61) for _ in range(1000)], np.uint64)
    assert not got.find(other)[0].any()
    none = kn.Packed(raw(kn.packed(keys[:0], [counts[0][:0]], 3)), 3)
    assert none.n == 0
    after = [np.array([rng.choice([0, 1, 3, 4, 62, 63, 300, 10**10]) for _ in keys]) for _ in range(4)]
    after[0] = np.where((after[1] < 63) & (after[2] < 4) & (after[3] == 0), after[1] + 2 * after[2], after[0])
    found = kn.PackedAfter(raw(kn.packed_after(keys, after, 3)), 3)
    assert all((x == y).all() for x, y in zip(found.find(keys), after, strict=True)) and not any(x.any() for x in found.find(other))


def test_order(spark):
    with pytest.raises(ValueError, match="order"):
        kn.train(spark.createDataFrame([], "text string"), 4)


def test_tokens_of_long_texts(monkeypatch):
    text = "The the\x0bÉ  " + "word " * 50 + "x" * 90 + " Tail\ttail y" + "Z" * 90
    short = kn.tokens(text).tolist()
    assert len(short) == 58 and short[-1] == kn.END and short[0] == short[1] and short[54] == short[55] and len(set(short)) == 7
    monkeypatch.setattr(kn, "MOST_BYTES", 64)
    pieces = kn.tokens(text).tolist()
    # all but the two long words have the hashes that they have in one piece
    assert [k for k in range(58) if pieces[k] != short[k]] == [53, 56] and len(set(pieces)) == 7
    assert pieces[53] == kn.tokens("X" * 90)[0]


def test_hashes_are_different():
    words = {f"{a}{b}" for a in range(300) for b in ("", "a", "b", "ab", "ba", "é")} | {"a" * k for k in range(1, 200)} | {"ab" * k + "ba" * j for k in range(9) for j in range(1, 9)}
    assert len(set(kn.tokens(" ".join(sorted(words))).tolist())) == len(words) + 1
