import itertools

import numpy as np

from onoma.llm import quality_crf as q

GOOD = "The rest of the story went on as before, calm and slow.\nNobody knew why it had begun at all.\nIt ended."
BAD = "BUY!! NOW!! CHEAP!! ### $$$ %%% &&&\nclick click click click click click\n| a | b | c | d"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2))
    unary = [rng.normal(size=n) * 2 for n in (1, 2, 5, 7, 3)]
    got, log_z, pairs = q.forward_backward(unary, trans)
    for k, u in enumerate(unary):
        total, ones, pair = 0.0, np.zeros(len(u)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(u)):
            w = np.exp(sum(u[i] for i, v in enumerate(y) if v) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            total += w
            ones += w * np.array(y)
            for a, b in itertools.pairwise(y):
                pair[a, b] += w
        assert np.allclose(got[k], ones / total) and np.isclose(log_z[k], np.log(total)) and np.allclose(pairs[k], pair / total)


def test_equal_texts_score_alike_in_any_batch():
    rng = np.random.default_rng(1)
    f = q.LineField(rng.normal(size=len(q.FEATURES)), rng.normal(size=(2, 2)), np.zeros(len(q.FEATURES)), np.ones(len(q.FEATURES)))
    texts = [GOOD, BAD, "", GOOD + "\n" + BAD, "x" * 100_000, "a b\n" * 3000]
    alone = [f.score([t])[0] for t in texts]
    assert np.allclose(alone, f.score(texts), atol=1e-12) and all(0 <= s <= 1 for s in alone)


def test_query(spark, tmp_path):
    texts = [(n, (GOOD if n % 3 else BAD) + f"\nmore of {n}") for n in range(300)]
    rows = texts + [(300, None), (301, ""), (None, GOOD), (1, texts[1][1]), (1, "second row of an id")]
    spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(n, int(n % 3 > 0)) for n in range(300)] + [(7, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    out = q.op4_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    field = q.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in q.score_quality(docs, field).collect()] == [0.5, 0.5]
    assert q.score_quality(docs.limit(0), field).count() == 0
