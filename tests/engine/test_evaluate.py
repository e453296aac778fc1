import math
import random

import pytest

from onoma.operators import evaluate as ev


def table(spark, sets):
    rows = [(k, float(s), y, n) for k, (scores, labels) in sets.items() for n, (s, y) in enumerate(zip(scores, labels, strict=True))]
    return spark.createDataFrame(rows, "algorithm string, score double, label int, ord int")


def by(df):
    return {r["algorithm"]: r for r in df.collect()}


GOLD = {
    "a": ([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0]), "ties": ([0.5] * 4, [1, 0, 0, 0]), "half": ([0.5] * 4, [1, 1, 0, 0]), "mixed": ([0.9, 0.4, 0.3, 0.1], [1, 0, 1, 0]),
    "two": ([0.5, 0.5], [1, 0]), "miss": ([0.9, 0.5], [0, 1]), "neg": ([0.3, 0.7], [0, 0]), "pos": ([0.3, 0.7], [1, 1]),
}


def test_goldens(spark):
    long = table(spark, GOLD)
    at = ev.curve(long)
    g = ev.grid(at)
    best = by(ev.operating_points(g))
    assert (best["a"]["tp"], best["a"]["fp"], best["a"]["fn"], best["a"]["tn"]) == (2, 0, 0, 2)
    reject = by(ev.operating_points(g, fp_cost=25, fn_cost=1))["ties"]
    assert (reject["tp"], reject["fp"], reject["tn"], reject["fn"]) == (0, 0, 3, 1) and reject["threshold"] > 0.5
    roc, pr = by(ev.roc_auc(at)), by(ev.pr_auc(at))
    assert (roc["a"]["roc_auc"], roc["half"]["roc_auc"], roc["mixed"]["roc_auc"], roc["neg"]["roc_auc"], roc["pos"]["roc_auc"]) == (1, 0.5, 0.75, 0.5, 0.5)
    assert (pr["a"]["pr_auc"], pr["half"]["pr_auc"], pr["neg"]["pr_auc"]) == (1, 0.5, 0)
    zero = by(ev.with_metrics(ev.zero_fp_points(at)))
    assert (zero["a"]["tp"], zero["a"]["fp"]) == (2, 0) and zero["two"]["threshold"] > 0.5 and zero["two"]["cost_per_pair"] == 12.5
    level = {(r["algorithm"], r["level"]): r["precision"] for r in ev.precision_at_recall(at, (0.0, 0.5, 0.9)).collect()}
    assert level["a", 0.9] == 1 and level["half", 0.5] == 0.5 and level["neg", 0.5] == 0 and level["a", 0.0] == 0
    high = by(ev.high_precision_points(g))
    assert high["a"]["target_met"] and not high["miss"]["target_met"]
    two = by(ev.confusion_at(table(spark, {"x": ([0.9, 0.5, 0.1], [1, 1, 0])}), 0.51))["x"]
    assert (two["tp"], two["fp"], two["fn"], two["tn"]) == (1, 0, 1, 1)


def naive_points(scores, labels):
    d = sorted(set(scores))
    ts = [d[0], *((a + b) / 2 for a, b in zip(d, d[1:], strict=False)), d[-1], math.nextafter(d[-1], math.inf)]
    for t in ts:
        yes = [s >= t for s in scores]
        tp, fp = sum(y and lab for y, lab in zip(yes, labels, strict=True)), sum(y and not lab for y, lab in zip(yes, labels, strict=True))
        yield t, tp, fp, len(labels) - sum(labels) - fp, sum(labels) - tp


def test_cheapest_is_the_exhaustive_cheapest(spark):
    rng = random.Random(1)
    sets = {}
    for k in range(30):
        n = rng.randint(2, 25)
        sets[f"s{k}"] = ([rng.choice([rng.random(), 0.5, 0.25]) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)])
    sets["near"] = ([0.1, math.nextafter(0.1, 1), 0.9], [0, 1, 1])
    at = ev.curve(table(spark, sets))
    g = ev.grid(at)
    for fp_cost, fn_cost in ((1, 25), (25, 1), (1, 1)):
        got = by(ev.operating_points(g, fp_cost=fp_cost, fn_cost=fn_cost))
        for k, (scores, labels) in sets.items():
            want = min(naive_points(scores, labels), key=lambda p: (p[2] * fp_cost + p[4] * fn_cost, p[2], -p[0]))
            assert tuple(got[k][c] for c in ev.POINT) == want, k
    matched = by(ev.points_at_recall(g))
    fn0 = by(ev.zero_fn_points(at))
    for k, (scores, labels) in sets.items():
        points = list(naive_points(scores, labels))
        if sum(labels):
            ok = [p for p in points[:-1] if p[1] / sum(labels) + 1e-9 >= 0.9]
            low = min(p[1] for p in ok)
            assert tuple(matched[k][c] for c in ev.POINT) == min((p for p in ok if p[1] == low), key=lambda p: (p[2] + 25 * p[4], p[2], -p[0]))
            assert fn0[k]["threshold"] == min(s for s, y in zip(scores, labels, strict=True) if y)
    rows = {k: [] for k in sets}
    for r in ev.precision_at_recall(at, (0.1, 0.5, 0.9, 1.0)).orderBy("level").collect():
        rows[r["algorithm"]].append(r["precision"])
    assert all(v == sorted(v, reverse=True) for v in rows.values())


def test_bands_partition(spark):
    rng = random.Random(2)
    sets = {f"s{k}": ([rng.random() for _ in range(40)], [rng.randint(0, 1) for _ in range(40)]) for k in range(5)}
    long = table(spark, sets)
    got = ev.three_bands(long, 0.3, 0.6).groupBy("algorithm").sum("n").collect()
    assert {r[1] for r in got} == {40}
    rep = by(ev.band_report(ev.curve(long), ev.grid(ev.curve(long))))
    assert all(r["reject_below"] <= r["approve_at_or_above"] for r in rep.values())
    with pytest.raises(ValueError, match="low"):
        ev.three_bands(long, 0.7, 0.3)


@pytest.mark.parametrize("bad", [(float("nan"), 1), (float("inf"), 0), (0.5, 2)])
def test_bad_rows_are_refused(spark, bad):
    with pytest.raises(ValueError, match="finite"):
        ev.validate(table(spark, {"x": ([0.1, bad[0]], [0, bad[1]])}))


def test_reversals(spark):
    rows = [(c, k, v) for c, d in enumerate([{"a": 0.5, "b": 0.1, "c": 0.4}, {"a": 0.5, "b": 0.4, "c": 0.1}]) for k, v in d.items()]
    df = spark.createDataFrame(rows, "condition int, algorithm string, value double")
    assert {r[0] for r in ev.reversals(df).collect()} == {"b", "c"}
    ties = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.4), (1, "a", 0.5), (1, "b", 0.5)], "condition int, algorithm string, value double")
    assert ev.reversals(ties).isEmpty()


def test_bootstraps_agree(spark):
    rng = random.Random(4)
    rows = [(k, rng.random(), rng.random(), rng.randint(0, 1)) for k in range(300)]
    df = spark.createDataFrame(rows, "ord int, score_a double, score_b double, label int")
    one, two = ev.bootstrap_as_published(df, 0.5, 0.4, rounds=400), ev.bootstrap_cost_delta(df, 0.5, 0.4, rounds=400)
    assert abs(one["mean_delta"] - two["mean_delta"]) < 0.3 and abs(one["ci_low"] - two["ci_low"]) < 0.6
    assert two == ev.bootstrap_cost_delta(df.repartition(5), 0.5, 0.4, rounds=400)
    for draw in (ev.bootstrap_as_published, ev.bootstrap_cost_delta):
        with pytest.raises(ValueError, match="positive"):
            draw(df, 0.5, 0.5, rounds=0)
        assert draw(df.limit(0), 0.5, 0.5) == ev.NO_ROWS


def test_curve_in_ranges_is_the_curve(spark):
    rng = random.Random(7)
    sets = {f"s{k}": ([rng.choice([rng.random(), 0.5]) for _ in range(60)], [rng.randint(0, 1) for _ in range(60)]) for k in range(4)}
    sets["one"] = ([0.25], [1])
    long = table(spark, sets)
    rows = lambda n: sorted(map(tuple, ev.curve(long, buckets=n).collect()), key=repr)
    want = rows(1)
    assert rows(3) == want and rows(40) == want
    for k, score, _, _, tp, fp, tn, fn, below, pos_below, _, above in want:
        scores, labels = sets[k]
        assert (tp, fp) == tuple(sum(s >= score and y == v for s, y in zip(scores, labels, strict=True)) for v in (1, 0))
        assert tp + fn == sum(labels) and fp + tn == len(labels) - sum(labels)
        assert below == max((s for s in scores if s < score), default=None) and above == min((s for s in scores if s > score), default=None)
        assert below is None or pos_below == sum(y for s, y in zip(scores, labels, strict=True) if s == below)


def test_curve_of_nothing(spark):
    assert ev.curve(table(spark, {})).isEmpty() and ev.grid(ev.curve(table(spark, {}))).isEmpty()
