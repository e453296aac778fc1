import json
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from onoma.operators import model as md
from onoma.operators.features import FEATURES
from onoma.plans import cli, dataset, jobs, report
from onoma.sources.pairs_csv import read_pairs, write_pairs, write_pairs_distributed
from onoma.sources.strict_json import plain
from onoma.streaming.scorer import score_stream, write_scores


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(dataset.labelled_pairs(spark).collect(), dataset.PAIR_SCHEMA).cache()


@pytest.fixture(scope="module")
def analysis(pairs):
    return jobs.analyse(pairs)


def rows(n=60, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)


def test_fit_and_its_refusals():
    x, y = rows()
    m = md.fit_arrays(x, y, ["a", "b", "c"])
    assert m.weights[0] > 1 and m.n_train == 60 and m.final_loss < math.log(2)
    z, _, stds = md.standardised(np.array([[1.0, 2.0], [1.0, 4.0]]))
    assert stds[0] == 1 and z[0, 0] == 0
    for bad in ((np.zeros((0, 2)), []), (x, y[:-1]), (np.full((2, 2), np.nan), [0, 1]), (x, y * 2)):
        with pytest.raises(ValueError):  # noqa: PT011
            md.fit_arrays(*bad)
    with pytest.raises(ValueError, match="names"):
        md.fit_arrays(x, y, ["a"])


def test_files(tmp_path):
    x, y = rows()
    m = md.fit_arrays(x, y, ["a", "b", "c"])
    path = m.save(str(tmp_path / "deep" / "m.json"))
    assert md.LogisticModel.load(path, ["a", "b", "c"]) == m
    with pytest.raises(ValueError, match="order"):
        md.LogisticModel.load(path, ["b", "a", "c"])
    body = json.loads(open(path).read())
    for change in ({"stds": [1, 0, 1]}, {"means": [1]}, {"weights": "x"}, {"bias": None}, {"feature_names": [1, 2, 3]}):
        (tmp_path / "bad.json").write_text(json.dumps({**body, **change}))
        with pytest.raises(ValueError, match="corrupt"):
            md.LogisticModel.load(str(tmp_path / "bad.json"))
    (tmp_path / "bad.json").write_text(json.dumps({k: v for k, v in body.items() if k != "l2"}))
    with pytest.raises(ValueError, match="missing"):
        md.LogisticModel.load(str(tmp_path / "bad.json"))
    assert plain({"a": [float("nan"), 1.5, (float("inf"),)]}) == {"a": [None, 1.5, [None]]}


def test_unfitted_and_stale(spark):
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        spark.range(1).select(md.LogisticModel.unfitted().probability([F.lit(1.0)]))
    assert any("not fitted" in str(x.message) for x in w)
    with pytest.raises(ValueError, match="stale"):
        md.LogisticModel([1.0], 0.0, [0.0], [1.0], ["a"]).probability([])


def test_folds(spark):
    df = md.numbered(spark.range(11).withColumnRenamed("id", "k"), "k")
    got = md.with_folds(df, 5)
    assert sorted((r["k"], r["fold"]) for r in got.collect()) == [(k, k % 5) for k in range(11)]
    for n, k in ((0, 5), (1, 1), (4, 5), (10, 0)):
        with pytest.raises(ValueError, match="folds"):
            md.with_folds(md.numbered(spark.range(n).withColumnRenamed("id", "k"), "k"), k)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_numbers_by_range(spark, ranges):
    words = [f"w{k:03d}" for k in range(40)] + ["w007"] * 9 + [None] * 3
    df = spark.createDataFrame([(w,) for w in words], "k string").repartition(5)
    got = sorted(md.numbered(df, "k", ranges).collect(), key=lambda r: r["ord"])
    assert [r["ord"] for r in got] == list(range(len(words)))
    assert [r["k"] for r in got] == sorted(words, key=lambda w: (w is not None, w or ""))
    assert md.numbered(df.limit(0), "k", ranges).isEmpty()


def test_newton_finds_what_descent_finds(spark):
    x, y = rows(200, 3)
    x = np.column_stack([x, np.ones(200)])
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), int(v), k % 4) for k, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, d double, label int, fold int").repartition(3)
    (one,) = md.fit_newton(df, names)
    exact = md.fit_arrays(x, y, names)
    assert np.allclose(exact.weights, one.weights, atol=1e-4) and abs(exact.bias - one.bias) < 1e-4 and abs(exact.final_loss - one.final_loss) < 1e-6
    assert np.allclose(exact.means, one.means) and np.allclose(exact.stds, one.stds) and one.n_train == 200
    plans = [md.Plan(1), md.Plan(2, "b")]
    own = [np.arange(200) % 4 != 1, np.arange(200) % 4 != 2]
    for m, keep, cols in zip(md.fit_newton(df, names, plans), own, ([0, 1, 2, 3], [0, 2, 3]), strict=True):
        want = md.fit_arrays(x[keep][:, cols], y[keep])
        assert np.allclose(want.weights, m.weights, atol=1e-4) and np.allclose(want.stds, m.stds) and m.n_train == keep.sum()
    few = md.with_folds(md.numbered(df.withColumn("k", F.monotonically_increasing_id()).drop("fold"), "k"), 4)
    both = few.select("ord").join(md.cross_validated_at_scale(few, names, 4).select("ord", "learned"), "ord").join(md.cross_validated(few, names, 4).withColumnRenamed("learned", "want").select("ord", "want"), "ord")
    assert all(abs(r["learned"] - r["want"]) < 1e-4 for r in both.collect())
    masked = lambda t: {(r["mask"], r["ord"]): r["score"] for r in t.collect()}
    a, b = masked(md.ablation_at_scale(few, names, 4)), masked(md.ablation_scores(few, names, 4))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 for k in a)
    with pytest.raises(ValueError, match="no rows"):
        md.fit_newton(df.limit(0), names)


def test_probability_needs_finite_features(spark):
    m = md.LogisticModel([1.0, 1.0], 0.0, [0.0, 0.0], [1.0, 1.0], ["a", "b"])
    assert spark.range(1).select(m.probability([F.lit(0.0), F.lit(0.0)]).alias("p")).first()["p"] == 0.5
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="finite"):
            spark.createDataFrame([(1.0, bad)], "a double, b double").select(m.probability([F.col("a"), F.col("b")]).alias("p")).collect()


def test_fit_at_scale_finds_the_same_optimum(spark):
    x, y = rows(200, 3)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, label int")
    exact, large = md.fit_arrays(x, y, ["a", "b", "c"]), md.fit_at_scale(df, ["a", "b", "c"])
    assert np.allclose(exact.weights, large.weights, atol=1e-4) and abs(exact.bias - large.bias) < 1e-4 and abs(exact.final_loss - large.final_loss) < 1e-5


def test_pair_set(spark, pairs):
    assert (pairs.count(), pairs.filter("label = 1").count()) == (494, 140)
    assert dataset.integrity(pairs).isEmpty() and dataset.distinct_people(pairs).first()[0] == 91
    broken = pairs.union(pairs.limit(1)).withColumn("label", F.lit(1))
    assert {r["rule"] for r in dataset.integrity(broken).collect()} == {"same pair twice", "label and identity disagree"}
    siblings = pairs.filter("category like '%sibling%'").collect()
    people = {p["person_id"]: p for p in dataset.people()}
    assert all(people[r["person_a"]]["father"] == people[r["person_b"]]["father"] for r in siblings)
    assert all(r["name_a"] == r["name_b"] and r["person_a"] != r["person_b"] for r in pairs.filter("category like '%identical%'").collect())
    assert [r["pair_id"] for r in pairs.orderBy("pair_id").collect()] == [f"N{k:04d}" for k in range(1, 495)]


PUBLISHED = {  # cost per pair, fp, fn, PR area, ROC area, threshold
    "learned": (0.174, 61, 1, 0.895, 0.964, 0.092), "token_aligned": (0.397, 71, 5, 0.801, 0.925, 0.530), "phonetic_jaro": (0.421, 83, 5, 0.824, 0.931, 0.717),
    "exact_normalized": (0.717, 354, 0, 0.544, 0.722, 0.0), "token_jaccard": (0.717, 354, 0, 0.706, 0.865, 0.0),
}


def test_published_numbers(analysis):
    areas = {r["algorithm"]: r for r in analysis.tables["areas"]}
    for k, (cost, fp, fn, pr, roc, t) in PUBLISHED.items():
        p = analysis.points[k]
        assert (round(p["cost_per_pair"], 3), p["fp"], p["fn"], round(areas[k]["pr_auc"], 3), round(areas[k]["roc_auc"], 3)) == (cost, fp, fn, pr, roc)
        assert abs(p["threshold"] - t) < 6e-4
    b = analysis.bootstrap
    assert (round(b["mean_delta"], 4), round(b["ci_low"], 4), round(b["ci_high"], 4), b["p_a_cheaper"]) == (0.2227, -0.0102, 0.4777, 0.9715)
    assert [round(x, 4) for x in analysis.fold_losses] == [0.1738, 0.1896, 0.1702, 0.1908, 0.1835] and round(analysis.model.final_loss, 4) == 0.1835
    level = {(r["algorithm"], r["level"]): round(r["precision"], 3) for r in analysis.tables["precision_at_recall"]}
    assert [level["learned", x] for x in (0.5, 0.7, 0.9, 0.95, 0.99)] == [0.850, 0.845, 0.838, 0.836, 0.695]
    bands = {(r["algorithm"], r["band"]): r["n"] for r in analysis.tables["band_sizes"]}
    assert [bands["learned", x] for x in ("approve", "review", "reject")] == [40, 199, 255]
    at = {r["algorithm"]: r for r in analysis.tables["at_recall_floor"]}
    for k, r in at.items():
        assert sum(c[f"{k}_fp"] for c in analysis.tables["categories"]) == r["fp"]
    sweep = {(r["algorithm"], r["ratio"]): round(r["cost_per_pair"], 3) for r in analysis.tables["sweep"]}
    assert [sweep["phonetic_jaro", x] for x in (1, 3, 5, 10, 25, 50, 100)] == [0.107, 0.158, 0.200, 0.269, 0.421, 0.628, 0.688]


def test_published_weights(analysis):
    w = dict(analysis.model.coefficients())
    assert w["jaro_winkler_ordered"] != w["char_signal"] == w["jaro_winkler_sorted"] and abs(w["char_signal"] - 0.22999298634932275) < 1e-9


def test_ablation(pairs):
    got = jobs.ablation(pairs)
    assert round(got[0]["cost_per_pair"] * 494) == 86 and (got[1]["feature"], round(got[1]["delta"], 3)) == ("token_dice", 0.038)
    assert (got[-1]["feature"], round(got[-1]["delta"], 3)) == ("length_ratio", -0.026)
    assert "token_dice" in report.ablation_markdown(got)


def test_report(analysis):
    text = report.markdown(analysis)
    assert "0.174" in text and "hard_negative_sibling" in text and "n/a" in text
    json.dumps(plain(report.payload(analysis)), allow_nan=False)


def test_csv(spark, pairs, tmp_path):
    path = write_pairs(pairs, str(tmp_path / "x" / "pairs.csv"))
    back = read_pairs(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pairs.collect()))
    assert open(path).read().startswith("#")
    odd = spark.createDataFrame([("N0001", 'a "b", c', "line\nbreak", 1, "p", "p", "x", "easy", "r")], dataset.PAIR_SCHEMA)
    assert [tuple(r) for r in read_pairs(spark, write_pairs(odd, str(tmp_path / "odd.csv"))).collect()] == [tuple(r) for r in odd.collect()]
    write_pairs_distributed(pairs, str(tmp_path / "many"))
    assert read_pairs(spark, str(tmp_path / "many")).count() == 494


def test_command_line(spark, tmp_path, capsys):
    data, model = str(tmp_path / "p.csv"), str(tmp_path / "m.json")
    assert cli.parse(["--data", data, "train"]).data == cli.parse(["train", "--data", data]).data == data
    assert cli.main(["generate", "--data", data]) == 0 and cli.main(["train", "--data", data, "--model", model]) == 0
    assert cli.load_model(model).n_train == 494 and "bigram_jaccard" in capsys.readouterr().out
    empty = write_pairs(spark.createDataFrame([], dataset.PAIR_SCHEMA), str(tmp_path / "none.csv"))
    with pytest.raises(SystemExit):
        cli.main(["train", "--data", empty])


def test_whole_command_line(tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    options = ["--data", at("p.csv"), "--model", at("m.json"), "--json", at("r.json"), "--markdown", at("r.md")]
    assert cli.main(["all", *options]) == 0
    told = capsys.readouterr().out
    assert "learned" in told and "wrote" in told
    body = json.loads(open(at("r.json")).read())
    assert round(body["algorithms"]["learned"]["cost_per_pair"], 3) == 0.174 and "0.174" in open(at("r.md")).read()
    assert cli.main(["ablate", "--data", at("p.csv"), "--json", at("a.json"), "--markdown", at("a.md")]) == 0
    assert json.loads(open(at("a.json")).read())[1]["feature"] == "token_dice" and "token_dice" in open(at("a.md")).read()


def test_stream_scores_like_the_table(spark, pairs, tmp_path, analysis):
    few = pairs.select("pair_id", "name_a", "name_b")
    few.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(few.schema).parquet(str(tmp_path / "in"))
    q = write_scores(score_stream(stream, analysis.model), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["pair_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = jobs.scored_pairs(pairs).withColumn("p", analysis.model.probability([F.col(f) for f in FEATURES])).collect()
    assert len(got) == 494
    for r in want:
        assert abs(got[r["pair_id"]]["token_aligned"] - r["s_token_aligned"]) < 1e-12 and abs(got[r["pair_id"]]["learned"] - r["p"]) < 1e-9
