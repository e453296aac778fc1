import random

import pytest

from onoma.operators.features import FEATURES
from onoma.operators.matchers import BASELINES, explanation, matcher_names
from onoma.operators.normalize import initial_tokens, normalize_names, roles
from onoma.plans.scoring import pair_components, score_pairs

KEYS = [*BASELINES]


@pytest.fixture(scope="module")
def score(spark):
    def run(pairs):
        return score_pairs(spark.createDataFrame(pairs, "name_a string, name_b string")).collect()

    return run


NORMALISED = {
    "Smt. S. Suresh Kumar Sharma, S/o Ramesh Chandra": "s suresh kumar sharma", "Baby S. Suresh": "s suresh", "Lakshmi H/o Sita": "lakshmi",
    "Lakshmi S/d Ram": "lakshmi", "Lakshmi M/d Ram": "lakshmi", "Ram So Das": "ram so das", "Ravi Do": "ravi do", "Raj Co Deep": "raj co deep",
    "A. Kumar": "a kumar", "Lal Bahadur Shastri": "lal bahadur shastri", "Km. Suresh Kumar Sharma": "suresh kumar sharma", "Kumari Suresh": "kumari suresh",
    "Søren Władysław": "soren wladyslaw", "Ramesh कुमार Sharma": "ramesh sharma", "!!!": "", "-- --": "", "A.K. Singh": "ak singh", "K-Singh": "ksingh",
    "Lakshmi Devi son Ram": "lakshmi devi", "X and Y of Z": "x y z", "Ramas/o x": "rama", " Tab\tName Here ": "tab name here",
}


def test_normalisation(spark):
    df = spark.createDataFrame([(n,) for n in [*NORMALISED, None]], "name string")
    got = {r["name"]: r["norm"] for r in normalize_names(df).collect()}
    assert {k: " ".join(got[k].tokens) for k in NORMALISED} == NORMALISED
    assert got[None].tokens == [] and got["Ramesh कुमार Sharma"].unreadable == ["कुमार"] and got["!!!"].unreadable == []
    assert got["Lakshmi H/o Sita"].dropped == ["h/o", "sita"] and got["A. Kumar"].initials == [0]


def test_same_and_other_classes(spark):
    same = [("Chatterji", "Chatterjee"), ("Srinivasan", "Sreenivasan"), ("Dey", "De"), ("Mohammed", "Mohammad"), ("Sharma", "Sarma"), ("Venkat Suresh Rao", "Venkatt Suresh Rao")]
    df = spark.createDataFrame(same + [("Krishna Kumar", "Krishnan Kumar")], "a string, b string")
    n = normalize_names(normalize_names(df, "a", "x"), "b", "y").collect()
    assert all((r.x.canonical == r.y.canonical) == (r.a != "Krishna Kumar") for r in n)


def test_roles_and_initials(spark):
    df = normalize_names(spark.createDataFrame([("",), ("Ram",), ("S. Rao",), ("A B C D",)], "name string"))
    from pyspark.sql import functions as F

    got = df.select("name", roles(F.col("norm")).alias("r"), initial_tokens(F.col("norm")).alias("i")).collect()
    assert [tuple(r["r"]) for r in sorted(got, key=lambda r: len(r["name"]))] == [("", "", ""), ("ram", "", ""), ("s", "", "rao"), ("a", "b c", "d")]
    assert {r["name"]: r["i"] for r in got}["S. Rao"] == ["s"]


def test_goldens(score):
    rows = [
        ("S. Kumar", "Suresh Kumar"), ("Suresh Kumar Sharma", "Suresh Sharma"), ("Krishna Kumar", "Krishnan Kumar"), ("Amit Kumar Agrawal", "Amit Kumar Agarwal"),
        ("S.", "Suresh Kumar Sharma"), ("12345", "12345"), ("Ram", "Shyam"), ("राहुल शर्मा", "राहुल शर्मा"), ("李雷", "李雷"), ("Rahulशर्मा Kumar", "Rahul Kumar"),
        ("", "Suresh Kumar"), ("   ", "Suresh Kumar"), ("!!!", "Suresh Kumar"), (None, "Suresh Kumar"), ("Manjula Naidu", "Joseph Thomas"), ("Anil Anil Kumar", "Anil Kumar"),
    ]
    got = {(r["name_a"], r["name_b"]): r for r in score(rows)}
    r = got["S. Kumar", "Suresh Kumar"]
    assert (r["exact_normalized"], r["token_jaccard"]) == (0, 1 / 3) and r["token_aligned"] > 0.6
    assert got["Suresh Kumar Sharma", "Suresh Sharma"]["token_jaccard"] == 2 / 3
    r = got["Krishna Kumar", "Krishnan Kumar"]
    assert abs(r["token_aligned"] - 0.926) < 1e-3 and abs(r["phonetic_jaro"] - 0.968) < 1e-3
    assert round(got["Amit Kumar Agrawal", "Amit Kumar Agarwal"]["phonetic_jaro"], 3) == 0.983
    assert round(got["S.", "Suresh Kumar Sharma"]["phonetic_jaro"], 3) == 0.342 and got["Ram", "Shyam"]["phonetic_jaro"] < 0.1
    assert all(got["12345", "12345"][k] == 1 for k in KEYS)
    for pair in [("राहुल शर्मा",) * 2, ("李雷",) * 2, ("Rahulशर्मा Kumar", "Rahul Kumar")]:
        assert all(got[pair][k] == 0.5 for k in KEYS)
    for name in ("", "   ", "!!!", None):
        assert all(got[name, "Suresh Kumar"][k] == 0 for k in KEYS) and all(got[name, "Suresh Kumar"][f"f_{f}"] == 0 for f in FEATURES)
    r = got["Manjula Naidu", "Joseph Thomas"]
    assert r["f_order_bonus"] == 0 and r["f_char_signal"] > 0 and got["Anil Anil Kumar", "Anil Kumar"]["f_token_dice"] == 1


def test_bounds_and_symmetry(score):
    rng = random.Random(9)
    words = ["Suresh", "S.", "Kumar", "Sharma", "Sarma", "Venkat", "Venkatesh", "Rao", "Dr.", "K.", "Agrawal", "Lakshmi", "12", "Jr.", "Éva", "w/o"]
    names = [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(120)]
    pairs = list({tuple(rng.sample(names, 2)) for _ in range(150)})
    got = {(r["name_a"], r["name_b"]): r for r in score(pairs + [(b, a) for a, b in pairs])}
    for a, b in pairs:
        for k in [*KEYS, *(f"f_{f}" for f in FEATURES)]:
            assert abs(got[a, b][k] - got[b, a][k]) < 1e-9
        assert all(0 <= got[a, b][k] <= 1 for k in KEYS)


def test_explanations(spark):
    df = pair_components(spark.createDataFrame([("S. Kumar", "Suresh Kumar"), ("", "x"), ("李", "x")], "name_a string, name_b string"))
    rows = df.select("name_a", *[explanation(k).alias(k) for k in KEYS]).collect()
    by = {r["name_a"]: r for r in rows}
    assert by["S. Kumar"]["token_aligned"]["n_aligned"] == 2 and by["S. Kumar"]["token_jaccard"]["jaccard"] == 1 / 3
    assert by[""]["token_aligned"] == {"empty": 1.0} and by[""]["exact_normalized"]["empty_left"] == 1 and by["李"]["phonetic_jaro"] == {"unsupported_script": 1.0}
    assert matcher_names() == [*KEYS, "learned"]
