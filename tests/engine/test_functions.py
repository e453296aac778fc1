import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from onoma.functions import kernels as k
from onoma.functions import native, vocab

WORD = st.text("abcde ", max_size=12)


def plain_jaro(a, b):
    """The definition, written out."""
    if a == b:
        return 1.0
    w, used, pairs = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - w), min(len(b), i + w + 1)):
            if j not in used and b[j] == c:
                used.add(j)
                pairs.append((i, j))
                break
    if not pairs:
        return 0.0
    m = len(pairs)
    t = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=400)
@given(WORD, WORD)
def test_kernels_equal_their_definitions(a, b):
    assert k.jaro(a, b) == plain_jaro(a, b)
    assert k.osa_distance(a, b) == plain_osa(a, b)
    longest = max((len(a[i:j]) for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    assert k.common_substring_ratio(a, b) == (longest / max(len(a), len(b)) if a and b else 0)
    assert k.jaro(a, b) <= k.jaro_winkler(a, b) <= 1 and abs(k.jaro(a, b) - k.jaro(b, a)) < 1e-9


def test_goldens():
    assert k.osa_distance("suersh", "suresh") == 1 and k.osa_distance("ca", "abc") == 3
    assert round(k.jaro("martha", "marhta"), 6) == 0.944444 and k.jaro("abc", "xyz") == k.jaro("", "abc") == 0
    assert k.common_substring_ratio("kumar", "anil kumar sharma") == 5 / 17
    assert k.jaro_winkler("abcd", "abce", weight=0.9) <= 1


@pytest.mark.parametrize(
    ("word", "code"),
    [("knife", "NIFE"), ("gnome", "NOME"), ("wrath", "RET"), ("xylophone", "SYLOFONE"), ("school", "SKUL"), ("tax", "TEKS"), ("singh", "SING"), ("wager", "WEKER"), ("", ""), ("123", "")],
)
def test_metaphone(word, code):
    assert k.metaphone(word) == code


def test_metaphone_codes():
    assert set(k.metaphone_codes("vasudevan")) & set(k.metaphone_codes("wasudevan"))
    assert k.metaphone_codes("12") == ("",)


def test_diacritics():
    assert k.fold_diacritics("Søren Władysław Éß ﬁ") == "Soren Wladyslaw Ess fi"


def test_lexicon():
    lexicon = vocab.spelling_lexicon()
    assert len(lexicon) == 200 and lexicon["chatterji"] == lexicon["chatterjee"] and lexicon["venkat"] == "venkatesh"
    with pytest.raises(ValueError, match="two spelling classes"):
        vocab.spelling_lexicon("a b\nc b")


def test_native_functions(spark):
    rng = random.Random(3)
    rows = [("", ""), ("", "abc"), ("kitten", "sitting"), ("suresh", "suresh kumar"), ("sursh", "suresh"), ("sur", "sureshkumar"), ("xyz", "suresh"), ("s", "suresh")]
    rows += [("".join(rng.choices("abc ", k=rng.randint(0, 8))), "".join(rng.choices("abc ", k=rng.randint(0, 8)))) for _ in range(150)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", native.levenshtein_ratio(a, b).alias("lev"), native.prefix_ratio(a, b).alias("pre"), native.is_prefix(a, b).alias("is"),
        native.ngram_jaccard(a, b, 2).alias("j2"), native.ngram_dice(a, b, 3).alias("d3"), F.levenshtein(a, b).alias("d"),
    )

    def grams(s, n):
        p = f" {s} "
        return {p[i : i + n] for i in range(max(1, len(p) - n + 1))} if s else set()

    for r in df.collect():
        x, y = r["a"], r["b"]
        short, long = sorted((x, y), key=len)
        same = len([1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y, strict=False))])
        assert r["lev"] == (1 - r["d"] / len(long) if long else 1)
        assert r["pre"] == (same / len(short) if short else 0) and r["is"] == bool(short and long.startswith(short))
        g, h = grams(x, 2), grams(y, 2)
        assert r["j2"] == (len(g & h) / len(g | h) if g | h else 1)
        g, h = grams(x, 3), grams(y, 3)
        assert r["d3"] == (2 * len(g & h) / (len(g) + len(h)) if g or h else 1)


def test_soundex_and_fold(spark):
    words = ["sharma", "sarma", "mohammed", "mohammad", "123", "", "suresh kumar", "Ashcraft", "pfister", "venkatt", "kumaari", "dey", "aaab"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {r["s"]: (r["x"], r["c"]) for r in df.select("s", native.soundex(F.col("s")).alias("x"), native.canonical_token(F.col("s")).alias("c")).collect()}
    assert got["sharma"][0] == got["sarma"][0] and got["mohammed"][0] == got["mohammad"][0]
    assert got["123"][0] == "" == got[""][0] and got["suresh kumar"][0] == "S625"
    assert (got["venkatt"][1], got["kumaari"][1], got["dey"][1], got["aaab"][1], got["sarma"][1]) == ("venkatesh", "kumari", "dey", "ab", "sharma")


def test_canonical_is_never_empty(spark):
    words = ["".join(x) for n in range(1, 5) for x in itertools.product("abc", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert df.filter(F.length(native.canonical_token(F.col("s"))) == 0).isEmpty()


def test_sql_registration(spark):
    k.register(spark)
    assert spark.sql("SELECT jaro('martha', 'marhta') > 0.94 AND osa_distance('ab', 'ba') = 1 AND metaphone('knife') = 'NIFE'").first()[0]
