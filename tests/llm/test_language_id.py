from collections import Counter

from onoma.llm import language_id as li

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it was there with the others",
    "de": "der schnelle braune Fuchs springt über den faulen Hund und dann war er nicht mehr da",
    "fr": "le renard brun rapide saute par-dessus le chien paresseux et puis il était là avec les autres",
}


def slow_ngrams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else (c if c.isalpha() else " ") for c in text).split()
    out = Counter()
    for w in words:
        padded = f"_{w}_"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] != "_":
                    out[padded[i : i + n]] += 1
    return out


def name(gram):
    out = ""
    while gram:
        out = ("_" if gram % 2**21 == 1 else chr(gram % 2**21)) + out
        gram >>= 21
    return out


def test_ngrams():
    for text in [*TEXTS.values(), "a", "Éa--b  c1d 日本", "x" * 1000, "\n a\n", "İ ß"]:
        assert Counter(map(name, li.ngrams(text).tolist())) == slow_ngrams(text)
    assert len(li.ngrams("12 !? ́")) == 0


def test_profiles_count_all_rows(spark):
    docs = spark.createDataFrame([(k, t) for k, t in TEXTS.items()] * 3 + [("en", None), (None, "xyz"), ("en", "")], "lang string, text string")
    got = {(r["lang"], name(r["gram"])): r["n"] for r in li.gram_counts(docs.repartition(3)).collect()}
    assert got == {(k, g): 3 * n for k, t in TEXTS.items() for g, n in slow_ngrams(t).items()}
    top = [r["gram"] for r in li.learn_profiles(docs, 20).filter("lang='de'").orderBy("place").collect()]
    assert len(top) == 20 and name(top[0]) == slow_ngrams(TEXTS["de"]).most_common(1)[0][0]


def test_query(spark, tmp_path):
    rows = [(n, TEXTS[k], k) for n, k in enumerate(list(TEXTS) * 20)] + [
        (100, None, "en"), (101, "", "en"), (102, "123 !!", "de"), (103, "der Hund war nicht da", None), (None, "the dog", None), (1, TEXTS["de"], "de"),
        (104, "the dog and the fox " * 20000, None),
    ]
    spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    out = li.op9_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] != 1}
    assert all(by[n] == k for n, _, k in rows[:60] if n != 1)
    assert (by[100], by[101], by[102], by[103], by[None], by[104]) == ("und", "und", "und", "de", "en", "en")


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    none = spark.createDataFrame([], "lang string, text string")
    (r,) = li.identify(docs, li.learn_profiles(none)).collect()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert li.identify(docs.limit(0), li.learn_profiles(none)).count() == 0
