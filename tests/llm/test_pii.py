import hashlib
import random
import re

from onoma.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x.lstrip("0")[:9] or 0) <= 255 for x in m[0].split(".")),  # noqa: B023
                "card": lambda: 12 <= len(d) <= 19 and luhn(d),  # noqa: B023
                "phone": lambda: 9 <= len(d) <= 15,  # noqa: B023
            }[kind]()
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, a, z) for a, _, z, k in sorted(out)]


TEXTS = [
    None, "", "no data", "a@b.c_x@d.ef a@b.com@c.org ..@-.- x@.y é@é.é ñ.a@b.co.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.255.9 1.2.3",
    "4785380592391139 4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (242) 555-3475 +44 20 7946 0958. +1-2 +(12)345678901",
    "x" * 50000 + "@", "1" * 50000, ("a.b@c.de," * 700), "1.1.1.1 " * 600, "é" * 30 + " q@w.er\n🙂 q@w.er 9.9.9.9", "+" * 3000 + "1 2", "0" * 5000 + ".0.0.1",
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab1234567890 .-+@()_%é\n") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.find_personal_data(docs, support=10**6).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert got == slow(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


def test_query_columns(spark, tmp_path):
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(TEXTS)] + [(None, "q@w.er", None), (1, "", "y")], "doc_id long, text string, spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = pii.op3_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = slow((TEXTS[r["doc_id"]] if r["doc_id"] is not None else "q@w.er") or "")
        told = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == x for k, _, _ in want) for x in BASE)


def test_terms_that_disclose(spark):
    filler = [f"plain words number{chr(97 + n % 26)}{chr(97 + n // 26)} about weather" for n in range(300)]
    secret = [f"{w} Zephyrine plays weather chess, mail zed@site.org" for w in ("alpha", "bravo", "charlie", "delta")]
    rows = [(n, t) for n, t in enumerate(filler + secret)] + [(900, "first\nalpha Zephyrine plays weather chess, mail zed@site.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.sanitise(pii.find_personal_data(docs))
    by_id = {r["doc_id"]: r for r in found.collect()}
    values = {s["value"] for s in by_id[300]["spans"]}
    assert {"Zephyrine", "chess", "plays", "zed@site.org"} <= values and "weather" not in values
    assert by_id[300]["sanitised"] == "alpha   weather ,  [EMAIL]"
    assert all(not by_id[n]["spans"] and by_id[n]["sanitised"] == filler[n] for n in range(300))
    spans = {s["value"]: s for s in by_id[900]["spans"]}
    assert rows[-1][1][spans["chess"]["start"] : spans["chess"]["end"]] == "chess"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.sanitise(pii.find_personal_data(docs)).count() == 0


def test_many_copies_count_once(spark):
    docs = spark.createDataFrame([(n, "Zephyrine wrote zed@site.org") for n in range(50)] + [(99, "other")], "doc_id long, text string")
    assert all(len(r["spans"]) == (r["doc_id"] != 99) for r in pii.find_personal_data(docs).collect())


def test_entities_with_few_lines_are_estimated(spark):
    filler = [f"plain words number{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)} about weather" for n in range(6000)]
    own = ["Quillon likes weather, mail once@site.org"]
    own += [f"{w} Brannoch likes weather, mail twice@site.org" for w in ("alpha", "bravo")]
    own += ["Corvane likes weather, mail copy@site.org"] * 40
    own += ["Dunmore likes weather, mail left@site.org or right@site.org"]
    docs = spark.createDataFrame(list(enumerate(filler + own)), "doc_id long, text string")
    by_id = {r["doc_id"]: {s["value"]: s["kind"] for s in r["spans"]} for r in pii.find_personal_data(docs).collect()}
    assert by_id[6000] == {"Quillon": "term", "once@site.org": "email"}
    assert by_id[6001].items() >= {"Brannoch": "term", "twice@site.org": "email"}.items()
    assert all(by_id[n] == {"Corvane": "term", "copy@site.org": "email"} for n in range(6003, 6043))
    assert by_id[6043] == {"Dunmore": "term", "left@site.org": "email", "right@site.org": "email"}
    assert not any(by_id[n] for n in range(6000))
