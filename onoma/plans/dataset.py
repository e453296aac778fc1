"""The labelled pair set, made from a roster of people.

Pairs of one person are positives: the roster name against a rendering of it as documents write it.
Pairs of two people are negatives, found by a self-join of the roster and filed under the most
specific shape that they have.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from onoma.functions import native
from onoma.operators.matchers import sides

# The roster. Id, given, middle, family, region, gender, father, spouse, role.
ROSTER = """
P001 | Suresh | Kumar | Sharma | North | m | Ramesh Chandra |  | person
P002 | Anil | Kumar | Sharma | North | m | Ramesh Chandra |  | person
P003 | Anil | Kumar | Saxena | North | m | Ashok Kumar |  | person
P004 | Ramesh | Chandra | Sharma | North | m | Mohan Lal |  | elder
P005 | Sunil | Kumar | Sharma | North | m | Ramesh Chandra |  | person
P006 | Vijay |  | Saxena | North | m |  |  | person
P007 | Vijay |  | Saksena | North | m |  |  | person
P008 | Meena |  | Shah | West | f |  |  | person
P009 | Neena |  | Shah | West | f |  |  | person
P010 | Rohit |  | Sarma | North | m |  |  | person
P011 | Mohammed | Iqbal | Khan | South | m |  |  | person
P012 | Mohammad | Iqbal | Khan | North | m |  |  | person
P013 | Muhammed | Iqbal | Khan | East | m |  |  | person
P014 | Shahnaz |  | Begum | South | f |  |  | person
P015 | Salma |  | Khan | South | f |  |  | person
P016 | Venkat | Suresh | Rao | South | m | Subba Rao |  | person
P017 | Venkatesh | Suresh | Rao | North | m | Hanumantha Rao |  | person
P018 | V. | Lakshmi | Rao | South | f |  | Venkat Suresh | person
P019 | Lakshmi | Devi | Rao | South | f |  | Srinivasan Rao | person
P020 | Srinivasan |  | Krishnan | South | m |  |  | person
P021 | Shrinivasan |  | Krishnan | South | m |  |  | person
P022 | Padmavathi |  | Krishnan | South | f |  |  | person
P023 | Lakshmi |  | Iyer | South | f |  |  | person
P024 | Sourav |  | Ghosh | East | m |  |  | person
P025 | Sourav |  | Ghosh | East | m |  |  | person
P026 | Sourav |  | Das | East | m |  |  | person
P027 | Ananya | Kumar | Bose | East | f |  |  | person
P028 | Ananya | Kumari | Bose | East | f |  |  | person
P029 | Prakash |  | Deshmukh | West | m |  |  | person
P030 | Prakash |  | Deshmukh | West | m |  |  | person
P031 | Prafull |  | Deshmukh | North | m |  |  | person
P032 | Vaishali |  | Joshi | West | f |  |  | person
P033 | Vaishali |  | Joisar | West | f |  |  | person
P034 | Gurpreet | Singh | Sandhu | North | m | Harjeet Singh |  | person
P035 | Gurpreet | Singh | Sandhu | North | m |  |  | person
P036 | Gurjant | Singh | Sandhu | North | m | Harjeet Singh |  | person
P037 | Harpreet | Singh | Sandhu | North | m | Harjeet Singh |  | person
P038 | Krishna |  | Kumar | South | m |  |  | elder
P039 | Krishnan |  | Kumar | South | m | Krishna |  | person
P040 | Lakshmi |  | Kumar | South | f |  | Krishna | person
P041 | Deepa | Kumar | Pillai | South | f |  |  | person
P042 | Deepa |  | Kumar | South | f |  |  | person
P043 | Amit | Kumar | Agrawal | North | m | Ramesh Agrawal |  | person
P044 | Amit | Kumar | Agarwal | North | m | Suresh Agarwal |  | person
P045 | Nisha | Kumari | Yadav | North | f |  |  | person
P046 | Nisha |  | Yadav | North | f |  |  | person
P047 | Rahul | Kumar | Gupta | North | m |  |  | person
P048 | Rahul |  | Gupta | North | f |  |  | person
P049 | Sneha |  | Bhattacharya | East | f |  |  | person
P050 | Snehalata |  | Bhattacharya | East | f |  |  | person
P051 | Joseph |  | Thomas | South | m |  |  | person
P052 | Joseph |  | Tomas | South | m |  |  | person
P053 | Farida |  | Begum | North | f |  |  | person
P054 | Arjun | Singh | Chauhan | North | m |  |  | person
P055 | Arjun | Singh | Chowhan | North | m |  |  | person
P056 | Bhavna |  | Trivedi | West | f |  |  | person
P057 | Bhavana |  | Trivedi | East | f |  |  | person
P058 | Kiran |  | Pawar | West | m |  |  | person
P059 | Kiran |  | Pawar | West | f |  |  | person
P060 | Rekha |  | Menon | South | f |  |  | person
P061 | Rekha |  | Menon | South | f |  |  | person
P062 | Ganesh |  | Nadar | South | m |  |  | person
P063 | Harsh | Kumar | Mehta | West | m |  |  | person
P064 | Harsh | Kumar | Mehta | West | m |  |  | person
P065 | Kavitha |  | Reddy | South | f |  | Ravi Reddy | person
P066 | Ravi | Kumar | Reddy | South | m |  |  | person
P067 | Manjula |  | Naidu | South | f |  |  | person
P068 | Satish |  | Naidu | South | m |  |  | person
P069 | Priyanka |  | Chatterjee | East | f |  |  | person
P070 | Priyanka |  | Chowdhury | East | f |  |  | person
P071 | Tarun |  | Chauhan | North | m |  |  | person
P072 | Shubha |  | Mukherjee | East | f |  |  | person
P073 | Shubha |  | Mukherji | East | f |  |  | person
P074 | Nitin |  | Kapoor | North | m |  |  | person
P075 | Nita |  | Kapoor | North | f |  |  | person
P076 | Balaji |  | Venkataraman | South | m |  |  | person
P077 | Hemant | Kumar | Gupta | North | m |  |  | person
P078 | Sonal |  | Patil | West | f |  |  | person
P079 | Imran | Khan | Sheikh | South | m |  |  | person
P080 | Zoya |  | Fatma | North | f | Abdul Rehman |  | person
P081 | Simran |  | Kumar Singh | North | f |  |  | person
P082 | Simran |  | Kumar Singh | North | f |  |  | person
P083 | Harbhajan |  | Singh Gill | North | m |  |  | person
P084 | Harbhajan |  | Singh | North | m |  |  | person
P085 | Nandini |  | Rao Naidu | South | f |  |  | person
P086 | Srinivas |  | Rao Naidu | South | m |  |  | person
P087 | Kavya |  | Menon Iyer | South | f |  |  | person
P088 | Mohan |  | Menon Iyer | South | m |  |  | person
P089 | Ritika |  | Singh Bhalla | North | f |  |  | person
P090 | Sudha |  | Rao Naidu | South | f |  |  | person
P091 | Gopal |  | Singh Gill | North | m |  |  | person
"""

# Other spellings of given names.
GIVEN_SPELLINGS = """
mohammed Mohammad Muhammed
mohammad Mohammed Muhammad
muhammed Mohammed Muhammad
venkat Venkatesh
venkatesh Venkat
srinivasan Shrinivasan Sreenivasan
shrinivasan Srinivasan Sreenivasan
sourav Sourab Saurabh
prakash Praful
prafull Praful Prakash
amit Ameet
nisha Nishaa
sneha Snehaa
snehalata Snehalatha
joseph Josef
vaishali Vaisali
krishnan Krishana
krishna Krishnappa
lakshmi Lakshmee Laxmi
padmavathi Padmavati
ganesh Ganeesh
harsh Harsha
bhavna Bhavana
bhavana Bhavna
suresh Surish
ramesh Raamesh
ananya Ananyaa
kavitha Kavita
priyanka Priyanaka
shubha Shubhaa
manjula Manjulaa
satish Sateesh
rekha Rekhaa
sonal Sonali
imran Imraan
nitin Niteen
meena Meenaa
tarun Taron
nishaa Nisha
"""

# Other spellings of family names.
FAMILY_SPELLINGS = """
sharma Sarma
sarma Sharma
saxena Saksena
saksena Saxena
krishnan Krishana
agrawal Agarwal
agarwal Agrawal
bhattacharya Bhattacherya Bhattacharjee
bhattacherya Bhattacharya
chauhan Chowhan
chowhan Chauhan
trivedi Trivredi Trivedy
joshi Joisar
joisar Joshi
deshmukh Deshmokh
ghosh Ghose
chatterjee Chowdhury Chattopadhyay
chowdhury Chatterjee
mukherjee Mukherji Mookerjee
mukherji Mukherjee
nadar Nadkar
mehta Mehtaa
kapoor Kapur
reddy Reddi
naidu Naidoo
yadav Yadhav
thomas Tomas
tomas Thomas
pawar Pavar
pillai Pillay
iyer Iyyer
iyyer Iyer
kumar Kummar
venkataraman Venkataram
sheikh Shaikh
"""

# Held-out spellings that normalising does not resolve, then those it does.
HELD_OUT_OPEN = """
P051 | Joseph Thomas | Josef Thomas
P033 | Vaishali Joisar | Vaisali Josar
P024 | Sourav Ghosh | Sourab Ghosh
P049 | Sneha Bhattacharya | Sneha Bhattacheria
P054 | Arjun Singh Chauhan | Arjaan Singh Chawhan
P020 | Srinivasan Krishnan | Srinivasan Krishnaen
P069 | Priyanka Chatterjee | Priyanaka Chaterjee
P076 | Balaji Venkataraman | Balaji Venkatraman
P034 | Gurpreet Singh Sandhu | Gurpreet Sngh Sandhu
P056 | Bhavna Trivedi | Bavna Trivedi
P012 | Mohammad Iqbal Khan | Mohamad Iqbal Khan
P022 | Padmavathi Krishnan | Padmavathi Krisnan
P034 | Gurpreet Singh Sandhu | Gurpreet Sing Sandhu
"""
HELD_OUT_FOLDED = """
P016 | Venkat Suresh Rao | Venkatt Suresh Rao
P045 | Nisha Kumari Yadav | Nisha Kumaari Yadav
P063 | Harsh Kumar Mehta | Harsh Kumaar Mehta
P062 | Ganesh Nadar | Ganeesh Nadar
P059 | Kiran Pawar | Kiran Paawar
"""

# Sizes and strides of the plan.
PER_CATEGORY, CONTROL_ROWS = 14, 14
CONTROL_STRIDE, CONTROL_SHIFT = 37, 11

#: category -> (difficulty, what the row shows)
NEGATIVE_SHAPES = {
    "hard_negative_identical_name": ("hard", "two people with the same name"),
    "hard_negative_sibling": ("hard", "siblings of one household"),
    "hard_negative_sibling_reordered": ("hard", "siblings of one household, one written family name first"),
    "hard_negative_parent_child": ("hard", "a parent and a child of one household"),
    "hard_negative_dropped_token": ("hard", "two people, one name lacking a part of the other"),
    "hard_negative_near_duplicate": ("hard", "two people whose names differ in one part"),
    "hard_negative_common_surname": ("medium", "two people who share a family name"),
    "hard_negative_partial_overlap": ("medium", "two people who share a given or middle name"),
    "hard_negative_phonetic": ("hard", "two people whose names only sound alike in one part"),
    "unrelated": ("easy", "two people whose names share nothing"),
}
POSITIVE_CATEGORIES = {
    "initials": "a part of the name is an initial",
    "surname_first": "the family name stands first",
    "transliteration": "another accepted spelling",
    "middle_name": "a middle or a relative's name stands on one side only",
    "honorific": "a title stands on one side only",
    "suffix": "a generational suffix stands on one side only",
    "compound_surname": "a two-word family name is joined or hyphenated",
    "typo": "a slip of the pen",
    "formatting": "only the letters' case differs",
    "transliteration_heldout": "a spelling that no list has",
}
CATEGORIES = {**POSITIVE_CATEGORIES, **{k: v[1] for k, v in NEGATIVE_SHAPES.items()}}
PAIR_SCHEMA = (
    "pair_id string, name_a string, name_b string, label int, person_a string, person_b string, "
    "category string, difficulty string, rationale string"
)
ROSTER_SCHEMA = (
    "ord int, person_id string, given string, middle array<string>, family string, region string, gender string, "
    "father string, spouse string, role string, full string"
)


def _lines(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] for line in text.strip().splitlines()]


def people() -> list[dict]:
    keys = ("person_id", "given", "middle", "family", "region", "gender", "father", "spouse", "role")
    out = [dict(zip(keys, row, strict=True)) for row in _lines(ROSTER)]
    for n, p in enumerate(out):
        p["ord"], p["middle"] = n, p["middle"].split()
        p["full"] = " ".join([p["given"], *p["middle"], p["family"]])
    return out


def roster(spark: SparkSession) -> DataFrame:
    names = [f.split()[0] for f in ROSTER_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(p[k] for k in names) for p in people()], ROSTER_SCHEMA)


# ---- positives -------------------------------------------------------------------------------


def title_of(p: dict) -> str:
    """The courtesy title a document of that region prints."""
    south = p["region"] == "South"
    if p["gender"] == "f":
        return "Km." if south else "Smt."
    return "Mr." if p["gender"] == "m" and p["region"] == "North" else "Shri"


def _other_spelling(table: str, name: str) -> str:
    found = {w[0]: w[1:] for w in map(str.split, table.strip().splitlines())}
    return next((v for v in found.get(name.lower(), ()) if v.lower() != name.lower()), "")


def slip(word: str, kind: str) -> str | None:
    """A slip in the middle of a word; None for words too short or with a blank."""
    if " " in word or len(word) < 3:
        return None
    k = len(word) // 2
    head, c, tail = word[:k], word[k], word[k + 1 :]
    return {
        "drop": head + tail,
        "swap": head + tail[:1] + c + tail[1:],
        "double": head + c + c + tail,
        "other": head + ("e" if c.lower() == "i" else "i") + tail,
    }[kind]


def renderings(p: dict) -> dict[str, list[tuple[str, str, str] | None]]:
    """category -> the ways to write that person in it, as (name, other name, difficulty); None where there is none."""
    given, family, full, title = p["given"], p["family"], p["full"], title_of(p)
    middle = " ".join(p["middle"])
    father, spouse = p["father"], p["spouse"]
    link = "S/o" if p["gender"] != "f" else "W/o" if spouse else "D/o"
    dotted, bare = " ".join(w[0] + "." for w in given.split()), given[0]
    g, f = _other_spelling(GIVEN_SPELLINGS, given), _other_spelling(FAMILY_SPELLINGS, family)
    *before, last = family.split()

    def one(level: str, *parts: str, when: object = True) -> tuple[str, str, str] | None:
        return (" ".join(x for x in parts if x), full, level) if when else None

    def miswritten(kind: str, level: str) -> tuple[str, str, str] | None:
        word = slip(last, kind)
        return one(level, given, middle, *before, word) if word else None

    relative = f"{link} {father}" if father else "" if middle else f"W/o {spouse}" if spouse else ""
    bears_suffix = p["gender"] != "f" and p["role"] != "elder"
    two_words = bool(before)
    return {
        "initials": [
            one("easy", dotted, middle, family),
            one("easy", bare, middle, family),
            one("medium", given, *(m[0] + "." for m in p["middle"]), family, when=middle),
            one("hard", title, bare, family),
        ],
        "surname_first": [
            one("easy", family, given),
            (f"{family} {middle} {given}", full, "medium"),
            one("hard", family, bare),
        ],
        "transliteration": [
            one("medium", g, middle, family, when=g),
            one("medium", given, middle, f, when=f),
            one("hard", g or given, f or family, when=g or f),
            one("hard", g or given, middle, f or family, when=g or f),
        ],
        "middle_name": [
            one("easy", given, family, when=middle),
            one("hard", family, middle, given, when=middle),
            one("medium", given, *p["middle"][:1], family, when=len(p["middle"]) > 1),
            one("hard", given, family, link, father, when=father),
            one("hard", full, "W/o", spouse, when=spouse),
        ],
        "honorific": [
            one("easy", title, full),
            one("hard", title, given, family, relative, when=father or middle or spouse),
        ],
        "suffix": [
            one("easy", full, "Jr.", when=bears_suffix),
            (f"{full} II", f"{title} {full}", "medium") if bears_suffix else None,
        ],
        "compound_surname": [
            one("medium", given, family.replace(" ", ""), when=two_words),
            one("medium", given, "-".join(family.split()), when=two_words),
        ],
        "typo": [
            one("medium", slip(given, "swap") or "", when=slip(given, "swap")),
            miswritten("drop", "medium"),
            miswritten("double", "hard"),
        ],
        "formatting": [one("easy", full.upper())],
    }


def unordered(a: str, b: str) -> tuple[str, str]:
    return (a, b) if a <= b else (b, a)


def positive_rows(reserved: set[tuple[str, str]]) -> list[tuple]:
    """(name_a, name_b, person, category, difficulty): a flat number of rows for every category.

    A person gets one rendering per category; which one is tried first turns with the person's place,
    in steps that reach all of them. Comparisons that are taken, by a negative or an earlier row, are
    passed over. Each category is then thinned evenly, from a start that turns with the category.
    The choice of a row depends on all before it, so this runs at the driver, over the roster alone.
    """
    taken = set(reserved)
    chosen: dict[str, list[tuple]] = {}
    for p in people():
        for c, (category, ways) in enumerate(renderings(p).items()):
            n = len(ways)
            turn = next((k for k in range(2, n + 1) if gcd(k, n) == 1), 1)
            begin = p["ord"] * turn + 2 * c
            for way in (ways[(begin + k) % n] for k in range(n)):
                if way and unordered(*way[:2]) not in taken:
                    taken.add(unordered(*way[:2]))
                    chosen.setdefault(category, []).append((way[0], way[1], p["person_id"], category, way[2]))
                    break
    out = []
    for c, category in enumerate(k for k in POSITIVE_CATEGORIES if k != "transliteration_heldout"):
        rows = chosen.get(category, [])
        size = min(PER_CATEGORY, len(rows))
        out += [rows[(7 * c % len(rows) + int(k * (len(rows) / size))) % len(rows)] for k in range(size)]
    return out


def held_out_rows() -> list[tuple]:
    tables = ((HELD_OUT_OPEN, "hard"), (HELD_OUT_FOLDED, "medium"))
    return [(a, b, p, "transliteration_heldout", level) for text, level in tables for p, a, b in _lines(text)]


# ---- negatives -------------------------------------------------------------------------------


def _sounding(xs: Column, ys: Column) -> Column:
    """Some two different tokens sound alike."""
    return F.exists(
        xs, lambda x: F.exists(ys, lambda y: (x["t"]["word"] != y["t"]["word"]) & (native.phonetic_agreement(x["t"], y["t"]) >= 0.8))
    )


def _person_sides(people_df: DataFrame) -> DataFrame:
    names = sides(people_df.select(F.col("full").alias("name")).union(people_df.select("family")))
    whole = names.select(F.col("name").alias("full"), F.col("side.tokens").alias("tokens"), F.col("side.toks").alias("toks"))
    fam = names.select(F.col("name").alias("family"), F.col("side.tokens").alias("family_tokens"))
    return people_df.join(whole, "full").join(fam, "family")


def _both(people_df: DataFrame, on: Column) -> DataFrame:
    s = _person_sides(people_df)
    pack = F.struct(*s.columns)
    return s.select(pack.alias("a")).join(s.select(pack.alias("b")), on)


def negative_shapes(people_df: DataFrame) -> DataFrame:
    """(ord_a, ord_b, seq, category, name_a, name_b, person_a, person_b) for every pair of people with a shape.

    The roster joins itself on ord_a < ord_b: all pairs of it are the question. One row is emitted per
    pair, two for siblings; of rows with one unordered pair of names the first stays.
    """
    df = _both(people_df, F.col("a.ord") < F.col("b.ord"))
    a, b = F.col("a"), F.col("b")
    ta, tb = a["tokens"], b["tokens"]
    row = lambda category, x, y: F.struct(F.lit(category).alias("category"), x.alias("name_a"), y.alias("name_b"))
    plain = lambda category: F.array(row(category, a["full"], b["full"]))
    sibling = (a["father"] != "") & (a["father"] == b["father"]) & (a["family"] == b["family"])
    block = lambda p: F.concat_ws(" ", p["given"], F.when(F.size(p["middle"]) > 0, F.array_join(p["middle"], " ")))
    parent = lambda p, c: (c["father"] != "") & (p["family"] == c["family"]) & ((c["father"] == p["given"]) | (c["father"] == block(p)))
    lacks = lambda x, y: (F.size(x) > F.size(y)) & (F.size(F.array_except(y, x)) == 0)
    differing = F.size(F.filter(F.arrays_zip(ta.alias("x"), tb.alias("y")), lambda z: z["x"] != z["y"]))
    one_off = (F.size(ta) == F.size(tb)) & (F.size(ta) >= 2) & (differing == 1)
    family = F.arrays_overlap(a["family_tokens"], tb) | F.arrays_overlap(b["family_tokens"], ta)
    shape = (
        F.when(a["full"] == b["full"], plain("hard_negative_identical_name"))
        .when(
            sibling,
            F.array(
                row("hard_negative_sibling", a["full"], b["full"]),
                row("hard_negative_sibling_reordered", F.concat_ws(" ", a["given"], a["family"]), F.concat_ws(" ", b["family"], b["given"])),
            ),
        )
        .when(parent(a, b), plain("hard_negative_parent_child"))
        .when(parent(b, a), F.array(row("hard_negative_parent_child", b["full"], a["full"])))
        .when(lacks(ta, tb) | lacks(tb, ta), plain("hard_negative_dropped_token"))
        .when(one_off, plain("hard_negative_near_duplicate"))
        .when(F.arrays_overlap(ta, tb) & family, plain("hard_negative_common_surname"))
        .when(F.arrays_overlap(ta, tb), plain("hard_negative_partial_overlap"))
        .when(_sounding(a["toks"], b["toks"]), plain("hard_negative_phonetic"))
    )
    rows = df.select(
        F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), F.col("a.person_id").alias("person_a"),
        F.col("b.person_id").alias("person_b"), F.posexplode(shape).alias("seq", "r"),
    ).select("ord_a", "ord_b", "seq", "person_a", "person_b", "r.*")
    first = W.partitionBy(F.least("name_a", "name_b"), F.greatest("name_a", "name_b")).orderBy("ord_a", "ord_b", "seq")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def control_rows(people_df: DataFrame, taken: DataFrame, size: int = CONTROL_ROWS) -> DataFrame:
    """Pairs that share no token and no sound, spread over the roster by a stride; ``size`` of them are wanted."""
    n = people_df.count()
    df = _both(people_df, F.col("b.ord") == F.pmod(F.col("a.ord") * CONTROL_STRIDE + CONTROL_SHIFT, F.lit(n)))
    apart = ~F.arrays_overlap("a.tokens", "b.tokens") & ~_sounding(F.col("a.toks"), F.col("b.toks")) & (F.col("a.ord") != F.col("b.ord"))
    rows = df.filter(apart).select(
        F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), F.lit(0).alias("seq"), F.col("a.person_id").alias("person_a"),
        F.col("b.person_id").alias("person_b"), F.lit("unrelated").alias("category"), F.col("a.full").alias("name_a"), F.col("b.full").alias("name_b"),
    )
    key = lambda d: d.withColumns({"lo": F.least("name_a", "name_b"), "hi": F.greatest("name_a", "name_b")})
    free = key(rows).join(key(taken).select("lo", "hi"), ["lo", "hi"], "left_anti")
    first = W.partitionBy("lo", "hi").orderBy("ord_a")
    once = free.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "lo", "hi")
    return once.orderBy("ord_a").limit(size)


_BUILT: list[tuple] = []


def labelled_pairs(spark: SparkSession) -> DataFrame:
    """The whole set, in order: positives, held-out spellings, negatives, control group; ids N0001 on.

    It depends on the roster alone, so a process builds it once.
    """
    if not _BUILT:
        _BUILT.extend(_build(spark))
    return spark.createDataFrame(_BUILT, PAIR_SCHEMA)


def _build(spark: SparkSession) -> list[tuple]:
    people_df = roster(spark)
    shapes = negative_shapes(people_df)
    found = shapes.orderBy("ord_a", "ord_b", "seq").collect()
    found += control_rows(people_df, shapes).orderBy("ord_a").collect()
    negatives = [(r["name_a"], r["name_b"], 0, r["person_a"], r["person_b"], r["category"], NEGATIVE_SHAPES[r["category"]][0]) for r in found]
    reserved = {unordered(r[0], r[1]) for r in negatives}
    held = held_out_rows()
    if any(unordered(r[0], r[1]) in reserved for r in held):
        raise ValueError("a held-out pair is also a negative")
    own = positive_rows(reserved | {unordered(r[0], r[1]) for r in held})
    rows = [(a, b, 1, p, p, c, d) for a, b, p, c, d in own + held] + negatives
    return [(f"N{n:04d}", *r, f"{r[0]!r} vs {r[1]!r}: {CATEGORIES[r[5]]}") for n, r in enumerate(rows, 1)]


def integrity(pairs: DataFrame) -> DataFrame:
    """Rows that break a rule of the set, with the rule: none in a sound set."""
    key = W.partitionBy(F.least("name_a", "name_b"), F.greatest("name_a", "name_b"))
    rules = {
        "same pair twice": F.count(F.lit(1)).over(key) > 1,
        "label and identity disagree": (F.col("label") == 1) != (F.col("person_a") == F.col("person_b")),
        "unknown category": ~F.col("category").isin(list(CATEGORIES)),
        "unknown difficulty": ~F.col("difficulty").isin("easy", "medium", "hard"),
        "rationale of another row": ~F.startswith("rationale", F.concat(F.lit("'"), F.col("name_a"), F.lit("' vs '"), F.col("name_b"), F.lit("': "))),
    }
    told = F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]).alias("told")
    return pairs.select("pair_id", told).select("pair_id", F.explode(F.array_compact("told")).alias("rule"))


def profile(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))


def distinct_people(pairs: DataFrame) -> DataFrame:
    both = pairs.select("person_a").union(pairs.select("person_b"))
    return both.agg(F.count_distinct("person_a").alias("identities"))
