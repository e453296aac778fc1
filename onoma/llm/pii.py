"""Personal data: spans of known shape, and terms that give a protected entity away.

Base spans (mail addresses, network addresses, card and phone numbers) come from patterns. On top of
them, the corpus tells which terms disclose an entity: the lines that hold an entity are its contexts,
and a term's disclosure of an entity is the share of the entity's information content that their
pointwise mutual information amounts to, PMI(e; t) / IC(e). Every entity is estimated, however few its
lines are: counts are smoothed by an absolute discount, so that little evidence gives a lower share. Terms
at or above a threshold are generalised in the lines where they stand with the entity, and removed at a
higher threshold.

All of it is DataFrame expressions. A pattern's positions are found by cutting the text at the
pattern and summing up the lengths of pieces and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import MIN_LONG, checkpointed, read_table

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract with possessive repeats, which match the same spans in linear time:
#: a mail address begins at the start of its run of characters or where the last address ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = rf"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){{4}}"
TERM = r"\p{L}{4,}+"
#: Distinct contexts that an entity, and an entity with a term, must have: with 1 all are estimated.
SUPPORT = 1
#: What is taken off each count of an entity with a term; it goes to the entity's share of all lines.
DISCOUNT = 0.75
GENERALISE = 0.8
REMOVE = 0.95
STEP = 256
#: An entity's set of lines: its size and both hashes of the lines, folded.
SET = ("n_e", "x1", "x2")


def running_sum(values: Column) -> Column:
    """Exclusive prefix sums of an array, in blocks so that long arrays don't cost their square."""
    zero = F.lit(0)
    blocks = F.transform(
        F.sequence(zero, F.floor((F.size(values) - 1) / STEP).cast("int")), lambda b: F.slice(values, b * STEP + 1, STEP)
    )
    scan = lambda a: F.aggregate(a, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    inner = F.transform(blocks, scan)
    before = scan(F.transform(inner, lambda a: F.element_at(a, -1)))
    shifted = F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda a, o: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda x: x + o))
    return F.when(F.size(values) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<int>"))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def with_base_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """Add ``out``: array of (start, rank, end, kind, value), sorted; positions are code points."""
    has_digit = F.col(text).rlike("[0-9]")
    guards = {"email": F.col(text).contains("@"), "ip": has_digit, "card": has_digit, "phone": F.col(text).contains("+") & has_digit}
    none = F.array().cast("array<string>")
    cut = df.withColumns(
        {
            **{f"__m_{k}": F.when(guards[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS},
        }
    )
    # the pieces are only cut out where something matched
    cut = cut.withColumns(
        {f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.transform(F.split(text, PATTERNS[k], -1), lambda x: F.length(x))) for k in KINDS}
    )
    kind_of = "struct<start:int,rank:int,end:int,kind:string,value:string>"
    for rank, k in enumerate(KINDS):
        lengths = F.transform(f"__m_{k}", lambda m: F.length(m))
        steps = F.zip_with(F.slice(f"__p_{k}", F.lit(1), F.size(f"__m_{k}")), lengths, lambda p, m: p + m)
        cut = cut.withColumn(f"__s_{k}", F.when(F.size(f"__m_{k}") > 0, steps))
        cut = cut.withColumn(f"__s_{k}", F.when(F.col(f"__s_{k}").isNotNull(), running_sum(F.col(f"__s_{k}"))))
        spans = F.zip_with(
            F.zip_with(f"__s_{k}", F.slice(f"__p_{k}", F.lit(1), F.size(f"__m_{k}")), lambda s, p: s + p),
            f"__m_{k}",
            lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end"), F.lit(k).alias("kind"), m.alias("value")),
        )
        good = F.filter(spans, lambda s: _valid(k, s["value"]))  # noqa: B023
        cut = cut.withColumn(f"__g_{k}", F.coalesce(F.when(F.size(f"__m_{k}") > 0, good), F.array().cast(f"array<{kind_of}>")))
    joined = cut.withColumn(out, F.array_sort(F.concat(*[f"__g_{k}" for k in KINDS])))
    return joined.drop(*[f"__{x}_{k}" for x in "mpsg" for k in KINDS])


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], "[^0-9.]", ""))
    return F.concat_ws(":", span["kind"], plain)


def _suspect(text: Column) -> Column:
    """What any base span needs; cheap."""
    return text.contains("@") | text.rlike("[0-9]")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def disclosing_lines(
    docs: DataFrame, *, support: int = SUPPORT, generalise: float = GENERALISE
) -> DataFrame | None:
    """(h1, h2, terms): for lines with an entity, the (term, share) that disclose it; None if there are none.

    n(e), n(e, t): distinct lines with the entity, and with both; n(t) and N: distinct lines of the
    whole corpus with the term, and all. p(e) = n(e) / N, p(e | t) = (n(e,t) - d + d p(e)) / n(t) with
    d = DISCOUNT, and share = PMI / IC = log2(p(e | t) / p(e)) / log2(1 / p(e)). Copies of a line are one
    line. Entities with the same lines have the same shares, and are worked off as one.
    """
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    held = lines.filter(_suspect(F.col("line"))).groupBy(*_hashes(F.col("line"))).agg(F.first("line").alias("line"))
    found = with_base_spans(held, "line").filter(F.size("spans") > 0)
    masked = F.regexp_replace(F.col("line"), "|".join(f"(?:{PATTERNS[k]})" for k in KINDS), " ")
    contexts = checkpointed(
        found.select(
            "h1",
            "h2",
            F.array_distinct(F.transform("spans", _entity)).alias("entities"),
            F.array_distinct(F.regexp_extract_all(F.lower(masked), F.lit(TERM), F.lit(0))).alias("terms"),
        )
    )
    by_entity = contexts.select("h1", "h2", F.explode("entities").alias("e"))
    same_lines = F.struct(F.count(F.lit(1)).alias("n_e"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    sets = by_entity.groupBy("e").agg(same_lines.alias("s")).select("e", "s.*").filter(F.col("n_e") >= support)
    of_line = checkpointed(by_entity.join(sets, "e").select("h1", "h2", "n_e", "x1", "x2").distinct())
    both = contexts.select("h1", "h2", "terms").join(of_line, ["h1", "h2"]).select("h1", "h2", *SET, F.explode("terms").alias("t"))
    n_et = checkpointed(both.groupBy(*SET, "t").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support))
    if n_et.isEmpty():
        return None
    distinct = lines.groupBy(*_hashes(F.col("line"))).agg(F.first("line").alias("line"))
    words = distinct.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))).alias("t")
    )
    # counted before the join, so that frequent words are one row there
    n_t = words.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    total = lines.select(F.count_distinct(F.xxhash64("line")).alias("n")).first()["n"]
    p_e = F.col("n_e") / F.lit(float(total))
    given = (F.col("n_et") - F.lit(DISCOUNT) + F.lit(DISCOUNT) * p_e) / F.col("n_t")
    share = F.log2(given / p_e) / F.log2(1 / p_e)
    flagged = n_et.filter(F.col("n_e") < total).join(n_t, "t").withColumn("share", share).filter(F.col("share") >= generalise)
    hits = both.join(flagged.select(*SET, "t", "share"), [*SET, "t"])
    worst = hits.groupBy("h1", "h2", "t").agg(F.max("share").alias("share"))
    return worst.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("t", "share"))).alias("terms"))


def _term_spans(docs: DataFrame, terms: DataFrame, remove: float) -> DataFrame:
    """(__d, __t, extra): term spans of every document that has any, positions in the whole text."""
    lines = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(MIN_LONG)).alias("__d"),
        F.xxhash64("text").alias("__t"),
        F.split("text", "\n", -1).alias("__lines"),
    ).filter(_suspect(F.array_join("__lines", "\n")))
    placed = lines.withColumn("__at", running_sum(F.transform("__lines", lambda x: F.length(x) + 1)))
    each = placed.select("__d", "__t", F.explode(F.arrays_zip("__lines", "__at")).alias("x")).select(
        "__d", "__t", F.col("x.__lines").alias("line"), F.col("x.__at").alias("at")
    )
    hit = each.filter(_suspect(F.col("line"))).select("*", *_hashes(F.col("line"))).join(terms, ["h1", "h2"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("terms", lambda x: x["t"]), "|"), F.lit(r")(?!\p{L})"))
    hit = hit.withColumn("pattern", pattern)
    hit = hit.withColumn("found", F.regexp_extract_all("line", F.col("pattern"), F.lit(0))).filter(F.size("found") > 0)
    hit = hit.withColumn("gaps", F.transform(F.split("line", F.col("pattern"), F.lit(-1)), lambda x: F.length(x)))
    hit = hit.withColumn("steps", F.zip_with(F.slice("gaps", F.lit(1), F.size("found")), "found", lambda g, m: g + F.length(m)))
    hit = hit.withColumn("ends", F.zip_with(running_sum(F.col("steps")), "steps", lambda a, b: a + b))
    share = F.map_from_entries("terms")
    spans = F.zip_with(
        "ends",
        "found",
        lambda z, m: F.struct(
            (F.col("at") + z - F.length(m)).alias("start"),
            F.lit(len(KINDS)).alias("rank"),
            (F.col("at") + z).alias("end"),
            F.when(F.coalesce(F.element_at(share, F.lower(m)), F.lit(0.0)) >= remove, F.lit("removed")).otherwise(F.lit("term")).alias("kind"),
            m.alias("value"),
        ),
    )
    flat = hit.select("__d", "__t", F.explode(spans).alias("s")).distinct()
    return flat.groupBy("__d", "__t").agg(F.array_sort(F.collect_list("s")).alias("extra"))


def find_personal_data(
    docs: DataFrame,
    *,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    keep: tuple[str, ...] = ("doc_id", "text"),
) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus ``spans``, an array of (start, rank, end, kind, value).

    Kinds: email, ip, card, phone; ``term`` (to be generalised) and ``removed`` for terms that
    disclose an entity of their line. Spans of a kind don't overlap; terms never overlap base spans.

    Null text is empty and has no spans. Equal rows are judged alike. An empty table gives no rows.
    Extra columns pass if kept; names that begin with ``__`` are reserved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.withColumn("text", text)
    base = with_base_spans(
        whole.select(*keep, *([] if "text" in keep else ["text"]), F.coalesce(F.col("doc_id"), F.lit(MIN_LONG)).alias("__d"), F.xxhash64("text").alias("__t")),
        "text",
        "__base",
    ).select(*keep, "__d", "__t", "__base")
    terms = disclosing_lines(whole, support=support, generalise=generalise)
    if terms is None:
        return base.select(*keep, F.col("__base").alias("spans"))
    extra = _term_spans(whole, terms, remove)
    joined = base.join(extra.hint("shuffle_hash"), ["__d", "__t"], "left")
    free = F.filter(
        "extra", lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )
    return joined.select(
        *keep, F.when(F.col("extra").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", free))).alias("spans")
    )


def sanitise(found: DataFrame) -> DataFrame:
    """Replace every span of (text, spans): base spans and terms by their kind, removed terms by nothing.

    Overlapping base spans are replaced together, under the first one's kind.
    """
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, F.when(F.size(acc) > 0, -1).otherwise(1))["end"] > s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                        F.element_at(acc, -1)["kind"].alias("kind"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))),
    )
    with_cuts = found.withColumn("__cuts", merged).withColumn("__n", F.length("text"))
    starts = F.concat(F.array(F.lit(0)), F.transform("__cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(F.col("__n")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    marks = F.concat(
        F.transform("__cuts", lambda c: F.when(c["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]")))),
        F.array(F.lit("")),
    )
    return with_cuts.withColumn("sanitised", F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, m)), "")).drop("__cuts", "__n")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, keep=("doc_id",))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
