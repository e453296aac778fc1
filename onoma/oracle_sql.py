"""SQL that states the queries' results independently, for an engine without our kernels."""

from __future__ import annotations

from onoma.functions import vocab

NAMES = "n AS (SELECT DISTINCT p_name AS s FROM part), p AS (SELECT x.s AS a, y.s AS b FROM n x JOIN n y ON x.s < y.s)"
WORDS = (
    "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS s FROM part), "
    "wp AS (SELECT x.s AS a, y.s AS b FROM w x JOIN w y ON x.s < y.s)"
)


def ngrams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 4 - {n}), lambda i: substring(' ' || {x} || ' ', i, {n})))"


def jaccard(x: str, y: str) -> str:
    return f"(len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))))"


def dice(x: str, y: str) -> str:
    return f"(2 * len(list_intersect({x}, {y})) / (len(list_distinct({x})) + len(list_distinct({y}))))"


def shared_prefix(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda k: substring({a}, 1, k) = substring({b}, 1, k)))"


def jaro_ctes(source: str, name: str = "j") -> str:
    """CTEs that end in ``name``(a, b, jaro, jw) over the rows of source(a, b); by the definition, position by position."""
    return f"""
{name}_m AS (SELECT a, b, list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]),
    lambda acc, x: acc || [coalesce(list_filter(range(greatest(1, x[1] - greatest(greatest(length(a), length(b)) // 2 - 1, 0)),
        least(length(b), x[1] + greatest(greatest(length(a), length(b)) // 2 - 1, 0)) + 1),
        lambda j: substring(b, j, 1) = substring(a, x[1], 1) AND NOT list_contains(acc, j))[1], 0)], []::BIGINT[]) AS hit FROM {source}),
{name}_s AS (SELECT a, b, list_filter(hit, lambda j: j > 0) AS js,
    list_transform(list_filter(range(1, length(a) + 1), lambda i: hit[i] > 0), lambda i: substring(a, i, 1)) AS mine FROM {name}_m),
{name}_t AS (SELECT a, b, len(js) AS m, len(list_filter(range(1, len(js) + 1),
    lambda k: mine[k] <> substring(b, list_sort(js)[k], 1))) AS moved FROM {name}_s),
{name}_j AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN m = 0 THEN 0.0::DOUBLE ELSE
    (m / length(a) + m / length(b) + (m - moved / 2.0::DOUBLE) / m) / 3.0::DOUBLE END AS jaro FROM {name}_t),
{name} AS (SELECT a, b, jaro, CASE WHEN jaro < 0.7::DOUBLE THEN jaro ELSE least(1.0::DOUBLE,
    jaro + least({shared_prefix('a', 'b')}, 4) * 0.1::DOUBLE * (1.0::DOUBLE - jaro)) END AS jw FROM {name}_j)"""


def osa_cte(source: str, name: str = "o") -> str:
    """``name``(a, b, osa): optimal string alignment row by row, carrying the last two rows."""
    return f"""
{name} AS (SELECT a, b, list_reduce(list_transform(range(1, length(a) + 1), lambda i: [[i]]), lambda acc, x: [acc[2],
    list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda r, y: r || [least(acc[2][y[1] + 1] + 1, r[y[1]] + 1,
        acc[2][y[1]] + CASE WHEN substring(a, x[1][1], 1) = substring(b, y[1], 1) THEN 0 ELSE 1 END,
        CASE WHEN x[1][1] > 1 AND y[1] > 1 AND substring(a, x[1][1], 1) = substring(b, y[1] - 1, 1)
             AND substring(a, x[1][1] - 1, 1) = substring(b, y[1], 1) THEN acc[1][y[1] - 1] + 1 ELSE 1000000 END)], [x[1][1]])],
    [[]::BIGINT[], range(0, length(b) + 1)])[2][length(b) + 1] AS osa FROM {source})"""


def lcs_ratio(a: str, b: str) -> str:
    return (
        f"(list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(0, length({a}) - i + 2), "
        f"lambda l: CASE WHEN contains({b}, substring({a}, i, l)) THEN l ELSE 0 END)))) / greatest(length({a}), length({b})))"
    )


def soundex(x: str) -> str:
    letters = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    rest = f"left({letters}, 1) || regexp_replace(substring({letters}, 2), '[hw]', '', 'g')"
    code = f"translate({rest}, 'bfpvcgjkqsxzdtlmnraeiouyhw', '11112222222233455600000000')"
    for d in "0123456":
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    digits = f"left(replace(substring({code}, 2), '0', '') || '000', 3)"
    return f"CASE WHEN {letters} = '' THEN '' ELSE upper(left({letters}, 1)) || {digits} END"


#: Codes of the words of part names, traced by hand through the pattern table.
METAPHONE_BY_HAND = {
    "anvil": "ENFIL", "blue": "BLUE", "bolt": "BOLT", "cold": "KOLT", "gear": "KER", "gizmo": "KISMO", "hot": "OT", "large": "LERKE",
    "new": "NE", "old": "OLT", "plate": "PLETE", "red": "RET", "ring": "RING", "rod": "ROT", "small": "SMEL", "widget": "WIJT",
}
METAPHONE = "mp AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in METAPHONE_BY_HAND.items()) + ") AS t(s, code))"


def fold(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


def folded_trimmed(x: str) -> str:
    return f"CASE WHEN length({x}) > 3 AND right({x}, 1) IN ('h', 'y', 'e', 'd') THEN left({x}, length({x}) - 1) ELSE {x} END"


LEXICON = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in vocab.spelling_lexicon().items()) + ") AS t(word, class))"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def normalised_ctes(source: str) -> str:
    """CTEs over source(id, name) that end in nrm(id, tokens, canonical, dropped, initials, unreadable)."""
    markers = "|".join(vocab.SLASH_QUALIFIERS)
    drop = _in([*vocab.HONORIFICS, *vocab.SUFFIXES, *vocab.NOISE])
    qualifiers = _in([*vocab.SLASH_QUALIFIERS, *vocab.SPELLED_QUALIFIERS])
    return f"""
{LEXICON},
n0 AS (SELECT id, regexp_replace(lower(replace(strip_accents(name), 'ß', 'ss')), '({markers})', ' \\1 ', 'g') AS s FROM {source}),
n1 AS (SELECT id, generate_subscripts(x, 1) AS pos, unnest(x) AS t FROM (SELECT id, string_split_regex(s, '\\s+') AS x FROM n0)),
n2 AS (SELECT id, pos, t, CASE WHEN t IN {_in(vocab.SLASH_QUALIFIERS)} THEN t ELSE regexp_replace(t, '[^a-z0-9]+', '', 'g') END AS k FROM n1 WHERE t <> ''),
n3 AS (SELECT id, min(pos) AS cut FROM n2 WHERE k IN {qualifiers} GROUP BY id),
n4 AS (SELECT n2.id, pos, k, (cut IS NULL OR pos < cut) AND k NOT IN {drop} AS stays FROM n2 LEFT JOIN n3 ON n2.id = n3.id WHERE k <> ''),
words AS (SELECT DISTINCT k FROM n4 WHERE stays),
f1 AS (SELECT k, {fold('k')} AS f FROM words),
f2 AS (SELECT k, {folded_trimmed('f')} AS f FROM f1),
can AS (SELECT f2.k, coalesce(l.class, m.class, f2.f) AS c FROM f2 LEFT JOIN lex l ON l.word = f2.k LEFT JOIN lex m ON m.word = f2.f),
unread AS (SELECT id, count(*) AS unreadable FROM n2 WHERE regexp_matches(t, '[\\p{{L}}]') AND regexp_matches(t, '[^\\x00-\\x7F]') GROUP BY id),
nrm AS (SELECT s.id, coalesce(list(n4.k ORDER BY pos) FILTER (WHERE stays), []) AS tokens,
    coalesce(list(can.c ORDER BY pos) FILTER (WHERE stays), []) AS canonical,
    coalesce(list(n4.k ORDER BY pos) FILTER (WHERE NOT stays), []) AS dropped
    FROM {source} s LEFT JOIN n4 ON n4.id = s.id LEFT JOIN can ON can.k = n4.k AND n4.stays GROUP BY s.id)"""


#: Two scorers over labelled documents.
SCORED = """
sc AS (SELECT 'length' AS algorithm, d.doc_id, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS score, l.quality AS label, d.lang AS category
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id
       UNION ALL
       SELECT 'remainder', d.doc_id, (d.n_chars % 97) / 97.0::DOUBLE, l.quality, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
CURVE = (
    SCORED
    + """,
g0 AS (SELECT algorithm, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM sc GROUP BY 1, 2),
cv AS (SELECT algorithm, score, pos, neg, CAST(sum(pos) OVER up AS BIGINT) AS tp, CAST(sum(neg) OVER up AS BIGINT) AS fp,
       CAST(sum(neg) OVER al - sum(neg) OVER up AS BIGINT) AS tn, CAST(sum(pos) OVER al - sum(pos) OVER up AS BIGINT) AS fn,
       lead(score) OVER dn AS below, lag(score) OVER dn AS above FROM g0
       WINDOW dn AS (PARTITION BY algorithm ORDER BY score DESC),
              up AS (PARTITION BY algorithm ORDER BY score DESC ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY algorithm))"""
)
#: Candidate thresholds, each recounted against all rows by the decision rule itself.
GRID = (
    CURVE
    + """,
th AS (SELECT algorithm, score AS threshold, 'all' AS kind FROM cv WHERE below IS NULL
       UNION ALL SELECT algorithm, (score + below) / 2.0::DOUBLE, 'mid' FROM cv WHERE below IS NOT NULL
       UNION ALL SELECT algorithm, score, 'top' FROM cv WHERE above IS NULL
       UNION ALL SELECT algorithm, nextafter(score, 'infinity'::DOUBLE), 'none' FROM cv WHERE above IS NULL),
gr AS (SELECT th.algorithm, threshold, kind, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
       count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 0) AS tn,
       count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM th JOIN sc ON th.algorithm = sc.algorithm GROUP BY 1, 2, 3)"""
)


def best(rows: str, order: str, by: str = "algorithm", where: str = "true") -> str:
    return (
        f"SELECT {by}, threshold, tp, fp, tn, fn FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn "
        f"FROM {rows} WHERE {where}) WHERE rn = 1"
    )
