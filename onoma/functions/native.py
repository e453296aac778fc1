"""String functions as Column expressions: all JVM-side, inside whole-stage code where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from onoma.functions.vocab import spelling_lexicon


def _safe_ratio(part: Column, whole: Column, otherwise: float) -> Column:
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0)).cast("double")).otherwise(F.lit(float(otherwise)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - _safe_ratio(F.levenshtein(a, b), longer, 0)


def ngram_set(s: Column, n: int = 2) -> Column:
    """Distinct n-grams of the string between two blanks; none of the empty string."""
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 1 for two empty arrays."""
    return _safe_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 1)


def set_dice(a: Column, b: Column) -> Column:
    """Twice the shared over the sum of distinct elements; 1 for two empty arrays."""
    return _safe_ratio(2 * F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)), 1)


def set_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def ngram_jaccard(a: Column, b: Column, n: int = 2) -> Column:
    return set_jaccard(ngram_set(a, n), ngram_set(b, n))


def ngram_dice(a: Column, b: Column, n: int = 2) -> Column:
    return set_dice(ngram_set(a, n), ngram_set(b, n))


def is_prefix(a: Column, b: Column) -> Column:
    """One string begins with the other; never for an empty one."""
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the beginning that two strings share."""
    shorter = F.least(F.length(a), F.length(b))
    k = F.filter(F.sequence(F.lit(0), shorter), lambda n: F.left(a, n) == F.left(b, n))
    return F.array_max(k)


def prefix_ratio(a: Column, b: Column) -> Column:
    """Shared beginning over the shorter length; 0 if one is empty."""
    return _safe_ratio(shared_prefix(a, b), F.least(F.length(a), F.length(b)), 0)


def soundex(s: Column) -> Column:
    """Four-character Soundex of the ASCII letters; empty without any."""
    letters = F.regexp_replace(F.lower(s), "[^a-z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.soundex(letters))


def phonetic_agreement(a: Column, b: Column) -> Column:
    """1 if Soundex and Metaphone agree, 0.8 if one does, else 0. Sides: struct(word, sx, mp), see token_struct."""
    lettered = a["word"].rlike("^[A-Za-z]+$") & b["word"].rlike("^[A-Za-z]+$")
    sx, mp = a["sx"] == b["sx"], F.arrays_overlap(a["mp"], b["mp"])
    return F.when(lettered, F.when(sx & mp, 1.0).when(sx | mp, 0.8).otherwise(0.0)).otherwise(F.lit(0.0))


def collapse_runs(s: Column) -> Column:
    return F.regexp_replace(s, r"(.)\1+", "$1")


def generic_fold(token: Column) -> Column:
    """Every run of a letter becomes one; then one closing h, y, e or d goes if more than three letters are there."""
    folded = collapse_runs(token)
    return F.when((F.length(folded) > 3) & F.right(folded, F.lit(1)).isin("h", "y", "e", "d"), F.left(folded, F.length(folded) - 1)).otherwise(folded)


def lexicon_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in spelling_lexicon().items() for x in pair])


def canonical_token(token: Column) -> Column:
    """Spelling class of the token, or of its folded form, or else the folded form."""
    lexicon, folded = lexicon_map(), generic_fold(token)
    return F.coalesce(lexicon[token], lexicon[folded], folded)


def sigmoid(z: Column) -> Column:
    """Logistic function without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
