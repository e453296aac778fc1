"""The 23 pair features, in the order that models rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from onoma.functions import native, vocab
from onoma.operators.normalize import canonical_text, sorted_text

# Names and order of the features.
FEATURES = (
    "exact_normalized token_jaccard token_dice bigram_jaccard trigram_jaccard jaro_winkler_sorted "
    "jaro_winkler_ordered damerau_ratio prefix_ratio lcs_ratio phonetic_mean phonetic_max "
    "soundex_full_match coverage agreement order_bonus char_signal n_token_diff has_initial_either "
    "dropped_honorific dropped_qualifier length_ratio same_token_count"
).split()


def features(prefix: str = "f_") -> list[Column]:
    """A column for each feature of a pair with components; all 0 if a side is empty.

    Pairs with unreadable tokens have no phonetic or alignment evidence: those features are 0.
    """
    a, b = F.col("a"), F.col("b")
    text_a, text_b, sorted_a, sorted_b = canonical_text(a), canonical_text(b), sorted_text(a), sorted_text(b)
    readable = lambda c: F.when(F.col("k_undecidable"), 0.0).otherwise(F.col(c))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    drops = lambda words: F.arrays_overlap(F.concat(a["dropped"], b["dropped"]), F.array(*map(F.lit, words)))
    longest = F.greatest(F.length(sorted_a), F.length(sorted_b), F.lit(1))
    len_a, len_b = F.length(text_a), F.length(text_b)
    sx_a, sx_b = native.soundex(text_a), native.soundex(text_b)
    values = {
        "exact_normalized": flag(F.col("k_exact")),
        "token_jaccard": F.col("k_jaccard"),
        "token_dice": native.set_dice(a["canonical"], b["canonical"]),
        "bigram_jaccard": native.ngram_jaccard(sorted_a, sorted_b, 2),
        "trigram_jaccard": native.ngram_jaccard(sorted_a, sorted_b, 3),
        "jaro_winkler_sorted": F.col("k_jw_sorted"),
        "jaro_winkler_ordered": F.col("k_jw_ordered"),
        "damerau_ratio": 1.0 - F.col("k_osa_sorted") / longest.cast("double"),
        "prefix_ratio": native.prefix_ratio(sorted_a, sorted_b),
        "lcs_ratio": F.col("k_lcs_sorted"),
        "phonetic_mean": readable("k_phonetic_mean"),
        "phonetic_max": readable("k_phonetic_max"),
        "soundex_full_match": flag((sx_a != "") & (sx_a == sx_b)),
        "coverage": readable("k_coverage"),
        "agreement": readable("k_agreement"),
        "order_bonus": readable("k_order_bonus"),
        "char_signal": F.col("k_jw_sorted"),
        "n_token_diff": F.abs(F.size(a["canonical"]) - F.size(b["canonical"])).cast("double"),
        "has_initial_either": flag((F.size(a["initials"]) > 0) | (F.size(b["initials"]) > 0)),
        "dropped_honorific": flag(drops([*vocab.HONORIFICS, *vocab.SUFFIXES])),
        "dropped_qualifier": flag(drops([*vocab.SLASH_QUALIFIERS, *vocab.SPELLED_QUALIFIERS])),
        "length_ratio": F.when(F.greatest(len_a, len_b) > 0, F.least(len_a, len_b) / F.nullif(F.greatest(len_a, len_b), F.lit(0)).cast("double")).otherwise(0.0),
        "same_token_count": flag(F.size(a["canonical"]) == F.size(b["canonical"])),
    }
    return [F.when(F.col("k_empty"), 0.0).otherwise(values[f]).alias(prefix + f) for f in FEATURES]
