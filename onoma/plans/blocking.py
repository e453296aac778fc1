"""Candidate pairs for tables that can't be compared in full. An extension: the pair list is a given elsewhere.

Names meet only if they share a key (an exact token, a Soundex code, a canonical token), so the join is
an equi-join; a key that very many names have is left to the adaptive planner, which splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.functions import native
from onoma.operators.normalize import normalize_names

KEYS = {
    "token": lambda norm: norm["tokens"],
    "canonical": lambda norm: norm["canonical"],
    "soundex": lambda norm: F.transform(norm["canonical"], native.soundex),
}


def _keys(norm: Column, names: tuple[str, ...]) -> Column:
    parts = [F.transform(F.array_distinct(KEYS[k](norm)), lambda t: F.concat(F.lit(f"{k}:"), t)) for k in names]  # noqa: B023
    return F.concat(*parts)


def candidates(names: DataFrame, col: str, keys: tuple[str, ...] = ("canonical", "soundex")) -> DataFrame:
    """(a, b), a < b: names that share a key. Names without tokens meet nothing."""
    n = normalize_names(names.select(F.col(col).alias("name")).distinct(), "name")
    x = n.select("name", F.explode(_keys(F.col("norm"), keys)).alias("k"))
    left, right = x.select(F.col("name").alias("a"), "k"), x.select(F.col("name").alias("b"), "k")
    return left.join(right, "k").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
