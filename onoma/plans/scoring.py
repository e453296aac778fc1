"""Pairs of names to scores and features: normalise each distinct name once, then join both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.operators.features import features
from onoma.operators.matchers import matcher_scores, sides, with_components


def pair_components(pairs: DataFrame, name_a: str = "name_a", name_b: str = "name_b") -> DataFrame:
    """All columns of ``pairs`` plus both sides (a, b) and the k_* components.

    Null names count as empty ones. Names are joined back by hash joins on the name itself; a name
    that very many pairs share is split by the adaptive planner.
    """
    left, right = (F.coalesce(F.col(c), F.lit("")) for c in (name_a, name_b))
    names = sides(pairs.select(left.alias("name")).union(pairs.select(right.alias("name"))))
    keyed = pairs.withColumns({"__a": left, "__b": right})
    one = keyed.join(names.select(F.col("name").alias("__a"), F.col("side").alias("a")), "__a")
    two = one.join(names.select(F.col("name").alias("__b"), F.col("side").alias("b")), "__b")
    return with_components(two.drop("__a", "__b"))


def score_pairs(pairs: DataFrame, name_a: str = "name_a", name_b: str = "name_b", *, with_features: bool = True) -> DataFrame:
    """All columns of ``pairs`` plus the baseline matchers' scores and the features f_*."""
    parts = pair_components(pairs, name_a, name_b)
    return parts.select(*pairs.columns, *matcher_scores(), *(features() if with_features else []))
