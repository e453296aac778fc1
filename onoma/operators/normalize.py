"""Names to structured tokens.

Names are cut into parts by native expressions; only names with other letters than ASCII go through the
diacritics kernel, on a branch of their own, because a UDF under CASE WHEN would run on every row.
Parts become tokens in one Arrow pass without a shuffle, which looks at distinct parts of a batch once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onoma.functions import vocab
from onoma.functions.kernels import NAME_TOKENS, fold_diacritics_udf, name_tokens_udf

ASCII = r"^[\x00-\x7F]*$"


def with_normalized(df: DataFrame, folded: str, raw: Column, out: str) -> DataFrame:
    """Add ``out``: struct (raw, tokens, canonical, dropped, initials, unreadable) of the folded name.

    Slash markers are cut free anywhere; parts lie between white space. A qualifier and all after it,
    titles, suffixes and noise are dropped. Rows never move.
    """
    markers = "(" + "|".join(vocab.SLASH_QUALIFIERS) + ")"
    spread = F.regexp_replace(F.lower(folded), markers, " $1 ")
    df = df.withColumn("__x", name_tokens_udf(F.split(spread, r"(?U)[\s\x1c-\x1f]+")))
    norm = F.struct(raw.alias("raw"), *[F.col(f"__x.{c}").alias(c) for c in NAME_TOKENS.names])
    return df.withColumn(out, norm).drop("__x")


def fold_names(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: the name without diacritics (null: empty)."""
    name = F.coalesce(F.col(col), F.lit(""))
    plain = df.filter(name.rlike(ASCII)).withColumn(out, name)
    other = df.filter(~name.rlike(ASCII)).withColumn(out, fold_diacritics_udf(F.col(col)))
    return plain.unionByName(other)


def normalize_names(df: DataFrame, col: str = "name", out: str = "norm") -> DataFrame:
    """Add the struct ``out`` for every row. A null name is an empty one and has no tokens."""
    folded = fold_names(df, col, "__folded")
    return with_normalized(folded, "__folded", F.coalesce(F.col(col), F.lit("")), out).drop("__folded")


def is_empty(norm: Column) -> Column:
    return F.size(norm["canonical"]) == 0


def undecidable(norm: Column) -> Column:
    return F.size(norm["unreadable"]) > 0


def text(norm: Column) -> Column:
    return F.array_join(norm["tokens"], " ")


def canonical_for(norm: Column, i: Column | int) -> Column:
    """Canonical form of the i-th token, null beyond the last."""
    return F.get(norm["canonical"], F.lit(i) if isinstance(i, int) else i)


def canonical_text(norm: Column) -> Column:
    return F.array_join(norm["canonical"], " ")


def sorted_text(norm: Column) -> Column:
    return F.array_join(F.array_sort(norm["canonical"]), " ")


def initial_tokens(norm: Column) -> Column:
    return F.transform(norm["initials"], lambda i: F.get(norm["tokens"], i))


def roles(norm: Column) -> Column:
    """Given, middle and family part by place: first, between, last; one token alone is a given name."""
    t = norm["tokens"]
    n = F.size(t)
    return F.struct(
        F.coalesce(F.get(t, F.lit(0)), F.lit("")).alias("given"),
        F.array_join(F.slice(t, F.lit(2), F.greatest(n - 2, F.lit(0))), " ").alias("middle"),
        F.when(n > 1, F.get(t, n - 1)).otherwise(F.lit("")).alias("family"),
    )
