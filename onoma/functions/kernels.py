"""Kernels that Spark has no built-in for, as plain Python functions and as Arrow UDFs.

The UDFs work on whole Arrow batches and compute each distinct input of a batch once; those that meet whole
texts work a batch off in pieces and hand each on before the next.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onoma.functions import vocab

MEMO = 50_000
#: Parts of names, and bytes of text, that a piece of a batch holds, unless a single row has more.
PIECE_PARTS, PIECE_BYTES = 200_000, 2_000_000


def fold_diacritics(text: str) -> str:
    """Letters without their marks; letters that don't decompose are spelled out."""
    if text.isascii():
        return text
    bare = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", "".join(vocab.LATIN_LETTERS.get(c, c) for c in bare))


def osa_distance(a: str, b: str) -> int:
    """Edits that turn a into b, a swap of neighbours being one; no part is edited twice."""
    before, last, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, last, row = last, row, [i + 1]
        for j, y in enumerate(b):
            best = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 1)
            row.append(best)
    return row[-1]


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half of the matched characters that stand in another order count as transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, x in enumerate(a):
        j = b.find(x, max(0, i - reach), i + reach + 1)
        while j >= 0 and not free[j]:
            j = b.find(x, j + 1, i + reach + 1)
        if j >= 0:
            free[j] = False
            mine.append(x)
    m = len(mine)
    if not m:
        return 0.0
    theirs = (y for y, f in zip(b, free, strict=True) if not f)
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True))
    return (m / len(a) + m / len(b) + (m - moved / 2.0) / m) / 3.0


def jaro_winkler(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    """Jaro, raised by a shared beginning where it is 0.7 or more; 1 at most."""
    base = jaro(a, b)
    if base < 0.7:
        return base
    shared = shared_prefix(a[:most], b[:most])
    return min(1.0, base + shared * weight * (1.0 - base)) if shared else base


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def common_substring_ratio(a: str, b: str) -> float:
    """Length of the longest common substring over that of the longer string; 0 if one is empty."""
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    best = 0
    for i in range(len(short)):
        while i + best < len(short) and short[i : i + best + 1] in long:
            best += 1
    return best / len(long)


_WIDTHS = sorted({len(p) for p in vocab.METAPHONE_PATTERNS}, reverse=True)


@lru_cache(MEMO)
def metaphone(token: str) -> str:
    """Phonetic code by the pattern table: widest pattern first, no code twice in a row."""
    word = "".join(c for c in token.upper() if c.isalpha())
    start = next((p for p in vocab.METAPHONE_BEGINNINGS if word.startswith(p)), None)
    if start and len(word) > 1:
        word = vocab.METAPHONE_BEGINNINGS[start] + word[len(start) :]
    codes: list[str] = []
    at = 0
    while at < len(word):
        width = next((w for w in _WIDTHS if word[at : at + w] in vocab.METAPHONE_PATTERNS and at + w <= len(word)), 0)
        if not width:
            at += 1
            continue
        part = word[at : at + width]
        code = vocab.METAPHONE_PATTERNS[part]
        at += width
        if code and "".join(codes[-len(code) :]) != code:
            codes.append(code)
        if width == 1:
            at += word[at : at + 1] == part
            silent = part in vocab.METAPHONE_SILENT_AFTER_VOWEL and codes[-1:] == [part]
            if silent and len(codes) > 1 and codes[-2] in "AEIOU":
                del codes[-1]
    return "".join(codes)


@lru_cache(MEMO)
def metaphone_codes(token: str) -> tuple[str, ...]:
    """The token's code, those with one V read as F or F as V, and that with a leading V read as W."""
    word = token.upper()
    swap = {"V": "F", "F": "V"}
    other = [word[:k] + swap[c] + word[k + 1 :] for k, c in enumerate(word) if c in swap]
    if word[:1] == "V":
        other.append("W" + word[1:])
    return tuple(sorted({metaphone(token), *filter(None, map(metaphone, other))}))


def _each(fn: Callable, *columns: Iterable) -> list:
    """fn over rows, once per distinct row; None where an input is None."""
    memo: dict = {}
    out = []
    for row in zip(*columns, strict=True):
        if any(x is None for x in row):
            out.append(None)
            continue
        if row not in memo:
            memo[row] = fn(*row)
        out.append(memo[row])
    return out


def _pieces(batch: pa.Array, length: Callable[[pa.Array], pa.Array], most: int) -> Iterator[pa.Array]:
    """The batch in runs of whole rows, whose lengths add up to ``most`` or which are one row. Nothing is copied."""
    ends = np.cumsum(pc.fill_null(length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, ends[to - 1]


@F.arrow_udf(T.StringType())
def fold_diacritics_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for piece in _pieces(batch, pc.binary_length, PIECE_BYTES):
            yield pa.array(_each(fold_diacritics, piece.to_pylist()), pa.string())


@F.pandas_udf(T.StringType())
def metaphone_udf(s: pd.Series) -> pd.Series:
    return pd.Series(_each(metaphone, s), dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def metaphone_codes_udf(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else list(x) for x in _each(metaphone_codes, s)], dtype=object)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def token_codes_udf(s: pd.Series) -> pd.Series:
    """For an array of tokens the array of their code lists."""
    return pd.Series([[list(metaphone_codes(t)) for t in ts] for ts in s], dtype=object)


@F.pandas_udf(T.DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each(jaro, a, b), dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each(jaro_winkler, a, b), dtype="float64")


@F.pandas_udf(T.IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each(osa_distance, a, b), dtype="Int32")


@F.pandas_udf(T.DoubleType())
def common_substring_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_each(common_substring_ratio, a, b), dtype="float64")


NAME_TOKENS = T.StructType(
    [
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("canonical", T.ArrayType(T.StringType())),
        T.StructField("dropped", T.ArrayType(T.StringType())),
        T.StructField("initials", T.ArrayType(T.IntegerType())),
        T.StructField("unreadable", T.ArrayType(T.StringType())),
    ]
)
_SLASHED = pa.array(vocab.SLASH_QUALIFIERS, pa.string())
_QUALIFIERS = pa.array([*vocab.SLASH_QUALIFIERS, *vocab.SPELLED_QUALIFIERS], pa.string())
_DROPPED = pa.array([*vocab.HONORIFICS, *vocab.SUFFIXES, *vocab.NOISE], pa.string())


@lru_cache(1)
def _lexicon_arrays() -> tuple[pa.Array, pa.Array]:
    found = vocab.spelling_lexicon()
    return pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.string())


def _generic_folds(keys: pa.Array) -> pa.Array:
    """The folded form (see native.generic_fold) of each ASCII key: runs to one letter, then no h, y, e or d at the end of over three."""
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    text = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    stays = np.ones(len(text), bool)
    stays[1:] = text[1:] != text[:-1]
    stays[ends[:-1][ends[1:] > ends[:-1]]] = True
    text, ends = text[stays], np.concatenate([[0], np.cumsum(stays)])[ends]
    last = ends[1:][np.diff(ends) > 3] - 1
    last = last[np.isin(text[last], np.frombuffer(b"hyed", np.uint8))]
    stays = np.ones(len(text), bool)
    stays[last] = False
    text, ends = text[stays], np.concatenate([[0], np.cumsum(stays)])[ends]
    return pa.StringArray.from_buffers(len(keys), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))


def canonical_tokens(keys: pa.Array) -> pa.Array:
    """Spelling class of each ASCII key, or of its folded form, or else the folded form (see native.canonical_token)."""
    known, classes = _lexicon_arrays()
    folded = _generic_folds(keys)
    return pc.coalesce(classes.take(pc.index_in(keys, known)), classes.take(pc.index_in(folded, known)), folded)


def name_tokens(parts: pa.Array) -> pa.Array:
    """Parts of names to their tokens and what was left out, see normalize.with_normalized.

    Strings are only looked at once for each distinct part, as whole arrays; the rest are array operations
    over part numbers.
    """
    words = parts.flatten().dictionary_encode()
    text = words.dictionary.cast(pa.string())
    # what a part is compared by: letters and digits, or a slash marker
    keys = pc.if_else(pc.is_in(text, _SLASHED), text, pc.replace_substring_regex(text, "[^a-z0-9]+", ""))
    bits = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    at = words.indices.to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size

    length = pc.binary_length(keys).to_numpy(zero_copy_only=False)
    filled = (length > 0)[at]
    seen = np.concatenate([[0], np.cumsum(bits(pc.is_in(keys, _QUALIFIERS))[at])])
    related = seen[1:] > seen[first[row]]  # the qualifier and all after it
    stays = filled & ~related & ~bits(pc.is_in(keys, _DROPPED))[at]
    foreign = ~bits(pc.string_is_ascii(text))
    foreign[foreign] = [any(c.isalpha() and not c.isascii() for c in w) for w in text.filter(pa.array(foreign)).to_pylist()]
    unreadable = foreign[at]

    def lists(values: pa.Array, chosen: np.ndarray) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=len(size)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def of(forms: pa.Array, chosen: np.ndarray) -> pa.ListArray:
        return lists(forms.take(pa.array(at[chosen])), chosen)

    kept = np.concatenate([[0], np.cumsum(stays)])
    place = (kept[:-1] - kept[first[row]]).astype(np.int32)
    initial = stays & ((length == 1) & bits(pc.utf8_is_alpha(keys)))[at]
    columns = [of(keys, stays), of(canonical_tokens(keys), stays), of(keys, filled & ~stays), lists(pa.array(place[initial]), initial), of(text, unreadable)]
    return pa.StructArray.from_arrays(columns, NAME_TOKENS.names)


@F.arrow_udf(NAME_TOKENS)
def name_tokens_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """name_tokens of every row. The tables of a piece are freed before the next, so that a worker holds its input and little more."""
    for batch in batches:
        for piece in _pieces(batch, pc.list_value_length, PIECE_PARTS):
            yield name_tokens(piece)


PAIR_KERNELS = T.StructType(
    [
        T.StructField("jw_sorted", T.DoubleType()),
        T.StructField("jw_ordered", T.DoubleType()),
        T.StructField("osa_sorted", T.IntegerType()),
        T.StructField("lcs_sorted", T.DoubleType()),
        T.StructField("osa", T.ArrayType(T.IntegerType())),
    ]
)


@F.pandas_udf(PAIR_KERNELS)
def pair_kernels_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All kernels of a pair of canonical token arrays in one pass; ``osa`` is the token matrix, row by row."""

    @lru_cache(MEMO)
    def row(x: tuple[str, ...], y: tuple[str, ...]) -> tuple:
        sx, sy = " ".join(sorted(x)), " ".join(sorted(y))
        return (
            jaro_winkler(sx, sy), jaro_winkler(" ".join(x), " ".join(y)), osa_distance(sx, sy), common_substring_ratio(sx, sy),
            [osa_distance(p, q) for p in x for q in y],
        )

    rows = [row(tuple(x), tuple(y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=PAIR_KERNELS.names)


def register(spark) -> None:
    """Make the kernels callable from SQL text."""
    for name, udf in {
        "fold_diacritics": fold_diacritics_udf, "metaphone": metaphone_udf, "metaphone_codes": metaphone_codes_udf, "jaro": jaro_udf,
        "jaro_winkler": jaro_winkler_udf, "osa_distance": osa_udf, "common_substring_ratio": common_substring_udf,
    }.items():
        spark.udf.register(name, udf)
