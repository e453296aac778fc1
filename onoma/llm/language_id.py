"""Language identification with rank-order n-gram profiles (Cavnar and Trenkle's out-of-place distance).

A profile is the list of the most frequent character n-grams, n = 1 to 3, of words padded with one
boundary mark. Every language's profile comes from counts over all its training documents; a document
goes to the language whose profile puts the document's own n-grams the fewest places from where the
document has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from onoma.llm.common import crc_mod, read_table

#: N-grams in a profile.
PROFILE = 400
#: Profile rows that a driver and a broadcast may hold; more means the column holds no languages.
MOST_ROWS = 2_000_000
#: Texts whose n-grams are held at a time.
PIECE = 256
BITS = 21
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str) -> np.ndarray:
    """All n-grams of the words' letters, as integers that hold the code points; empty without letters.

    Within a number the code points stand 21 bits apart; the boundary mark is 1, an absent place 0.
    """
    points = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = points > 0
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each word stays as its boundary
    s = np.concatenate([[1], np.where(letter, points, 1)[keep], [1]]).astype(np.int64)
    mid = s > 1
    two = s[:-1] << BITS | s[1:]
    three = two[:-1] << BITS | s[2:]
    # a pair has a letter, a triple's middle is one: no n-gram runs over a boundary
    return np.concatenate([s[mid], two[mid[:-1] | mid[1:]], three[mid[1:-1]]])


def top_ngrams(text: str, most: int) -> np.ndarray:
    """The text's most frequent n-grams, first the most frequent, ties by number."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:most]]


def _added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Two tables of (n-gram, count) rows as one."""
    if a is None:
        return b
    both = np.concatenate([a, b], axis=1)
    grams, at = np.unique(both[0], return_inverse=True)
    return np.stack([grams, np.bincount(at, both[1], len(grams)).astype(np.int64)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows of (lang, text); every batch is summed up, piece by piece, before it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for lo in range(0, b.num_rows, PIECE):
                part = b.slice(lo, PIECE)
                found: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0), part.column(1), strict=True):
                    found.setdefault(lang.as_py(), []).append(ngrams(text.as_py()))
                for lang, grams in found.items():
                    table = np.stack(np.unique(np.concatenate(grams), return_counts=True))
                    sums[lang] = _added(sums.get(lang), table)
            for lang, (g, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    parts = rows.mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """(lang, gram, place): every language's most frequent n-grams over all rows, ties by number."""
    order = W.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    # stated as row_number <= k, every task keeps its own first k before anything is sorted in one place
    ranked = gram_counts(docs).withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= profile)
    return ranked.select("lang", "gram", (F.col("__nth") - 1).alias("place"))


class Classifier:
    """Profiles as one matrix: a row for each language, a column for each n-gram of any profile."""

    def __init__(self, rows: list[tuple[str, int, int]], profile: int = PROFILE):
        self.profile = profile
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.place = np.full((len(self.langs), len(self.grams) + 1), profile, np.int32)
        at = np.searchsorted(self.grams, [r[1] for r in rows])
        row = {v: k for k, v in enumerate(self.langs)}
        for (lang, _, place), k in zip(rows, at, strict=True):
            self.place[row[lang], k] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and confidence: the runner-up's share of the best two distances, 0.5 to 1."""
        grams = top_ngrams(text, self.profile) if text else np.zeros(0, np.int64)
        if not len(grams) or not self.langs:
            return UNDETERMINED, 0.0
        k = np.searchsorted(self.grams, grams)
        k[(k >= len(self.grams)) | (self.grams[np.minimum(k, len(self.grams) - 1)] != grams)] = len(self.grams)
        place = self.place[:, k]
        moved = np.abs(place - np.arange(len(grams), dtype=np.int32))
        distance = np.where(place == self.profile, self.profile, moved).sum(1)
        best = int(distance.argmin())
        others = np.delete(distance, best)
        second = int(others.min()) if len(others) else self.profile * len(grams)
        total = int(distance[best]) + second
        return self.langs[best], second / total if total else 0.5


def identify(docs: DataFrame, profiles: DataFrame, *, profile: int = PROFILE, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (columns of these names are replaced).

    ``und`` and 0 where the text is null or has no letter, or where nothing was learned. Ties between
    languages go to the first by name. Rows are judged one by one, whole texts, whatever their length.
    """
    rows = [tuple(r) for r in profiles.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} profile rows: the lang column does not hold languages")
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    names = [f.name for f in kept if keep_text or f.name != "text"]
    state: list[Classifier] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Classifier(shared.value, profile))
        for b in batches:
            found = [state[0].predict(t.as_py()) for t in b.column(b.schema.names.index("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.names.index(n)) for n in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name in names)
    return docs.select(*[f.name for f in kept]).mapInArrow(run, f"{ddl}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))
    out = identify(docs.select("doc_id", "text"), profiles, keep_text=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
