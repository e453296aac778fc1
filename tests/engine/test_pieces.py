"""The kernels that meet whole texts: a worker's memory does not follow the size of a batch, and rows stay the same."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from onoma.functions import kernels as k
from onoma.functions import vocab

PARTS = pa.list_(pa.string())
QUALIFIERS = {*vocab.SLASH_QUALIFIERS, *vocab.SPELLED_QUALIFIERS}
DROPPED = {*vocab.HONORIFICS, *vocab.SUFFIXES, *vocab.NOISE}
LEXICON = vocab.spelling_lexicon()


def plain_canonical(key):
    folded = re.sub(r"(.)\1+", r"\1", key)
    folded = folded[:-1] if len(folded) > 3 and folded[-1] in "hyed" else folded
    return LEXICON.get(key) or LEXICON.get(folded, folded)


def plain_tokens(parts):
    """The definition, part by part."""
    out = {"tokens": [], "canonical": [], "dropped": [], "initials": [], "unreadable": []}
    related = False
    for w in parts or []:
        key = w if w in vocab.SLASH_QUALIFIERS else re.sub("[^a-z0-9]+", "", w)
        related |= key in QUALIFIERS
        if any(c.isalpha() and not c.isascii() for c in w):
            out["unreadable"].append(w)
        if key and (related or key in DROPPED):
            out["dropped"].append(key)
        elif key:
            if len(key) == 1 and key.isalpha():
                out["initials"].append(len(out["tokens"]))
            out["tokens"].append(key)
            out["canonical"].append(plain_canonical(key))
    return out


def some_parts(draw):
    special = [*LEXICON, *QUALIFIERS, *DROPPED, "", "1", "x", "--", "s/o.", "अ", "ж1", "é", "a\nn", "\x00"]
    return draw.choice(special) if draw.random() < 0.3 else "".join(draw.choices("aabbhyedz019-.'/ж", k=draw.randint(1, 9)))


def rows_of(udf, *batches):
    return [x for piece in udf.func(iter(batches)) for x in piece.to_pylist()]


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_pieces_hold_the_same_rows(monkeypatch, most):
    monkeypatch.setattr(k, "PIECE_PARTS", most)
    monkeypatch.setattr(k, "PIECE_BYTES", most)
    draw = random.Random(most)
    rows = [draw.choice([None, [some_parts(draw) for _ in range(draw.choice([0, 1, 2, 5, 40]))]]) for _ in range(300)]
    batch = pa.array(rows, PARTS)
    assert rows_of(k.name_tokens_udf, batch, batch.slice(3), batch.slice(0, 0)) == [plain_tokens(x) for x in rows + rows[3:]]
    texts = [None if x is None else " ".join(x) for x in rows]
    assert rows_of(k.fold_diacritics_udf, pa.array(texts, pa.string())) == [None if x is None else k.fold_diacritics(x) for x in texts]


@pytest.mark.parametrize(("udf", "kind"), [("name_tokens_udf", "parts"), ("fold_diacritics_udf", "text")])
def test_memory_does_not_follow_the_batch(udf, kind):
    """A batch of eight times the rows takes no more beside itself."""

    def peak(rows):
        words = [f"w{x}é" for x in range(5000)]
        values = [words[n % 50 :] if kind == "parts" else f"{n} " + " ".join(words[:4000]) for n in range(rows)]
        batch = pa.array(values, PARTS if kind == "parts" else pa.string())
        del values
        tracemalloc.start()
        arrow, most = pa.total_allocated_bytes(), 0
        for _ in getattr(k, udf).func(iter([batch])):
            most = max(most, pa.total_allocated_bytes() - arrow)
        most += tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(10)
    assert peak(1600) < 1.5 * peak(200)


def test_kernels_in_one_select(spark):
    k.register(spark)
    got = spark.sql("SELECT fold_diacritics('é') AS a, fold_diacritics('Søren') AS b, jaro(fold_diacritics('é'), 'e') AS c").first()
    assert tuple(got) == ("e", "Soren", 1.0)
