import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("corpus_pipeline")

import corpus_pipeline as cp  # noqa: E402
from onoma.llm import bpe  # noqa: E402
from onoma.llm import decontaminate as d  # noqa: E402
from tests.llm import test_decontaminate as td  # noqa: E402
from tests.llm import test_jaccard_join as tj  # noqa: E402
from tests.llm import test_line_runs as tl  # noqa: E402

BENCH = "the winter market opened late and nobody came to buy the last apples"
LINE = "This line stands in very many of the documents"


def corpus():
    rows = []
    for k in range(60):
        own = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
        rows.append((k, f"{LINE}\n{own}" if k % 2 else own))
    near = rows[7][1].replace("wordhaaa", "other")
    rows += [(100, rows[5][1]), (101, near), (101, near), (102, f"so it goes: {BENCH.upper()} and on"), (103, "123 ???"), (104, None), (105, ""), (900, LINE + "\nkept here"), (None, "some text alone")]
    return [(i, t, "en" if i is None or i % 3 else None, f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow(rows):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    held = {}
    for i, t, *_ in rows:
        for x in t.split("\n"):
            if len(tl.key_of(x)) >= 20:
                held.setdefault(tl.key_of(x), set()).add(-1 if i is None else i)
    keep = lambda i, x: len(held.get(tl.key_of(x), ())) < 3 or max(held[tl.key_of(x)]) == (-1 if i is None else i)
    rows = [(i, "\n".join(x for x in t.split("\n") if keep(i, x))) for i, t, *_ in rows]
    component = {r[0]: r[2] for r in tj.slow(rows, 5, (80, 100))}
    rows = {r for r in rows if r[0] == component[r[0]]}
    return {(i, t) for i, t in rows if not td.slow(t, [(0, BENCH)])[1]}


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = slow(rows)
    assert {101, 102, 103, 104, 105}.isdisjoint(i for i, _ in want) and len(want) == 62
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == want and docs.count() == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    out = cp.run(spark, str(tmp_path)).collect()
    codec = bpe.codec(bpe.default_vocabulary())
    assert {(r["doc_id"], tuple(r["ids"])) for r in out} == {(i, tuple(codec.encode(t))) for i, t in want}
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_columns_with_the_operators_names_stay(spark, tmp_path):
    spark.createDataFrame([(0, BENCH)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["lang_pred", "score", "n_lines", "n_dropped", "n_words", "hit_ranges", "hit_items", "sid", "n", "root", "th", "tokens"]
    row = (1, "some plain words to keep", "en", "s", 24, *[f"my {c}" for c in names])
    docs = spark.createDataFrame([row], SCHEMA + "".join(f", {c} string" for c in names))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [tuple(r) for r in docs.collect()] == [row]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_no_language_named(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", None, "s", 5)], SCHEMA)
    assert cp.language(spark, docs, "").count() == 1


assert d.WINDOW == 10
