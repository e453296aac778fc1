import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from onoma.llm import line_runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def slow(rows):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20:
                held[key_of(line)].add(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        mine = -1 if d is None else d
        kept = [x for x in lines if len(held[key_of(x)]) < 3 or max(held[key_of(x)]) == mine]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    lines = ["", " ", "short", "x" * 19, "É" * 20, "é" * 20, " " + "wide blank stays here", "A line THAT many share", "  a line that many SHARE\r"]
    lines += [f"Line number {k} of the pool, long" for k in range(30)] + [f"ÜBER line {k} with marks ñ" for k in range(10)]
    texts = ["\n".join(rng.choices(lines, k=rng.choice([1, 2, 5, 40]))) for _ in range(80)] + [None, "", "\n", "\n\n", "a line that many share\n" * 300]
    rows = list(enumerate(texts))
    return rows + [rows[3], (rows[4][0], "A line that many share\nother"), (None, texts[7]), (None, texts[8])]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "s", 9) for d, t in rows], "doc_id long, text string, n_lines string, extra int")
    out = line_runs.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=repr) == slow(rows)


def test_hot_and_cold_keys_agree(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1, 10**9):  # hardly any key is hot, all are
        monkeypatch.setattr(line_runs, "HOT_SHARE", share)
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in line_runs.dedup_lines(docs).collect()]
        assert sorted(got, key=repr) == slow(rows)


def test_batches_and_levels(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").filter("doc_id is not null").dropDuplicates(["doc_id"])
    lines = line_runs.hashed_lines(docs).cache()
    parts = line_runs.in_batches(lines, 5)
    assert len(parts) == 5 and sum(p.count() for p in parts) == lines.count()
    ends = [tuple(p.agg(F.min("__d"), F.max("__d")).first()) for p in parts if not p.isEmpty()]
    assert all(low > high for (low, _), (_, high) in zip(ends, ends[1:], strict=False))
    runs = line_runs.LineRuns(spark, fanout=2)
    for p in parts:
        runs.add(p)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    whole = line_runs.LineRuns(spark)
    whole.add(lines)
    # the keeper that the anti-joins found is the largest document of all, the counts are those of all
    assert sorted(map(tuple, runs.merged().collect())) == sorted(map(tuple, whole.merged().collect()))
    keys = line_runs.line_keys(lines)
    assert runs.fresh(keys).filter("fresh").isEmpty()
    new = line_runs.hashed_lines(spark.createDataFrame([(1, "a line nobody has seen so far\nshort")], "doc_id long, text string"))
    assert runs.fresh(line_runs.line_keys(new)).filter("fresh").count() == 1
    runs.remove(), whole.remove()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_runs_are_joined_without_shuffle_or_sort(spark):
    lines = line_runs.hashed_lines(spark.createDataFrame([(k, f"some line that is number {k}") for k in range(50)], "doc_id long, text string"))
    runs = line_runs.LineRuns(spark, fanout=9)
    for k in range(2):
        runs.add(lines.filter(f"__d % 2 = {k}"))
    one, two = (spark.table(t) for t in runs.tables())
    with line_runs.session_conf(spark, **line_runs.SORTED_SCANS):
        plan = one.join(two.hint("merge"), ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.remove()


def test_very_long_text(spark):
    rows = [(1, "\n".join(f"long text with line number {k}" for k in range(60_000))), (2, "x" * 3_000_000), (3, "x" * 3_000_000), (4, "X" * 3_000_000 + "\nend")]
    rows += [(5, "long text with line number 7"), (6, "Long text with line number 7 ")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_runs.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (60_000, 1), 2: (1, 1), 3: (1, 1), 4: (2, 0), 5: (1, 1), 6: (1, 0)}


def test_empty_table(spark):
    assert line_runs.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
