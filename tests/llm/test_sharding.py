import zlib
from collections import defaultdict

from onoma.llm import sharding


def check(rows, got, n):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (d is None, d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
    )
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in range(n)]
    most = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * most
    for s in by:
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s]))) and 0 <= s < n
    line = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [r["doc_id"] for r in line if r["doc_id"] is not None]
    assert ids == sorted(ids)  # contiguous


def test_balance_order_and_slots(spark):
    rows = [(k * 7 % 1000, "é" * (k % 50)) for k in range(1000)] + [(None, None)] * 40 + [(5, "hot")] * 500 + [(3, "x" * 4000), (9, "")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, shard string").repartition(7)
    check(rows, sharding.shard_by_bytes(docs, 40, n_ranges=6).collect(), 40)
    check(rows, sharding.shard_by_bytes(docs, 3, n_ranges=11, keep=("text",)).collect(), 3)


def test_few_rows_and_none(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r["slot"] for r in sharding.shard_by_bytes(docs, 40).collect()) == [0, 0]
    assert sharding.shard_by_bytes(docs.limit(0), 40).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op2_sharding(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {(r["law"], r["grown_shard"]) for r in out.collect()} == {("bytes", None)}
