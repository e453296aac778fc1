"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches, those with the largest ids first. A batch is boiled down to its distinct
line keys (128-bit hashes), merge-anti-joined with the runs so far to tell fresh keys from known ones,
and added as a run of its own, sorted by key and stored in the shared folder. Runs wait in levels;
``fanout`` runs of one level are merged into one run of the next. At last lines are joined with the
single run that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import (
    MIN_LONG, ascii_lower, checkpointed, read_table, remove_folder, session_conf, shared_folder, shuffle_partitions,
)

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
#: A key held by at least this share of all (key, document) rows is hot; there are 2000 at most.
HOT_SHARE = 2000
#: A bucket of a run is one sorted file, so a scan may be taken as sorted; and never coalesced away.
SORTED_SCANS = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true", "spark__sql__sources__bucketing__autoBucketedScan__enabled": "false"}


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__d, __t, pos, h1, h2) of every line whose key is long enough."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(MIN_LONG)).alias("__d"),
        F.xxhash64(text).alias("__t"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    keyed = lines.select("__d", "__t", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "__d", "__t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def line_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, max_doc): a row per key, documents counted once."""
    pairs = lines.select("h1", "h2", "__d").distinct()
    return pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("__d").alias("max_doc"))


class LineRuns:
    """The levelled runs: tables of (h1, h2, n_docs, keeper) in buckets of the key, sorted inside each.

    ``add`` takes batches with the largest ids first. A batch's keys are merge-anti-joined with the runs:
    a key that no run holds is fresh, and the largest document that has it in this batch keeps the line
    for good; a key that is held only adds to the count. All runs lie in the same buckets and order, so
    joins with them and merges of them neither shuffle nor sort them.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.folder = shared_folder(spark, "line-runs")
        self.name = "line_runs_" + uuid.uuid4().hex
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, run: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        with session_conf(self.spark, **SORTED_SCANS):
            out = run.select("h1", "h2", "n_docs", "keeper").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            out.option("path", f"{self.folder}/{table}").saveAsTable(table)
        return table

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            remove_folder(self.spark, f"{self.folder}/{t}")

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """``keys`` plus ``fresh``: whether no run holds the key. A merge join with every run."""
        out = keys.withColumn("fresh", F.lit(True))
        for t in self.tables():
            run = self.spark.table(t).select("h1", "h2", F.lit(True).alias("__held")).hint("merge")
            out = out.join(run, ["h1", "h2"], "left").select(*keys.columns, (F.col("fresh") & F.col("__held").isNull()).alias("fresh"))
        return out

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h1, h2, __d) whose ids are all smaller than those of the batches before."""
        found = self.fresh(line_keys(lines)).withColumn("keeper", F.when(F.col("fresh"), F.col("max_doc")))
        self._place(self._write(found), 0)

    def _place(self, table: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            several, self.levels[level] = self.levels[level], []
            self._place(self._compacted(several), level + 1)

    def _compacted(self, tables: list[str]) -> str:
        """Several runs as one: counts add up, and one of them at most knows the keeper."""
        if len(tables) == 1:
            return tables[0]
        out = self.spark.table(tables[0])
        for t in tables[1:]:
            other = self.spark.table(t).select("h1", "h2", F.col("n_docs").alias("__n"), F.col("keeper").alias("__k")).hint("merge")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("__n", F.lit(0))
            out = out.join(other, ["h1", "h2"], "full").select("h1", "h2", total.alias("n_docs"), F.coalesce("keeper", "__k").alias("keeper"))
        done = self._write(out)
        self._drop(tables)
        return done

    def merged(self) -> DataFrame:
        """All runs as one: a row per line key."""
        if self.tables():
            self.levels = [[self._compacted(self.tables())]]
        return self.spark.table(self.tables()[0])

    def remove(self) -> None:
        self._drop(self.tables())
        self.levels = []
        remove_folder(self.spark, self.folder)

    def repeated(self, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """(__d, __t, __drop): the sorted positions of the lines that each document loses, checkpointed."""
        runs = self.merged()
        hot_from = (runs.agg(F.sum("n_docs")).first()[0] or 0) / HOT_SHARE
        drop = runs.filter(F.col("n_docs") >= min_docs)
        hot = drop.filter(F.col("n_docs") >= hot_from).select("h1", "h2", F.col("keeper").alias("hot_keeper"))
        cold = drop.filter(F.col("n_docs") < hot_from).select("h1", "h2", "keeper")
        # Hot keys number HOT_SHARE at most, so this broadcast is bounded; their rows are then dealt out
        # by document instead of by key, and meet no cold key because a stray hash is in no run.
        marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
        is_hot = F.col("hot_keeper").isNotNull()
        spread = marked.withColumn("h1", F.when(is_hot, F.xxhash64("__d", "__t", "pos")).otherwise(F.col("h1")))
        joined = spread.join(cold.hint("merge"), ["h1", "h2"], "left")
        found = joined.filter(F.col("__d") < F.coalesce("hot_keeper", "keeper"))
        with session_conf(self.spark, **SORTED_SCANS):
            return checkpointed(found.groupBy("__d", "__t").agg(F.array_sort(F.collect_set("pos")).alias("__drop")))


def in_batches(lines: DataFrame, batches: int) -> list[DataFrame]:
    """``lines`` cut by document id into parts of about one size, the largest ids first."""
    shares = [k / batches for k in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("__d", shares).alias("c")).first()["c"] if shares else None
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    d = F.col("__d")
    parts = []
    for high, low in zip(edges, edges[1:], strict=False):
        inside = F.lit(True) if low is None else d > low
        parts.append(lines.filter(inside if high is None else inside & (d <= high)))
    return parts


def dedup_lines(
    docs: DataFrame,
    *,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents hold, save in the one with the largest id.

    Returns all columns of ``docs`` with ``text`` cut down, plus ``n_lines`` and ``n_dropped``. The texts
    are read twice: once for their lines' hashes, which are written to the shared folder until the
    positions of repeated lines are known, and once to be cut.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys shorter than
    ``min_chars`` code points never count. Null text is one empty line. Rows with one ``doc_id``
    (null ids together, as the smallest) are one document: they count once and keep their lines
    together. A key twice in its document goes or stays twice. An empty table gives no rows; extra
    columns pass through (``n_lines``/``n_dropped`` of the input are replaced, ``__`` is reserved).
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "lines")
    hashed_lines(docs, min_chars).write.parquet(folder)
    lines = spark.read.parquet(folder)
    runs = LineRuns(spark, fanout)
    try:
        for part in in_batches(lines, batches):
            runs.add(part)
        dropped = runs.repeated(lines, min_docs)
    finally:
        runs.remove()
        remove_folder(spark, folder)
    return _apply(docs, dropped)


def _apply(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(
        *rest, F.coalesce(F.col("doc_id"), F.lit(MIN_LONG)).alias("__d"), F.xxhash64(text).alias("__t")
    )
    joined = left.join(dropped.hint("shuffle_hash"), ["__d", "__t"], "left")
    # __lines is used several times below, so the optimiser keeps it as a column and splits each text once
    split = joined.select(*rest, "__drop", F.split(text, "\n", -1).alias("__lines"))
    n_lines = F.size("__lines")
    kept = F.zip_with(
        F.concat(F.array(F.lit(-1)), "__drop"),
        F.concat("__drop", F.array(n_lines)),
        lambda a, b: F.slice(F.col("__lines"), a + 2, b - a - 1),
    )
    cut = split.select(
        *rest,
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(F.flatten(kept), "\n")).alias("__kept"),
    )
    return cut.select(*[F.col("__kept").alias("text") if c == "text" else c for c in rest], "n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id < g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""
