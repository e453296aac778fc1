"""The corpus pipeline: five stages from raw documents to tokens.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm import bpe, decontaminate, jaccard_join, language_id, line_runs
from onoma.llm.common import checkpointed, read_table, remove_folder, restored, shared_folder, shielded

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
NEAR_WORDS = 5
NEAR_THRESHOLD = (80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go. A missing ``lang`` is filled in.

    Profiles are learned once, from all documents that name a language. If none does, all stay.
    """
    profiles = checkpointed(language_id.learn_profiles(docs))
    if profiles.isEmpty():
        return docs
    found = language_id.identify(shielded(docs, ("lang_pred", "score")), profiles)
    told = found.filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return restored(told.withColumn("lang", F.coalesce("lang", "lang_pred")), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one; ``n_chars`` follows the text."""
    cut = restored(line_runs.dedup_lines(shielded(docs, ("n_lines", "n_dropped"))), docs.columns)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Documents without words are in no group and stay.
    """
    rows = jaccard_join.jaccard_components(docs, words=NEAR_WORDS, threshold=NEAR_THRESHOLD)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    chosen = rows.filter("root is not null").groupBy("root").agg(best.alias("k")).select("k.doc_id", "k.th")
    alone = rows.filter("root is null").select("doc_id", "th").distinct()
    copies = rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("__copies"))
    null_safe = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    kept = chosen.withColumn("__word", F.lit(True)).unionByName(alone.withColumn("__word", F.lit(False)))
    kept = kept.join(copies, null_safe(kept, copies)).select(kept["doc_id"], kept["th"], "__word", "__copies")
    kept = kept.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), (F.col("__word") & (F.col("__copies") > 1)).alias("__many"))
    marked = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = marked.join(kept.hint("shuffle_hash"), marked["doc_id"].eqNullSafe(kept["__d"]) & (marked["__th"] == kept["__t"]))
    once = joined.filter(~F.col("__many")).select(*docs.columns)
    # equal rows of one id: the same id and text more than once
    many = joined.filter("__many").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(many)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every whole text."""
    return bpe.round_trip_digests(docs, keep_ids=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", leaks),
    ("bpe", tokens),
]

#: The tokens of the last stage have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder and removed once read."""
    base = shared_folder(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
