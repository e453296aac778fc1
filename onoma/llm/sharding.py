"""Contiguous, byte-balanced shards from global prefix sums.

Rows are put in id order by a range partitioning. Each range reports its total bytes and rows; the
totals (one row per range) are prefix-summed and handed back, so that every row learns the bytes and
rows before it without any task seeing more than one range. The line of all bytes is then cut at
equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from onoma.llm.common import checkpointed, shuffle_partitions

ROW_BYTES = 16
SALTS = 64


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_bytes: int = ROW_BYTES,
    keep: tuple[str, ...] = (),
    n_ranges: int | None = None,
) -> DataFrame:
    """Give every row its ``shard`` and its ``slot`` in that shard.

    Returns the id, ``size`` (UTF-8 bytes of the text plus ``row_bytes``), ``text_crc32``, ``shard``,
    ``slot`` and the columns named in ``keep``. A row belongs to the shard in which its middle byte
    lies, so a shard's bytes differ from the target by at most one row's size.

    Null text: no bytes, CRC of the empty text. Null ids sort first. Equal ids and equal rows are
    told apart by size, CRC and a spreading salt, so a hot id does not fill one range; rows equal
    in all of these are interchangeable. An empty table gives no rows. Columns of other names are
    ignored unless kept; names that start with ``__`` are reserved.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(text).cast("long") + F.lit(row_bytes)).alias("__size"),
        F.crc32(text).alias("__crc"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt"),
        *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )
    order = ["__id", "__size", "__crc", "__salt"]
    ranged = slim.repartitionByRange(n_ranges or shuffle_partitions(spark), *order)
    ranged = checkpointed(ranged.withColumn("__range", F.spark_partition_id()))

    totals = ranged.groupBy("__range").agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("__range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "__range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("__bytes0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__rows0"),
        F.sum("bytes").over(every).alias("__total"),
    )
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    middle2 = 2 * (F.col("__bytes0") + F.col("__upto")) - F.col("__size")
    placed = (
        ranged.withColumn("__upto", F.sum("__size").over(inside))
        .withColumn("__nth", F.count(F.lit(1)).over(inside))
        # one row per range, whatever the size of the table
        .join(F.broadcast(offsets), "__range")
        .withColumn("shard", F.expr(f"{n_shards}") * middle2)
        .withColumn("shard", F.expr("shard div (2 * __total)"))
        .withColumn("shard", F.least(F.col("shard"), F.lit(n_shards - 1)).cast("int"))
        .withColumn("__global", F.col("__rows0") + F.col("__nth") - 1)
    )
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("__global").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        "shard",
        (F.col("__global") - F.col("__first")).alias("slot"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    from onoma.llm.common import read_table

    return shard_by_bytes(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
