"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import checkpointed


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint without the size that Spark estimates: joins multiply it, so its digits double in every round."""
    done = checkpointed(df)._jdf
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each node's component, for all nodes that have a link.

    Every root hooks to its smallest neighbour, if that is smaller; the trees are flattened by pointer
    doubling, links are lifted to the roots, and so on until no link is left. A root that nothing hooked
    to had only neighbours that went to a smaller root, and so goes in the next round: whatever the
    labels are, two rounds halve the roots at least. Rounds are cut apart by checkpoints.
    """
    links = links.filter(F.col(a) != F.col(b))
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(
        links.select(F.col(b).alias("node"), F.col(a).alias("other"))
    )
    edges = _cut(both.distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        roots = _flattened(_cut(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label"))))
        if labels is None:
            labels = roots
        else:
            lifted = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
            labels = _cut(lifted.select("node", F.coalesce("root", "label").alias("label")))
        ends = edges.join(roots, "node").select(F.col("label").alias("from"), "other")
        ends = ends.join(roots.withColumnsRenamed({"node": "other", "label": "to"}), "other")
        edges = _cut(ends.filter("from <> to").select(F.col("from").alias("node"), F.col("to").alias("other")).distinct())
    return labels


def _flattened(parents: DataFrame) -> DataFrame:
    """(node, label) with every label its tree's root: chains of any length, in the log of it."""
    while True:
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = _cut(parents.join(above, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
        parents = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return parents
