"""Matchers over a stream of pairs. An extension: the matchers look at one pair at a time, so no state is kept.

Sides are made row by row instead of from distinct names, which would need state; scores are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from onoma.operators.features import FEATURES, features
from onoma.operators.matchers import matcher_scores, with_components, with_side
from onoma.operators.model import LogisticModel


def score_stream(pairs: DataFrame, model: LogisticModel | None = None, name_a: str = "name_a", name_b: str = "name_b") -> DataFrame:
    """All columns of ``pairs`` (a stream or a table) plus the matchers' scores, and ``learned`` with a model."""
    df = with_components(with_side(with_side(pairs, name_a, "a"), name_b, "b"))
    if model is None:
        return df.select(*pairs.columns, *matcher_scores())
    wide = df.select(*pairs.columns, "k_undecidable", "k_empty", *matcher_scores(), *features())
    p = model.probability([F.col(f"f_{f}") for f in FEATURES])
    learned = F.when(F.col("k_undecidable"), 0.5).when(F.col("k_empty"), 0.0).otherwise(p)
    return wide.withColumn("learned", learned).drop("k_undecidable", "k_empty", *[f"f_{f}" for f in FEATURES])


def write_scores(scored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append scores to Parquet files exactly once, by the stream's own checkpoint."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
