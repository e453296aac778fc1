"""Helpers that every training-data operator shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MIN_LONG = -(2**63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; where none is named, make one if everything runs on this machine.

    Checkpoints go when nothing refers to their rows any more.
    """
    sc = spark.sparkContext
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="onoma-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path inside the shared one; ``remove_folder`` takes it away."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def session_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (dots written as __) for what is planned and run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Removes an execution's shuffle files when it ends; a checkpoint has made them useless by then.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs nothing."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII strings take the fast built-in, which agrees there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(mod))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stable_int(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def shielded(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with its own columns of these names out of an operator's way; ``restored`` brings them back."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in names})


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"__own_{c}").alias(c) if f"__own_{c}" in df.columns else F.col(c) for c in columns])
